"""Incremental form of the text scan + parse (no streaming in the reference).

The reference only reads whole log files in batch. For logs that keep
arriving, the same parse runs unchanged on a file stream: new files in
the folder become micro-batches, parsed rows are appended to the
date-partitioned parquet table that every batch query reads. No state,
no new operators.
"""

from logscope.streaming.logs import append_parsed_logs, parsed_log_stream  # noqa: F401
