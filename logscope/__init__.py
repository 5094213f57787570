"""logscope: Spark-native analytics over HTTP access logs in Common Log Format.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from native
Spark expressions; nothing is collected to the driver except small,
size-bounded results (models, top-k lists) where noted.
"""

from logscope.operators.parse import parse_log, requests_table, with_time  # noqa: F401
from logscope.operators.service import Dashboard, LogService  # noqa: F401
from logscope.session import build_session  # noqa: F401
from logscope.sources.logs import read_log_text  # noqa: F401
from logscope.sources.sinks import materialize_requests, read_requests, write_result  # noqa: F401

__all__ = ["Dashboard", "LogService", "build_session", "materialize_requests", "parse_log",
           "read_log_text", "read_requests", "requests_table", "with_time", "write_result"]
