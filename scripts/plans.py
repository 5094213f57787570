"""Write docs/PLANS.md: final (AQE) formatted plans of headline queries on
the materialised request table.

Usage: python scripts/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logscope.plans import catalog  # noqa: E402
from logscope.session import build_session  # noqa: E402
from logscope.sources.sinks import materialize_requests, read_requests  # noqa: E402

SHOW = ["top_endpoints", "status_distribution", "hourly_status_counts", "status_method_totals",
        "unique_endpoints_4xx", "top5_host_weekday", "filter_page", "avg_daily_requests_per_host",
        "size_histogram", "host_features_derived", "traffic_forecast"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    path = os.path.join(tempfile.mkdtemp(prefix="plans-"), "requests")
    materialize_requests(catalog.R(spark, sf), path)
    catalog.use_materialized(spark, sf, read_requests(spark, path))
    out = ["# Physical plans (final AQE plans, materialised request table)\n",
           "Generated by `scripts/plans.py`; the table is parquet partitioned by `date`.\n"]
    for name in SHOW:
        df = catalog.QUERIES[name](spark, sf)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        text = re.sub(r"file:[^\]\s,]+", "<requests>", buf.getvalue())
        out += [f"\n## {name}\n", "```", text.rstrip(), "```"]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
