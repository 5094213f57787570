"""Command line: list, run or explain registered queries.

    python -m logscope list
    python -m logscope run top_endpoints --sf /root/testdata/sf0.01 -n 20
    python -m logscope run statistics --sf /root/testdata/sf0.01 --out /path/stats --format json
    python -m logscope explain filter_page --sf /root/testdata/sf0.01 --materialized /path/requests
    python -m logscope materialize --sf /root/testdata/sf0.01 --out /path/requests
    python -m logscope materialize --parsed --sf /root/testdata/sf0.01 --out /path/parsed
    python -m logscope run distinct_per_column --parsed --materialized /path/parsed
"""

from __future__ import annotations

import argparse

from logscope.plans import catalog
from logscope.session import build_session
from logscope.sources.sinks import materialize_parsed, materialize_requests, read_requests, write_result


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="logscope")
    ap.add_argument("command", choices=["list", "run", "explain", "materialize"])
    ap.add_argument("name", nargs="?")
    ap.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with the driver tables")
    ap.add_argument("--master", default=None, help="e.g. local[8]; default: from spark-submit")
    ap.add_argument("--materialized", default=None, help="serve R from this parquet table")
    ap.add_argument("--parsed", action="store_true",
                    help="'materialize' writes (and --materialized reads) the parsed table")
    ap.add_argument("--out", default=None, help="output folder for 'materialize', or for 'run' results")
    ap.add_argument("--format", default="json", help="result format for 'run --out' (json, parquet, csv)")
    ap.add_argument("-n", type=int, default=20, help="rows to show")
    a = ap.parse_args(argv)
    if a.command == "list":
        for name in catalog.QUERIES:
            print(name, "(oracle)" if name in catalog.ORACLE else "")
        return
    spark = build_session(a.master)
    if a.command == "materialize":
        if a.parsed:
            materialize_parsed(catalog.parsed(spark, a.sf), a.out)
        else:
            materialize_requests(catalog.R(spark, a.sf), a.out)
        return
    if a.materialized:
        table = read_requests(spark, a.materialized)
        if a.parsed:
            catalog.use_materialized_parsed(spark, a.sf, table)
        else:
            catalog.use_materialized(spark, a.sf, table)
    df = catalog.QUERIES[a.name](spark, a.sf)
    if a.command == "explain":
        df.explain(mode="formatted")
    elif a.out:
        write_result(df, a.out, a.format)
    else:
        df.show(a.n, truncate=False)


if __name__ == "__main__":
    main()
