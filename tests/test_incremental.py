"""Incremental loads: every line once, other dates untouched."""

import os
import time

import pytest

from logscope.operators.parse import requests_table
from logscope.sources import incremental as IN


def line(day, i):
    return f'h{i}.example.com - - [{day:02d}/Jul/1995:10:00:{i % 60:02d} -0400] "GET /p{i} HTTP/1.0" 200 {i}'


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")
            and IN.MANIFEST not in d}


def content(spark, path):
    return sorted((r["host"], r["endpoint"]) for r in IN.read_loaded(spark, path).collect())


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "logs"), str(tmp_path / "table")


def test_overlapping_loads_give_each_line_once(spark, place):
    logs, table = place
    put(logs, "a.log", [line(1, i) for i in range(5)] + [line(2, i) for i in range(5)])
    put(logs, "b.log", [line(2, i) for i in range(5, 9)] + ["no time here"])
    assert IN.ingest(spark, [f"{logs}/a.log"], table) == 1
    assert IN.ingest(spark, [f"{logs}/a.log", f"{logs}/b.log"], table) == 1
    want = sorted((r["host"], r["endpoint"]) for r in requests_table(spark.read.text([f"{logs}/a.log", f"{logs}/b.log"])).collect())
    assert content(spark, table) == want
    before = files_of(table)
    assert IN.ingest(spark, [logs], table) == 0 and files_of(table) == before


def test_late_file_rewrites_only_its_dates(spark, place):
    logs, table = place
    put(logs, "a.log", [line(d, i) for d in (1, 2, 3) for i in range(4)])
    IN.ingest(spark, [logs], table)
    before = files_of(table)
    put(logs, "late.log", [line(2, 77)])
    IN.ingest(spark, [logs], table)
    after = files_of(table)
    for day in ("1995-07-01", "1995-07-03"):
        assert {f: t for f, t in before.items() if day in f} == {f: t for f, t in after.items() if day in f} != {}
    assert len(content(spark, table)) == 13


def test_changed_file_replaces_its_rows(spark, place):
    logs, table = place
    put(logs, "a.log", [line(1, i) for i in range(4)] + [line(2, 9), "no time here"])
    put(logs, "b.log", [line(1, 50)])
    IN.ingest(spark, [logs], table)
    time.sleep(1.1)
    put(logs, "a.log", [line(1, 0), line(3, 3)])  # day 2 has no line any more
    assert IN.ingest(spark, [logs], table) == 1
    assert [e for _, e in content(spark, table)] == ["/p0", "/p3", "/p50"]


def test_load_that_died_before_its_manifest_is_done_again(spark, place):
    logs, table = place
    put(logs, "a.log", [line(1, i) for i in range(3)])
    IN.ingest(spark, [logs], table)
    put(logs, "b.log", [line(1, i) for i in range(3, 6)])
    IN.ingest(spark, [logs], table)
    folder = os.path.join(table, IN.MANIFEST)
    newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part")), key=os.path.getmtime)
    os.remove(newest)
    assert IN.ingest(spark, [logs], table) == 1
    assert len(content(spark, table)) == 6
