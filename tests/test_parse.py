"""Parser edge cases (FIXTURES section 4) and wall-clock time handling."""

import datetime as dt

import pytest

from logscope.operators.parse import fill_content_size, parse_log, parse_no_match, requests_table, with_instant

EDGE = [
    # line, host, timestamp matched, (method, endpoint, protocol), status, size
    ('199.72.81.55 - - [01/Jul/1995:00:00:01 -0400] "GET /history/apollo/ HTTP/1.0" 200 6245',
     "199.72.81.55", True, ("GET", "/history/apollo/", "HTTP/1.0"), 200, 6245),
    ('unicomp6.unicomp.net - - [01/Jul/1995:00:00:06 -0400] "GET /shuttle/countdown/" 304 -',
     "unicomp6.unicomp.net", True, ("GET", "/shuttle/countdown/", ""), 304, None),
    ('localhost - - [01/Jul/1995:00:00:06 -0400] "GET /x y z HTTP/1.0" 200 10',
     "", True, ("", "", ""), 200, 10),
    ('a.b - - [01/Jul/1995:00:00:06 +0100] "POST /x HTTP/1.0" 200 10',
     "", False, ("POST", "/x", "HTTP/1.0"), 200, 10),
    ('a.bc - - [01/Jul/1995:24:00:06 -0400] "" 404 0', "a.bc", True, ("", "", ""), 404, 0),
    ("", "", False, ("", "", ""), None, None),
    ('x.yy - - [bad] "GET /a 404 HTTP/1.0" 500 5 ', "x.yy", False, ("", "", ""), 404, None),
    ('big.host.com - - [31/Aug/1995:23:59:59 -0400] "GET /b HTTP/1.0" 200 99999999999',
     "big.host.com", True, ("GET", "/b", "HTTP/1.0"), 200, None),
]


def test_edge_lines(lines_df):
    rows = parse_log(lines_df([e[0] for e in EDGE])).collect()
    for r, (line, host, ts_ok, req, status, size) in zip(rows, EDGE):
        assert r["host"] == host, line
        assert (r["timestamp"] != "") == ts_ok, line
        assert (r["method"], r["endpoint"], r["protocol"]) == req, line
        assert r["status"] == status, line
        assert r["content_size"] == size, line


def test_no_null_strings(lines_df):
    rows = parse_log(lines_df([e[0] for e in EDGE])).collect()
    for r in rows:
        for c in ["host", "timestamp", "method", "endpoint", "protocol"]:
            assert r[c] is not None


def test_fill_content_size(lines_df):
    rows = fill_content_size(parse_log(lines_df([e[0] for e in EDGE]))).collect()
    assert [r["content_size"] for r in rows] == [6245, 0, 10, 10, 0, 0, 0, 0]


def test_time_wall_clock_and_bad_values(lines_df):
    lines = [
        'h.example.com - - [01/Jul/1995:00:00:01 -0400] "GET / HTTP/1.0" 200 1',
        'h.example.com - - [01/Jul/1995:24:00:06 -0400] "GET / HTTP/1.0" 200 1',
        'h.example.com - - [31/Feb/1995:10:00:00 -0400] "GET / HTTP/1.0" 200 1',
        'h.example.com - - [01/Foo/1995:10:00:00 -0400] "GET / HTTP/1.0" 200 1',
        'h.example.com - - [] "GET / HTTP/1.0" 200 1',
        'h.example.com - - [31/Aug/1995:23:59:59 -0400] "GET / HTTP/1.0" 200 1',
    ]
    t = [r["time"] for r in requests_table(lines_df(lines)).collect()]
    assert t == [dt.datetime(1995, 7, 1, 0, 0, 1), None, None, None, None, dt.datetime(1995, 8, 31, 23, 59, 59)]


def test_time_independent_of_session_zone(spark, lines_df):
    lines = ['h.example.com - - [12/Mar/1995:02:30:00 -0400] "GET / HTTP/1.0" 200 1',
             'h.example.com - - [01/Jul/1995:13:14:15 -0400] "GET / HTTP/1.0" 200 1']
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = [(r["time"], r["hour"]) for r in requests_table(lines_df(lines)).selectExpr("time", "hour(time) AS hour").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    utc = [(r["time"], r["hour"]) for r in requests_table(lines_df(lines)).selectExpr("time", "hour(time) AS hour").collect()]
    assert ny == utc
    assert utc[1][1] == 13


def test_instant_applies_offset(lines_df):
    line = 'h.example.com - - [01/Jul/1995:00:00:01 -0400] "GET / HTTP/1.0" 200 1'
    r = with_instant(parse_log(lines_df([line]))).collect()[0]
    assert r["time"] == dt.datetime(1995, 7, 1, 0, 0, 1)
    assert r["instant_epoch"] == int(dt.datetime(1995, 7, 1, 4, 0, 1, tzinfo=dt.timezone.utc).timestamp())


def test_no_match_sentinel(lines_df):
    rows = parse_no_match(lines_df(["localhost - - [x] \"GET /a HTTP/1.0\" 200 1", "a.bc junk"])).collect()
    assert rows[0]["host"] == "no match" and rows[0]["method"] == "GET"
    assert rows[1]["host"] == "a.bc" and rows[1]["endpoint"] == "no match"


def test_parse_plan_has_no_python(lines_df):
    plan = requests_table(lines_df(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("n", [1, 2])
def test_multi_file_scan(spark, tmp_path, n):
    """Two files without a final newline are read as separate lines (A2)."""
    from logscope.sources.logs import read_log_text
    p1, p2 = tmp_path / "a.txt", tmp_path / "b.txt"
    p1.write_text("l1\nl2")
    p2.write_text("l3")
    paths = [str(p1), str(p2)][:n]
    got = sorted(r["value"] for r in read_log_text(spark, paths).collect())
    assert got == ["l1", "l2", "l3"][: 2 if n == 1 else 3]


def test_clf_time_text_ignores_session_zone(spark):
    from pyspark.sql import functions as F

    from logscope.functions.parse import clf_time_text
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS ts UNION ALL "
                   "SELECT TIMESTAMP_NTZ '0995-07-01 00:00:05' AS ts")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(clf_time_text("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["10/Mar/2024:02:30:00", "01/Jul/0995:00:00:05"]
    back = df.select(clf_time_text("ts").alias("timestamp")).select(X_time("timestamp")).collect()
    assert [r[0] for r in back] == [r[0] for r in df.collect()]


def X_time(c):
    from logscope.functions.parse import clf_time
    return clf_time(c)
