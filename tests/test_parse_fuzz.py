"""Seeded fuzz: Spark's parse equals a brute-force Python parse of the
same patterns (``re`` in ASCII mode matches Java's character classes)."""

import datetime as dt
import random
import re

from logscope.functions import patterns as P
from logscope.operators.parse import parse_log, requests_table

FLAGS = re.ASCII


def _group(pattern, line, g):
    m = re.search(pattern, line, FLAGS)
    return m.group(g) if m else ""


def _int32(text):
    if text == "":
        return None
    v = int(text)
    return v if -2**31 <= v < 2**31 else None


def _time(ts):
    if ts == "":
        return None
    months = {m: i for i, m in enumerate(P.MONTHS, start=1)}
    if ts[3:6] not in months:
        return None
    try:
        return dt.datetime(int(ts[7:11]), months[ts[3:6]], int(ts[0:2]),
                           int(ts[12:14]), int(ts[15:17]), int(ts[18:20]))
    except ValueError:
        return None


def brute(line):
    req = [_group(P.REQUEST_PATTERN, line, i) for i in (1, 2, 3)]
    return {"host": _group(P.HOST_PATTERN, line, 1), "timestamp": _group(P.TIMESTAMP_PATTERN, line, 1),
            "method": req[0], "endpoint": req[1], "protocol": req[2],
            "status": _int32(_group(P.STATUS_PATTERN, line, 1)),
            "content_size": _int32(_group(P.CONTENT_SIZE_PATTERN, line, 1))}


def random_line(rnd):
    pick = rnd.choice
    host = pick(["h1.example.com", "localhost", "a.b", "a.bc", "1.2.3.4", "x", "", "big.host.co.uk", "a..b"])
    day = pick(["01", "31", "29", "00", "1", "15"])
    mon = pick(P.MONTHS + ["JAN", "Foo", "12a", "Se"])
    year = pick(["1995", "2024", "95", "0001"])
    hh, mm, ss = pick(["00", "23", "24", "7"]), pick(["00", "59", "60"]), pick(["00", "59", "61"])
    off = pick(["-0400", "+0100", "-04", "0000", ""])
    ts = pick([f"[{day}/{mon}/{year}:{hh}:{mm}:{ss} {off}]", "[bad]", "", f"[{day}/{mon}/{year}:{hh}:{mm}:{ss}]"])
    toks = pick([[], ["GET"], ["GET", "/a"], ["POST", "/a/b.html", "HTTP/1.0"], ["GET", "/x", "y", "z"],
                 ["HEAD", "/404", "HTTP/1.1"], ["G\tT", "/a"]])
    sep = pick([" ", "  ", "\t"])
    req = pick(['"' + sep.join(toks) + '"', sep.join(toks), '"' + " ".join(toks)])
    status = pick(["200", "304", "-", "2000", "20", "404"])
    size = pick(["1234", "-", "0", "99999999999", "2147483647", "2147483648", "12 ", ""])
    parts = [host, "-", "-", ts, req, status, size]
    if rnd.random() < 0.1:
        parts.insert(rnd.randrange(len(parts)), pick(["junk", "\"q\"", "500"]))
    return " ".join(parts) if rnd.random() < 0.95 else pick(["", " ", "\"\"", "a.bc "])


def test_parse_matches_brute_force(lines_df):
    rnd = random.Random(20241203)
    lines = [random_line(rnd) for _ in range(3000)]
    got = parse_log(lines_df(lines)).collect()
    for line, row in zip(lines, got):
        assert row.asDict() == brute(line), line


def test_time_matches_brute_force(lines_df):
    rnd = random.Random(7)
    lines = [random_line(rnd) for _ in range(3000)]
    got = requests_table(lines_df(lines)).collect()
    for line, row in zip(lines, got):
        assert row["time"] == _time(brute(line)["timestamp"]), line
