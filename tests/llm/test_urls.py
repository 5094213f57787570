import random

import numpy as np
import pytest

from logscope.llm import urls

SCHEMA = "verdict string, host string, path string"


def brute(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    won = max(fits, default=None)
    return host, path, won and won[3], won[2] if won else "allow"


URLS = ["http://A.Example.ORG/es/1?q#f", "https://org/", "http://x.org", "nothing", "", None, "a://b://c.org/x", "http://notorg/",
        "http://example.org/en/1", "http://example.org/en/", "ftp://com/de/x#y", "http://x.com/fr/?", "http://.org/a", "http://a..com/de/",
        "http://www.example.org:80/es/", "http://" + "a." * 20000 + "org/es/", "http://example.org/" + "x" * 100000, "http://org?x/es/"]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(spark, pages, rules, parts=1):
    df = spark.createDataFrame(pages, "page_id long, url string, host int, rule string")
    table = spark.createDataFrame(rules, SCHEMA)
    return [tuple(r) for r in urls.judge(df, urls.build(df, table, parts=parts)).collect()]


@pytest.mark.parametrize("parts", [1, 3])
def test_verdicts_equal_brute_force(spark, parts):
    pages = [(i, u, 1, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], 1, "x"), (0, URLS[0], 1, "x")]
    assert sorted(judged(spark, pages, RULES, parts), key=str) == sorted([(i, *brute(u, RULES)) for i, u, _, _ in pages], key=str)


def test_many_rules_and_ties(spark):
    rng = random.Random(1)
    names = [f"h{i}.net" for i in range(60)]
    rules = list({(rng.choice(["allow", "block"]), h, rng.choice(["/", "/a", "/a/b", ""])) for h in names for _ in range(2)})
    rules += [("block", "net", "/a/b/c/d"), ("allow", "both.net", "/"), ("block", "both.net", "/")]
    pages = [(i, f"http://{rng.choice(['', 'w.'])}h{rng.randint(0, 99)}.net{rng.choice(['', '/', '/a', '/a/b/c/d'])}", 1, "x") for i in range(1500)]
    pages += [(9999, "http://both.net/x", 1, "x")]
    assert sorted(judged(spark, pages, rules)) == sorted((i, *brute(u, rules)) for i, u, _, _ in pages)


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30000).select(*urls.hashes(urls.F.col("id")), "id")
    listed = keys.where("id % 7 = 0")
    one = urls.cascade(listed, keys)
    rows = keys.toPandas()
    assert len(one.levels) > 2
    assert (one.lists(rows["h1"].to_numpy(), rows["h2"].to_numpy()) == (rows["id"] % 7 == 0)).all()
    assert [x.bits for x in one.levels[2:]] < [x.bits for x in one.levels[:-2]]


def test_size_is_checked(spark):
    keys = spark.range(1000).select(*urls.hashes(urls.F.col("id")))
    with pytest.raises(ValueError):
        urls.cascade(keys, keys, max_bytes=64)
    assert not urls.cascade(keys.limit(0), keys).lists(np.array([1]), np.array([2])).any()


def test_no_rules_and_empty_tables(spark):
    assert judged(spark, [(1, "http://a.org/", 1, "x")], []) == [(1, "a.org", "/", None, "allow")]
    assert judged(spark, [(1, "http://a.org/", 1, "x")], [(None, "org", "/"), ("block", None, "/")]) == [(1, "a.org", "/", None, "allow")]
    assert judged(spark, [], RULES) == []
