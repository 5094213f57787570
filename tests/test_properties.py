"""Property tests against numpy: histogram bins, exact median, forecast."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logscope.operators import sizes as SZ


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=-10**6, max_value=10**6), min_size=0, max_size=60),
       bins=st.integers(min_value=1, max_value=20),
       scale=st.sampled_from([1.0, 3.0, 1024.0]))
def test_histogram_equals_numpy(spark, values, bins, scale):
    df = spark.createDataFrame([(v,) for v in values], "content_size int")
    got = SZ.size_histogram(df, bins=bins, scale=scale).collect()
    counts, edges = np.histogram(np.array(values, dtype=float) / scale, bins=bins)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] + [got[-1]["bin_end"]] == edges.tolist()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=-2**31, max_value=2**31 - 1), min_size=1, max_size=60),
       repeat=st.integers(min_value=0, max_value=40))
def test_exact_median_equals_numpy(spark, values, repeat):
    vals = values + [values[0]] * repeat  # a hot value
    df = spark.createDataFrame([(v,) for v in vals], "content_size int")
    got = SZ.exact_median(df, "content_size").collect()[0]["median"]
    assert got == float(np.median(np.array(vals, dtype=np.int64)))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ys=st.lists(st.integers(min_value=0, max_value=5000), min_size=3, max_size=40),
       gaps=st.lists(st.integers(min_value=1, max_value=3), min_size=40, max_size=40),
       periods=st.integers(min_value=1, max_value=10))
def test_forecast_equals_numpy(spark, ys, gaps, periods):
    import datetime as dt

    from logscope.operators import forecast as FC
    d0 = dt.date(2024, 1, 1)
    days, d = [], 0
    for g in gaps[: len(ys)]:
        days.append(d)
        d += g
    hist = spark.createDataFrame([(d0 + dt.timedelta(days=x), y) for x, y in zip(days, ys)], "ds date, y long")
    got = FC.forecast(hist, periods=periods).collect()
    x, y = np.array(days, dtype=float), np.array(ys, dtype=float)
    slope, icpt = np.polyfit(x, y, 1)
    wd = np.array([(d0 + dt.timedelta(days=int(v))).weekday() for v in days])
    resid = y - (icpt + slope * x)
    eff = {w: resid[wd == w].mean() for w in set(wd.tolist())}
    left = resid - np.array([eff[w] for w in wd])
    sigma = left.std(ddof=1) if len(left) > 1 else 0.0
    last = days[-1]
    for i, r in enumerate(got, start=1):
        xi = last + i
        w = (d0 + dt.timedelta(days=xi)).weekday()
        yhat = icpt + slope * xi + eff.get(w, 0.0)
        assert r["ds"] == d0 + dt.timedelta(days=xi)
        assert abs(r["yhat"] - yhat) < 1e-4 * max(1.0, abs(yhat))
        assert abs((r["yhat_upper"] - r["yhat"]) - FC.Z80 * sigma) < 1e-4 * max(1.0, sigma)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.sampled_from(["/a", "/b", "/c", "/d", "/e", "", "/x y"]), min_size=0, max_size=50),
       k=st.integers(min_value=1, max_value=6))
def test_top_k_equals_python(spark, keys, k):
    from collections import Counter

    from logscope.operators import distributions as DS
    df = spark.createDataFrame([(e,) for e in keys], "endpoint string")
    got = [(r["endpoint"], r["count"]) for r in DS.top_endpoints(df, k).collect()]
    want = sorted(Counter(keys).items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(codes=st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=999)), min_size=0, max_size=50))
def test_status_categories_equal_python(spark, codes):
    from collections import Counter

    from logscope.functions import patterns as P
    from logscope.operators import distributions as DS

    def category(s):
        for label, lo, hi in P.STATUS_CATEGORIES:
            if s is not None and lo <= s < hi:
                return label
        return P.STATUS_OTHER
    df = spark.createDataFrame([(c,) for c in codes], "status int")
    got = {r["status_category"]: r["count"] for r in DS.status_distribution(df).collect()}
    assert got == dict(Counter(category(c) for c in codes))


_HOSTS = ["a.bb.com", "c.dd.org", "", "e.ff.net"]
_EPS = ["/a", "/b", "/c", ""]
_METHODS = ["GET", "POST", "HEAD", ""]


@st.composite
def request_rows(draw):
    import datetime as dt
    n = draw(st.integers(min_value=0, max_value=40))
    rows = []
    for _ in range(n):
        t = draw(st.one_of(st.none(), st.integers(min_value=0, max_value=14 * 24 * 3600 - 1)))
        rows.append((draw(st.sampled_from(_HOSTS)), draw(st.sampled_from(_METHODS)), draw(st.sampled_from(_EPS)),
                     "HTTP/1.0", draw(st.one_of(st.none(), st.sampled_from([200, 204, 302, 304, 404, 500]))),
                     draw(st.integers(min_value=0, max_value=10**6)),
                     None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)))
    return rows


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=request_rows())
def test_breakdowns_equal_python(spark, rows):
    import datetime as dt
    from collections import Counter, defaultdict

    from logscope.functions import patterns as P
    from logscope.operators import breakdowns as BD
    from logscope.operators import filters as FL
    from logscope.operators import traffic as TR
    schema = ("host string, method string, endpoint string, protocol string, status int, content_size int, "
              "time timestamp_ntz")
    df = spark.createDataFrame(rows, schema)

    # page filter with NULL status selected
    lo, hi = dt.date(2024, 1, 3), dt.date(2024, 1, 9)
    want = sum(1 for r in rows if r[6] is not None and lo <= r[6].date() <= hi
               and (r[4] in (200, 304) or r[4] is None) and r[1] in ("GET", "HEAD"))
    assert FL.filter_page(df, lo, hi, [200, 304, None], ["GET", "HEAD"]).count() == want

    # hourly class counts (hours with none of the three classes left out)
    cnt = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        h = None if r[6] is None else r[6].hour
        for i, (_, a, b) in enumerate(P.STATUS_CODES):
            if r[4] is not None and a <= r[4] < b:
                cnt[h][i] += 1
    want_h = {h: tuple(v) for h, v in cnt.items() if any(v)}
    got_h = {r["hour"]: (r["count_2xx"], r["count_3xx"], r["count_4xx"])
             for r in BD.hourly_status_counts(df).collect()}
    assert got_h == want_h

    # distinct GET endpoints with 2xx per weekday x hour range (hour 0 dropped)
    ranges = {h: lab for lab, a, b in P.HOUR_RANGES for h in range(a, b + 1)}
    sets = defaultdict(set)
    for r in rows:
        if r[6] is None or r[1] != "GET" or r[4] is None or not (200 <= r[4] < 300) or r[6].hour not in ranges:
            continue
        sets[(P.WEEKDAY_ABBR[r[6].weekday()], ranges[r[6].hour])].add(r[2])
    got_u = {(r["weekday"], r["hour_range"]): r["unique_endpoints"]
             for r in BD.unique_endpoints_by_status(df, 200, 300).collect()}
    assert got_u == {k: len(v) for k, v in sets.items()}

    # weekday traffic
    want_w = Counter(P.WEEKDAY_NAMES[r[6].weekday()] for r in rows if r[6] is not None)
    assert {r["day"]: r["count"] for r in TR.weekday_traffic(df).collect()} == dict(want_w)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=request_rows())
def test_host_features_equal_python(spark, rows):
    import datetime as dt
    import statistics
    from collections import defaultdict

    from logscope.operators import features as FT
    schema = ("host string, method string, endpoint string, protocol string, status int, content_size int, "
              "time timestamp_ntz")
    df = spark.createDataFrame(rows, schema)
    got = {r["host"]: r for r in FT.host_features_derived(df).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    epoch = dt.datetime(1970, 1, 1)
    for h, rs in by.items():
        g = got[h]
        sizes = [r[5] for r in rs]
        times = [r[6] for r in rs if r[6] is not None]
        days = {t.day for t in times}
        assert g["total_requests"] == len(rs)
        assert g["unique_pages"] == len({r[2] for r in rs})
        assert g["active_hours"] == len({t.hour for t in times})
        assert g["active_days"] == len(days)
        assert abs(g["avg_content_size"] - sum(sizes) / len(sizes)) < 1e-6
        if len(sizes) > 1:
            assert abs(g["std_content_size"] - statistics.stdev(sizes)) < 1e-6 * max(1.0, statistics.stdev(sizes))
        else:
            assert g["std_content_size"] is None
        errors = sum(1 for r in rs if r[4] is not None and r[4] >= 400)
        assert g["error_count"] == errors
        assert abs(g["error_rate"] - errors / len(rs)) < 1e-12
        if times:
            avg_ts = sum((t - epoch).total_seconds() for t in times) / len(times)
            assert abs(g["avg_timestamp"] - avg_ts) < 1e-3
            assert abs(g["requests_per_day"] - len(rs) / len(days)) < 1e-12
        else:
            assert g["avg_timestamp"] is None and g["requests_per_day"] is None
