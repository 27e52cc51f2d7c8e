import re
from collections import Counter, defaultdict
from math import sqrt

import pytest

from schemaloom.llm import url_filter as uf

RULES = [uf.Rule.of(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
PAGES = [
    (1, "http://a.Example.NET/en/x?y#z", 5, "h"), (2, "https://net/", 5, None), (3, "https://x.net", 5, "h"), (4, "https://x.net?/", 5, "h"),
    (5, None, 5, "h"), (6, "no scheme/en/", 5, "h"), (7, "https://notexample.com/de/", 5, "h"), (8, "HTTPS://EXAMPLE.com/de/", 5, "h"),
    (9, "https://example.com/de", 5, "h"), (10, "x://org/fr/://net/", 5, "h"), (10, "x://org/fr/://net/", 5, "h"), (None, "http://b.org/fr/#", 5, "h"),
    (12, "http://www.a.co.uk/", 5, "h"), (13, "http://b.a.co.uk:80/", 5, "h"), (14, "http://u@10.0.0.1/", 5, "h"), (15, "://", 5, "h"),
    (16, "http://ÄB.org/FR/", 5, "h"), (17, "http://b.org\n/fr/", 5, "h"), (18, "http://" + "long." * 5_000 + "com/" + "p" * 50_000, 5, "h"),
]


def parsed(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), path


def ruled(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def names(host):
    bare = re.sub(r"^.*@|:\d*$", "", host)
    x = bare.split(".")
    if x[-1].isdigit():
        return bare, bare
    m = 2 if ".".join(x[-2:]) in uf.TWO_LABELS else 1
    return ".".join(x[-m - 1 :]), ".".join(x[-m:])


def shrunk(units):
    """{unit: (n, k, base)} to {unit: (weight, rate)}"""
    more = sum((k - n * b) ** 2 - n * b * (1 - b) for n, k, b in units.values())
    pairs = sum(n * (n - 1) * b * (1 - b) for n, k, b in units.values())
    rho = min(uf.MOST_RHO, max(uf.LEAST_RHO, more / pairs)) if pairs else uf.UNKNOWN_RHO
    w = 1 / rho - 1
    return {u: (w, (k + w * b) / (n + w)) for u, (n, k, b) in units.items()}


def rated(pages, outcomes):
    bad = {}
    for i, b in outcomes:
        if i is not None:
            bad[i] = max((x for x in (bad.get(i), b) if x is not None), default=None)
    n, k = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
    tops = {}
    for i, url in pages:
        host = parsed(url)[0]
        domain, suffix = tops[host] = names(host)
        b = bad.get(i)
        for level, unit in enumerate((host, (domain, suffix), suffix)):
            n[unit, level][0] += b is not None
            k[unit, level][0] += bool(b)
    pick = lambda level, base: {u: (n[u, lv][0], k[u, lv][0], base(u)) for u, lv in list(n) if lv == level}
    total = pick(2, lambda u: 0).values()
    m0 = (sum(x[1] for x in total) + 0.5) / (sum(x[0] for x in total) + 1)
    suffixes = shrunk(pick(2, lambda u: m0))
    domains = shrunk(pick(1, lambda u: suffixes[u[1]][1]))
    hosts = shrunk(pick(0, lambda u: domains[tops[u]][1]))
    return {h: (n[h, 0][0], k[h, 0][0], r, r - uf.BOUND * sqrt(r * (1 - r) / (n[h, 0][0] + w + 1))) for h, (w, r) in hosts.items()}


def told(spark, pages):
    """Hosts that differ a lot, with nulls, repeats and ids of no page."""
    rows = [(i, parsed(u)[0].startswith(("a", "tion", "m.")) if i % 7 else None) for i, u in pages if i is not None]
    return spark.createDataFrame([*rows, *rows[:3], (None, True), (10**9, True)], "page_id long, bad boolean")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, id int, host string")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_reputation(spark, pages, given):
    for df in (pages, given):
        rows = [(r.page_id, r.url) for r in df.select("page_id", "url").collect()]
        outcomes = told(spark, rows)
        expected = rated(rows, outcomes.collect())
        got = uf.reputation(df, outcomes).collect()
        assert Counter(r.host for r in got) == Counter(list(expected))
        for r in got:
            assert (r.domain, r.suffix) == names(r.host)
            assert (r.n, r.k, r.rate, r.lower) == pytest.approx(expected[r.host], rel=1e-6)


def test_judged(spark, pages, given):
    for df in (pages, given):
        rows = [(r.page_id, r.url) for r in df.select("page_id", "url").collect()]
        outcomes = told(spark, rows)
        lower = {h: x[3] for h, x in rated(rows, outcomes.collect()).items()}
        expected = Counter()
        for i, url in rows:
            host, path = parsed(url)
            r = ruled(host, path)
            own = "block" if lower[host] > 0.3 else "allow"
            expected[i, host, path, r and r.host + r.path, r.verdict if r else own] += 1
        got = Counter(map(tuple, uf.judged(df, outcomes, RULES, limit=0.3).collect()))
        assert got == expected
    assert {x[4] for x in got if x[3] is None} == {"allow", "block"}


def test_without_rules_outcomes_or_pages(spark, pages):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = uf.judged(pages, none, []).collect()
    assert len(got) == len(PAGES) and {(r.rule, r.verdict) for r in got} == {(None, "allow")}
    assert uf.judged(pages.limit(0), none, RULES).count() == 0


def test_longest_rule_then_longest_host(spark):
    rules = [uf.Rule.of(*r) for r in (("allow", "b/xy"), ("block", "a.b/"), ("allow", "c/d"), ("block", "c/d"))]
    rows = spark.createDataFrame([("a.b", "/xy"), ("c", "/d"), ("c", "/")], "host string, path string")
    got = rows.select(uf.rule_of(rows.host, rows.path, rules).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("a.b/", "block"), ("c/d", "block"), (None, None)]
