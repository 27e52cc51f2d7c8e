import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from schemaloom.llm import mixing


def shared_out(sizes, weights, limit):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        extra = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += extra[s]
            if out[s] >= limit * sizes[s]:
                left += out[s] - limit * sizes[s]
                out[s] = float(limit * sizes[s])
                open_.discard(s)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("weights, limit", [((5, 2, 1), 3), ((1, 100), 2), ((1,), 1), ((1, 50, 1), 3)])
@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_mixture(docs, sample, weights, limit, buckets):
    for df in (docs, sample):
        rows, got = df.collect(), mixing.mixture(df, weights, limit, buckets=buckets).collect()
        assert Counter((r.id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, words(r.text)) for r in rows)
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r.source] += words(r.text)
        targets = shared_out(sizes, weights, limit)
        for r in got:
            assert r.source_size == sizes[r.source]
            assert r.target == pytest.approx(targets[r.source])
            assert 0 <= r.taken <= limit * r.size
            taken[r.source] += r.taken
        for s, target in targets.items():
            assert abs(taken[s] - target) < 1 + 1e-6


def test_mixture_agrees_with_itself(sample):
    one = mixing.mixture(sample).collect()
    other = mixing.mixture(sample.repartition(5, "lang"), buckets=16).collect()
    assert Counter(one) == Counter(other)


def test_mixture_runs_without_python(sample):
    for df in (mixing.mixture(sample), mixing.mixed(sample)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_mixed_rows(docs, sample, no_docs):
    for df in (docs, sample):
        plan = mixing.mixture(df)
        times = plan.select("id", "source", (F.ceil(F.col("taken") / F.col("size"))).alias("n")).where("size > 0").collect()
        expected = Counter()
        for r in times:
            if r.n:
                expected[(r.id, r.source)] += r.n
        got = mixing.mixed(df)
        assert got.columns == df.columns
        assert Counter((r.doc_id, r.source) for r in got.collect()) == expected
    assert mixing.mixed(no_docs).count() == 0
    assert mixing.mixture(no_docs).count() == 0


def test_rows_that_differ_in_one_column_stay_apart(spark):
    rows = [(1, "one two", "s", "en"), (1, "one two", "s", "de"), (1, "one two", "s", None), (1, "one two", "s", "en"), (2, "x", "t", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = Counter(map(tuple, mixing.mixed(df).collect()))
    words_of = mixing.mixture(df).groupBy("source").agg({"taken": "sum"}).collect()
    assert {r.source for r in words_of} == {"s", "t"}
    assert set(got) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in got.items())
    # All of source s is taken about as often, whatever the language.
    assert {r[3] for r in got if r[0] == 1} == {"en", "de", None}


def test_wrong_weights(docs):
    with pytest.raises(ValueError):
        mixing.mixture(docs, weights=(1, 0))
