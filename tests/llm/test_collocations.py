import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import collocations as co


def pieces(text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, longest=3, least=10, covered=50, first=2000):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for words in pieces(r.text):
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for q, b in found.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    longer[q[i : i + m]] = max(longer[q[i : i + m]], b)
        kept = []
        for p, a in found.items():
            if 100 * longer[p] >= covered * a:
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(kept)[:first], 1)]
    return out


TEXTS = [
    ("A big red dog. a BIG red dog, a big red cat\nthe a big red; big red dog", "en"), ("a a a a a a a\ta a  a", "en"),
    ("a b\x0bc d\x0ce f\x00g  h ÄB äb b!c", None), (None, "en"), ("", "de"), (".,;:!?", "de"), ("x" * 100_000 + " y z", "und"),
    ("x y x y x y x y. x", "und"), ("y x y", ""), ("long " * 30_000 + "end", "fr"),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i // 2, t, lang, "s", i) for i, (t, lang) in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, ids int").repartition(4)


@pytest.mark.parametrize("group", [1, 7, 60, 10**6])
def test_against_all_counts(texts, docs, group):
    for df in (texts, docs):
        for longest, least, first in ((3, 2, 2000), (4, 3, 5), (2, 1, 2000)):
            got = co.collocations(df, longest, least, first=first, group=group).collect()
            assert sorted(map(tuple, got)) == sorted(brute(df.collect(), longest, least, first=first))


def test_groups_keep_to_their_budget(sample):
    """No group gets more leaves than two budgets, though some words occur more often than one."""
    budget = 3_000
    rows = sample.select(F.coalesce("lang", F.lit("und")).alias("part"), "text")
    shards = co.stored(rows.mapInArrow(co._shards, "shard string, part string, n long, words string, counts binary, length long, codes binary, begins binary"), "shards")
    answers = co.dictionary.numbered(shards, 2)
    assert co.dictionary.words(answers).agg(F.max("total")).first()[0] > budget
    both = shards.drop("words", "counts", "n").join(co.dictionary.by_shard(answers), "shard")
    leaves = both.mapInArrow(co._leaves(3, budget), "part string, group long, split boolean, n int, ids array<binary>, counts binary")
    sizes = [r["s"] for r in leaves.groupBy("group").agg(F.sum("n").alias("s")).collect()]
    assert len(sizes) > 10 and max(sizes) <= 2 * budget


def test_words_of():
    texts = pa.array([t or "" for t, _ in TEXTS])
    words, begins = co.words_of(texts)
    flat = [(w, i == 0) for t, _ in TEXTS for p in pieces(t) for i, w in enumerate(p)]
    assert list(zip(words.to_pylist(), begins.tolist())) == flat


def test_nothing_to_count(no_docs, docs):
    assert co.collocations(no_docs).count() == 0
    assert co.collocations(docs.withColumn("text", F.lit(" . ")), least=1).count() == 0
    with pytest.raises(ValueError):
        co.collocations(docs, longest=1)
