import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import shared, toxicity

CALM = "river stone garden morning letter window paper silver carpet lantern".split()


def corpus(n, seed=1):
    pick, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [pick.choice(CALM) + pick.choice(["", "s", "ing", "ed"]) for _ in range(pick.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), "grumpf" + pick.choice(["", "er", "ok", "ist"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(400)
    odd = [(1000, "", "x"), (1001, None, "x"), (1002, "123 !!", "x"), (None, "grumpfer grumpfok", "x"), (0, docs[0][1], "x")]
    return (
        spark.createDataFrame(docs + odd, "doc_id long, text string, score string"),
        spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int"),
    )


def test_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.id is None else str(r.id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
        if r.held_out and r.id is not None and r.id < 1000:
            assert r.predicted == int(r.id % 5 == 0), r
    by_id = {r.id: r.predicted for r in rows}
    assert by_id[None] == 1 and by_id[1000] == by_id[1001] == by_id[1002] == 0


def test_held_out_labels_teach_nothing(tables):
    docs, labels = tables
    held = toxicity.remainder("doc_id") == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (sorted(map(tuple, toxicity.toxicity(docs, x).collect()), key=str) for x in (labels, flipped))
    assert one == other


def test_without_toxic_keeps_columns_and_clean_rows(tables):
    docs, labels = tables
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 5} | {1000, 1001, 1002}


def test_without_labels(docs, no_docs, tables):
    _, labels = tables
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0
    ones = labels.where("doc_id in (0, 5, 10)")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, ones).collect())


def test_probabilities_of_a_context_add_up():
    """Kneser-Ney by dictionaries gives the evidence that the tables give."""
    seen = {0: ["stone", "stones", "river"], 1: ["grumpf", "grumpfer"]}
    grams, starts, lengths = toxicity._grams(seen[0] + seen[1])
    place = np.concatenate([p for _, p, _ in grams])
    before = np.concatenate([b for _, _, b in grams])
    words = np.repeat(np.arange(5), lengths + 1)
    toxic = np.concatenate([words[at] >= 3 for at, _, _ in grams])
    uniq, first, inverse = np.unique(place, return_index=True, return_inverse=True)
    counts = [np.bincount(inverse[toxic == y], minlength=len(uniq)).astype(float) for y in (False, True)]
    model = toxicity.Model.of(uniq, before[first], counts)

    def count(y, gram):
        return sum(f"\x02{w}\x03"[i : i + len(gram)] == gram for w in seen[y] for i in range(len(w) + 3 - len(gram)) if i + len(gram) > 1)

    def following(y, context):
        out = {}
        for w in seen[y]:
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                if i >= len(context) and s[i - len(context) : i] == context:
                    out[s[i]] = out.get(s[i], 0) + 1
        return out

    def share(tables, gram, lower):
        total = sum(sum(t.values()) for t in tables)
        if not total:
            return lower
        kinds = max(len(t) for t in tables)
        n = sum(t.get(gram[-1], 0) for t in tables)
        return (max(n - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * lower) / total

    def evidence(word):
        s, out = f"\x02{word}\x03", 0.0
        for i in range(1, len(s)):
            lower = 1 / toxicity.ALPHABET
            for k in range(1, min(toxicity.ORDER, i + 1) + 1):
                gram = s[i - k + 1 : i + 1]
                tables = [following(y, gram[:-1]) for y in (0, 1)]
                own = [share([t], gram, lower) for t in tables]
                lower = share(tables, gram, lower)
            out += np.log(own[1]) - np.log(own[0])
        return out

    tests = ["grumpfok", "stone", "unseen", "r"]
    got, letters = model.evidence(tests)
    assert got == pytest.approx([evidence(w) for w in tests], rel=1e-4)
    assert letters.tolist() == [len(w) + 1 for w in tests]


def test_every_labelled_row_teaches(spark):
    """Many labels teach as few do: no text is left out of the counts."""
    docs = [(i, "grumpf river" if i % 5 == 0 else "stone garden", "x") for i in range(400)]
    labels = spark.range(300_000).selectExpr("id as doc_id", "1 as quality", "int(id % 5 = 0) as toxic")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, score string"), labels).model.value
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs]
    for y in (0, 1):
        words = [w for (i, t, _), h in zip(docs, held) if not h and int(i % 5 == 0) == y for w in t.split()]
        assert model.counts[y].sum() == sum(len(at) for at, _, _ in toxicity._grams(words)[0])


def test_every_gram_has_its_own_count():
    """Two grams never share a count, however many there are."""
    pick = random.Random(5)
    words = list({"".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)})
    grams, _, _ = toxicity._grams(words)
    place, before = (np.concatenate([g[i] for g in grams]) for i in (1, 2))
    expected = {s[i - k + 1 : i + 1] for w in words for s in [f"\x02{w}\x03"] for i in range(1, len(s)) for k in range(1, 7) if k <= i + 1}
    uniq, first, n = np.unique(place, return_index=True, return_counts=True)
    assert len(uniq) == len(expected)
    model = toxicity.Model.of(uniq, before[first], [n, np.ones(len(n))])
    assert (model.counts[0][model.grams.of(uniq)] == n).all()
    assert model.totals[0].sum() == len(place)
    strange, _, _ = toxicity._grams(["ßßßßßß"])
    assert all((model.counts[0][model.grams.of(p)][:-1] == 0).all() for _, p, _ in strange)


def test_evidence_is_kept_within_bounds(monkeypatch):
    seen = ["stone", "stones", "grumpf"]
    grams, _, _ = toxicity._grams(seen)
    uniq, first, n = np.unique(np.concatenate([g[1] for g in grams]), return_index=True, return_counts=True)
    model = toxicity.Model.of(uniq, np.concatenate([g[2] for g in grams])[first], [n, n % 2])
    monkeypatch.setattr(toxicity, "HELD", 4)
    for words in (["stone", "x"], ["x", "river", "grumpf"], ["stone", "lamp"], ["a", "b", "c", "d", "e"]):
        for got, expected in zip(model.known(words), model.evidence(words)):
            assert got == pytest.approx(expected)


@pytest.mark.parametrize("part", ["= 3", "<> 3"])
def test_a_class_in_one_part_only_still_teaches(tables, part):
    docs, labels = tables
    labels = labels.where(f"not (toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 4 {part})")
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.id is not None and r.id < 1000 and r.held_out]
    toxic, calm = ([r.score for r in rows if (r.id % 5 == 0) == y] for y in (True, False))
    assert np.mean(np.array(toxic) >= toxicity.THRESHOLD) > 0.9
    assert np.mean(np.array(calm) < toxicity.THRESHOLD) > 0.9


def test_labels_without_documents_do_not_calibrate(spark, tables, monkeypatch):
    """Far more labels of no document than the calibration takes: they change nothing."""
    docs, labels = tables
    monkeypatch.setattr(toxicity, "CALIBRATED_ON", 30)
    lost = spark.range(10**6, 10**6 + 2_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    scores = lambda l: {r.id: r.score for r in toxicity.toxicity(docs, l).collect()}
    assert scores(labels.select("doc_id", "toxic").unionByName(lost)) == pytest.approx(scores(labels))


def test_repeated_documents_calibrate_once(spark, tables):
    docs, labels = tables
    one = docs.where("doc_id = 7")
    more = docs.unionByName(one).unionByName(one)
    got = toxicity.toxicity(more, labels).collect()
    assert len(got) == docs.count() + 2 and all(0 <= r.score <= 1 for r in got)


def test_likely_in(spark):
    ids = spark.range(0, 30_000, 7).unionByName(spark.range(5, 6))
    rows = spark.range(-5_000, 40_000).selectExpr("id as doc_id", "id as _at", "'x' as _block")
    got = shared.likely_in(rows, "doc_id", ids, ids.count())
    assert got.columns == rows.columns
    kept = {r.doc_id for r in got.collect()}
    wanted = {r.id for r in ids.collect()}
    # All that are there, and about one other in BITS_EACH.
    assert wanted <= kept and len(kept - wanted) < 45_000 / 16
    assert shared.likely_in(rows, "doc_id", ids.limit(0), 0).count() == 0
