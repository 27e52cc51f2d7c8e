import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from schemaloom.llm import audit, dictionary


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def failed(rows):
    first = {}
    for r in rows:
        if r.doc_id is not None:
            key = r.text or ""
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
    out = []
    for r in rows:
        text, w = r.text or "", words(r.text)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (r.doc_id is not None and r.doc_id > first[text])
        out.append((r.doc_id, r.lang or "", fails))
    return out


def audited(fails, labels):
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in fails}:
            left = [x for x in fails if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[2]]
                row = [len(left) - len(hit), len(hit), sum(f in x[2] for x in gone)]
                row += [sum(x[1] == part and x[2] == f for x in fails), sum(x[0] in good for x in hit), sum(x[0] in toxic for x in hit)]
                out[part, order, step] = row
                shapley[part, f] += len(hit)
                left, gone = [x for x in left if f not in x[2]], gone + hit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (13, 1, 0), (8, 0, 1)]


def test_failures(docs, sample):
    for df in (docs, sample):
        got = audit.failures(df).collect()
        assert Counter((r.id, r.part, r.fails) for r in got) == Counter(failed(df.collect()))


def test_audit(spark, docs, sample):
    for df, labels in (
        (docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")),
        (sample, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")),
    ):
        got = audit.audit(audit.failures(df), labels).collect()
        expected = audited(failed(df.collect()), labels.collect())
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == expected
        assert len(got) == len(expected)


def test_matrix(docs, sample):
    """Every row's entries are its words, with their counts."""
    for df in (docs, sample):
        shards, words_ = audit.matrix(df)
        known = words_.collect()
        name = {r.word_id: r.word for r in known}
        assert sorted(name) == list(range(len(known)))
        got = Counter()
        for s in shards.collect():
            low = 0
            for i, high in enumerate(s.ends):
                entries = frozenset((name[c], n) for c, n in zip(s.columns[low:high], s.counts[low:high]))
                assert len(entries) == high - low
                got[s.ids[i], entries] += 1
                low = high
        rows = df.collect()
        assert got == Counter((r.doc_id, frozenset(Counter(words(r.text)).items())) for r in rows)
        assert set(name.values()) == {w for r in rows for w in words(r.text)}


def test_empty_table_and_other_ids(docs, no_docs, spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit.failures(no_docs).count() == 0
    assert audit.audit(audit.failures(no_docs), labels).count() == 0
    # Ids that are text, and texts that are all empty.
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("text", F.lit(None).cast("string"))
    got = audit.failures(named).collect()
    assert Counter(r.fails for r in got) == Counter({"A": 2, "AE": 12})


def test_dictionary(spark):
    """Ids do not depend on shards or buckets, sums and starts are exact, rare words have no id."""
    rows, total, own = [], defaultdict(int), {}
    for i in range(9):
        part = "ab"[i % 2]
        own[f"s{i}"] = [(part, w) for w in dictionary.coded(pa.array([f"w{j}" for j in range(i % 4, 60, 1 + i % 3)] + ["ü" * 50_000]))[1].to_pylist()]
        counts = np.arange(len(own[f"s{i}"])) + i
        for key, n in zip(own[f"s{i}"], counts.tolist()):
            total[key] += n
        rows.append((part, f"s{i}", len(counts), "\n".join(w for _, w in own[f"s{i}"]), counts.tobytes()))
    rows.append(("a", "none", 0, "", b""))
    local = spark.createDataFrame(rows, "part string, shard string, n long, words string, counts binary")
    for entries, least in ((10_000, 1), (7, 1), (50, 60)):
        answers = dictionary.numbered(local, least, entries)
        known = {(r.part, r.word): r for r in dictionary.words(answers).collect()}
        assert {k: r.total for k, r in known.items()} == {k: n for k, n in total.items() if n >= least}
        assert sorted(r.word_id for r in known.values()) == list(range(len(known)))
        by_id = sorted((r.word_id, r.total) for r in known.values())
        start = {i: sum(n for _, n in by_id[:i]) for i, _ in by_id}
        blocks = {r["shard"]: r["blocks"] for r in dictionary.by_shard(answers).toArrow().to_pylist()}
        assert set(blocks) == set(own)
        for s, keys in own.items():
            ids = dictionary.ids_of(blocks[s])
            assert list(ids) == [known[k].word_id if k in known else -1 for k in keys]
            there = [i for i in range(len(ids)) if ids[i] >= 0]
            assert [dictionary.starts_of(blocks[s])[i] for i in there] == [start[ids[i]] for i in there]
            assert list(dictionary.totals_of(blocks[s])) == [total[k] for k in keys]
