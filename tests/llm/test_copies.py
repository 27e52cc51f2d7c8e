"""Exact and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schemaloom.llm import components, exact_dedup, simhash


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append(r)
    out = Counter()
    for text, own in groups.items():
        rank = lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best = min(own, key=rank)
        for r in own:
            kept = r.doc_id == best.doc_id and len(r.text or "") == len(best.text or "")
            out[(r.doc_id, best.doc_id, len(own), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("runs, shard", [(8, 100_000), (5, 3), (1, 4)])
def test_groups(docs, sample, monkeypatch, runs, shard):
    monkeypatch.setattr(exact_dedup, "RUNS", runs)
    monkeypatch.setattr(exact_dedup, "SHARD_ENTRIES", shard)
    for df in (docs, sample):
        got = exact_dedup.duplicate_groups(df)
        assert Counter(tuple(r) for r in got.collect()) == expected_groups(df.collect())


def test_rounds_merge_sorted_runs(sample):
    best = F.struct("points", F.col("id").isNull().alias("no_id"), "id").alias("best")
    first = exact_dedup.digests(sample).select("run", *exact_dedup.EVIDENCE, best, F.lit(1).cast("long").alias("n"))
    merged = exact_dedup.merged(first.withColumn("shard", F.pmod("check", F.lit(2))))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # One exchange, by shard and run; its sort is the only one, and the merge reads it.
    assert plan.count("Exchange hashpartitioning(shard") == plan.count("Exchange") == plan.count("+- Sort [") == 1
    assert "SortAggregate" in plan
    rows = merged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).collect()
    of_run = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.place):
        of_run[r.shard, r.run].append(r)
    for own in of_run.values():
        assert len({r.part for r in own}) == 1
        assert [bytes(r.digest) for r in own] == sorted({bytes(r.digest) for r in own})
    runs = exact_dedup.tree_merge(first, 2).select("run").distinct().collect()
    assert [r.run for r in runs] == [0]


def test_groups_run_without_python(sample):
    text = exact_dedup.duplicate_groups(sample)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_deduplicated_keeps_one_row_per_text(docs, sample, no_docs):
    for df in (docs, sample):
        rows = df.collect()
        got = exact_dedup.deduplicated(df)
        assert got.columns == df.columns
        kept = got.collect()
        assert sorted(plain(r.text) for r in kept) == sorted({plain(r.text) for r in rows})
        assert set(kept) <= set(rows)
    assert exact_dedup.deduplicated(no_docs).count() == 0
    assert exact_dedup.duplicate_groups(no_docs).count() == 0


def brute_fingerprint(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", fold)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        known = least.get(r)
        least[r] = d if known is None else (known if d is None else min(known, d))
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("block", [2, simhash.BLOCK])
def test_near_duplicates(docs, sample, block):
    for df in (docs, sample):
        rows = df.collect()
        fps = [brute_fingerprint(r.text) for r in rows]
        expected = Counter(
            (r.doc_id, f"{fp:016x}", c) for r, fp, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps))
        )
        got = simhash.near_duplicates(df, block=block).select("id", simhash.hex_of(F.col("fp")), "component")
        assert Counter(tuple(r) for r in got.collect()) == expected


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (2**64 - 1) == brute_fingerprint(text)


def planted(n, seed):
    """Chains, stars and strangers: every new number differs from an old one in up to four bits."""
    pick = random.Random(seed)
    fps = [pick.getrandbits(64) for _ in range(5)]
    while len(fps) < n:
        base = pick.choice(fps)
        for b in pick.sample(range(64), pick.randint(0, 4)):
            base ^= 1 << b
        fps.append(base)
    return fps


@pytest.mark.parametrize("block", [3, 40, simhash.BLOCK])
def test_links_connect_what_links(spark, block):
    fps = sorted(set(planted(150, 3)))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block).collect()
    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
    got = {r.node: r.root for r in components.components(spark.createDataFrame(found or [], "a long, b long")).collect()}
    expected = brute_components(list(range(len(fps))), fps)
    by_root = defaultdict(set)
    for f, c in zip(signed, expected):
        by_root[c].add(got.get(f, f))
    assert all(len(x) == 1 for x in by_root.values())
    assert len({next(iter(x)) for x in by_root.values()}) == len(by_root)


def test_a_group_gives_fewer_links_than_pairs():
    pick = random.Random(1)
    base, fps = pick.getrandbits(64), set()
    while len(fps) < 400:
        fps.add(base ^ (1 << pick.randrange(32, 64)) ^ (1 << pick.randrange(32, 64)))
    found = simhash.bucket_links(np.array(sorted(fps), np.uint64).view(np.int64), 0)
    assert len(found) < len(fps)


def test_chain_of_links_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in components.components(chain).collect()}
    assert roots == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(chain.limit(0)).count() == 0


def test_without_near_duplicates(docs, sample, no_docs):
    for df in (docs, sample):
        found = simhash.near_duplicates(df).select("id", "component").collect()
        kept = simhash.without_near_duplicates(df)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(r.component) for r in found})
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.without_near_duplicates(no_docs).count() == 0


def test_rows_with_null_and_repeated_ids_keep_one_row_per_group(spark):
    texts = [" ".join(f"{w}{i}" for i in range(12)) for w in ("river", "stone", "lamp", "paper", "cloud", "horse")]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0] + " more"), (None, texts[3]), (7, texts[3])]
    # Two texts under one id, one of them also without an id; and repeated rows.
    rows += [(5, texts[4]), (5, texts[5]), (None, texts[5]), (5, texts[4]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    ids = list(range(len(rows)))
    for r, c in zip(rows, brute_components(ids, [brute_fingerprint(t) for _, t in rows])):
        groups[c].append(r)
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())
    expected = Counter(min(own, key=rank) for own in groups.values())
    assert len(expected) >= 6
    assert Counter(map(tuple, simhash.without_near_duplicates(docs).collect())) == expected


def test_deduplicated_keeps_the_most_code_points_without_ids(spark):
    texts = [f"{w}{i}" for w in ("a", "b", "c") for i in range(10)]
    rows = [(d, t) for d in (None, 5) for x in texts for t in (f"{x}z{d}", f" {x}z{d}", f"{x} z {d}", f"{x}\tz {d}", f"{x}z{d} ")]
    expected = Counter()
    for low in range(0, len(rows), 5):
        # Two tie with two code points more.
        expected[min(rows[low + 2 : low + 4], key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())] += 1
    for n in (1, 3):
        got = exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))
        assert Counter(map(tuple, got.collect())) == expected
