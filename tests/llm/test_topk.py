import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, q int, shard string"


def brute(rows, asks, k):
    fine = {}
    for r in rows:
        e = r["embedding"]
        if r["vec_id"] is not None and e and all(x is not None and math.isfinite(x) for x in e):
            fine.setdefault((r["vec_id"], tuple(math.floor(256 * float(np.float32(x))) for x in e)), 0)
            fine[r["vec_id"], tuple(math.floor(256 * float(np.float32(x))) for x in e)] += 1
    out = set()
    for v, q in fine:
        if asks(v):
            hits = [
                (-sum(a * b for a, b in zip(q, p)), w) for (w, p), n in fine.items() for _ in range(n) if w != v and len(p) == len(q)
            ]
            out |= {(v, i + 1, w, -s) for i, (s, w) in enumerate(sorted(hits)[:k])}
    return out


def found(df, asks, k, **options):
    return {tuple(r) for r in topk.top_k(df, asks, k, **options).collect()}


@pytest.mark.parametrize("shard_rows", [7, 64, 16_384])
def test_equals_brute_force(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    rng = np.random.default_rng(5)
    rows = [{"vec_id": i, "embedding": [float(x) for x in rng.normal(size=6).round(1)], "label": 0, "q": 1, "shard": "s"} for i in range(150)]
    rows += [dict(rows[3], vec_id=1000 + i) for i in range(20)]  # ties
    rows += [{"vec_id": 2000 + i, "embedding": e, "label": None, "q": None, "shard": None} for i, e in enumerate(
        [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [0.5, 0.25], [1.0, 2.0], [0.0] * 6]
    )]
    rows += [{"vec_id": None, "embedding": [1.0] * 6, "label": 1, "q": 1, "shard": ""}, dict(rows[10]), dict(rows[10])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard_rows) == brute(rows, lambda v: v % 10 == 0, 5)


def test_large_numbers_stay_exact(spark):
    rows = [{"vec_id": i, "embedding": [3e15 + i * 1e9, 1.0], "label": 0, "q": 0, "shard": ""} for i in range(3)]
    got = found(spark.createDataFrame(rows, SCHEMA), F.lit(True), 2)
    assert len(got) == 6 and all(s == 2**63 - 1 for *_, s in got)


def test_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True), 5).count() == 0


def test_bounds_prune():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(m * 100, 3, (500, 8)) for m in range(-3, 4)]).astype(np.int64)
    tree = topk.BallTree(np.arange(len(rows)), rows)
    visits = []
    tree.low = type("Seen", (list,), {"__getitem__": lambda s, i: visits.append(i) or list.__getitem__(s, i)})(tree.low)
    list(tree.search(rows[:1], np.array([0]), np.array([-np.inf]), 5))
    leaves = sum(x < 0 for x in tree.left)
    assert len(visits) < leaves / 3
