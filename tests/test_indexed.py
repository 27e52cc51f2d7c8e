"""The index gives what scoring every column gives, with far less of it."""

import random

import pytest
from helpers import asked, doc, docs, plan
from pyspark.sql import functions as F

from schemaloom.config import RetrievalConfig
from schemaloom.operators import indexed as I
from schemaloom.operators import retrieval as R
from schemaloom.operators.catalog import linking_catalog

PARTS = (
    "order date id count name site visit total x y utm east sp code species rate avg month hub apple long student group "
    "loc plot obs num number year mean percent value price a of Obs#"
).split()


def schema(seed, tables, most):
    draw = random.Random(seed)
    name = lambda n: draw.choice(["", "tbl", "X_"]) + draw.choice(["_", " ", ""]).join(
        p if draw.random() < 0.5 else p.title() for p in draw.choices(PARTS, k=draw.randint(1, n))
    )
    made = {}
    while len(made) < tables:
        made[name(2)] = list(dict.fromkeys(name(3) for _ in range(draw.randint(0, most))))
    full = [f"{t}.{c}" for t, cs in made.items() for c in cs]
    keys = draw.sample(full, min(len(full), tables // 2)) if full else []
    fks = [tuple(draw.sample(full, 2)) for _ in range(tables // 2)] if len(full) > 1 else []
    return doc(made, pk=keys, fk=fks)


def questions(seed, n):
    draw = random.Random(seed)
    return [" ".join(draw.choices([*PARTS, "which", "how", "Straße", "list"], k=draw.randint(0, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    by_key = {f"k{i}": schema(i, n, most) for i, (n, most) in enumerate([(1, 3), (5, 6), (30, 9), (60, 4), (3, 0), (0, 0)])}
    rows = [(100 * i + j, key, q) for i, key in enumerate(by_key) for j, q in enumerate(questions(i, 25))]
    rows += [(-1, "k2", None), (-2, "nowhere", "order"), (-3, None, "order"), (-4, "k3", "")]
    return asked(spark, rows).repartition(4), docs(spark, by_key)


def test_equal_to_scoring_everything(made):
    asked_, catalog = made
    index = I.indexed_catalog(catalog).cache()
    scored = R.with_scores(asked_, catalog, 10**4)
    for k in (1, 3, 100):
        # Exact: the scores have to agree in every bit.
        expected = sorted(map(tuple, R.topk_tables(scored, k).collect()))
        assert sorted(map(tuple, I.topk_tables(asked_, index, k, 10**4).collect())) == expected
        assert sorted(map(tuple, I.topk_tables(asked_, index, k).collect())) == expected
    for c in (
        RetrievalConfig(max_tables=2, max_columns_per_table=3, min_columns_per_table=1, join_neighbor_limit=1),
        RetrievalConfig(max_tables=4, max_columns_per_table=2, min_columns_per_table=2, join_neighbor_limit=3),
        RetrievalConfig(max_tables=3, include_join_neighbors=False),
    ):
        rows = lambda df: {r.question_id: r.candidates for r in df.select("question_id", "candidates").collect()}
        assert rows(I.candidate_schema(asked_, index, c, 10**4)) == rows(R.candidate_schema(asked_, catalog, c, 10**4))


def test_no_tables_wanted(made):
    asked_, catalog = made
    assert I.topk_tables(asked_, I.indexed_catalog(catalog), 0, 10**4).count() == 0


def test_few_columns_of_a_large_schema_are_scored(spark):
    """50,000 columns, of which a question's words lead to a handful."""
    tables = {f"entity{i:04d}": [f"field{i:04d}_{j}" for j in range(99)] + [f"created_by_user{i}"] for i in range(500)}
    tables["orders"] = ["order_id", "customer_name", "total_price", "created"]
    tables["field0007 archive"] = ["customer_name", "created"]
    catalog = linking_catalog(docs(spark, {"large": doc(tables, pk=["orders.order_id"])})).cache()
    asked_ = asked(spark, [(1, "large", "total price of orders by customer name"), (2, "large", "was field0007 3 created"), (3, "large", "zzz")])
    index = I.indexed_catalog(catalog, stored=True).cache()
    expected = R.topk_tables(R.with_scores(asked_, catalog, 60_000, stored=True), 3).collect()
    assert sorted(map(tuple, I.topk_tables(asked_, index, 3, 60_000).collect())) == sorted(map(tuple, expected))
    work = {r.question_id: r.scored_columns for r in I.with_best_tables(asked_, index, 3).collect()}
    assert work[1] <= 200 and work[3] == 0
    # `created` is in 502 tables; the bounds end the scoring after a few of them.
    hits = index.select(F.explode("index").alias("p")).select(F.inline("p")).where("key = 'w:created'").select(F.size("at")).first()[0]
    assert hits == 502 and work[2] <= 500


def test_scored_once(made):
    """Equal questions are scored once, whoever asks; rows are those of the plain way."""
    asked_, catalog = made
    more = asked_.unionByName(asked_.withColumn("question_id", F.col("question_id") + 10**6)).unionByName(asked_)
    for size in (10**4, None):
        expected = R.topk_tables(R.with_scores(more, catalog, size), 3).collect()
        once = R.with_scores_once(more, catalog, size)
        assert set(once.columns) == set(R.with_scores(more, catalog, size).columns)
        assert sorted(map(tuple, R.topk_tables(once, 3).collect())) == sorted(map(tuple, expected))


def test_a_hot_question_is_split(spark, monkeypatch):
    """One question asked by all: its rows lie in several tasks, and it is scored in one row."""
    catalog = docs(spark, {"k": schema(3, 5, 4)})
    hot = spark.range(4_000).select(F.col("id").alias("question_id"), F.lit("k").alias("db_id"), F.lit("order date").alias("question"))
    seen = []

    def watched(left, right, key, spread_by, join=R.hot_key_join, **kw):
        """The rows of each salt that the join gives the hot question."""
        salt = F.pmod(F.xxhash64(spread_by), F.ceil(F.lit(left.count()) / 500))
        seen.append([tuple(r) for r in left.groupBy(salt.alias("salt")).count().orderBy("salt").collect()])
        assert right.count() == 1
        return join(left, right, key, spread_by, rows_per_salt=500, **kw)

    monkeypatch.setattr(R, "hot_key_join", watched)
    once = R.with_scores_once(hot, catalog, 100)
    assert once.count() == 4_000
    (salts,) = seen
    assert len(salts) == 8 and all(300 < n < 700 for _, n in salts)


def test_index_is_made_inside_the_schema_row(spark, made):
    """No posting is shuffled, and small schemas list their last letters to be searched in a question."""
    _, catalog = made
    whole = catalog.localCheckpoint()
    assert "Exchange" not in plan(I.indexed_catalog(whole))
    large = {"large": doc({f"t{i}": [f"field{i:04d}_{j}" for j in range(20)] for i in range(40)})}
    rows = I.indexed_catalog(whole.unionByName(docs(spark, large))).select("db_key", F.size("index").alias("n"), "grams").collect()
    assert [r.db_key for r in rows if r.grams is None] == ["large"]
    assert next(r.n for r in rows if r.db_key == "large") == 800


def test_a_small_schema_lists_its_tables(spark, made):
    """It has no hash table; its tables hold words, names and the scores they have without evidence."""
    asked_, catalog = made
    rows = {r.db_key: r for r in I.indexed_catalog(catalog).collect()}
    assert {k: len(r.grams) for k, r in rows.items()} == {k: len(r.tables) for k, r in rows.items()}
    assert all(r["index"] == [] and r.tiny == [] and r.idle == [] for r in rows.values())
    large = I.indexed_catalog(docs(spark, {"large": doc({f"t{i}": [f"c{i}_{j}" for j in range(20)] for i in range(40)})})).first()
    assert large.grams is None and len(large["index"]) == 800 and len(large.idle) == 40


def test_index_made_behind_the_shuffle(spark, made):
    """Documents are shuffled and not what is made from them; the rows are the same."""
    asked_, catalog = made
    names = {f"t{i}": [f"order{i}_{j}" for j in range(20)] for i in range(30)}
    catalog = catalog.unionByName(docs(spark, {"large": doc(names, pk=["t1.order1_0"], fk=[("t1.order1_0", "t2.order2_1")])}))
    asked_ = asked_.unionByName(asked(spark, [(-5, "large", "order1_0 and order2 1"), (-6, "large", "none")]))
    cfg = RetrievalConfig(max_tables=2, max_columns_per_table=3, min_columns_per_table=1, join_neighbor_limit=1)
    late = I.indexed_catalog(catalog, late=True)
    expected = {r.question_id: r.candidates for r in R.candidate_schema(asked_, catalog, cfg, 10**4).collect()}
    for size in (10**4, None):
        found = I.candidate_schema(asked_, late, cfg, size)
        assert {r.question_id: r.candidates for r in found.collect()} == expected
    lines = plan(found.select("question_id", "candidates")).splitlines()
    (at,) = [i for i, line in enumerate(lines) if "AS _made" in line]
    assert "Exchange hashpartitioning(db_key" in lines[at + 1]
