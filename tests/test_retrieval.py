import pytest
from helpers import asked, doc, docs, plan
from pyspark.sql import functions as F

from schemaloom.config import PRESETS, RetrievalConfig, RunConfig
from schemaloom.functions.links import LINKS_TYPE
from schemaloom.operators import joins
from schemaloom.operators import retrieval as R
from schemaloom.operators.catalog import linking_catalog

# A diamond: a and b both touch hub; far hangs on hub.
DIAMOND = doc(
    {
        "apple": ["apple_id", "hub_id"],
        "berry": ["berry_id", "hub_id"],
        "hub": ["hub_key"],
        "side": ["side_key", "apple_ref"],
        "far": ["far_key", "hub_ref"],
    },
    fk=[("apple.hub_id", "hub.hub_key"), ("berry.hub_id", "hub.hub_key"), ("side.apple_ref", "apple.apple_id"),
        ("far.hub_ref", "hub.hub_key")],
)


def cfg(**kw):
    return RetrievalConfig(**{"min_columns_per_table": 1, **kw})


def shape(df):
    return {
        r.question_id: [(t.table_id, t.table_name, [(c.column_id, c.col_name) for c in t["columns"]]) for t in r.candidates]
        for r in df.collect()
    }


def chosen(spark, question, c, links=None, d=DIAMOND):
    rows = asked(spark, [(1, "k", question)])
    force = None
    if links is not None:
        rows = rows.withColumn("links", F.from_json(F.lit(links), LINKS_TYPE))
        force = "links"
    return shape(R.candidate_schema(rows, docs(spark, {"k": d}), c, 100, force))[1]


def names(tables):
    return [t[1] for t in tables]


def test_ties_go_by_name_down_then_schema_order(spark):
    d = doc({"B": ["q"], "a": ["q"], "b": ["q"], "C": ["q"]})
    got = names(chosen(spark, "nothing", cfg(max_tables=4, include_join_neighbors=False), d=d))
    assert got == ["C", "B", "b", "a"]


def test_neighbours_are_added_seed_by_seed(spark):
    one = cfg(max_tables=2, join_neighbor_limit=1)
    two = cfg(max_tables=2, join_neighbor_limit=2)
    question = "apple apple_id berry berry_id"
    seeds = names(chosen(spark, question, cfg(max_tables=2, include_join_neighbors=False)))
    assert set(seeds) == {"apple", "berry"}
    # Both seeds share hub; the second seed has nothing left to add.
    assert set(names(chosen(spark, question, two))) == {"apple", "berry", "hub", "side"}
    got = names(chosen(spark, question, one))
    assert got[:2] == seeds and len(got) in (3, 4) and len(set(got)) == len(got)
    assert names(chosen(spark, question, cfg(max_tables=2, join_neighbor_limit=0))) == seeds


def test_forced_tables_exceed_the_budget_in_schema_order(spark):
    c = cfg(max_tables=1, include_join_neighbors=False)
    got = chosen(spark, "berry berry_id", c, '{"FAR":["far_key"],"side":[],"ghost":["x"],"apple":["nope"]}')
    assert names(got) == ["berry", "apple", "side", "far"]
    assert [t[0] for t in got] == ["T1", "T2", "T3", "T4"]


def test_forced_columns_survive_and_order_is_restored(spark):
    d = doc({"t": ["zeta", "alpha", "mid", "plain", "date"]}, pk=["t.plain"])
    kept = lambda c, links=None: [x[1] for x in chosen(spark, "date of mid", c, links, d)[0][2]]
    two = cfg(max_columns_per_table=2)
    assert kept(two) == ["mid", "date"]
    assert kept(two, '{"t":["zeta","alpha","plain"]}') == ["zeta", "alpha", "plain"]
    assert kept(cfg(max_columns_per_table=2, min_columns_per_table=3)) == ["mid", "plain", "date"]
    ids = [x[0] for x in chosen(spark, "date of mid", two, None, d)[0][2]]
    assert ids == ["C1", "C2"]


def test_scores_by_hand(spark):
    d = doc({"visits": [("VisitDate", "time"), "x"]}, pk=["visits.VisitDate"])
    scored = R.with_scores(asked(spark, [(1, "k", "Which year were the visits")]), docs(spark, {"k": d}), 10)
    got = {r.col_name: r.score for r in R.column_scores(scored).collect()}
    # visit + date of two words, the date hint, the key bonus; no literal hit.
    assert got["VisitDate"] == pytest.approx(1.35 * 2 / 2**0.5 + 0.35 + 0.05)
    assert got["x"] == 0.0
    table = R.table_scores(scored).first().score
    best = got["VisitDate"]
    assert table == pytest.approx(0.75 * 2 / 2**0.5 + 4.5 + 0.7 * best + 0.15 * best)


def test_table_without_columns(spark):
    d = doc({"empty": [], "full": ["a"]})
    df = R.candidate_schema(asked(spark, [(1, "k", "empty")]), docs(spark, {"k": d}), cfg(), 10)
    rows = R.explode_candidates(df).orderBy("t_rank").collect()
    assert [(r.table_name, r.col_name) for r in rows] == [("empty", None), ("full", "a")]


def test_question_without_schema_drops_out(spark):
    df = R.candidate_schema(asked(spark, [(1, "nowhere", "q"), (2, "k", "q")]), docs(spark, {"k": DIAMOND}), cfg(), 10)
    assert [r.question_id for r in df.collect()] == [2]


def _many(spark):
    rows = [(i, "k" if i % 3 else "cold" + str(i), f"apple berry far {i % 5}") for i in range(90)]
    catalog = {"k": DIAMOND, **{"cold" + str(i): DIAMOND for i in range(0, 90, 3)}}
    return asked(spark, rows), docs(spark, catalog)


def test_broadcast_and_salted_joins_agree(spark, monkeypatch):
    questions, catalog = _many(spark)
    small = R.candidate_schema(questions, catalog, cfg(max_tables=2), 100)
    # k holds two thirds of the rows and is split over many salts.
    monkeypatch.setattr(joins.hot_key_join, "__defaults__", ("inner", None, None, 7))
    large = R.candidate_schema(questions.repartition(3), catalog, cfg(max_tables=2), None)
    assert shape(small) == shape(large) and len(shape(large)) == 90


def test_hot_key_is_split(spark, monkeypatch):
    questions, _ = _many(spark)
    left = questions.withColumnRenamed("db_id", "db_key")
    right = left.select("db_key").distinct().withColumn("x", F.length("db_key"))
    df = joins.hot_key_join(left, right, "db_key", "question_id", rows_per_salt=7)
    assert df.count() == 90
    parts = df.where("db_key = 'k'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    left_out = joins.hot_key_join(left, right.where("db_key = 'k'"), "db_key", "question_id", "left", rows_per_salt=7)
    assert left_out.count() == 90 and left_out.where("x is null").count() == 30


def test_input_order_does_not_matter(spark):
    questions, catalog = _many(spark)
    a = R.candidate_schema(questions, catalog, cfg(), 100)
    b = R.candidate_schema(questions.orderBy(F.rand(7)).repartition(5), catalog.repartition(3), cfg(), 100)
    assert shape(a) == shape(b)


def test_plan_has_one_join_and_no_python(spark, monkeypatch):
    questions, catalog = _many(spark)
    text = plan(R.candidate_schema(questions, catalog, PRESETS["final"], 100))
    assert "Python" not in text and "Window" not in text
    assert text.count("Exchange hashpartitioning") == 0 and text.count("BroadcastExchange") == 1
    large = plan(R.candidate_schema(questions, catalog, PRESETS["final"], None))
    assert "SortMergeJoin" in large and "Window" not in large and "CartesianProduct" not in large


def test_candidates_are_evaluated_once(spark):
    questions, catalog = _many(spark)
    # The rows are not tested for emptiness below the generator.
    for columns in (100, None):
        text = plan(R.explode_candidates(R.candidate_schema(questions, catalog, cfg(), columns)))
        joins_on_conditions = [line for line in text.split("\n") if "Join" in line and "sort_array" in line]
        assert not joins_on_conditions and sum("sort_array" in line for line in text.split("\n")) == 1


def test_recall(spark):
    rows = asked(spark, [(1, "k", "apple apple_id")]).withColumn(
        "links", F.from_json(F.lit('{"apple":["apple_id","hub_id"],"far":["far_key"],"ghost":[]}'), LINKS_TYPE)
    )
    c = cfg(max_tables=1, include_join_neighbors=False, max_columns_per_table=1)
    r = R.retrieval_recall(R.candidate_schema(rows, docs(spark, {"k": DIAMOND}), c, 10), "links").first()
    assert (r.gold_tables, r.found_tables, r.gold_columns, r.found_columns) == (3, 1, 3, 1)
    assert r.table_recall == pytest.approx(1 / 3)


def test_config():
    got = RetrievalConfig.from_mapping({"max_tables": 3, "unknown": 1})
    assert got.max_tables == 3 and got.max_columns_per_table == 18
    assert RetrievalConfig.from_mapping(None) == RetrievalConfig() == PRESETS["default"]
    run = RunConfig.from_mapping({"output_format": "IDS", "retrieval": {"max_tables": 24}, "note": "x"})
    assert run.output_format == "ids" and run.retrieval.max_tables == 24
    with pytest.raises(ValueError):
        RunConfig(output_format="xml")


def test_few_steps_per_column(spark):
    """Scores have no CASE, and names whose mask shares no bit with the question's are not searched for words."""
    catalog, rows = docs(spark, {"k": DIAMOND}), asked(spark, [(1, "k", "apple key"), (2, "k", None)])
    stored = linking_catalog(catalog).localCheckpoint()
    assert "CASE WHEN" not in plan(R.with_scores(rows, stored, 100, stored=True).select("question_id", "scored"))
    item = lambda mask: F.struct(
        F.array(F.lit(" apple ")).alias("words"), F.lit(mask).cast("long").alias("mask"), F.lit(1.0).alias("norm")
    )
    q = F.struct(F.lit(" apple ").alias("bag"), F.lit(6).cast("long").alias("mask"))
    got = spark.range(1).select(*[R._overlap(q, item(m)).alias(f"m{m}") for m in (1, 2)]).first()
    assert tuple(got) == (0.0, 1.0)
