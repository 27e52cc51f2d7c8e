from collections import Counter

import pytest
from helpers import plan
from pyspark.sql import functions as F

from schemaloom.functions.links import LINKS_TYPE
from schemaloom.operators import curate as U
from schemaloom.operators.joins import hot_key_join, hot_keys


def examples(spark, sizes, links='{"a":["x"],"b":[]}'):
    rows, qid = [], 0
    for db, n in sizes.items():
        for _ in range(n):
            rows.append((qid, db, "q", "select 1", links))
            qid += 1
    df = spark.createDataFrame(rows, "question_id bigint, db_id string, question string, gold_sql string, l string")
    return df.withColumn("schema_links", F.from_json("l", LINKS_TYPE)).drop("l")


def sizes_of(df):
    return {r.db_id: r.n for r in U.db_counts(df).collect()}


def test_light_balance(spark):
    base = examples(spark, {f"d{n}": n for n in (1, 4, 5, 6, 9, 10, 13)})
    done = U.light_balance(base)
    assert sizes_of(done) == {"d1": 2, "d4": 8, "d5": 10, "d6": 10, "d9": 10, "d10": 10, "d13": 13}
    copies = done.where("is_oversampled")
    # Copies are the first rows of their database.
    first = {r.db_id: r.m for r in base.groupBy("db_id").agg(F.min("question_id").alias("m")).collect()}
    assert {r.db_id: r.m for r in copies.groupBy("db_id").agg(F.min("question_id").alias("m")).collect()} == {
        d: first[d] for d in ("d1", "d4", "d5", "d6", "d9")
    }
    log = {r.db_id: (r.original_count, r.target_count, r.duplications_added) for r in U.balance_log(base).collect()}
    assert log["d4"] == (4, 8, 4) and log["d9"] == (9, 10, 1) and "d10" not in log
    assert "WindowGroupLimit" in plan(done)


def test_published_balance_identity(spark):
    """Eight small databases of six rows gain 32 copies, as in the published counts."""
    base = examples(spark, {**{f"s{i}": 6 for i in range(8)}, "big": 253})
    stats = U.dataset_stats(U.light_balance(base)).first()
    assert (stats.total_examples, stats.original_examples, stats.oversampled_examples) == (333, 301, 32)
    assert stats.multi_table_examples + stats.single_table_examples == stats.total_examples
    assert stats.empty_column_examples == 333 and stats.many_column_examples == 0
    assert (stats.avg_tables_per_example, stats.max_columns, stats.unique_databases) == (2.0, 1, 9)


def test_stats_of_nothing(spark):
    stats = U.dataset_stats(examples(spark, {"d": 1}).where("false").withColumn("is_oversampled", F.lit(False))).first()
    assert (stats.total_examples, stats.avg_tables_per_example, stats.max_tables) == (0, 0.0, 0)


def test_train_balance(spark):
    base = examples(spark, {"a": 1, "b": 20, "c": 63}, links='{"a":["x"]}')
    multi = examples(spark, {"d": 2}).withColumn("question_id", F.col("question_id") + 1000)
    done = U.train_balance(base.unionByName(multi), seed=5).cache()
    # The target is the average of 21.5 rows, cut to 21.
    assert sizes_of(done) == {"a": 21, "b": 21, "c": 63, "d": 21 + 2}
    assert done.where("part = 'extra'").count() == 2
    assert done.where("part = 'draw' and db_id = 'a'").select("question_id").distinct().count() == 1
    again = U.train_balance(base.unionByName(multi).repartition(7), seed=5)
    key = ["question_id", "db_id", "part", "copy"]
    assert sorted(map(tuple, done.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def test_small_average_is_lifted_to_the_floor(spark):
    assert sizes_of(U.train_balance(examples(spark, {"a": 2, "b": 4}, '{"a":[]}'), seed=1)) == {"a": 18, "b": 18}


def test_numbering_in_pieces(spark):
    base = examples(spark, {"hot": 50, "cold": 3})
    done = U.numbered_in_group(base, "db_id", "question_id", piece=7).collect()
    assert len(done) == 53
    numbers = lambda db: {r.question_id: r.rn for r in done if r.db_id == db}
    assert numbers("cold") == {50: 1, 51: 2, 52: 3}
    assert numbers("hot") == {q: q + 1 for q in range(50)}
    whole = U.numbered_in_group(base, "db_id", "question_id").collect()
    assert {r.question_id: r.rn for r in whole if r.db_id == "hot"} == {q: q + 1 for q in range(50)}
    again = U.numbered_in_group(base.repartition(5), "db_id", "question_id", piece=7).collect()
    assert {(r.question_id, r.rn) for r in done} == {(r.question_id, r.rn) for r in again}


def test_ranges_follow_the_rows(spark):
    """One far id, ids that crowd together, and a group of its own size: ranges of about equal rows."""
    far = spark.range(20_000).selectExpr("'hot' as db_id", "id as question_id").union(spark.sql("select 'hot', 9000000000000000000"))
    crowd = spark.range(5_000).selectExpr("'crowd' as db_id", "cast(pow(id, 3) as long) - 7000000 as question_id")
    base = far.union(crowd).union(spark.sql("select 'cold', 5L")).repartition(4)
    cut = U.cut_groups(base, "db_id", "question_id", piece=1_000)
    sizes = {}
    for r in cut.groupBy("db_id", "_piece").count().collect():
        sizes.setdefault(r.db_id, []).append(r["count"])
    assert sizes["cold"] == [1] and len(sizes["hot"]) > 30 and len(sizes["crowd"]) >= 10
    for db in ("hot", "crowd"):
        assert max(sizes[db]) <= 2 * sorted(sizes[db])[len(sizes[db]) // 2]
    for piece in (1_000, 3, 10**6):
        done = U.numbered_in_group(base, "db_id", "question_id", piece=piece)
        expected, n = {}, Counter()
        for r in base.orderBy("question_id").collect():
            n[r.db_id] += 1
            expected[r.db_id, r.question_id] = n[r.db_id]
        assert {(r.db_id, r.question_id): r.rn for r in done.collect()} == expected


def test_places_of_a_seeded_order(spark):
    base = examples(spark, {"a": 300, "b": 41})
    order = [r.question_id for r in U.seeded_shuffle(base, 7, ["question_id"]).collect()]
    for slots in (1, 5, 4_096):
        placed = U.numbered_shuffle(base.repartition(3), 7, ["question_id"], slots)
        assert placed.columns == [*base.columns, "place"]
        assert [r.question_id for r in placed.orderBy("place").collect()] == order
        assert sorted(r.place for r in placed.collect()) == list(range(1, 342))


def test_db_counts_broadcast_or_salted(spark):
    base = examples(spark, {"hot": 50, "cold": 3})
    sizes = lambda df: sorted((r.question_id, r.n) for r in df.collect())
    small, large = U.with_db_count(base), U.with_db_count(base, broadcast_bytes=1)
    assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large)
    assert sizes(small) == sizes(large) and len(sizes(small)) == 53


def test_repeated_in_pieces(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "k string, n bigint")
    rows = U.repeated(df, "n", "i", piece=3).orderBy("k", "i").collect()
    assert [(r.k, r.i) for r in rows] == [("a", i) for i in range(1, 11)] + [("c", 1)]


def test_target_oversample(spark):
    base = examples(spark, {"NTSB": 2, "SBODemoUS-Banking": 1, "other": 3})
    assert sizes_of(U.target_oversample(base)) == {"NTSB": 8, "SBODemoUS-Banking": 4, "other": 3}
    assert U.target_oversample(base, extra=-1).count() == 6


def test_seeded_shuffle(spark):
    base = examples(spark, {"a": 30})
    order = lambda df, seed: [r.question_id for r in U.seeded_shuffle(df, seed, ["question_id"]).collect()]
    assert order(base, 1) == order(base.repartition(5), 1) != order(base, 2)
    assert sorted(order(base, 1)) == list(range(30))


CASES = [
    ("q", "select a from b", '{"a":["x"]}', 3, 5, ["underrepresented_db:3"]),
    ("q", "select a from b", '{"a":["x"]}', 12, 2, ["low_resource_db:12"]),
    ("q", "select a from b", '{"a":["x"]}', 13, 0, []),
    (
        "w " * 25,
        "SELECT TOP 1 count(x) FROM a JOIN b ON 1 join c ON 2 WHERE EXISTS (select 1) GROUP BY y",
        '{"a":["1","2","3"],"b":["1","2","3"],"c":["1","2"],"d":[]}',
        13,
        5 + 4 + 4 + 3 + 2 + 1 + 3 + 1,
        ["many_tables:4", "many_columns:8", "empty_column_table", "multi_join:2", "group_order_having",
         "aggregate_or_distinct", "subquery_or_top", "long_question"],
    ),
    (
        "q",
        "select a from b join c",
        '{"a":["1","2","3"],"b":["1","2"]}',
        13,
        3 + 2 + 2,
        ["two_tables", "medium_columns:5", "join"],
    ),
    # The blanks of a fragment are part of it.
    ("q", "where x in(1)", '{"a":["x"]}', 13, 0, []),
]


@pytest.mark.parametrize("question, sql, links, n, score, reasons", CASES)
def test_difficulty(spark, question, sql, links, n, score, reasons):
    base = examples(spark, {"d": n}, links).withColumns({"question": F.lit(question), "gold_sql": F.lit(sql)})
    row = U.difficulty(base).first()
    assert (row.score, row.reasons, row.n) == (score, reasons, n)


def test_selection_order_and_ties(spark):
    rows = [(1, 9, 1, 1, 5), (2, 9, 1, 1, 5), (3, 9, 1, 1, 4), (4, 9, 1, 2, 9), (5, 9, 2, 1, 9), (6, 11, 1, 1, 9), (7, 8, 9, 9, 1)]
    df = spark.createDataFrame(rows, "question_id bigint, score int, num_tables int, num_columns int, n bigint")
    pick = U.select_for_augmentation(df.withColumn("db_id", F.lit("d")), max_examples=5)
    assert [r.question_id for r in pick.collect()] == [6, 5, 4, 3, 1]
    assert U.selection_by_db(pick).first().selected == 5
    assert "TakeOrderedAndProject" in plan(pick)


def test_every_hot_key_is_salted(spark):
    left = spark.range(4500).selectExpr("id as question_id", "id % 1500 as k")
    right = spark.range(1500).selectExpr("id as k", "id * 2 as twice")
    counts = left.groupBy("k").count().withColumnRenamed("count", "n")
    assert hot_keys(counts, "k", 1).count() == 1500
    rows = hot_key_join(left, right, "k", "question_id", rows_per_salt=1)
    assert rows.count() == 4500 and rows.where("twice <> 2 * (question_id % 1500)").count() == 0
