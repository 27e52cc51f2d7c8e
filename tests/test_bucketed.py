"""Published tables join without an exchange and score alike."""

import pytest
from helpers import asked, doc, docs, plan

from schemaloom.operators import bucketed
from schemaloom.operators import retrieval as R


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("buckets"))
    catalog = docs(spark, {f"k{i}": doc({f"T{i}": ["name", "town"], "U": []}) for i in range(9)})
    rows = [(i, "k 0" if i % 3 else f"k{i % 12}", f"name of t{i % 9}") for i in range(300)]
    rows = [(q, d.replace(" ", ""), t) for q, d, t in rows] + [(900, None, "x"), (901, "k1", None), (None, "k2", "town")]
    questions = asked(spark, rows)
    bucketed.publish(questions, catalog, "bucketed_test", path, buckets=8, rows_per_salt=40)
    yield questions, catalog
    for part in ("questions", "schemas"):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_test_{part}")


def test_equal_rows(spark, made):
    questions, catalog = made
    top = lambda df: sorted(map(repr, R.topk_tables(df, 2).collect()))
    assert top(bucketed.with_scores(spark, "bucketed_test")) == top(R.with_scores(questions, catalog, 50))


def test_no_exchange_between_scan_and_join(spark, made):
    text = plan(bucketed.with_scores(spark, "bucketed_test"))
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_a_hot_database_is_split(spark, made):
    salts = spark.table("bucketed_test_questions").where("db_key = 'k0'").groupBy("_salt").count().collect()
    assert len(salts) > 3 and max(r["count"] for r in salts) < 100
    assert spark.table("bucketed_test_schemas").where("db_key = 'k1'").count() == 1
