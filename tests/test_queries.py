import duckdb
import pytest

import __spark_entry__ as entry
import check
from workloads import oracle
from workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"
# Queries that together touch every module; `python check.py` compares all of them.
COMPARED = [
    "fk_edges",
    "question_tokens",
    "forced_candidate_schema",
    "parse_links",
    "validate_links",
    "leaderboard",
    "train_balance",
    "select_for_augmentation",
    "pad_batch",
    "dataset_stats",
    "retrieval_recall",
    "parsed_examples",
    "parsed_predictions",
    "parsed_runs",
    "selection_rows",
    "parsed_catalog",
    "stored_gold",
    "stored_stats",
    "stored_leaderboard",
]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle.build())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "question_id" and df.count() > 0


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_twin(spark, name):
    db = duckdb.connect()
    for table in check.TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = db.sql(entry.oracle_sql()[name]).df()
    assert check.normal(ours) == check.normal(theirs)
