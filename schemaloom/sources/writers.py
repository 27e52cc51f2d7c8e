"""Writers. Every one writes a folder of part files, one per task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.config import RunConfig
from schemaloom.functions.links import to_links_map
from schemaloom.operators.curate import dataset_stats, db_counts


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines, plain unless a `compression` is given; readers tell it by the names of the files.

    Records with whole schemas in their prompts are best written with `gzip`:
    those of a database lie together and repeat its schema. Such a file is read
    by one task, as it was written by one.
    """
    df.write.mode("overwrite").json(path, compression=compression)


def prediction_rows(df: DataFrame, links: str = "parsed") -> DataFrame:
    return df.select("question_id", to_links_map(F.col(links)).alias("schema_links"))


def write_predictions(df: DataFrame, path: str, links: str = "parsed") -> None:
    """`{question_id, schema_links}` lines from parsed links."""
    prediction_rows(df, links).write.mode("overwrite").json(path)


def write_stats(records: DataFrame, split: str, path: str) -> None:
    """Totals of a split as one line, its database counts as lines beside it."""
    named = lambda df: df.select(F.lit(split).alias("split"), "*")
    named(dataset_stats(records)).write.mode("overwrite").json(f"{path}/{split}/totals")
    named(db_counts(records)).write.mode("overwrite").json(f"{path}/{split}/examples_per_db")


# Description of the record files.
PREPARATION_SETTINGS = {
    "schema_format": "text with table/column/type/key_info",
    "balancing_strategy": "light oversampling (cap at 2x) for databases with < 10 examples",
    "output_format": "chat-format JSONL with system/user/assistant roles + metadata",
    "normalization": "alphabetically sorted tables and columns",
    "metadata_fields": [
        "source: 'original' or 'oversampled'",
        "num_tables: count of tables in schema_links",
        "num_columns: count of columns in schema_links",
        "is_multitable: boolean",
        "has_empty_columns: boolean",
        "is_oversampled: boolean",
    ],
}


def preparation_settings(include_types: bool, include_keys: bool, balanced: bool) -> dict:
    return {
        **PREPARATION_SETTINGS,
        "include_types": include_types,
        "include_keys": include_keys,
        "balancing_applied": balanced,
    }


def write_config(spark: SparkSession, settings: dict | RunConfig, path: str) -> None:
    """One settings document as one line of JSON."""
    values = settings.to_dict() if isinstance(settings, RunConfig) else settings
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def _write_table(df: DataFrame, path: str) -> None:
    """A table with a header; quotes inside a value are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_per_question(rows: DataFrame, path: str) -> None:
    columns = ["question_id", "db_id", "p_t", "r_t", "f1_t", "p_c", "r_c", "f1_c"]
    keys = ["run_id"] if "run_id" in rows.columns else []
    _write_table(rows.select(*keys, *columns), path)


# Fixed values in the next two functions: the field names of the files.
def review_rows(selected: DataFrame) -> DataFrame:
    """Rows of the review table; reasons joined with `;`."""
    return selected.select(
        "question_id",
        "db_id",
        F.col("n").alias("db_count"),
        "score",
        F.concat_ws(";", "reasons").alias("reasons"),
        "num_tables",
        "num_columns",
        "question",
        "gold_sql",
    )


def selection_rows(selected: DataFrame) -> DataFrame:
    """Selected examples in their own form with the selection facts added."""
    return selected.select(
        "question_id",
        "db_id",
        "question",
        "gold_sql",
        "schema_links",
        F.col("score").alias("selection_score"),
        F.col("reasons").alias("selection_reasons"),
        F.col("num_tables").alias("num_linked_tables"),
        F.col("num_columns").alias("num_linked_columns"),
        F.col("n").alias("original_db_example_count"),
    )


def write_review(selected: DataFrame, path: str) -> None:
    _write_table(review_rows(selected), path)


def write_selection(selected: DataFrame, path: str) -> None:
    selection_rows(selected).write.mode("overwrite").json(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """All runs, best first, columns in alphabetical order."""
    _write_table(board.select(*sorted(board.columns)), path)


def write_best_run(best: DataFrame, path: str) -> None:
    best.write.mode("overwrite").json(path)


def write_splits(records: DataFrame, path: str) -> None:
    """Original and balanced records, told apart by their folder `source=…`."""
    records.write.mode("overwrite").partitionBy("source").json(path)


def publish_catalog(catalog: DataFrame, path: str) -> DataFrame:
    """Store a nested catalog once and read it back for many jobs."""
    catalog.write.mode("overwrite").parquet(path)
    return catalog.sparkSession.read.parquet(path)
