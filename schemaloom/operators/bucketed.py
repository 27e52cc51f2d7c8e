"""Questions and schemas stored in equal buckets, for many jobs over the same questions.

The shuffle and the split of hot databases are paid once, when the tables are
written. Every later job joins bucket by bucket, without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.arrays import let
from schemaloom.operators.catalog import db_key, linking_catalog
from schemaloom.operators.joins import ROWS_PER_SALT, salted_sides
from schemaloom.operators.retrieval import question_features, scored_tables

KEYS = ("db_key", "_salt")


def publish(
    questions: DataFrame, docs: DataFrame, name: str, path: str, buckets: int = 1024, rows_per_salt: int = ROWS_PER_SALT
) -> None:
    """Write the tables `<name>_questions` and `<name>_schemas` below `path`, replacing earlier ones of that name.

    Both are bucketed by database and salt; a database with more than
    `rows_per_salt` questions has several salts and its schema is stored once
    per salt. One task writes one bucket, so there is one file for each.
    """
    asked = questions.withColumn("db_key", db_key(F.col("db_id")))
    sides = salted_sides(asked, linking_catalog(docs), "db_key", "question_id", rows_per_salt=rows_per_salt)
    for rows, part in zip(sides, ("questions", "schemas")):
        (
            rows.repartition(buckets, *KEYS)
            .write.mode("overwrite")
            .bucketBy(buckets, *KEYS)
            .sortBy(*KEYS)
            .option("path", f"{path}/{part}")
            .saveAsTable(f"{name}_{part}")
        )


def joined(spark: SparkSession, name: str) -> DataFrame:
    """Published questions with the `tables` of their database."""
    asked, schemas = (spark.table(f"{name}_{part}") for part in ("questions", "schemas"))
    # The merge hint keeps the planner from broadcasting on a guessed size.
    return asked.join(schemas.hint("merge"), list(KEYS)).drop("_salt")


def with_scores(spark: SparkSession, name: str) -> DataFrame:
    """The rows of `retrieval.with_scores` from published tables."""
    scored = let(question_features(F.col("question")), lambda q: scored_tables(q, F.col("tables")))
    return joined(spark, name).withColumn("scored", scored)
