"""Joins of a large side with one row per key, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A catalog of at most this many columns is broadcast. A column with its
# features stays well under 1 KB, so a broadcast stays under 50 MB.
BROADCAST_COLUMNS = 50_000
# One task takes about this many rows of a hot key.
ROWS_PER_SALT = 1_000_000
# A key with less than this part of all rows is no burden to any one task.
# Keys above it are fewer than this number, which bounds their list.
HOT_PART = 100_000


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """Every key of `counts` (`key`, `n`) with more than `rows` rows, or than 1 / `HOT_PART` of all if that is more.

    So there are fewer than `HOT_PART` of them, however large the data: the
    list may be broadcast.
    """
    share = counts.agg(F.greatest(F.lit(rows), F.coalesce(F.sum("n"), F.lit(0)) / HOT_PART).alias("share"))
    return counts.where(F.col("n") > share.scalar()).select(key, "n")


def salted_sides(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    counts: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a `_salt` to join by beside `key`: see `hot_key_join`."""
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    salts_of = F.ceil(F.col("n") / rows_per_salt).cast("int").alias("_salts")
    hot = F.broadcast(hot_keys(counts, key, rows_per_salt).select(key, salts_of))
    salts = F.coalesce("_salts", F.lit(1))
    salted = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted, repeated


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    derive: dict[str, Column] | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join `left` to the one row per `key` of `right` in a shuffle.

    Keys with more than `rows_per_salt` left rows (or, beyond `HOT_PART` times
    that many rows in all, 1 / `HOT_PART` of them) are split over several
    tasks: their rows get a salt from a hash of `spread_by`, which gives the
    same salt when a lost task runs again, and the one right row is repeated
    per salt. All other keys use salt 0 and stay as they are. `counts`
    (`key`, `n`, not too small) may be given where it is cheaper to have than
    by counting `left`.

    `derive` replaces the columns of `right` by expressions on them. They are
    evaluated behind the shuffle, which so moves the raw columns only.
    """
    salted, repeated = salted_sides(left, right, key, spread_by, counts, rows_per_salt)
    # Both sides are laid out for the join here. A fixed number of partitions
    # keeps small but costly inputs from being folded into a few tasks.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = salted.repartition(parts, key, "_salt")
    repeated = repeated.repartition(parts, key, "_salt")
    if derive is not None:
        repeated = repeated.select(key, "_salt", *[expr.alias(name) for name, expr in derive.items()])
    # The merge hint keeps the planner from broadcasting on a guessed size.
    return salted.join(repeated.hint("merge"), [key, "_salt"], how).drop("_salt")


def join_catalog(
    questions: DataFrame,
    catalog: DataFrame,
    columns: int | None,
    derive: dict[str, Column] | None = None,
    spread_by: str = "question_id",
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Attach the catalog row of each question's database by `db_key`.

    `columns` is the measured size of the catalog (`catalog_size`); up to
    `BROADCAST_COLUMNS` it is broadcast, beyond or unmeasured it is shuffled
    with hot databases salted. `derive` turns schema documents into what the
    job needs; a catalog stored in its final form needs none.
    """
    if columns is not None and columns <= BROADCAST_COLUMNS:
        if derive is not None:
            catalog = catalog.select("db_key", *[expr.alias(name) for name, expr in derive.items()])
        return questions.join(F.broadcast(catalog), "db_key", how)
    return hot_key_join(questions, catalog, "db_key", spread_by, how, counts, derive)
