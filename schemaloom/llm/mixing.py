"""Mixing sources to target weights, in DataFrame operations.

Every document gets a random key from a hash, and lies in the order of its key
within its source. A source's words up to a document are a sum of whole
buckets of keys before it, and a running sum inside its own; no task sees more
than a bucket. Each source is cut where its words reach its budget; a budget
beyond the source's words repeats the order, epoch by epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm.shared import WORD, saved, text_of

# Buckets of keys in a source. A source of 10^9 documents has 250,000 in each.
BUCKETS = 4_096
SEED = "mix-1"


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int, total: Column | None = None) -> DataFrame:
    """`target` of every row (`source`, `source_size`).

    Sources in the order of their code points, null last, weigh `weights` in
    turn. Sharing out by weight, with a limit of `most_epochs` times the
    source's size and the excess shared again, ends at one level: the target
    is the smaller of the limit and level x weight. The sources with the
    smallest limit per weight are the ones that reach it.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(in_order) - 1) % len(weights) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
    limit = (F.col("source_size") * most_epochs).cast("double")
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    shared = (
        weighed.withColumn("limit", limit)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("before", F.coalesce(F.sum("limit").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("after", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
    )
    # The first source that the level does not fill sets it for all behind it.
    open_ = F.col("level") * F.col("weight") < F.col("limit")
    level = F.min(F.when(open_, F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    target = F.coalesce(F.least(F.col("limit"), level["level"] * F.col("weight")), F.col("limit"))
    return shared.withColumn("target", target).select("source", "source_size", "target")


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most_epochs: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    buckets: int = BUCKETS,
    seed: str = SEED,
    row_key: Column | None = None,
) -> DataFrame:
    """Rows (`id`, `source`, `size`, `source_size`, `target`, `taken`), one for each row of `docs`.

    `size` is the number of words, 0 for a null text; `taken` the words that
    the mix takes of the document, epochs added up. A source's taken words are
    its target rounded down; the document at the cut gives only the words up
    to it. Null is a source of its own. Documents of one key (repeated ids)
    lie in the order of their sizes. Sources without words get no words, and
    an empty table no rows. `row_key`, if given, is added as a column of that name.
    """
    if most_epochs < 1 or min(weights) <= 0:
        raise ValueError("epochs and weights must be positive")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets
    extra = [] if row_key is None else [row_key.alias("row_key")]
    rows = saved(
        docs.select(
            F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(text_column).alias("size"), *extra
        )
        .withColumn("key", key)
        .withColumn("bucket", F.floor(bucket / F.lit(1 << 32)).cast("int"))
    )
    of_buckets = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = of_buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    wanted = targets(sizes, weights, most_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    plan = starts.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = placed["source"].eqNullSafe(plan["source"]) & (placed["bucket"] == plan["bucket"])
    at = F.col("start") + F.col("inside")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    left = F.col("budget") - F.col("epochs") * F.col("source_size")
    names = ["row_key"] if extra else []
    return (
        placed.join(plan, same)
        .select("id", placed["source"], "size", "source_size", "target", at.alias("at"), budget.alias("budget"), *names)
        .withColumn("epochs", epochs)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left - F.col("at"))))
        .select("id", "source", "size", "source_size", "target", "taken", *names)
    )


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them.

    A document stays whole: the one at the cut of a source counts as taken.
    Rows of which nothing is taken go, as do those without words. Repeated
    rows, equal in every column, are taken as often as all of them together.
    """
    columns = {"id_column": id_column, "text_column": text_column, "source_column": source_column}
    # Of the whole row: rows that differ in any column are counted and taken apart.
    key = F.xxhash64(F.struct("*"))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    counts = mixture(docs, row_key=key, **columns, **options).groupBy("row_key", "id").agg(F.sum(times).cast("int").alias("times"))
    # The row as one column, so that no name of its can clash.
    rows = docs.select(F.struct("*").alias("row"), key.alias("row_key"))
    both = rows.join(counts.where("times > 0"), "row_key").where(F.col(f"row.{id_column}").eqNullSafe(F.col("id")))
    once = both.dropDuplicates(["row_key", "id"])
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
