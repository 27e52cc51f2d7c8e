"""Training set curation: statistics, balancing, oversampling, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.functions import links as L
from schemaloom.functions import tokens as tok
from schemaloom.functions.arrays import any_of, let
from schemaloom.operators.joins import HOT_PART, hot_key_join, hot_keys

# Counts per database are broadcast up to this size: the names and ROW_BYTES for each.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 32
# Rows per piece when a group is numbered or repeated in pieces.
PIECE = 1_000_000
# A large group is cut into PARTS ranges at most; the sketch of its quantiles
# errs by 1 / ACCURACY of its rows, a tenth of such a range.
PARTS, ACCURACY = 1_024, 10_240
# Bounds that are compared one by one.
CHUNK = 32
# Slots of a seeded order.
SLOTS = 4_096


def db_counts(examples: DataFrame) -> DataFrame:
    return db_sizes(examples, "db_id")


def counts_size(counts: DataFrame) -> int:
    """Bytes of a broadcast of `counts`, by a distributed sum."""
    each = F.coalesce(F.octet_length("db_id"), F.lit(0)) + ROW_BYTES
    return counts.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def with_db_count(
    examples: DataFrame,
    counts: DataFrame | None = None,
    size: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each row with the size `n` of its database.

    Up to `broadcast_bytes` the counts are broadcast and the examples stay
    where they are; beyond, both are shuffled with hot databases salted. Who
    has the counts already gives them, and their `counts_size`.
    """
    if counts is None:
        counts = db_counts(examples)
    if size is None:
        size = counts_size(counts)
    if size <= broadcast_bytes:
        return examples.join(F.broadcast(counts), "db_id")
    return hot_key_join(examples, counts, "db_id", "question_id", counts=counts)


def dataset_stats(records: DataFrame, *keys: str) -> DataFrame:
    """One row of totals over records with `schema_links` and `is_oversampled`, or one for each value of `keys`.

    The counts per database are a relation of their own (`db_counts`): their
    number grows with the data and does not belong into one row.
    """
    links = F.col("schema_links")
    sized = records.select(
        *keys,
        "db_id",
        "is_oversampled",
        L.table_count(links).alias("tables"),
        L.column_count(links).alias("cols"),
        L.has_empty_table(links).alias("has_empty"),
    )
    return sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_distinct("db_id").alias("unique_databases"),
        F.count_if(F.col("tables") > 1).alias("multi_table_examples"),
        F.count_if(F.col("tables") <= 1).alias("single_table_examples"),
        F.count_if("has_empty").alias("empty_column_examples"),
        F.count_if(F.col("cols") >= 3).alias("many_column_examples"),
        F.count_if("is_oversampled").alias("oversampled_examples"),
        F.count_if(~F.col("is_oversampled")).alias("original_examples"),
        F.coalesce(F.avg("tables"), F.lit(0.0)).alias("avg_tables_per_example"),
        F.coalesce(F.avg("cols"), F.lit(0.0)).alias("avg_columns_per_example"),
        F.coalesce(F.max("tables"), F.lit(0)).alias("max_tables"),
        F.coalesce(F.max("cols"), F.lit(0)).alias("max_columns"),
    )


def light_target(n: Column, threshold: int) -> Column:
    """Twice the rows, but not beyond the threshold."""
    return F.least(2 * n, F.lit(threshold))


def light_balance(
    examples: DataFrame, threshold: int = 10, order: Sequence[str] = ("question_id",)
) -> DataFrame:
    """Add copies of the first rows, by `order`, of databases below the threshold.

    `order` has to identify a row; `readers.INPUT_ORDER` is that of the files.
    The rank filter reaches the map side of the shuffle (group limit), so a
    hot database sends only a handful of rows per task.
    """
    first = examples.withColumn(
        "_rn", F.row_number().over(W.partitionBy("db_id").orderBy(*order))
    ).where(F.col("_rn") <= max(1, threshold // 2))
    small = db_counts(examples).where(F.col("n") < threshold)
    copies = (
        first.join(small, "db_id")
        .where(F.col("_rn") <= light_target(F.col("n"), threshold) - F.col("n"))
        .drop("_rn", "n")
    )
    marked = lambda df, source, flag: df.withColumns(
        {"source": F.lit(source), "is_oversampled": F.lit(flag)}
    )
    return marked(examples, "original", False).unionByName(marked(copies, "oversampled", True))


def balance_log(examples: DataFrame, threshold: int = 10) -> DataFrame:
    """Databases that get copies: size before, target, copies added."""
    target = light_target(F.col("n"), threshold)
    return (
        db_counts(examples)
        .where(F.col("n") < threshold)
        .select(
            "db_id",
            F.col("n").alias("original_count"),
            target.alias("target_count"),
            (target - F.col("n")).alias("duplications_added"),
        )
        .where("duplications_added > 0")
    )


def _place(bounds: Column, x: Column) -> Column:
    """How many of the sorted bounds lie below `x`: first by chunks of them, then inside one."""
    below = lambda arr: F.size(F.filter(arr, lambda b: b < x))
    ends = F.filter(bounds, lambda _, i: i % CHUNK == CHUNK - 1)
    return let(CHUNK * below(ends), lambda skipped: skipped + below(F.slice(bounds, skipped + 1, CHUNK)))


def cut_groups(df: DataFrame, group: str, by: str, piece: int = PIECE, counts: DataFrame | None = None) -> DataFrame:
    """Rows with the `_piece` of their group that they are in: ranges of `by` behind each other.

    Groups of more than `piece` rows are cut at quantiles that a sketch of
    `by` gives, two ranges for every `piece` rows, so that ranges hold about as
    many rows however the numbers lie. Beyond `PARTS` ranges, and where groups
    of `piece` rows are less than 1 / `HOT_PART` of all, ranges grow instead
    of their number, which bounds the list that is broadcast.
    """
    sizes = db_sizes(df, group) if counts is None else counts
    share = sizes.agg(F.greatest(F.lit(piece), F.coalesce(F.sum("n"), F.lit(0)) / HOT_PART).alias("share")).scalar()
    parts = F.least(F.lit(PARTS), F.ceil(2 * F.col("n") / share)).cast("int").alias("_parts")
    hot = hot_keys(sizes, group, piece).select(group, parts)
    each = [i / PARTS for i in range(1, PARTS)]
    sketch = F.approx_percentile(by, each, ACCURACY).alias("_all")
    bounds = F.transform(
        F.sequence(F.lit(1), F.col("_parts") - 1),
        lambda i: F.element_at("_all", F.floor(i * PARTS / F.col("_parts")).cast("int")),
    )
    cuts = (
        df.select(group, by).join(F.broadcast(hot), group).groupBy(group).agg(F.max("_parts").alias("_parts"), sketch)
        .select(group, F.array_distinct(bounds).alias("_bounds"))
    )
    placed = F.when(F.col("_bounds").isNotNull(), _place(F.col("_bounds"), F.col(by))).otherwise(0)
    return df.join(F.broadcast(cuts), group, "left").withColumn("_piece", placed).drop("_bounds")


def db_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def numbered_in_group(
    df: DataFrame, group: str, by: str, piece: int = PIECE, counts: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group from 1 as `rn`, in the order of the unique whole number `by`.

    The ranges of a large group (`cut_groups`) are numbered one by one behind
    each other, so that no task has to sort a hot group. The numbers are the
    same whatever `piece` is. Who has the sizes `n` of these groups, or of
    more, gives them as `counts`.
    """
    cut = cut_groups(df, group, by, piece, counts)
    before = F.sum("_size").over(W.partitionBy(group).orderBy("_piece")) - F.col("_size")
    shifts = (
        cut.groupBy(group, "_piece")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", before)
        .drop("_size")
    )
    local = F.row_number().over(W.partitionBy(group, "_piece").orderBy(by))
    return (
        cut.withColumn("rn", local)
        .join(shifts, [group, "_piece"])
        .withColumn("rn", F.col("rn") + F.col("_before"))
        .drop("_piece", "_before")
    )


def repeated(df: DataFrame, times: str, number: str, piece: int = PIECE) -> DataFrame:
    """Each row `times` times, numbered from 1, in pieces spread over tasks."""
    pieces = df.where(F.col(times) > 0).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / piece)))
    )
    start = F.col("_piece") * piece
    here = F.sequence(start + 1, F.least(start + piece, F.col(times)))
    keys = [c for c in df.columns if c != times]
    return pieces.repartition(*keys, "_piece").withColumn(number, F.explode(here)).drop("_piece")


def _hash_below(n: Column, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def train_balance(examples: DataFrame, seed: int, floor: int = 18) -> DataFrame:
    """Fill small databases by seeded draws, then repeat multi-table rows once.

    The target is the average database size, at least `floor`. Draws are with
    replacement and depend only on seed, database and draw number, so a lost
    task draws the same again. `part` tells original, draw and extra apart.
    """
    counts = db_counts(examples)
    target = counts.agg(
        F.greatest(F.lit(floor), F.floor(F.sum("n") / F.count(F.lit(1)))).alias("target")
    ).scalar()
    short = counts.withColumn("need", (target - F.col("n")).cast("long")).where("need > 0")
    draws = repeated(short, "need", "draw").select(
        "db_id",
        "draw",
        (_hash_below(F.col("n"), F.lit(seed), F.col("db_id"), F.col("draw")) + 1).alias("rn"),
    )
    # Ids alone are numbered, of short databases only; the rest of a row follows once it is drawn.
    ids = examples.select("db_id", "question_id").join(short.select("db_id"), "db_id", "left_semi")
    drawn = numbered_in_group(ids, "db_id", "question_id", counts=counts).join(draws, ["db_id", "rn"]).drop("rn")
    drawn = examples.join(drawn, ["db_id", "question_id"]).withColumn("copy", F.col("draw").cast("long"))
    parts = F.array(F.lit("original"), F.when(L.table_count(F.col("schema_links")) >= 2, F.lit("extra")))
    kept = examples.withColumns({"part": F.explode(F.array_compact(parts)), "copy": F.lit(0).cast("long")})
    return kept.unionByName(drawn.drop("draw").withColumn("part", F.lit("draw")))


def is_target(
    db_id: Column,
    databases: Sequence[str] = V.TARGET_DATABASES,
    prefixes: Sequence[str] = V.TARGET_PREFIXES,
) -> Column:
    return any_of([db_id.isin(*databases)] + [db_id.startswith(p) for p in prefixes])


def target_oversample(
    examples: DataFrame,
    extra: int = 3,
    databases: Sequence[str] = V.TARGET_DATABASES,
    prefixes: Sequence[str] = V.TARGET_PREFIXES,
) -> DataFrame:
    """Rows of the target databases `extra` more times, numbered by `copy`."""
    copies = F.when(is_target(F.col("db_id"), databases, prefixes), F.lit(max(0, extra))).otherwise(F.lit(0))
    return examples.withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))


def shuffle_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_shuffle(df: DataFrame, seed: int, by: Sequence[str]) -> DataFrame:
    """Rows in a seeded order; `by` has to identify a row.

    The range exchange of the sort spreads the hash evenly over the tasks.
    """
    return (
        df.withColumn("_key", shuffle_key(seed, *[F.col(b) for b in by])).orderBy("_key", *by).drop("_key")
    )


def numbered_shuffle(df: DataFrame, seed: int, by: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Rows with their `place`, from 1, in the order of `seeded_shuffle`; `by` has to identify a row.

    Slots are ranges of the hash, so rows are numbered inside their slot and
    moved on by the rows of all slots before it: no task sees all rows, and
    the places do not depend on the number of slots.
    """
    key = df.withColumn("_key", shuffle_key(seed, *[F.col(b) for b in by]))
    # 32 bits of the hash, cut into ranges.
    slot = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * slots / (1 << 32)).cast("int")
    slotted = key.withColumn("_slot", slot)
    # One row per slot.
    earlier = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = db_sizes(slotted, "_slot").select("_slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_slot").orderBy("_key", *by))
    placed = slotted.withColumn("_inside", inside).join(F.broadcast(starts), "_slot")
    return placed.withColumn("place", F.col("_before") + F.col("_inside")).drop("_key", "_slot", "_inside", "_before")


def difficulty_rules(threshold: int) -> list[list[tuple[Column, int, Column]]]:
    """Rule groups as (condition, points, reason); the first hit of a group counts."""
    links, n, sql = F.col("schema_links"), F.col("n"), F.col("gold_sql")
    tables, columns, joins = L.table_count(links), L.column_count(links), tok.join_count(sql)
    tagged = lambda name, value: F.concat(F.lit(name + ":"), value.cast("string"))
    return [
        [
            (n < threshold, 5, tagged("underrepresented_db", n)),
            (n <= 12, 2, tagged("low_resource_db", n)),
        ],
        [(tables >= 3, 5, tagged("many_tables", tables)), (tables == 2, 3, F.lit("two_tables"))],
        [
            (columns >= 8, 4, tagged("many_columns", columns)),
            (columns >= 5, 2, tagged("medium_columns", columns)),
        ],
        [(L.has_empty_table(links), 4, F.lit("empty_column_table"))],
        [(joins >= 2, 3, tagged("multi_join", joins)), (joins == 1, 2, F.lit("join"))],
        [(tok.sql_contains(sql, V.GROUP_ORDER_FRAGMENTS), 2, F.lit("group_order_having"))],
        [(tok.sql_contains(sql, V.AGGREGATE_FRAGMENTS), 1, F.lit("aggregate_or_distinct"))],
        [(tok.sql_contains(sql, V.SUBQUERY_FRAGMENTS), 3, F.lit("subquery_or_top"))],
        [(tok.word_count(F.col("question")) >= 25, 1, F.lit("long_question"))],
    ]


def difficulty(examples: DataFrame, threshold: int = 10) -> DataFrame:
    """`score` and `reasons` of each example, beside its sizes and `n`."""
    points, reasons = F.lit(0), []
    for group in difficulty_rules(threshold):
        value, reason = F.lit(0), F.lit(None).cast("string")
        for condition, score, text in reversed(group):
            value = F.when(condition, F.lit(score)).otherwise(value)
            reason = F.when(condition, text).otherwise(reason)
        points = points + value
        reasons.append(reason)
    links = F.col("schema_links")
    return with_db_count(examples).withColumns(
        {
            "score": points,
            "reasons": F.array_compact(F.array(*reasons)),
            "num_tables": L.table_count(links),
            "num_columns": L.column_count(links),
        }
    )


def select_for_augmentation(
    scored: DataFrame, min_score: int = 9, max_examples: int = 90, order: Sequence[str] = ("question_id",)
) -> DataFrame:
    """The hardest examples above a score, hardest first; ties by `order`, for instance `readers.INPUT_ORDER`."""
    return (
        scored.where(F.col("score") >= min_score)
        .orderBy(
            F.col("score").desc(),
            F.col("num_tables").desc(),
            F.col("num_columns").desc(),
            F.col("n").asc(),
            *order,
        )
        .limit(max_examples)
    )


def selection_by_db(selected: DataFrame) -> DataFrame:
    return selected.groupBy("db_id").agg(F.count(F.lit(1)).alias("selected")).orderBy("db_id")
