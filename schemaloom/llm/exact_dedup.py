"""Exact dedup by a tree of merged digest runs, in DataFrame operations.

Rows are dealt over runs by a hash, and combined on the map side: a run holds
one entry per text, with its best row, the number of rows and the evidence.
Runs are then merged in binomial rounds. In round r, run i + 2^r joins run i:
both come to one partition, sorted by digest, and one pass over the sorted
entries keeps the best row of each text whose evidence agrees, until run 0 is
left. An entry stands for many rows, so a text with a third of all rows moves
as one row per run. No run is ever whole in one task: the digests are cut into
shards of `SHARD_ENTRIES` entries, each with a tree of its own, and all trees
go through a round together. The answers go down the same way: to the first
runs, and there to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import SPACE, saved, text_of

# First runs; log2 of them is the number of rounds.
RUNS = 8
# Entries of all runs that one shard has on average. The number of shards grows with the input.
SHARD_ENTRIES = 100_000

# Entries are the same text only if all of these agree: a SHA-256, a second
# hash of another family, and the length.
EVIDENCE = ["digest", "check", "length"]


def normalized(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(`id`, `points`, evidence, `run`) of every row."""
    raw = text_of(text_column)
    plain = docs.select(F.col(id_column).alias("id"), F.char_length(raw).alias("points"), normalized(raw).alias("plain"))
    out = plain.select(
        "id", "points", F.sha2("plain", 256).alias("hex"), F.xxhash64("plain").alias("check"),
        F.octet_length("plain").alias("length"),
    )
    run = F.pmod(F.xxhash64("id", "points"), F.lit(RUNS)).cast("int")
    return out.select("id", "points", F.unhex("hex").alias("digest"), "check", "length", run.alias("run"))


def _best(entries: DataFrame, *keys: str) -> DataFrame:
    """One entry per text and `keys`: the most code points, then the smallest id, null last."""
    return entries.groupBy(*keys, *EVIDENCE).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merged(runs: DataFrame) -> DataFrame:
    """The runs of one number in one partition per shard, sorted and merged in one pass.

    The exchange is by run and not by text, and the aggregate that follows it
    reads the sorted partition as it lies.
    """
    together = runs.repartition("shard", "run").sortWithinPartitions("shard", "run", *EVIDENCE)
    return _best(together, "shard", "run")


def tree_merge(first: DataFrame, shards: int) -> DataFrame:
    """One entry per text out of the entries (`run`, evidence, `best`, `n`) of all first runs."""
    entries = first.withColumn("shard", F.pmod("check", F.lit(shards)))
    step = 1
    while step < RUNS:
        # Run i + step goes to run i; the others stay.
        entries = merged(entries.withColumn("run", F.col("run") - F.col("run").bitwiseAND(F.lit(step))))
        step *= 2
    return entries


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (`id`, `keep_id`, `group_size`, `kept`, `text_sha256`), one for each row of `docs`.

    Texts are equal when they are without white space. The row with the most
    code points, then with the smallest id, stays; a null id comes last. A
    null text is empty, and all empty texts are equal. Repeated rows count
    each; those that tie with the row that stays are all marked kept. An empty
    table gives no rows.
    """
    out = _answered(docs, id_column, text_column)
    return out.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _answered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(`id`, `points`, `digest`, `keep_id`, `group_size`, `kept`) of every row."""
    rows = saved(digests(docs, id_column, text_column))
    # The smallest struct is the best row: most points first, ids without null first.
    best = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("no_id"), F.col("id"))
    first = saved(_best(rows.select("run", *EVIDENCE, best.alias("best"), F.lit(1).cast("long").alias("n")), "run"))
    entries = tree_merge(first, max(1, -(-first.count() // SHARD_ENTRIES)))
    answers = entries.select(*EVIDENCE, F.col("best.id").alias("keep_id"), F.col("best.points").alias("most"), F.col("n").alias("group_size"))
    down = first.select("run", *EVIDENCE).join(answers, EVIDENCE)
    out = rows.join(down, ["run", *EVIDENCE])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == -F.col("most"))
    return out.select("id", "points", "digest", "keep_id", "group_size", kept.alias("kept"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per text.

    Of rows that tie by code points and id, the one with the smallest text by
    its hash stays.
    """
    keep = _answered(docs, id_column, text_column).where("kept").select(
        F.xxhash64("id").alias("id_hash"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("id").alias("keep_id"), F.col("points").alias("most")
    )
    raw = text_of(text_column)
    digest = F.sha2(normalized(raw), 256).alias("text_sha256")
    # The row as one column, so that no name of its can clash.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(id_column).alias("id_hash"), digest, F.char_length(raw).alias("points"))
    both = rows.join(keep.distinct(), ["id_hash", "text_sha256"]).where("points = most")
    mine = both.where(F.col(f"row.{id_column}").eqNullSafe(F.col("keep_id")))
    # Of rows that tie one; the join has brought them together.
    by_text = F.min_by("row", F.sha2(text_of(f"row.{text_column}"), 256)).alias("row")
    return mine.groupBy("id_hash", "text_sha256").agg(by_text).select("row.*")
