"""Helpers of the operators: tables, shared folders, fixed patterns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as white space, and words between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the folder that the cluster shares.

    `spark.checkpoint.dir` names it. Where that is unset, a temporary folder
    takes its place in local mode only, as in tests; on a cluster, whose
    executors would each write to their own disk, it is an error.
    """
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` computed once, in files that outlive any executor."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a table in the shared folder, so that later steps read only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is not None:
        return given
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    known = spark.conf.get("schemaloom.llm.folder", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("schemaloom.llm.folder", known)
    return known


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


# Ids of a filter are marked in so many bits each, and in a bitmap of BLOCK bits a row;
# all rows together stay below MOST_BITS, 64 MB.
BITS_EACH, BLOCK, MOST_BITS = 32, 1 << 15, 1 << 29


def likely_in(rows: DataFrame, id_column: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose id may be among the `n` of `ids` (`id`): all that are, and few others.

    A bitmap of the ids' hashes is broadcast, at most 64 MB of it, so rows
    drop out before any shuffle. With more than 10^8 ids it lets more and more
    others through; an exact join has to follow in any case.
    """
    blocks = 1
    while blocks * BLOCK < min(n * BITS_EACH, MOST_BITS):
        blocks *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks * BLOCK))
    at = ids.select(place("id").alias("at"))
    marks = at.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("at") % BLOCK).alias("marks"))
    # The row as one column, so that no name of its can clash.
    placed = rows.select(F.struct("*").alias("row"), place(id_column).alias("at"))
    found = placed.join(F.broadcast(marks), F.floor(F.col("at") / BLOCK) == F.col("block"))
    # Bit i of a bitmap is bit i % 8, from the lowest, of byte i div 8.
    byte = F.conv(F.hex(F.substring("marks", (F.col("at") % BLOCK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), F.col("at") % 8).cast("int")
    return found.where(byte.bitwiseAND(bit) > 0).select("row.*")
