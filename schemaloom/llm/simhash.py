"""Near-duplicates by SimHash: fingerprints, pigeonring links, components.

Two 64-bit fingerprints link at three or fewer differing bits. With four
segments of 16 bits in a ring, the pigeonring principle says that a linked
pair has a segment to start from at which the differences of the first 1, 2, 3
and 4 segments stay within their shares of the budget: 0, 1, 2 and 3 bits. So
the first segment is equal, and of the second at least one half is. These 24
bits are the key of a bucket; the longer chains are tested inside it before
the full distance.

A bucket yields links that connect what its pairs connect, never all pairs: a
fingerprint that has been reached is not compared again with those that were
reached before. Buckets beyond a block are split, and every two blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.components import components
from schemaloom.llm.shared import saved, text_of

SHINGLE = 3
SEED = 42
# Distinct fingerprints of a bucket that one task compares at most, twice.
BLOCK = 32_768
# Shingles of a text that are hashed at a time.
AT_ONCE = 65_536

SEGMENTS, BITS = 4, 16
# Differing bits allowed to the first 1, 2, 3 and 4 segments of a chain.
BUDGETS = (0, 1, 2, 3)


def fingerprint(text: bytes) -> int:
    """The fingerprint of UTF-8 bytes as a signed 64-bit number; zero without words."""
    # On bytes, lower() folds A-Z only, and split() knows just the six white spaces.
    words = text.lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    ones = np.zeros(64, np.int64)
    digest, space = xxhash.xxh64_intdigest, b" "
    for low in range(0, n, AT_ONCE):
        # The last shingle of a part takes words of the next one.
        part = words[low : low + AT_ONCE + SHINGLE - 1]
        own = zip(*(part[i:] for i in range(SHINGLE))) if len(part) >= SHINGLE else [part]
        hashes = np.fromiter((digest(space.join(s), SEED) for s in own), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the text, the last one, and its fingerprint."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = pa.array([fingerprint(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (`id`, `fp`), one per row of `docs`. A null text counts as empty, with fingerprint zero."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(_fingerprints, rows.select("id", F.lit(0).cast("long").alias("fp")).schema)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << BITS) - 1))


def bucket_keys(fp: Column) -> Column:
    """The eight keys of a fingerprint: start, half, first segment, half of the second."""
    out = []
    for start in range(SEGMENTS):
        for half in range(2):
            second = F.shiftrightunsigned(_segment(fp, start + 1), half * BITS // 2).bitwiseAND(F.lit((1 << BITS // 2) - 1))
            first = F.shiftleft(_segment(fp, start), BITS // 2)
            out.append(F.shiftleft(F.lit(start * 2 + half).cast("long"), 24).bitwiseOR(first).bitwiseOR(second))
    return F.array(*out)


def _chain_masks(start: int) -> list[np.uint64]:
    """Masks of the first 1, 2, 3 and 4 segments from `start` on."""
    segment, mask, out = (1 << BITS) - 1, 0, []
    for i in range(SEGMENTS):
        mask |= segment << (BITS * ((start + i) % SEGMENTS))
        out.append(np.uint64(mask))
    return out


def linked(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Places of `others` whose chains from `start` keep every budget."""
    differ = others ^ one
    at = np.arange(len(others))
    for mask, budget in zip(_chain_masks(start), BUDGETS):
        fine = np.bitwise_count(differ[at] & mask) <= budget
        at = at[fine]
    return at


def bucket_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join just what all links inside a bucket join."""
    out, rest = [], fps.view(np.uint64)
    while len(rest) > 1:
        # All that the first one reaches, one after the other.
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            at = linked(one, rest, start)
            if len(at):
                near = rest[at]
                a = int(np.uint64(one).view(np.int64))
                out += [(a, b) for b in near.view(np.int64).tolist()]
                front += list(near)
                rest = np.delete(rest, at)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, fps = None, []

    def flush():
        if len(fps) > 1:
            found = bucket_links(np.array(fps, np.int64), (key[0] >> 24) // 2)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for *now, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", "fp"))):
            if now != key:
                yield from flush()
                key, fps = now, []
            fps.append(fp)
    yield from flush()


def links(distinct_fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (`a`, `b`) between distinct fingerprints `fp`, enough to connect all that link."""
    keyed = saved(distinct_fps.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = saved(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = keyed.join(blocks, "key").withColumn("no", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Block no meets every other: it goes to the pairs (no, i) and (i, no).
    pairs = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    laid = pairs.select("key", F.least("no", "i").alias("x"), F.greatest("no", "i").alias("y"), "fp")
    return laid.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "fp").mapInArrow(_links, "a long, b long")


def _grouped(rows: DataFrame, block: int) -> DataFrame:
    """(`fp`, `root`, `component`) of every fingerprint of `rows` (`id`, `fp`)."""
    # The rows of a fingerprint may be many; they shrink before they move.
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(distinct.select("fp"), block))
    named = found.withColumnRenamed("node", "fp")
    reached = saved(distinct.join(named, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = saved(reached.groupBy("root").agg(F.min("least").alias("component")))
    return saved(reached.select("fp", "root").join(smallest, "root").select("fp", "root", "component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (`id`, `fp`, `component`), one for each row of `docs`.

    `component` is the smallest id that links reach, the row's own included;
    null ids count as larger than all others. Rows with one fingerprint are
    linked, also those without words (fingerprint zero). Repeated rows get
    equal answers. An empty table gives no rows.
    """
    rows = saved(fingerprints(docs, id_column, text_column))
    return rows.join(_grouped(rows, block).select("fp", "component"), "fp").select("id", "fp", "component")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group the one with the smallest id.

    Null ids count as larger than all others. Of rows that repeat the smallest
    id of a group, the one with the smallest text by its hash stays; so it does
    in groups without any id. Every group keeps one row.
    """
    text_hash = F.sha2(text_of(text_column), 256)
    marked = docs.select(F.col(id_column).alias("id"), F.unhex(text_hash).alias("hash"), text_of(text_column).alias("text"))
    rows = saved(marked.mapInArrow(_fingerprints, marked.select("id", "hash", F.lit(0).cast("long").alias("fp")).schema))
    groups = _grouped(rows.select("id", "fp"), BLOCK).select("fp", "root")
    # Of a fingerprint only the best row can be the best of its group.
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")
    best = rows.groupBy("fp").agg(F.min(rank).alias("best")).join(groups, "fp").groupBy("root").agg(F.min("best").alias("best"))
    # Equal texts have one fingerprint, so an id and a text belong to one group only.
    keep = best.select(F.xxhash64("best.id").alias("id_hash"), F.col("best.hash").alias("hash"), F.col("best.id").alias("keep_id"))
    # The row as one column, so that no name of its can clash.
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(id_column).alias("id_hash"), F.unhex(text_hash).alias("hash"))
    both = own.join(keep, ["id_hash", "hash"]).where(F.col(f"row.{id_column}").eqNullSafe(F.col("keep_id")))
    return both.dropDuplicates(["id_hash", "hash"]).select("row.*")
