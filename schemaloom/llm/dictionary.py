"""Global ids for the words of many shards.

Every shard has its distinct words as a local dictionary, ordered by a hash;
its codes are the places in it. The local dictionaries are cut into buckets,
ranges of the hash with a bounded number of entries; a bucket sums up what its
shards say of a word, sorts its words and numbers them; prefix sums over the
buckets turn that into ids of the whole table. So a word moves once per shard
that holds it, and not once per document, and no task and no driver holds the
whole dictionary.

Words never hold a line feed, so a run of them travels as one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm.shared import stored

# Local entries that a bucket has on average.
ENTRIES = 250_000

PIECE = "part string, bucket long, shard string, start int, words string, counts binary"
ANSWER = "part string, bucket long, shard string, start int, words string, rank binary, total binary, before binary, n long, mass long"


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        starts = np.cumsum(lengths) - lengths
        data = (data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)]
        out = np.zeros(len(words), np.uint64)
        if len(data):
            out[lengths > 0] = np.add.reduceat(data, starts[lengths > 0])
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The code of every word, and the distinct words in the order of their codes."""
    found = words.dictionary_encode()
    order = np.argsort(hashes(found.dictionary), kind="stable")
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    return code[found.indices.to_numpy()], found.dictionary.take(pa.array(order))


def joined(words: pa.Array) -> str:
    return "\n".join(words.to_pylist())


def lists(values: pa.Array | np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists of `values`, the i-th up to `ends[i]`."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Local dictionaries by bucket."""
        for batch in batches:
            for part, shard, words, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "words", "counts"))):
                if not words:
                    continue
                split = words.split("\n")
                # Codes are in the order of the hash, and so are the buckets.
                own = ((hashes(pa.array(split)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                edges = list(zip(first.tolist(), [*first[1:].tolist(), len(own)]))
                columns = [
                    pa.repeat(part, len(edges)), pa.array(own[first]), pa.repeat(shard, len(edges)), pa.array(first.astype(np.int32)),
                    pa.array(["\n".join(split[a:b]) for a, b in edges]),
                    pa.array([None if counts is None else counts[8 * a : 8 * b] for a, b in edges], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "bucket", "shard", "start", "words", "counts"])

    return run


def _numbered(least: int, sums: bool):
    def run(table: pa.Table) -> pa.Table:
        """Ranks and sums of one bucket's words: a row for each shard, and one without shard for the words."""
        n, runs = len(table), pc.split_pattern(table.column("words").combine_chunks(), "\n")
        found = runs.flatten().dictionary_encode()
        which = found.indices.to_numpy()
        # As bytes the words sort as UTF-8 does.
        sorted_ = pc.sort_indices(found.dictionary.cast(pa.binary())).to_numpy()
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64) if sums else np.ones(len(which), np.int64)
        total = np.zeros(len(sorted_), np.int64)
        np.add.at(total, which, counts)
        kept = sorted_[total[sorted_] >= least]
        rank, before = np.full(len(total), -1, np.int32), np.zeros(len(total), np.int64)
        rank[kept], before[kept] = np.arange(len(kept)), np.cumsum(total[kept]) - total[kept]
        ends = np.cumsum(pc.list_value_length(runs).to_numpy())

        def packed(values: np.ndarray) -> list[bytes]:
            own = values[which]
            return [own[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]

        none = [None] * n
        text, mass = joined(found.dictionary.take(pa.array(kept))), int(total[kept].sum())
        columns = {
            "part": [*table.column("part").to_pylist(), table.column("part")[0].as_py()],
            "bucket": [table.column("bucket")[0].as_py()] * (n + 1),
            "shard": [*table.column("shard").to_pylist(), None],
            "start": [*table.column("start").to_pylist(), None],
            "words": [*none, text],
            "rank": [*packed(rank), None],
            "total": [*(packed(total) if sums else none), total[kept].tobytes() if sums else None],
            "before": [*(packed(before) if sums else none), None],
            "n": [*none, len(kept)],
            "mass": [*none, mass],
        }
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), *[pa.binary()] * 3, pa.int64(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(columns.values(), types)], names=list(columns))

    return run


def numbered(local: DataFrame, least: int = 1, entries: int = ENTRIES, sums: bool = True) -> DataFrame:
    """Answers of all buckets, computed once, with `first` and `before_all`: the ids and the counts of all buckets before.

    `local` has rows (`part`, `shard`, `n`, `words`, `counts`): a local
    dictionary of `n` words and their counts, packed. Words of different parts
    are different words; a shard has one part. Only words whose counts sum up
    to `least` get an id; without `sums`, counts are null and none is summed.
    Empty dictionaries and an empty table give no answers.
    """
    (size,) = local.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    cut = local.select("part", "shard", "words", "counts").mapInArrow(_cut(max(1, -(-size // entries))), PIECE)
    answers = stored(cut.groupBy("part", "bucket").applyInArrow(_numbered(least, sums), ANSWER), "dictionary")
    # One row per bucket.
    earlier = Window.orderBy("part", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = answers.where("shard IS NULL").select(
        "part", "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
        F.coalesce(F.sum("mass").over(earlier), F.lit(0)).alias("before_all"),
    )
    return answers.join(starts, ["part", "bucket"])


def by_shard(answers: DataFrame) -> DataFrame:
    """(`shard`, `blocks`): all answers to a shard, in the order of its codes."""
    block = F.struct("start", "first", "before_all", "rank", "total", "before")
    return answers.where("shard IS NOT NULL").groupBy("shard").agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, words, total, n in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "words", "total", "n"))):
            if n:
                totals = pa.nulls(n, pa.int64()) if total is None else pa.array(np.frombuffer(total, np.int64))
                columns = [pa.repeat(part, n), pa.array(first + np.arange(n)), pa.array(words.split("\n")), totals]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "word_id", "word", "total"])


def words(answers: DataFrame) -> DataFrame:
    """The dictionary: (`part`, `word_id`, `word`, `total`)."""
    rows = answers.where("shard IS NULL").select("part", "first", "words", "total", "n")
    return rows.mapInArrow(_unpacked, "part string, word_id long, word string, total long")


def _values(blocks: list[dict], name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(b[name] for b in blocks), kind)


def ids_of(blocks: list[dict]) -> np.ndarray:
    """Global ids in the order of a shard's codes; -1 for words without one."""
    rank = _values(blocks, "rank", np.int32).astype(np.int64)
    return np.where(rank < 0, -1, rank + _repeated(blocks, "first"))


def starts_of(blocks: list[dict]) -> np.ndarray:
    """The counts of all words that come before a word in the order of ids."""
    return _values(blocks, "before", np.int64) + _repeated(blocks, "before_all")


def totals_of(blocks: list[dict]) -> np.ndarray:
    return _values(blocks, "total", np.int64)


def _repeated(blocks: list[dict], name: str) -> np.ndarray:
    return np.repeat([b[name] for b in blocks], [len(b["rank"]) // 4 for b in blocks])
