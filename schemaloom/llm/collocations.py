"""Collocations of all texts from suffix subtrees that are built apart.

Vertical partitioning: the words, in the order of the global dictionary, are
grouped by their counts, so that all suffixes that begin with a group's words
fit a memory budget. A word beyond the budget is a prefix too short: its
suffixes are told apart by all their words and shared among the groups that its
own count covers. Suffixes end after the longest phrase (or with their piece),
so a subtree has a bounded depth. Each shard of texts builds its part of every
group's subtree and sends only the leaves with their counts; a group merges
them and reads the count of every phrase from the leaves below its node.

Words too rare for any phrase end a suffix like the end of a piece: a phrase
with such a word is as rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm import dictionary
from schemaloom.llm.dictionary import lists
from schemaloom.llm.ragged import slices
from schemaloom.llm.shared import stored, text_of

# Occurrences of suffixes in a group: about 40 bytes each while they are merged.
GROUP = 2_000_000
UNKNOWN = "und"

# Bytes of words (0), between words (1) and between pieces (2).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes, compressed place by place."""
    return pa.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(8, n).T.copy().view("<i8").reshape(n)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and for each whether it begins a piece."""
    data = np.frombuffer(b"\n".join(pc.ascii_lower(texts).cast(pa.binary()).to_pylist()), np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.r_[False, inside, False].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    breaks = np.flatnonzero(kind == 2)
    before = np.searchsorted(breaks, starts)
    return words.cast(pa.string()), np.diff(before, prepend=-1) > 0


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one part as codes of their own words."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        which = parts.indices.to_numpy()
        for i, part in enumerate(parts.dictionary.to_pylist()):
            for texts in slices(batch.column("text").filter(pa.array(which == i))):
                found, begins = words_of(texts)
                codes, words = dictionary.coded(found)
                counts = np.bincount(codes, minlength=len(words)).astype(np.int64)
                columns = {
                    "shard": [f"{task}-{n}"], "part": [part], "n": [len(words)], "words": [dictionary.joined(words)],
                    "counts": [counts.tobytes()], "length": [len(codes)], "codes": [packed(codes)],
                    "begins": [np.packbits(begins).tobytes()],
                }
                n += 1
                yield pa.RecordBatch.from_pydict(columns)


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row, in the order of the rows; the entries are -1 or larger."""
    key, size = columns[0] + 1, int(columns[0].max(initial=-1)) + 2
    for c in columns[1:]:
        more = int(c.max(initial=-1)) + 2
        if size * more >= 1 << 63:
            known, key = np.unique(key, return_inverse=True)
            size = len(known)
        key, size = key * more + c + 1, size * more
    return key


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    key = _keys(columns)
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at = order[first]
    return [c[at] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _leaves(longest: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's suffixes of two words or more, cut to `longest`, counted and dealt to groups."""
        for batch in batches:
            names = ("part", "length", "codes", "begins", "blocks")
            for part, length, codes, begins, blocks in zip(*(batch.column(c).to_pylist() for c in names)):
                if not blocks or not length:
                    continue
                own = unpacked(codes, length)
                ids, start, total = (f(blocks) for f in (dictionary.ids_of, dictionary.starts_of, dictionary.totals_of))
                begins = np.unpackbits(np.frombuffer(begins, np.uint8), count=length).astype(bool)
                # Local codes sort faster than ids; -1 ends a suffix.
                word = np.where(ids[own] >= 0, own, -1)
                suffix = [word]
                for k in range(1, longest):
                    # The word k places on, unless a piece begins there or the suffix has ended.
                    follows = np.full(length, -1)
                    follows[: max(length - k, 0)] = np.where(begins[k:], -1, word[k:])
                    suffix.append(np.where(suffix[-1] >= 0, follows, -1))
                full = suffix[1] >= 0
                if not full.any():
                    continue
                suffix, counts = _summed([c[full] for c in suffix], np.ones(int(full.sum()), np.int64))
                where = start[suffix[0]] // group
                split = total[suffix[0]] > group
                as_ids = [np.where(c >= 0, ids[c], -1) for c in suffix]
                # A prefix beyond the budget: all words of the suffix choose one of its groups.
                mixed = np.zeros(int(split.sum()), np.uint64)
                for c in as_ids[1:]:
                    mixed = (mixed ^ (c[split].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                parts = -(-total[suffix[0][split]] // group)
                where[split] += (mixed % parts.astype(np.uint64)).astype(np.int64)
                key = where * 2 + split
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                rows = []
                for a, b in zip(first, [*first[1:], len(order)]):
                    at = order[a:b]
                    rows.append((part, int(where[at[0]]), bool(split[at[0]]), len(at), [packed(c[at]) for c in as_ids], packed(counts[at])))
                types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.binary()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "group", "split", "n", "ids", "counts"]
                )

    return run


def _counted(longest: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        """Merge a group's leaves and read off the counts of the phrases above them."""
        sizes = table.column("n").to_pylist()
        columns = [
            np.concatenate([unpacked(x[k], n) for x, n in zip(table.column("ids").to_pylist(), sizes)]) for k in range(longest)
        ]
        counts = np.concatenate([unpacked(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes)])
        columns, counts = _summed(columns, counts)
        split, ids, ends, sums = table.column("split")[0].as_py(), [], [], []
        for m in range(2, longest + 1):
            # Leaves are in order, so those below one node stand together.
            deep = columns[m - 1] >= 0
            head = [c[deep] for c in columns[:m]]
            new = np.flatnonzero(np.any([np.diff(c, prepend=-2) != 0 for c in head], axis=0))
            if not len(new):
                continue
            total = np.add.reduceat(counts[deep], new)
            # What other groups hold of a split prefix is not known here; its longest phrases are whole.
            kept = total >= (1 if split and m < longest else least)
            ids.append(np.stack([c[new][kept] for c in head], axis=1).ravel())
            ends.append(np.full(int(kept.sum()), m))
            sums.append(total[kept])
        empty = [np.zeros(0, np.int64)]
        flat, sizes, sums = (np.concatenate(x or empty) for x in (ids, ends, sums))
        part = pa.repeat(table.column("part")[0].as_py(), len(sums)).cast(pa.string())
        return pa.table([part, lists(flat, np.cumsum(sizes)), pa.array(sums)], names=["part", "ids", "a"])

    return run


def phrases(
    docs: DataFrame, longest: int, least: int, text_column: str = "text", part_column: str = "lang", group: int = GROUP
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of phrases, of words, and of all words of a part.

    (`part`, `ids`, `a`): phrases of 2 to `longest` words that occur `least`
    times or more in the texts of a part, as word ids; (`part`, `word_id`,
    `word`, `total`): the words that do; (`part`, `n`). A-Z count as lower
    case; `.,;:!?` and line ends end a piece, and no phrase goes on behind it.
    A null text is empty, a null part is `und`; repeated rows count each. No
    texts give no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur")
    rows = docs.select(F.coalesce(F.col(part_column), F.lit(UNKNOWN)).alias("part"), text_of(text_column).alias("text"))
    schema = "shard string, part string, n long, words string, counts binary, length long, codes binary, begins binary"
    shards = stored(rows.mapInArrow(_shards, schema), "shards")
    answers = dictionary.numbered(shards, least)
    both = shards.drop("words", "counts", "n").join(dictionary.by_shard(answers), "shard")
    leaves = both.mapInArrow(
        _leaves(longest, group), "part string, group long, split boolean, n int, ids array<binary>, counts binary"
    )
    merged = leaves.groupBy("part", "group", "split").applyInArrow(_counted(longest, least), "part string, ids array<long>, a long")
    known = stored(merged, "phrases")
    # Only phrases whose prefix is split come in several rows.
    whole = known.groupBy("part", "ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return whole, dictionary.words(answers), shards.groupBy("part").agg(F.sum("length").alias("n"))


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    covered: int = 50,
    first: int = 2000,
    text_column: str = "text",
    part_column: str = "lang",
    group: int = GROUP,
) -> DataFrame:
    """Rows (`part`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`): the `first` phrases of each part.

    A phrase that occurs `a` times is cut in two after every word; the cut with
    the lowest floor(10^6 a^2 / (l r)), l and r being the counts of its two
    ends, gives the score, the first of equals. Phrases inside a longer one
    with `covered` in a hundred of their occurrences or more are left out.
    Order: score and `a` down, then the phrase in the order of its bytes.
    See `phrases` for what counts as a phrase, nulls and empty tables.
    """
    counted, known, sizes = phrases(docs, longest, least, text_column, part_column, group)
    counted = stored(counted, "counted")
    ends = counted.select("ids", F.col("a").alias("c")).unionByName(known.select(F.array("word_id").alias("ids"), F.col("total").alias("c")))
    at = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cuts = counted.select("part", "ids", "a", at).select(
        "*", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right")
    )
    cuts = cuts.join(ends.select(F.col("ids").alias("left"), F.col("c").alias("l")), "left")
    cuts = cuts.join(ends.select(F.col("ids").alias("right"), F.col("c").alias("r")), "right")
    # 16 digits a count: the products stay below 38.
    score = F.expr(
        "(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * CAST(1000000 AS DECIMAL(7,0)))"
        " DIV (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))"
    )
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("part", "ids", "a").agg(lowest.alias("cut")).select("part", "ids", "a", "cut.score", "cut.l", "cut.r")
    # The contiguous shorter phrases of each phrase.
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.size("ids") - 1),
                lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m)),
            )
        )
    ).alias("ids")
    around = counted.where(F.size("ids") > 2).select(inner, F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    left = scored.join(around, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    # Ties stay in until the words are known.
    place = F.rank().over(Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a")))
    best = left.withColumn("place", place).where(F.col("place") <= first).drop("place", "longer")
    named = (
        best.select("part", "ids", "a", "l", "r", "score", F.posexplode("ids").alias("i", "word_id"))
        .join(known.select("word_id", "word"), "word_id")
        .groupBy("part", "ids", "a", "l", "r", "score")
        .agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
        .withColumn("phrase", F.array_join("w.word", " "))
    )
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(sizes, "part").select("part", "rank", "phrase", "a", "l", "r", "n", "score")
