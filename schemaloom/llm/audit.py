"""What each filter removes alone, first and after others, from a sparse document-term matrix.

Tasks turn slices of documents into shards of a sparse matrix in CSR form,
with codes of the slice's own words. The codes become ids of one dictionary
of all words (`dictionary.py`), so all shards are rows of one matrix. A row's
sum is a document's number of words and its stored entries are its distinct
words; these two decide the filters on length and repetition. The flags of the
other filters were taken while the text was at hand. Per part there are at
most 32 x 4 kinds of documents, and every order of the filters is worked out
on their counts alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm import dictionary
from schemaloom.llm.dictionary import lists
from schemaloom.llm.ragged import slices
from schemaloom.llm.shared import saved, stored, text_of

# Limits of the filters: words at least, distinct words and capitals in a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
# Every byte of UTF-8 but those that continue a character.
_POINT = np.ones(256, np.uint8)
_POINT[0x80:0xC0] = 0


def _sums(marks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.int64)
    if len(marks):
        out[lengths > 0] = np.add.reduceat(marks, starts[lengths > 0], dtype=np.int64)
    return out


def csr(rows: np.ndarray, codes: np.ndarray, n_rows: int, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, codes and counts of the entries (row, code), repeats counted."""
    keys = np.sort(rows * max(n_codes, 1) + codes)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    which = keys[first] // max(n_codes, 1)
    ends = np.cumsum(np.bincount(which, minlength=n_rows))
    return ends, (keys[first] - which * n_codes).astype(np.int32), counts.astype(np.int32)


def packed(codes: np.ndarray) -> bytes:
    """Codes as bytes, compressed place by place: high bytes hardly change along a row."""
    return pa.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(4, n).T.copy().view("<i4").reshape(n)


def _shard(name: str, ids: pa.Array, parts: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """A slice of documents as one shard with local codes."""
    split = pc.ascii_split_whitespace(texts)
    flat, per_row = split.flatten(), pc.list_value_length(split).to_numpy()
    # Leading and trailing white space leaves empty words.
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    codes, words = dictionary.coded(flat.filter(pa.array(full)))
    ends, codes, counts = csr(np.repeat(np.arange(len(texts)), per_row)[full], codes, len(texts), len(words))

    raw = texts.cast(pa.binary()).to_pylist()
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(raw), np.uint8)
    capitals, points, symbols = (_sums(marks[data], starts, lengths) for marks in (_CAPITAL, _POINT, _SYMBOL))
    digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
    one = np.array([len(texts)])
    columns = {
        "shard": pa.array([name]), "ids": lists(ids, one), "parts": lists(parts, one),
        "capitals": lists(100 * capitals > MOST_CAPITALS * points, one), "symbols": lists(symbols > 0, one),
        "digests": lists(digests, one), "ends": lists(ends, one),
        "codes": pa.array([packed(codes)]), "counts": pa.array([packed(counts)]),
        "n": pa.array([len(words)]), "words": pa.array([dictionary.joined(words)]),
    }
    return pa.RecordBatch.from_pydict(columns)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        low = 0
        for texts in slices(batch.column("text")):
            own = slice(low, low + len(texts))
            yield _shard(f"{task}-{n}", batch.column("id")[own], batch.column("part")[own], texts)
            low, n = low + len(texts), n + 1


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with global ids in place of local codes."""
    names = ["shard", "ids", "parts", "capitals", "symbols", "digests", "ends"]
    for batch in batches:
        for i in range(len(batch)):
            row, ends = batch.slice(i, 1), batch.column("ends")[i].values
            n = ends[len(ends) - 1].as_py()
            codes, counts = (unpacked(batch.column(c)[i].as_py(), n) for c in ("codes", "counts"))
            blocks = batch.column("blocks")[i].as_py()
            # A shard of empty texts only has no words and no answer.
            columns = dictionary.ids_of(blocks)[codes] if blocks else np.zeros(0, np.int64)
            arrays = [*(row.column(c) for c in names), lists(columns, np.array([n])), lists(counts, np.array([n]))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "columns", "counts"])


def matrix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of `docs` and its dictionary.

    A row of the first is a shard in CSR form: row i has the entries from
    `ends[i - 1]` to `ends[i]` of `columns` (word ids) and `counts`; `ids`,
    `parts`, `capitals`, `symbols` and `digests` belong to its rows. The second
    is (`word_id`, `word`). Words are what stands between white
    space, with their case. A null text is empty and has an empty row, a null
    part is an empty string; repeated rows have a row each. An empty table has
    no shards.
    """
    part = F.coalesce(F.col(part_column), F.lit("")).alias("part")
    rows = docs.select(F.col(id_column).alias("id"), part, text_of(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    carried = (
        f"ids array<{kind}>, parts array<string>, capitals array<boolean>, symbols array<boolean>, "
        "digests array<binary>, ends array<long>"
    )
    shards = stored(
        rows.mapInArrow(
            _shards, f"shard string, {carried}, codes binary, counts binary, n long, words string"
        ),
        "shards",
    )
    local = shards.select(F.lit("").alias("part"), "shard", "n", "words", F.lit(None).cast("binary").alias("counts"))
    answers = dictionary.numbered(local, sums=False)
    both = shards.drop("words", "n").join(dictionary.by_shard(answers), "shard", "left")
    encoded = both.mapInArrow(_encoded, f"shard string, {carried}, columns array<long>, counts array<int>")
    return encoded, dictionary.words(answers).select("word_id", "word")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and stored entries of every row of the shards."""
    for batch in batches:
        for i in range(len(batch)):
            ends, counts = batch.column("ends")[i].values.to_numpy(), batch.column("counts")[i].values.to_numpy()
            lengths = np.diff(np.r_[0, ends])
            columns = [batch.column(c)[i].values for c in ("ids", "parts", "capitals", "symbols", "digests")]
            columns += [pa.array(_sums(counts, ends - lengths, lengths)), pa.array(lengths)]
            names = ["id", "part", "capitals", "symbols", "digest", "words", "kinds"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def failures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """(`id`, `part`, `fails`) of every row of `docs`: the letters of the filters that it fails.

    A: under 100 words. B: under 80 distinct words in a hundred. C: over 10
    capitals A-Z in a hundred characters. D: holds one of `#$%&*|`. E: another
    row with a smaller id has the same text. An empty text fails A only, and E
    if it is not the first. A null id is neither smaller nor larger than any.
    Repeated rows with one id do not make each other fail.
    """
    shards, _ = matrix(docs, id_column, text_column, part_column)
    kind = docs.schema[id_column].dataType.simpleString()
    measured = saved(
        shards.drop("columns").mapInArrow(
            _measured, f"id {kind}, part string, capitals boolean, symbols boolean, digest binary, words long, kinds long"
        )
    )
    texts = measured.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    marked = measured.join(texts.select("digest", "first"), "digest", "left")
    fails = F.concat(
        F.when(F.col("words") < LEAST_WORDS, "A").otherwise(""),
        F.when(100 * F.col("kinds") < LEAST_DISTINCT * F.col("words"), "B").otherwise(""),
        F.when(F.col("capitals"), "C").otherwise(""),
        F.when(F.col("symbols"), "D").otherwise(""),
        F.when(F.col("id") > F.col("first"), "E").otherwise(""),
    )
    return marked.select("id", "part", fails.alias("fails"))


def audit(failed: DataFrame, labels: DataFrame, id_column: str = "doc_id", filters: str = FILTERS) -> DataFrame:
    """Rows (`part`, `filter_order`, `step`, `kept`, `removed`, `redundant`, `unique_fails`, `good_lost`, `toxic_lost`, `shapley`).

    One row for each part, order of `filters` and step. `failed` is what
    `failures` gives. `labels` (id, `quality`, `toxic`) may repeat an id; one
    label of 1 is enough. Labels that are null or of other documents count
    nowhere; without a label a document is neither good nor toxic. No
    documents give no rows.
    """
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    n = F.count(F.lit(1)).alias("n")
    kinds = failed.join(known, "id", "left").groupBy("part", "fails", "good", "toxic").agg(n)
    orders = F.explode(F.array([F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    each = kinds.select("*", orders).select("*", steps)
    own, earlier = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    letters = F.split("fails", "")
    each = each.select(
        "*",
        own.alias("filter"),
        F.contains("fails", own).alias("hit"),
        F.exists(letters, lambda c: (c != "") & F.contains(earlier, c)).alias("early"),
    )
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias
    removed = F.col("hit") & ~F.col("early")
    rows = each.groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("hit") & ~F.col("early"))("kept"),
        total(removed)("removed"),
        total(F.col("hit") & F.col("early"))("redundant"),
        total(F.col("fails") == F.col("filter"))("unique_fails"),
        total(removed & F.col("good"))("good_lost"),
        total(removed & F.col("toxic"))("toxic_lost"),
    )
    shapley = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
