"""Token ids in ORC files: integer run lengths, row indexes, Bloom filters.

Documents are sorted by id over the files, so file after file holds ascending
ids. ORC writes the ids of a stripe as run-length encoded integers; its row
index and Bloom filters on the document id let a reader skip stripes and
groups of rows, and every stripe can be read by a task of its own.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.llm.ragged import Words, as_lists, sequences, slices
from schemaloom.llm.shared import saved, text_of

# Bytes of a stripe, rows of a row-index group, and the Bloom filters' rate of false hits.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000
FALSE_HITS = 0.01
# Words whose ids a worker keeps, and half as many pre-tokens.
KEPT = 600_000


# Fixed value: the pre-tokens of lower-cased text without contractions.
PRETOKENS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Words of these characters only take the fast way below (the tests compare
# all of them): no contraction, no special string. Any other goes to the library.
KNOWN = regex.compile("[\x21-\x26\x28-\x3b\x3d-\x7e\xa1-\u02ff]*+")
# Letters below this one are single, composed letters; a stop ends a word.
LATIN_END, STOPS = "\u0300", frozenset(".,;:!?|")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Kept:
    """A bounded memory. When its newer half is full, what the older one holds and nobody asked for goes."""

    def __init__(self, size: int):
        self.half, self.new, self.old = size // 2, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new
        self.new[key] = value


class RecentWords(Words):
    """`Words` whose `make` gives ids as bytes, and whose memory forgets in parts."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        super().__init__(make)
        self.kept = Kept(KEPT)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each word's begin."""
        kept = self.kept
        found = list(map(kept.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            made = self.make(new)
            for w, x in zip(new, made):
                kept.put(w, x)
            rest = iter(made)
            found = [next(rest) if x is None else x for x in found]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return np.frombuffer(b"".join(found), "<i4"), starts.astype(np.int32)


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    merge, find = tokenizer.model.tokenize, PRETOKENS.findall
    kept = Kept(KEPT // 2)

    def pieces(pretoken: str) -> bytes:
        ids = kept.get(pretoken)
        if ids is None:
            written = pretoken if pretoken.isascii() else "".join([letters[b] for b in pretoken.encode()])
            ids = array("i", [t.id for t in merge(written)]).tobytes()
            kept.put(pretoken, ids)
        return ids

    def ids_of(word: str) -> bytes | None:
        low = word.lower()
        if low.isalpha():
            if low.isascii() or max(word + low) < LATIN_END:
                return pieces(low)
        elif low[-1] in STOPS and (stem := low[:-1]).isalpha() and (stem.isascii() or max(word + low) < LATIN_END):
            return pieces(stem) + pieces(low[-1])
        if KNOWN.fullmatch(word):
            return b"".join(map(pieces, find(normalize("NFC", word).lower())))
        return None

    def make(words: list[str]) -> list[bytes]:
        # White space at the ends of a text leaves empty words.
        out = [ids_of(w) if w else b"" for w in words]
        rest = iter(tokenizer.encode_batch([w for w, x in zip(words, out) if x is None], add_special_tokens=False))
        return [array("i", next(rest).ids).tobytes() if x is None else x for x in out]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"{path}: not a tokenizer of lower-cased words")
    return RecentWords(make)


def encoder(path: str, end_id: int | None):
    """A function of a text column: its ids, with `end_id` behind them.

    For tokenizers whose pre-tokens never hold white space, so that a text's
    ids are those of what stands between white space, one after the other.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        words, parts = _words(path), []
        for part in slices(texts):
            ids, starts = sequences(pc.ascii_split_whitespace(part), words)
            if end_id is not None:
                ids, starts = np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))
            parts.append(as_lists(ids, starts))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return lambda text: encode(F.coalesce(text, F.lit("")))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write (`doc_id`, `ids`) of every row to ORC files in the order of the document ids.

    Null texts count as empty and have the end id only. Null ids come first;
    repeated ids stand side by side. An empty table gives an empty folder of
    files that reads as no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    # Sorted before they are encoded: the ranges are then found without encoding twice.
    laid = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        laid.select("doc_id", encoder(tokenizer, end_id)(F.col("text")).alias("ids"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(FALSE_HITS))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """(`doc_id`, `ids`) of the files; a condition on `doc_id` prunes files, stripes and groups of rows."""
    rows = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return rows if condition is None else rows.where(condition)


def digests(spark: SparkSession, path: str, digest) -> DataFrame:
    """Rows (`doc_id`, `start`, `n_tokens`, `digest`) of all documents of the files.

    `start` is the number of ids of all documents before, in the order of the
    files and of the rows in them; `digest` a function of the ids column.
    """
    row = F.monotonically_increasing_id()
    rows = spark.read.schema("doc_id long, ids array<int>").orc(path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("digest"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row"),
    )
    # Rows of a split come in the order of the file; files are numbered by their writers.
    kept = saved(rows.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long")))
    sizes = kept.groupBy("part", "file", "block").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n", "part")
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = placed.join(offsets, ["file", "block"])
    return out.select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "digest")
