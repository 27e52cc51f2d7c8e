"""Token counts without token ids.

A text's tokens are the pieces of its pre-tokens. Each distinct pre-token is
cut into pieces once; its count is joined to the pre-token's postings (which
documents hold it, and how often), and the products are summed by document.

Documents are numbered inside chunks, so that a posting takes six bytes. A
pre-token has one row per chunk, however frequent it is, and its rows are
salted by neighbourhoods of chunks: a pre-token that every document holds
meets in as many tasks as the corpus is large, and its pieces are counted once
in each.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import text_of

# Characters of text and documents that one chunk takes at most (one document
# more than the characters). They bound the memory of a worker.
CHUNK_CHARS = 24_000_000
CHUNK_DOCS = 65_536
# Postings that a worker gathers before it sums them by document.
SUMMED_AT_ONCE = 4_000_000
# Tasks that wrote the rows of one pre-token that meet: 16 for long rows of
# postings, 1,024 for the others. 16 tasks with six chunks each (128 MB of text)
# give 96 rows of 384 KB at most, 1,024 give 6,144 rows of 1.5 KB.
LONG_ROW, NEAR, FAR = 1_536, 1 << 4, 1 << 10

# Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of these characters only: the pattern agrees with the library on each
# of them (the tests compare all). Any other text is split by the library.
KNOWN = regex.compile("[\x00-ͯ‐-‧]*+")

POSTINGS = "pretoken string, header_of long, chunk long, postings binary"
# A posting: the document's number in its chunk, and how often it holds the pre-token.
POSTING = np.dtype([("doc", "<u2"), ("n", "<u4")])
SUM = np.dtype([("doc", "<u2"), ("n", "<i8")])


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splitter(path: str) -> Callable[[str], Counter]:
    """A function that counts a text's pre-tokens, special strings included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level tokenizer without normalizer and prefix space")
    special = [t["content"] for t in spec.get("added_tokens", [])]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    find, tokenizer = regex.compile(BYTE_LEVEL).findall, _load(path)

    def pretokens(text: str) -> Counter:
        parts, found = [text], []
        if cut is not None and any(s in text for s in special):
            parts, found = cut.split(text), cut.findall(text)
        out = Counter(found)
        for part in parts:
            if KNOWN.fullmatch(part):
                out.update(find(part))
            else:
                spans = tokenizer.pre_tokenizer.pre_tokenize_str(part)
                out.update(part[a:b] for _, (a, b) in spans)
        return out

    return pretokens


def _packed(doc: np.ndarray, n: np.ndarray, starts: np.ndarray, kind: np.dtype) -> pa.Array:
    """A binary array of slices of one buffer. Few columns make rows cheap to move."""
    values = np.empty(len(doc), kind)
    values["doc"], values["n"] = doc, n
    offsets = (starts * kind.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8))])


def _header(ids: list, sizes: list) -> bytes:
    """What a chunk's documents are called, and their bytes."""
    rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "n_bytes"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _postings(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = splitter(path)
        part, chunks = TaskContext.get().partitionId(), 0
        schema = pa.schema([("pretoken", pa.string()), ("header_of", pa.int64()), ("chunk", pa.int64()), ("postings", pa.binary())])
        number: dict[str, int] = {}
        which, counts, ids, sizes, chars = [], [], [], [], 0

        def flush():
            chunk = (part << 32) | chunks
            yield pa.RecordBatch.from_pylist([{"header_of": chunk, "chunk": chunk, "postings": _header(ids, sizes)}], schema)
            if number:
                w = np.concatenate(which)
                order = np.argsort(w, kind="stable")
                starts = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(number)))])
                owner = np.repeat(np.arange(len(ids)), [len(x) for x in which])
                n = len(number)
                postings = _packed(owner[order], np.concatenate(counts)[order], starts, POSTING)
                columns = [pa.array(number, pa.string()), pa.nulls(n, pa.int64()), pa.array(np.full(n, chunk)), postings]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pretokens(text)
                which.append(np.fromiter((number.setdefault(k, len(number)) for k in found), np.int64, len(found)))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
                ids.append(doc)
                sizes.append(len(text.encode()))
                chars += len(text)
                if chars >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield from flush()
                    chunks += 1
                    number, which, counts, ids, sizes, chars = {}, [], [], [], [], 0
        if ids:
            yield from flush()

    return run


def _sums(path: str):
    """Counts the pieces of each distinct pre-token of a sorted partition, and sums them by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(path)
        schema = pa.schema([("chunk", pa.int64()), ("header", pa.binary()), ("sums", pa.binary())])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, pieces_of_last, n_held = None, 0, 0

        def flush():
            chunk, doc, worth = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((doc, chunk))
            chunk, doc, worth = chunk[order], doc[order], worth[order]
            first = np.flatnonzero(np.r_[True, (np.diff(chunk) != 0) | (np.diff(doc) != 0)])
            total, chunk, doc = np.add.reduceat(worth, first), chunk[first], doc[first]
            cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(chunk) != 0]), len(chunk)]
            columns = [pa.array(chunk[cuts[:-1]]), pa.nulls(len(cuts) - 1, pa.binary()), _packed(doc, total, cuts, SUM)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            headers = batch.filter(pc.is_valid(batch.column("header_of")))
            if headers.num_rows:
                columns = [headers.column("chunk"), headers.column("postings"), pa.nulls(headers.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            batch = batch.filter(pc.is_null(batch.column("header_of")))
            if not batch.num_rows:
                continue
            coded = batch.column("pretoken").dictionary_encode()
            words = coded.dictionary.to_pylist()
            # Rows come sorted by hash, so only a batch's first pre-token can have been seen before.
            new = words[1:] if words[0] == last else words
            encoded = tokenizer.encode_batch_fast(new, add_special_tokens=False)
            found = [len(e) for e in encoded]
            found = [pieces_of_last, *found] if words[0] == last else found
            last, pieces_of_last = words[-1], found[-1]
            pieces = np.array(found, np.int64)[coded.indices.to_numpy()]
            lengths = pc.binary_length(batch.column("postings")).to_numpy() // POSTING.itemsize
            own = np.frombuffer(b"".join(batch.column("postings").to_pylist()), POSTING)
            chunks = np.repeat(batch.column("chunk").to_numpy(), lengths)
            held.append((chunks, own["doc"], np.repeat(pieces, lengths) * own["n"]))
            n_held += len(own)
            if n_held >= SUMMED_AT_ONCE:
                yield flush()
                n_held = 0
        if held:
            yield flush()

    return run


def _by_document(chunk_rows: pa.Table) -> pa.Table:
    rows, total = None, np.zeros(CHUNK_DOCS, np.int64)
    for header, sums in zip(chunk_rows.column("header").to_pylist(), chunk_rows.column("sums").to_pylist()):
        if sums is None:
            rows = pa.ipc.open_stream(header).read_all()
        else:
            own = np.frombuffer(sums, SUM)
            total[own["doc"]] += own["n"]
    return rows.append_column("n_tokens", pa.array(total[: rows.num_rows]))


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (`id`, `n_bytes`, `n_tokens`), one for each row of `docs`.

    `tokenizer` is the path of a byte-level tokenizers file on every worker.
    Null texts count as empty: no bytes, no tokens. Ids may be null or repeat;
    each row gets its own count. Other columns of `docs` play no part. `docs`
    must give the same rows in the same order when a task runs again, as files
    and checkpoints do.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    postings = rows.mapInArrow(_postings(tokenizer), POSTINGS)
    # A header goes by its chunk, all rows of a pre-token go together. One number
    # is sorted far faster than strings; equal hashes of two pre-tokens only
    # make their pieces be counted again.
    task = F.shiftright("chunk", 32)
    salt = F.when(F.octet_length("postings") > LONG_ROW, F.floor(task / NEAR)).otherwise(-1 - F.floor(task / FAR))
    dealt = postings.repartition("pretoken", "header_of", salt)
    together = dealt.sortWithinPartitions(F.xxhash64("pretoken"))
    sums = together.mapInArrow(_sums(tokenizer), "chunk long, header binary, sums binary")
    return sums.groupBy("chunk").applyInArrow(_by_document, "id long, n_bytes long, n_tokens long")
