"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A text's marked words ("▁word") are encoded once per batch. The distinct words
are sorted, which makes them a trie in depth-first order: each one takes over
the forward states of the prefix that it shares with the one before, and only
the rest is computed.

A state is the last piece of a prefix's encoding. In a model of the BPE kind,
whose pieces come from merges and not from the best sum of scores, exactly one
piece that ends at a prefix may follow the state at its own start: the pair
must be what the merges make of the two joined texts. So the states of a word
lead back to its encoding, like those of a Viterbi search.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.ragged import Words, as_lists, sequences, slices, strings
from schemaloom.llm.shared import text_of

MARK = "▁"
NEVER = float("-inf")
# Pairs of pieces whose test a worker remembers.
KEPT_PAIRS = 400_000
# A marked word: marks, and all up to the next one.
MARKED = regex.compile(f"{MARK}+[^{MARK}]*+")


class Pieces:
    """The pieces of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {self.texts[i]: i for i in range(n) if plain[i]}
        self.scores = {self.texts[i]: model.get_score(i) for i in range(n) if plain[i]}
        self.of_byte = {int(self.texts[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.of_byte) != 256:
            raise ValueError(f"{path}: a model with byte fallback is needed")
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError(f"{path}: a piece goes beyond a word")
        # All ends of pieces; a whole piece gives itself.
        self.ends = {t[i:]: "" for t in self.ids for i in range(len(t))} | {t: t for t in self.ids}
        self.bytes = {i: t.replace(MARK, " ").encode() for t, i in self.ids.items()} | {i: bytes([b]) for b, i in self.of_byte.items()}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """The merges, one by one: the best pair first, of equals the left one."""
        parts, score = list(text), self.scores.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], NEVER)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], NEVER)
        return parts

    def _followers(self, piece: str) -> dict[str, bool]:
        """What is known about the pieces behind `piece`; "" stands for the start of a word."""
        known = self.pairs.get(piece)
        if known is None:
            known = self.pairs[piece] = {}
        return known

    def _test(self, one: str, other: str, known: dict[str, bool]) -> bool:
        if self.n_pairs >= KEPT_PAIRS:
            for d in self.pairs.values():
                d.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known[other] = out = self.merged(one + other) == ([one, other] if one else [other])
        return out

    def encode_sorted(self, words: list[str]):
        """The pieces of each word; sorted words share the work for their prefixes."""
        # By length of the prefix: its last piece, and what may follow that.
        last, after = [""], [self._followers("")]
        before, ends = "", self.ends.get
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], after[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # The pieces that end here; a character that is none counts as one.
                low, found = end - 1, [word[end - 1]]
                while low:
                    low -= 1
                    piece = ends(word[low:end])
                    if piece is None:
                        break
                    if piece:
                        found.append(piece)
                for piece in reversed(found):
                    start = end - len(piece)
                    fits = after[start].get(piece)
                    if fits is None:
                        fits = self._test(last[start], piece, after[start])
                    if fits:
                        last.append(piece)
                        after.append(self._followers(piece))
                        break
                else:
                    raise AssertionError(f"no piece ends at {end} of {word[:end]!r}")
            before, end, out = word, len(word), []
            while end:
                out.append(last[end])
                end -= len(out[-1])
            yield out[::-1]

    def ids_of(self, words: list[str]) -> list[list[int]]:
        out: dict[str, list[int]] = {}
        ordered = sorted(words)
        for word, pieces in zip(ordered, self.encode_sorted(ordered)):
            ids: list[int] = []
            for p in pieces:
                if p in self.ids:
                    ids.append(self.ids[p])
                else:
                    ids += [self.of_byte[b] for b in p.encode()]
            out[word] = ids
        return [out[w] for w in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text; ids that are not pieces of text give nothing."""
        raw = b"".join([self.bytes.get(i, b"") for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Pieces, Words]:
    pieces = Pieces(path)
    return pieces, Words(pieces.ids_of)


def marked_words(texts: pa.Array) -> pa.ListArray:
    """The marked words of every text; none for an empty one."""
    # Unless marks run together, the words are what stands between spaces.
    odd = pc.match_substring_regex(texts, f"^ |  | $|{MARK}|^$")
    if not pc.any(odd).as_py():
        words = pc.split_pattern(texts, " ")
        flat = pc.binary_join_element_wise(pa.scalar(MARK), words.flatten(), "")
        return pa.ListArray.from_arrays(words.offsets, flat)
    return pa.array([MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))


def _encoded(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    return sequences(marked_words(texts), words)


def encoder(model: str):
    """A function of a text column: its ids (array<int>). `model` is a path on every worker."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        _, words = _loaded(model)
        parts = [as_lists(*_encoded(part, words)) for part in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return lambda text: encode(F.coalesce(text, F.lit("")))


def decoder(model: str):
    """A function of an ids column: the text; none for null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        pieces, _ = _loaded(model)
        values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        return pa.array([pieces.decode(values[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())

    return lambda ids: decode(F.coalesce(ids, F.array().cast("array<int>")))


def checked(model: str):
    """A function of a text column: ids, their CRC-32, the length of the text decoded from them, whether it is the same.

    Encoding and decoding take place in one pass, so that ids go to no second
    worker; `with_ids=False` leaves them there.
    """

    def checks(texts: pa.Array, with_ids: bool) -> pa.Array:
        pieces, words = _loaded(model)
        kind = pa.list_(pa.int32())
        rows: list[list] = [[], [], [], [], []]
        for part in slices(texts):
            ids, starts = _encoded(part, words)
            rows[0].append(as_lists(ids, starts) if with_ids else pa.nulls(len(part), kind))
            for text, a, b in zip(strings(part), starts.tolist(), starts[1:].tolist()):
                decoded = pieces.decode(ids[a:b])
                rows[1].append(b - a)
                rows[2].append(zlib.crc32(ids[a:b]))
                rows[3].append(len(decoded))
                rows[4].append(decoded == text)
        lists = pa.concat_arrays(rows[0]) if rows[0] else pa.array([], kind)
        columns = [lists, *(pa.array(r, pa.int64()) for r in rows[1:4]), pa.array(rows[4], pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["ids", "n_tokens", "ids_crc32", "decoded_chars", "round_trip"])

    def run(text: Column, with_ids: bool = True) -> Column:
        def call(texts: pa.Array) -> pa.Array:
            return checks(texts, with_ids)

        udf = F.arrow_udf(call, "ids array<int>, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")
        return udf(F.coalesce(text, F.lit("")))

    return run


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (`id`, `text`, `ids`), one for each row of `docs`.

    The ids are those of the library, without begin and end. Null texts count
    as empty and have no ids. Characters without a piece become bytes.
    """
    text = text_of(text_column)
    return docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("ids", encoder(model)(F.col("text")))


def decoded(rows: DataFrame, model: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """`rows` and the text of their ids; null ids give an empty text."""
    return rows.withColumn(text_column, decoder(model)(F.col(ids_column)))


def _crc32s(ids: pa.Array) -> pa.Array:
    values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])], pa.int64())


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return F.arrow_udf(_crc32s, "long")(F.coalesce(ids, F.array().cast("array<int>")))
