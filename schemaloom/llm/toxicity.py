"""Toxicity by two Kneser-Ney language models of the letters of words.

A word is the letters between a start and an end mark. For every letter both
classes give a probability from the letters before it: the class's own counts,
discounted, and what the discount frees goes to the estimate of one letter
less, which both classes share. So an expression that no labelled text holds
counts the same in both, and only what a class has seen tells them apart.

A word's evidence is the toxic minus the ordinary log-likelihood, as a sum and
by letter. A text is judged by its words with most evidence (one, three and
six), by its evidence per letter and by its length: a calibration of these,
fitted on labelled texts that the models have not seen, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import likely_in, saved, text_of

# Letters that a probability looks at, its own included.
ORDER = 6
DISCOUNT = 0.75
ALPHABET = 256
# Labelled texts that the calibration is fitted on at most, taken by a hash.
CALIBRATED_ON = 20_000
TOP = (1, 3, 6)
THRESHOLD = 0.3
# Texts are read in parts of about this many letters.
PART = 1_000_000
# Distinct words that a task holds at most, and of which it makes grams at once.
HELD, AT_ONCE = 300_000, 50_000

WORDS = re.compile(r"[^\W\d_]+")
FEATURES = 2 * len(TOP) + 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each length up to ORDER: letters' positions, keys of the grams that end there, keys of what is before them.

    Also the first position of each word, and the number of letters of each.
    """
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    into = np.arange(len(codes)) - np.repeat(starts, lengths + 1)
    at = np.flatnonzero(into > 0)
    with np.errstate(over="ignore"):
        before, out = np.zeros(len(codes), np.uint64), []
        for k in range(1, ORDER + 1):
            # A gram ending here is the shorter one ending a letter before, and this letter.
            shorter = np.zeros_like(before) if k == 1 else np.concatenate([before[:1], before[:-1]])
            now = _mixed(_mixed(shorter + np.uint64(k)) + codes)
            own = at[into[at] >= k - 1]
            out.append((own, now[own], _mixed(shorter[own] + np.uint64(k))))
            before = now
    return out, starts, lengths


class Places:
    """Places of 64-bit keys, twice as many as keys or more; a key that is not there gets an empty place."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros(1 << (2 * len(keys)).bit_length(), np.uint64)
        at, rest = self._first(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] == 0]
            self.keys[at[free]] = keys[free]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) % len(self.keys)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at, rest = self._first(keys), np.arange(len(keys))
        while len(rest):
            there = self.keys[at[rest]]
            rest = rest[(there != keys[rest]) & (there != 0)]
            at[rest] = (at[rest] + 1) % len(self.keys)
        return at

    def laid(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.keys), np.float32)
        out[at] = values
        return out


@dataclass
class Model:
    """Counts of grams and of what follows their first letters, for ordinary (0) and toxic (1) texts.

    Every gram and every context has a place of its own, so the tables grow
    with the grams of the labelled texts.
    """

    grams: Places
    contexts: Places
    counts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    held: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, place: np.ndarray, before: np.ndarray, counts: list[np.ndarray]) -> Model:
        """`place` has the keys of distinct grams, `before` those of their contexts."""
        distinct, number = np.unique(before, return_inverse=True)
        grams, contexts = Places(place), Places(distinct)
        at, of = grams.of(place), contexts.of(distinct)
        dense = [grams.laid(at, c) for c in counts]
        totals = [contexts.laid(of, np.bincount(number, c, len(distinct))) for c in counts]
        kinds = [contexts.laid(of, np.bincount(number, c > 0, len(distinct))) for c in counts]
        return cls(grams, contexts, dense, totals, kinds)

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`evidence`, which a worker keeps for the words of its next texts."""
        new = [w for w in words if w not in self.held]
        if len(self.held) + len(new) > HELD:
            self.held.clear()
            new = words
        if new:
            self.held.update(zip(new, self.evidence(new)[0].tolist()))
        total = np.fromiter((self.held[w] for w in words), np.float64, len(words))
        return total, np.fromiter(map(len, words), np.int64, len(words)) + 1

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic minus ordinary log-likelihood of each word, and its letters."""
        grams, starts, lengths = _grams(words)
        size = int(starts[-1] + lengths[-1] + 1)
        lower, shared = np.full(size, 1 / ALPHABET), None
        own = [np.full(size, 1 / ALPHABET), np.full(size, 1 / ALPHABET)]
        for at, gram, context in grams:
            base, place, before = lower[at], self.grams.of(gram), self.contexts.of(context)
            for y in (0, 1):
                own[y][at] = _interpolated(self.counts[y][place], self.totals[y][before], self.kinds[y][before], base)
            both = [a[0][i] + a[1][i] for a, i in ((self.counts, place), (self.totals, before))]
            # A gram known to both classes is one kind; the larger number is close and never too large.
            kinds = np.maximum(self.kinds[0][before], self.kinds[1][before])
            shared = _interpolated(both[0], both[1], kinds, base)
            lower[at] = shared
        ratio = np.log(own[1]) - np.log(own[0])
        ratio[starts] = 0
        return np.add.reduceat(ratio, starts), lengths


def _interpolated(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    known = np.maximum(total, 1)
    return np.where(total > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * lower) / known, lower)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= PART:
            yield part
            part, n = [], 0
    if part:
        yield part


def features(model: Model, texts: list[str]) -> np.ndarray:
    """A row per text; zeros for a text without words."""
    out = []
    for part in _parts(texts):
        number: dict[str, int] = {}
        owned = [[number.setdefault(w, len(number)) for w in WORDS.findall(t.lower())] for t in part]
        if number:
            total, letters = model.known(list(number))
            by_letter = total / letters
        for own in owned:
            row = np.zeros(FEATURES)
            if own:
                i = np.array(own)
                for values, first in ((by_letter[i], 0), (total[i], len(TOP))):
                    top = np.sort(np.partition(values, -TOP[-1])[-TOP[-1] :] if len(i) > TOP[-1] else values)[::-1]
                    row[first : first + len(TOP)] = [top[:k].sum() / k for k in TOP]
                row[-2:] = total[i].sum() / letters[i].sum(), np.log1p(len(i))
            out.append(row)
    return np.array(out).reshape(-1, FEATURES)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each kind that hold a word: ordinary and toxic, seen by the calibration or not."""
    number: dict[str, int] = {}
    counts = np.zeros((4, 0), np.int64)

    def flush():
        words = list(number)
        for low in range(0, len(words), 65_536):
            own = slice(low, low + 65_536)
            columns = [pa.array(words[own], pa.string()), *(pa.array(c[own]) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n0", "n1", "n2", "n3"])

    for batch in batches:
        kinds, low = batch.column("kind").to_numpy(), 0
        for part in _parts(batch.column("text").to_pylist()):
            which: list[list[int]] = [[], [], [], []]
            for t, kind in zip(part, kinds[low : low + len(part)]):
                which[kind] += [number.setdefault(w, len(number)) for w in set(WORDS.findall(t.lower()))]
            low += len(part)
            counts = np.pad(counts, ((0, 0), (0, len(number) - counts.shape[1])))
            for k in range(4):
                counts[k] += np.bincount(np.array(which[k], np.int64), minlength=len(number))
            if len(number) >= HELD:
                yield from flush()
                number, counts = {}, np.zeros((4, 0), np.int64)
    yield from flush()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of words, summed for some words at a time."""
    words, held = [], []

    def flush():
        n = np.concatenate(held, axis=1)
        grams, _, lengths = _grams(words)
        word_of = np.repeat(np.arange(len(words)), lengths + 1)
        own = np.concatenate([word_of[at] for at, _, _ in grams])
        before = np.concatenate([b for _, _, b in grams])
        place, first, inverse = np.unique(np.concatenate([p for _, p, _ in grams]), return_index=True, return_inverse=True)
        counts = [np.bincount(inverse, n[k][own], len(place)).astype(np.int64) for k in range(4)]
        columns = [place.view(np.int64), before[first].view(np.int64), *counts]
        for low in range(0, len(place), 65_536):
            arrays = [pa.array(c[low : low + 65_536]) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", "before", "n0", "n1", "n2", "n3"])

    for batch in batches:
        words += batch.column("word").to_pylist()
        held.append(np.array([batch.column(f"n{k}").to_numpy() for k in range(4)]))
        if len(words) >= AT_ONCE:
            yield from flush()
            words, held = [], []
    if words:
        yield from flush()


def remainder(id_column: str) -> Column:
    """crc32(id as text) mod 4; rows with 2 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4


class Scorer:
    """A fitted model: `score` of a text column, in all rows or a part of them."""

    def __init__(self, model, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, base: float):
        self.model, self.weights, self.mean, self.spread, self.base = model, weights, mean, spread, base

    def score(self, text: Column) -> Column:
        held, weights, mean, spread, base = self.model, self.weights, self.mean, self.spread, self.base

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            if held is None:
                return pa.array(np.full(len(texts), base))
            x = (features(held.value, texts.to_pylist()) - mean) / spread
            return pa.array(1 / (1 + np.exp(-(weights[0] + x @ weights[1:]).clip(-50, 50))))

        return run(F.coalesce(text, F.lit("")))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, ridge = np.zeros(z.shape[1]), np.r_[0, np.ones(z.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w).clip(-50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, spread


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> Scorer:
    """Models of all labelled rows that are not held out.

    `labels` (id, 0 or 1) may repeat an id; one toxic label makes it toxic.
    Null ids and labels teach nothing, nor do labels without a document; a
    label of 1 or more is toxic. An empty table gives no rows. The counts of
    two thirds of the rows make the models for the calibration, which is fitted
    on at most `CALIBRATED_ON` of the others; the models for scoring take them
    all. If a class is missing in one of these parts, the score is not
    calibrated; if it is missing in both, every score is the share of toxic
    labels (0 without any).
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg((F.max(F.col(label_column).cast("int")) >= 1).cast("int").alias("y"))
    )
    rest = F.when(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 3, 2).otherwise(0)
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    taught = saved(known.where(remainder("id") != 2).withColumn("kind", (rest + F.col("y")).cast("int")))
    # Texts without a label go before the shuffle; the join has one form at any size.
    near = likely_in(texts.where(remainder("id") != 2), "id", taught, taught.count())
    labelled = near.join(taught.select("id", "kind").hint("merge"), "id").select("kind", "text")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]
    words = labelled.mapInArrow(_word_counts, "word string, n0 long, n1 long, n2 long, n3 long").groupBy("word").agg(*sums)
    counted = words.mapInArrow(_gram_counts, "place long, before long, n0 long, n1 long, n2 long, n3 long")
    # A row per distinct gram of the labelled texts.
    table = counted.groupBy("place").agg(F.max("before").alias("before"), *sums).toArrow()
    place, before = (table.column(c).to_numpy().view(np.uint64) for c in ("place", "before"))
    n = [table.column(f"n{k}").to_numpy() for k in range(4)]
    del table

    def uncalibrated() -> Scorer:
        ones, rows = taught.agg(F.sum("y"), F.count(F.lit(1))).first()
        base = (ones or 0) / rows if rows else 0.0
        if not all((n[y] + n[2 + y]).sum() for y in (0, 1)):
            return Scorer(None, np.zeros(0), np.zeros(0), np.zeros(0), base)
        # Nothing to calibrate on: the odds of toxic labels and the evidence of the word with most of it.
        weights = np.zeros(1 + FEATURES)
        weights[0], weights[1 + len(TOP)] = np.log(base / (1 - base)), 1
        whole = spark.sparkContext.broadcast(Model.of(place, before, [n[0] + n[2], n[1] + n[3]]))
        return Scorer(whole, weights, np.zeros(FEATURES), np.ones(FEATURES), base)

    if not all(c.sum() for c in n):
        return uncalibrated()
    half = spark.sparkContext.broadcast(Model.of(place, before, n[:2]))
    # Of the labels that have a document; moves ids alone.
    there = saved(taught.where("kind >= 2").join(docs.select(F.col(id_column).alias("id")), "id", "left_semi").select("id", "y"))
    # A share by hash that surely holds enough, so that the limit sees a bounded number of rows.
    part = 1 << 20
    share = min(part, -(-2 * CALIBRATED_ON * part // max(there.count(), 1)))
    order = F.xxhash64("id")
    # A bounded list of ids, so it can be broadcast.
    chosen = there.where(F.pmod(order, F.lit(part)) < share).orderBy(order, "id").limit(CALIBRATED_ON)

    @F.arrow_udf("array<double>")
    def vector(column: pa.Array) -> pa.Array:
        return pa.array(features(half.value, column.to_pylist()).tolist(), pa.list_(pa.float64()))

    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", F.xxhash64("text").alias("h"), vector("text").alias("x"))
    # One row for each id, however many texts it has.
    seen = rows.groupBy("id").agg(F.max("y").alias("y"), F.min_by("x", "h").alias("x")).toPandas()
    x, y = np.array(seen["x"].tolist()), seen["y"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return uncalibrated()
    whole = spark.sparkContext.broadcast(Model.of(place, before, [n[0] + n[2], n[1] + n[3]]))
    weights, mean, spread = _logistic(x, y)
    half.unpersist()
    return Scorer(whole, weights, mean, spread, 0.0)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows (`id`, `held_out`, `score`, `predicted`), one for each row of `docs`.

    A null text is empty; a text without words gets a score too. Repeated rows
    get equal answers.
    """
    scorer = fit(docs, labels, id_column, text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), (remainder(id_column) == 2).alias("held_out"), scorer.score(F.col(text_column)).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs` whose score stays below the threshold."""
    scorer = fit(docs, labels, id_column, text_column)
    rows = docs.select(F.struct("*").alias("row"), scorer.score(F.col(text_column)).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")
