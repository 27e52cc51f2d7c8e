"""Id sequences of texts from the id sequences of their distinct words, in arrays."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at a time, and words whose ids a worker keeps.
SLICE_BYTES = 8_000_000
KEPT_WORDS = 300_000


class Words:
    """Ids of words, looked up in a worker's bounded memory or made for all new words at once."""

    def __init__(self, make: Callable[[list[str]], list[list[int]]]):
        self.make, self.kept = make, {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each word's begin."""
        kept = self.kept
        found = list(map(kept.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            made = dict(zip(new, (array("i", x).tobytes() for x in self.make(new))))
            found = [made[w] if x is None else x for w, x in zip(words, found)]
            if len(kept) + len(made) > KEPT_WORDS:
                kept.clear()
            kept.update(made)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return np.frombuffer(b"".join(found), "<i4"), starts.astype(np.int32)


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of about SLICE_BYTES; a longer text is one by itself."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())])
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES)))
        yield column.slice(low, high - low)
        low = high


def sequences(words: pa.ListArray, coder: Words) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every row's words in a row, and where each row's begin (one more entry than rows)."""
    coded = words.flatten().dictionary_encode()
    ids, starts = coder(strings(coded.dictionary))
    which = coded.indices.to_numpy()
    rows = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
    lengths = np.diff(starts)[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # From the start of each word's ids on, one after the other.
    at = np.repeat((starts[which] - (ends - lengths)).astype(np.int32), lengths)
    at += np.arange(total, dtype=np.int32)
    return ids[at], np.concatenate([[0], ends])[rows]


def as_lists(ids: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
