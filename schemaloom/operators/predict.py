"""Batch prediction with a user's model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.sequences import token_count
from schemaloom.functions.workers import kept

Predictor = Callable[[list[str]], list[str]]


def token_batches(lengths: Sequence[int], budget: int) -> list[np.ndarray]:
    """Positions of prompts in batches of about equal lengths, the shortest first.

    The padded size of a batch, its longest prompt times their number, stays
    within `budget`; a prompt that is longer by itself has a batch of its own.
    """
    sizes = np.maximum(np.asarray(lengths, dtype="int64"), 1)
    order = np.argsort(sizes, kind="stable")
    batches, start = [], 0
    for end in range(1, len(order) + 1):
        # Lengths rise, so the prompt to come would be the longest.
        if end == len(order) or sizes[order[end]] * (end + 1 - start) > budget:
            batches.append(order[start:end])
            start = end
    return batches


def responses(
    prompt: Column, load: Callable[[], Predictor], tokens_per_batch: int | None = None, length: Column | None = None
) -> Column:
    """Response text per prompt, in Arrow batches.

    `load` runs once per Python worker, so a model is loaded once and serves
    all batches of all tasks there. Only the prompt travels to Python.

    With `tokens_per_batch` the model gets the prompts of an Arrow batch
    ordered by `length` in batches whose padded size stays within it, so that
    neither memory nor padding depends on the longest prompt of 10,000 rows.
    `length` counts regex tokens unless given; null counts as 0. Responses come
    back in the order of the rows.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = kept(name, load)
        for batch in batches:
            yield pd.Series(model(batch.tolist()), index=batch.index, dtype=object)

    @F.pandas_udf("string")
    def answer_by_size(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = kept(name, load)
        for texts, lengths in batches:
            given = np.empty(len(texts), dtype=object)
            values = texts.to_numpy(dtype=object)
            for places in token_batches(lengths.to_numpy(), tokens_per_batch):
                given[places] = model(values[places].tolist())
            yield pd.Series(given, index=texts.index, dtype=object)

    if tokens_per_batch is None:
        return answer(prompt)
    if tokens_per_batch < 1:
        raise ValueError("tokens_per_batch has to be positive")
    counted = token_count(prompt) if length is None else length
    return answer_by_size(prompt, F.coalesce(counted.cast("long"), F.lit(0).cast("long")))


def batch_predict(
    df: DataFrame,
    prompt: str,
    load: Callable[[], Predictor],
    tokens_per_batch: int | None = None,
    length: Column | None = None,
) -> DataFrame:
    """Rows with the `response` to their prompt; see `responses`."""
    return df.withColumn("response", responses(F.col(prompt), load, tokens_per_batch, length))
