"""Token id sequences for supervised training, as array expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.functions.arrays import let, take, take_last
from schemaloom.functions.workers import kept

# A run of word characters, or one other visible character.
TOKEN = r"\w+|[^\w\s]"


def token_texts(text: Column) -> Column:
    """The regex tokens of a text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def hashed_token_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """Ids of regex tokens by hash: a stand-in that needs no vocabulary file."""
    return hashed_ids(token_texts(text), vocabulary)


def hashed_ids(tokens: Column, vocabulary: int = 50_000) -> Column:
    """The id of each token by its hash."""
    return F.transform(
        tokens,
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % vocabulary).cast("int"),
    )


def token_count(text: Column) -> Column:
    """How many regex tokens a text has."""
    return F.regexp_count(text, F.lit(TOKEN))


def tokenizer_ids(text: Column, load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Ids from a user's tokenizer in Arrow batches.

    `load` runs once per Python worker and returns a function from a list of
    texts to a list of id lists.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize: Any = kept(name, load)
        for batch in batches:
            yield pd.Series(tokenize(batch.tolist()), index=batch.index)

    return encode(text)


def fit_answer(answer: Column, max_length: int, eos_id: int) -> Column:
    """An answer that fills the whole sequence is cut and closed again."""
    return F.when(
        F.size(answer) >= max_length, F.concat(take(answer, max_length - 1), F.array(F.lit(eos_id)))
    ).otherwise(answer)


def fit_prompt(prompt: Column, answer: Column, max_length: int) -> Column:
    """The end of the prompt that fits beside the answer; none without room."""
    return take_last(prompt, max_length - F.size(answer))


def input_budget(prompt: Column, max_length: int) -> Column:
    """The end of an inference prompt that fits."""
    return take_last(prompt, F.lit(max_length))


def last_tokens(text: Column, max_length: int) -> Column:
    """The end of a text, cut to so many regex tokens with the blanks before them."""
    parts = F.regexp_extract_all(text, F.lit(rf"\s*(?:{TOKEN})"), F.lit(0))
    return let(parts, lambda p: F.array_join(take_last(p, F.lit(max_length)), ""))


def sequence_row(prompt: Column, answer: Column) -> Column:
    """Input ids, attention mask and labels of an already fitted pair."""
    ids = F.concat(prompt, answer)
    return F.struct(
        ids.alias("input_ids"),
        F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(V.IGNORED_LABEL), F.size(prompt)), answer).alias("labels"),
    )


def pad(arr: Column, length: Column, value: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), length - F.size(arr)))
