"""Training sequences as DataFrames: fitting, labels, padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.functions import sequences as seq
from schemaloom.operators.curate import numbered_shuffle


def truncate_pair(df: DataFrame, max_length: int, eos_id: int) -> DataFrame:
    """Fit `prompt_ids` and `answer_ids` into a length; flag cut prompts."""
    answer = df.withColumn("answer_ids", seq.fit_answer(F.col("answer_ids"), max_length, eos_id))
    fitted = seq.fit_prompt(F.col("prompt_ids"), F.col("answer_ids"), max_length)
    return answer.withColumn(
        "truncated", F.size("prompt_ids") > max_length - F.size("answer_ids")
    ).withColumn("prompt_ids", fitted)


def truncation_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if("truncated").alias("truncated_rows"), F.count(F.lit(1)).alias("total_rows")
    )


def label_mask(df: DataFrame) -> DataFrame:
    """`input_ids`, `attention_mask` and `labels` of a fitted pair."""
    row = seq.sequence_row(F.col("prompt_ids"), F.col("answer_ids"))
    return df.withColumn("_row", row).select(*df.columns, "_row.*").drop("prompt_ids", "answer_ids")


def assign_batches(df: DataFrame, by: str, batch_size: int, seed: int) -> DataFrame:
    """Number rows into batches in a seeded order over all of them; `by` has to identify a row.

    Every batch but the last is full. See `curate.numbered_shuffle` for how
    rows are numbered without a task that sees them all.
    """
    placed = numbered_shuffle(df, seed, [by])
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / batch_size)).drop("place")


def pad_batch(df: DataFrame, pad_id: int) -> DataFrame:
    """Right-pad the rows of each `batch` to its longest row."""
    longest = F.max(F.size("input_ids")).over(W.partitionBy("batch"))
    return (
        df.withColumn("_longest", longest)
        .withColumns(
            {
                "input_ids": seq.pad(F.col("input_ids"), F.col("_longest"), pad_id),
                "attention_mask": seq.pad(F.col("attention_mask"), F.col("_longest"), 0),
                "labels": seq.pad(F.col("labels"), F.col("_longest"), V.IGNORED_LABEL),
            }
        )
        .drop("_longest")
    )
