"""Candidates and prompts under the settings of many runs in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions import prompts as P
from schemaloom.functions.arrays import inline_rows
from schemaloom.operators.retrieval import candidates, with_scores

# Distinct budgets and runs that one job takes. Beyond them it stops: settings travel in every row.
MOST_RUNS = 10_000


@dataclass(frozen=True)
class ColumnBudget:
    """A `RetrievalConfig` whose values are columns."""

    max_tables: Column
    columns_kept: Column
    join_neighbor_limit: Column
    include_types: Column
    include_keys: Column
    # A limit of 0 adds none.
    include_join_neighbors: bool = True

    @classmethod
    def of(cls, row: Column) -> ColumnBudget:
        return cls(
            max_tables=row.max_tables,
            columns_kept=F.greatest(row.min_columns_per_table, row.max_columns_per_table),
            join_neighbor_limit=F.when(row.include_join_neighbors, row.join_neighbor_limit).otherwise(0),
            include_types=row.include_types,
            include_keys=row.include_keys,
        )


def _by_budget(settings: DataFrame) -> Column:
    """All settings as one array of `(retrieval, runs)`, one entry per distinct budget."""
    run = F.struct("run_id", "output_format")
    grouped = settings.groupBy("retrieval").agg(F.collect_list(run).alias("runs"), F.count(F.lit(1)).alias("n"))
    rows = F.struct("retrieval", "runs")
    too_many = F.raise_error(F.lit(f"more than {MOST_RUNS} runs")).cast("array<int>").isNull()
    bounded = F.when(F.coalesce(F.sum("n"), F.lit(0)) > MOST_RUNS, too_many).otherwise(F.lit(True))
    return grouped.agg(F.collect_list(rows).alias("rows"), bounded.alias("ok")).where("ok").select("rows").scalar()


def candidates_by_run(scored: DataFrame, settings: DataFrame) -> DataFrame:
    """Scored questions with their `candidates` under the budgets of every run.

    `settings` holds `run_id`, `output_format` and the struct `retrieval`.
    A question is scored once and its candidates are made once for each
    distinct budget; only then it meets the runs. Without runs no row is left.
    """
    # A column first: Spark takes no subquery inside a higher-order function.
    with_budgets = scored.withColumn("_budgets", _by_budget(settings))
    made = F.transform(
        "_budgets",
        lambda b: F.struct(
            b.retrieval.alias("retrieval"),
            b.runs.alias("runs"),
            candidates(F.col("tables"), F.col("scored"), ColumnBudget.of(b.retrieval)).alias("candidates"),
        ),
    )
    kept = [c for c in scored.columns if c != "scored"]
    offered = inline_rows(with_budgets, made, "retrieval", *kept)
    return inline_rows(offered, "runs", "run_id", *kept, "retrieval", "candidates")


def prompts_by_run(
    questions: DataFrame, catalog: DataFrame, settings: DataFrame, columns: int | None = None
) -> DataFrame:
    """The prompt of every question for every run, with that run's budgets and answer format."""
    offered = candidates_by_run(with_scores(questions, catalog, columns), settings)
    cfg = ColumnBudget.of(F.col("retrieval"))

    def prompt(name: str) -> Column:
        user = P.user_content(F.col("question"), F.col("candidates"), cfg, name)
        return P.prompt_text(P.system_prompt(name), user)

    text = F.when(F.col("output_format") == "ids", prompt("ids")).otherwise(prompt("names"))
    return offered.withColumn("prompt", text)
