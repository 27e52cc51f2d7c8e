"""Scoring of predictions: per question, per run, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.functions import links as L
from schemaloom.functions.arrays import choose, inline_rows, let
from schemaloom.operators.catalog import db_key
from schemaloom.operators.links import with_catalog, with_name_index

METRICS = ("p_t", "r_t", "f1_t", "p_c", "r_c", "f1_c")


def last_wins(predictions: DataFrame) -> DataFrame:
    """The last prediction per run and question, with the number of entries.

    Aggregated on the map side first, so many repeats of one id stay cheap.
    Places count within a file where `file_path` is given. With `question_key`,
    the id as text, ids that are not whole numbers stay apart.
    """
    given = lambda *names: [c for c in names if c in predictions.columns]
    return predictions.groupBy("run_id", "question_id", *given("question_key")).agg(
        F.max_by("links_json", F.struct(*given("file_path"), "pos")).alias("links_json"),
        F.count(F.lit(1)).alias("entries"),
    )


def _division(part: Column, whole: Column, otherwise: Column) -> Column:
    return choose(whole > 0, part / whole, otherwise)


def prf(predicted: Column, gold: Column) -> Column:
    """Precision, recall and F1 of two distinct arrays.

    An empty prediction is only precise against empty gold; empty gold has
    nothing left to recall.
    """
    sizes = F.struct(
        F.size(F.array_intersect(predicted, gold)).alias("tp"),
        F.size(predicted).alias("found"),
        F.size(gold).alias("wanted"),
    )

    def rates(n: Column) -> Column:
        return F.struct(
            _division(n.tp, n.found, choose(n.wanted == 0, F.lit(1.0), F.lit(0.0))).alias("p"),
            _division(n.tp, n.wanted, F.lit(1.0)).alias("r"),
        )

    return let(
        let(sizes, rates),
        lambda x: F.struct(
            x.p.alias("p"), x.r.alias("r"), _division(2 * x.p * x.r, x.p + x.r, F.lit(0.0)).alias("f1")
        ),
    )


def per_question(
    questions: DataFrame,
    gold: DataFrame,
    predictions: DataFrame,
    docs: DataFrame,
    runs: list[str | int],
    columns: int | None = None,
) -> DataFrame:
    """Six metrics per run and question.

    Questions without gold or without a schema are left out, a missing
    prediction scores as empty. `runs` is the list of runs to score.
    """
    # The last answers of all runs travel with their question, which meets gold and schema once.
    known = predictions.where(F.col("question_id").isNotNull() & F.col("run_id").isin(runs))
    answers = last_wins(known).groupBy("question_id").agg(F.collect_list(F.struct("run_id", "links_json")).alias("answers"))
    wanted = gold.select("question_id", F.col("links_json").alias("wanted"))
    asked = questions.select("question_id", "db_id").join(wanted, "question_id").join(answers, "question_id", "left")
    # Questions per database: enough to find hot databases, without the joins.
    counts = questions.groupBy(db_key(F.col("db_id")).alias("db_key")).agg(F.count(F.lit(1)).alias("n"))
    names = F.col("names")

    def scored(run: Column, answer: Column, g: Column) -> Column:
        return let(
            L.canonical_sets(L.scorer_entries(answer.links_json), names),
            lambda p: let(
                F.struct(prf(p.tables, g.tables).alias("t"), prf(p.pairs, g.pairs).alias("c")),
                lambda m: F.struct(
                    run.alias("run_id"),
                    *[m[level][metric].alias(f"{metric}_{level}") for level in ("t", "c") for metric in ("p", "r", "f1")],
                    p.bad_tables.alias("bad_tables"),
                    p.bad_columns.alias("bad_columns"),
                    # A prediction without links is there all the same; it scores as empty.
                    answer.isNull().alias("is_missing"),
                ),
            ),
        )

    def of_run(run: Column, g: Column) -> Column:
        answer = F.try_element_at(F.filter("answers", lambda a: a.run_id == run), F.lit(1))
        return let(answer, lambda a: scored(run, a, g))

    run_ids = F.array(*[F.lit(r) for r in runs])
    rows = let(
        L.canonical_sets(L.scorer_entries(F.col("wanted")), names, is_gold=True),
        lambda g: F.transform(run_ids, lambda run: of_run(run, g)),
    )
    made = inline_rows(with_name_index(asked, docs, columns, counts), rows, "run_id", "question_id", "db_id")
    return made.select("run_id", "question_id", "db_id", *made.columns[3:])


def _with_scores(averages: DataFrame) -> DataFrame:
    third = lambda level: (F.col(f"p_{level}") + F.col(f"r_{level}") + F.col(f"f1_{level}")) / 3.0
    return averages.withColumns({"table_score": third("t"), "column_score": third("c")}).withColumn(
        "leaderboard_score", 0.5 * F.col("table_score") + 0.5 * F.col("column_score")
    )


def _measures() -> list[Column]:
    return [
        *[F.avg(m).alias(m) for m in METRICS],
        F.count(F.lit(1)).alias("questions"),
        F.count_if("is_missing").alias("missing"),
        F.sum("bad_tables").alias("bad_tables"),
        F.sum("bad_columns").alias("bad_columns"),
    ]


def _averages(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*_measures())


def macro_scores(rows: DataFrame) -> DataFrame:
    """Averages, scores and unknown identifier counts per run."""
    return _with_scores(_averages(rows, "run_id"))


def by_database(rows: DataFrame) -> DataFrame:
    """The same per run and database, to find weak databases."""
    return _with_scores(_averages(rows, "run_id", "db_id"))


def scores_by_level(rows: DataFrame) -> DataFrame:
    """`macro_scores` (`level` run, without `db_id`) and `by_database` (`level` database) from one pass over the scoring."""
    level = F.when(F.grouping("db_id") == 1, "run").otherwise("database").alias("level")
    both = rows.groupingSets([["run_id"], ["run_id", "db_id"]], "run_id", "db_id").agg(level, *_measures())
    return _with_scores(both)


def hallucinations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(
        F.sum("bad_tables").alias("bad_tables"), F.sum("bad_columns").alias("bad_columns")
    )


def eval_diagnostics(
    questions: DataFrame,
    gold: DataFrame,
    predictions: DataFrame,
    docs: DataFrame,
    columns: int | None = None,
) -> DataFrame:
    """Per run: repeated entries, ids nobody asked, and predictions that go
    unscored because the question has no schema or no gold.

    `unscored_*` and `scored` count distinct predicted questions of the run;
    `evaluable` is the number of questions with schema and gold, so a run
    misses `evaluable - scored` predictions.
    """
    present = {"has_schema": F.lit(True)}
    status = (
        with_catalog(questions.select("question_id", "db_id"), docs, columns, present, how="left")
        .join(gold.select("question_id", F.lit(True).alias("has_gold")), "question_id", "left")
        .select(
            "question_id",
            F.when(F.col("has_schema").isNull(), "no_schema")
            .when(F.col("has_gold").isNull(), "no_gold")
            .otherwise("scored")
            .alias("status"),
        )
    )
    # Questions and predicted ids meet once; an id holds at most one entry per run.
    last = last_wins(predictions)
    keys = [c for c in ("question_id", "question_key") if c in last.columns]
    answer = lambda run, entries, asked: F.struct(
        run.alias("run_id"), entries.alias("entries"), F.lit(asked).alias("asked")
    )
    by_id = last.groupBy(*keys).agg(
        F.collect_list(answer(F.col("run_id"), F.col("entries"), False)).alias("answers")
    )
    # The question itself counts as one more row, of no run.
    nobody = F.lit(None).cast(last.schema["run_id"].dataType)
    asked = F.when(F.col("status").isNotNull(), F.array(answer(nobody, F.lit(0).cast("long"), True)))
    rows = status.join(by_id, "question_id", "full").select(
        "status", F.explode(F.flatten(F.array_compact(F.array("answers", asked)))).alias("a")
    ).select("status", "a.*")
    counted = rows.groupBy("run_id", "asked").agg(
        F.sum(F.col("entries") - 1).alias("duplicates"),
        F.count_if(F.col("status").isNull()).alias("extra"),
        F.count_if(F.col("status") == "no_schema").alias("unscored_no_schema"),
        F.count_if(F.col("status") == "no_gold").alias("unscored_no_gold"),
        F.count_if(F.col("status") == "scored").alias("scored"),
    )
    # One row per run, and one for the questions.
    evaluable = F.max(F.when(F.col("asked"), F.col("scored"))).over(W.partitionBy())
    return (
        counted.withColumn("evaluable", F.coalesce(evaluable, F.lit(0).cast("long")))
        .withColumn("missing", F.col("evaluable") - F.col("scored"))
        .where(~F.col("asked"))
        .drop("asked")
    )


def extra_predictions(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """Predicted ids that nobody asked."""
    return (
        predictions.select("run_id", "question_id")
        .distinct()
        .join(questions.select("question_id"), "question_id", "left_anti")
    )


def eval_report(scores: DataFrame) -> DataFrame:
    """The text report of each run, four decimals."""
    four = lambda name: F.format_number(F.col(name), 4)
    rule = "((P+R+F1)/3)"
    lines = [
        F.format_string("Evaluated:                  %d questions", F.col("questions")),
        F.when(
            F.col("missing") > 0,
            F.format_string("Missing prediction count:   %d  (scored as empty)", F.col("missing")),
        ),
        F.format_string(
            "Schema-invalid identifiers: tables=%d, columns=%d", F.col("bad_tables"), F.col("bad_columns")
        ),
        F.lit(""),
        F.lit("---- Table-level (macro-averaged across questions) ----"),
        F.concat(F.lit("  Precision_T : "), four("p_t")),
        F.concat(F.lit("  Recall_T    : "), four("r_t")),
        F.concat(F.lit("  F1_T        : "), four("f1_t")),
        F.concat(F.lit("  Table Score : "), four("table_score"), F.lit("     " + rule)),
        F.lit(""),
        F.lit("---- Column-level (Table.Column pairs, macro-averaged) ----"),
        F.concat(F.lit("  Precision_C : "), four("p_c")),
        F.concat(F.lit("  Recall_C    : "), four("r_c")),
        F.concat(F.lit("  F1_C        : "), four("f1_c")),
        F.concat(F.lit("  Column Score: "), four("column_score"), F.lit("     " + rule)),
        F.lit(""),
        F.concat(
            F.lit("==> Leaderboard Score : "),
            four("leaderboard_score"),
            F.lit("   (0.5*Table + 0.5*Column)"),
        ),
    ]
    return scores.select("run_id", F.concat_ws("\n", *lines).alias("report"))


# Label in a report for each leaderboard metric.
REPORT_LABELS = {
    "leaderboard_score": "Leaderboard Score",
    "precision_t": "Precision_T",
    "recall_t": "Recall_T",
    "f1_t": "F1_T",
    "table_score": "Table Score",
    "precision_c": "Precision_C",
    "recall_c": "Recall_C",
    "f1_c": "F1_C",
    "column_score": "Column Score",
}


def parse_report(reports: DataFrame, text: str = "report") -> DataFrame:
    """Metrics out of report text; -1 where a line is missing."""
    number = lambda label: F.coalesce(
        F.regexp_extract(F.col(text), label + r"\s*:\s*([0-9.]+)", 1).try_cast("double"), F.lit(-1.0)
    )
    return reports.withColumns({name: number(label) for name, label in REPORT_LABELS.items()})


def leaderboard(scores: DataFrame, runs: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """All runs, best first; a run without scores gets -1.

    `runs` holds `run_id, run_name, adapter_dir, base_model`. Metrics are those
    of the four-decimal report. Equal scores keep the order of the paths.
    `outcomes` (`run_id, inferred, evaluated`), if given, says which steps of a
    run went well: a run that was not inferred has no metrics, one whose
    scoring failed keeps what it has, but is not `ok`. A run that it does not
    list, or lists with null, is judged by its scores.
    """
    printed = parse_report(eval_report(scores)).drop("report")
    board = runs.join(printed, "run_id", "left")
    metrics = {name: F.coalesce(name, F.lit(-1.0)) for name in REPORT_LABELS}
    status = F.when(F.col("leaderboard_score").isNull(), "infer_failed").otherwise("ok")
    if outcomes is not None:
        board = board.join(outcomes.select("run_id", "inferred", "evaluated"), "run_id", "left")
        lost = F.col("inferred") == F.lit(False)
        metrics = {name: F.when(lost, F.lit(-1.0)).otherwise(value) for name, value in metrics.items()}
        status = (
            F.when(lost, "infer_failed")
            .when(F.col("evaluated") == F.lit(False), "eval_failed")
            .when(F.col("inferred") & F.col("evaluated"), "ok")
            .otherwise(status)
        )
    return (
        board.withColumn("status", status)
        .withColumns(metrics)
        .drop("inferred", "evaluated")
        .orderBy(F.col("leaderboard_score").desc(), "adapter_dir")
    )


def best_run(board: DataFrame, min_score: float = -1.0) -> DataFrame:
    """The best run that went well, and whether it is good enough to promote."""
    return (
        board.where((F.col("status") == "ok") & (F.col("leaderboard_score") >= 0))
        .orderBy(F.col("leaderboard_score").desc(), "adapter_dir")
        .limit(1)
        .withColumn("promote", F.col("leaderboard_score") >= min_score)
    )


def runs_with_config(board: DataFrame, configs: DataFrame) -> DataFrame:
    """Hyper-parameters beside the scores; one row per run on both sides."""
    return board.join(configs, "run_id", "left")
