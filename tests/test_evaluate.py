import pytest
from helpers import asked, doc, docs
from pyspark.sql import functions as F

from schemaloom.operators import evaluate as E
from schemaloom.plans import jobs

DB = doc({"A": ["x", "y"], "B": ["z"]})


@pytest.mark.parametrize(
    "pred, gold, p, r, f1",
    [
        ([], [], 1, 1, 1),
        ([], ["a"], 0, 0, 0),
        (["a"], [], 0, 1, 0),
        (["a", "b"], ["b", "c"], 0.5, 0.5, 0.5),
        (["a"], ["a"], 1, 1, 1),
        (["a"], ["b"], 0, 0, 0),
        (["a", "b", "c"], ["a"], 1 / 3, 1, 0.5),
    ],
)
def test_prf(spark, pred, gold, p, r, f1):
    df = spark.createDataFrame([(pred, gold)], "p array<string>, g array<string>")
    got = df.select(E.prf(F.col("p"), F.col("g")).alias("m")).first().m
    assert (got.p, got.r, got.f1) == pytest.approx((p, r, f1))


@pytest.fixture()
def data(spark):
    questions = asked(spark, [(i, "nowhere" if i == 5 else "k", "q") for i in range(1, 7)])
    gold = spark.createDataFrame(
        [(1, '{"A":["x"]}'), (2, '{"A":[]}'), (3, '{"A":["x"],"B":["z"]}'), (4, '{"B":["z"]}'), (5, "{}")],
        "question_id bigint, links_json string",
    )
    predictions = spark.createDataFrame(
        [
            ("r1", 1, '{"a":["X"]}', 0),
            ("r1", 2, '{"A":["x"]}', 1),
            ("r1", 2, '{"A":[]}', 2),  # the last one counts
            ("r1", 3, '{"A":["x","ghost"],"ghost":["q"]}', 3),
            ("r1", 5, '{"A":[]}', 4),
            ("r1", 6, '{"A":[]}', 5),
            ("r1", 99, '{"A":[]}', 6),
            ("r1", None, '{"A":[]}', 7),
            ("r2", 1, "[1]", 0),
        ],
        "run_id string, question_id bigint, links_json string, pos bigint",
    )
    return questions, gold, predictions, docs(spark, {"k": DB})


def test_per_question(data):
    rows = {(r.run_id, r.question_id): r for r in E.per_question(*data, ["r1", "r2"], 10).collect()}
    # 5 has no schema and 6 no gold: both are left out.
    assert sorted(rows) == [(r, q) for r in ("r1", "r2") for q in (1, 2, 3, 4)]
    metrics = lambda key: tuple(rows[key][m] for m in E.METRICS)
    assert metrics(("r1", 1)) == (1, 1, 1, 1, 1, 1)
    assert metrics(("r1", 2)) == (1, 1, 1, 1, 1, 1)
    assert metrics(("r1", 3)) == pytest.approx((0.5, 0.5, 0.5, 1 / 3, 0.5, 0.4))
    assert metrics(("r1", 4)) == (0, 0, 0, 0, 0, 0) and rows["r1", 4].is_missing
    assert (rows["r1", 3].bad_tables, rows["r1", 3].bad_columns) == (1, 2)
    # Something else than an object scores as empty but is not missing.
    assert metrics(("r2", 1)) == (0, 0, 0, 0, 0, 0) and not rows["r2", 1].is_missing
    # Empty gold columns against nothing predicted are perfect.
    assert metrics(("r2", 2)) == (0, 0, 0, 1, 1, 1)


def test_shuffled_plan_gives_the_same(data):
    a = sorted(map(tuple, E.per_question(*data, ["r1", "r2"], 10).collect()))
    b = sorted(map(tuple, E.per_question(*data, ["r1", "r2"], None).collect()))
    assert a == b


def test_diagnostics(data):
    rows = {r.run_id: r for r in E.eval_diagnostics(*data, 10).collect()}
    r1 = rows["r1"]
    assert (r1.duplicates, r1.extra, r1.unscored_no_schema, r1.unscored_no_gold, r1.scored, r1.evaluable, r1.missing) == (
        1, 2, 1, 1, 3, 4, 1,
    )
    assert rows["r2"].missing == 3
    extra = {(r.run_id, r.question_id) for r in E.extra_predictions(data[2].where("question_id is not null"), data[0]).collect()}
    assert extra == {("r1", 99)}


def test_leaderboard_and_best_run(spark, data):
    runs = spark.createDataFrame(
        [(r, r, f"runs/{n}", "m") for r, n in (("r1", "10"), ("r2", "2"), ("r3", "1"))],
        "run_id string, run_name string, adapter_dir string, base_model string",
    )
    board = jobs.score_runs(*data, runs, ["r1", "r2"], 10)
    rows = board.collect()
    assert [(r.run_id, r.status) for r in rows] == [("r1", "ok"), ("r2", "ok"), ("r3", "infer_failed")]
    assert rows[2].leaderboard_score == -1.0 and rows[2].f1_t == -1.0
    best = E.best_run(board, min_score=0.99).first()
    assert best.run_id == "r1" and best.promote is False


def test_text_ids_stay_apart(spark, data):
    questions, gold, _, docs = data
    rows = [(1, "1"), (None, "text:1"), (None, "text:x"), (None, "text:x")]
    preds = spark.createDataFrame(
        [("r", q, key, "{}", i) for i, (q, key) in enumerate(rows)],
        "run_id string, question_id bigint, question_key string, links_json string, pos int",
    )
    row = E.eval_diagnostics(questions, gold, preds, docs, 10).first()
    assert (row.duplicates, row.extra, row.scored) == (1, 2, 1)
    assert E.per_question(questions, gold, preds, docs, ["r"], 10).where("not is_missing").count() == 1


def test_outcomes_of_runs(spark, data):
    runs = spark.createDataFrame(
        [(r, r, f"runs/{r}", "m") for r in ("r1", "r2", "r3", "r4")],
        "run_id string, run_name string, adapter_dir string, base_model string",
    )
    outcomes = spark.createDataFrame(
        [("r1", True, False), ("r2", True, True), ("r3", False, None)], "run_id string, inferred boolean, evaluated boolean"
    )
    scores = E.macro_scores(E.per_question(*data, ["r1", "r2"], 10))
    board = E.leaderboard(scores, runs, outcomes)
    assert board.columns == E.leaderboard(scores, runs).columns
    status = {r.run_id: (r.status, r.leaderboard_score >= 0) for r in board.collect()}
    assert status == {
        "r1": ("eval_failed", True), "r2": ("ok", True), "r3": ("infer_failed", False), "r4": ("infer_failed", False),
    }
    assert E.best_run(board).first().run_id == "r2"


def test_equal_scores_keep_path_order(spark):
    scores = spark.createDataFrame(
        [(r, *[0.5] * 9, 4, 0, 0, 0) for r in ("a", "b")],
        "run_id string, p_t double, r_t double, f1_t double, p_c double, r_c double, f1_c double, table_score double,"
        "column_score double, leaderboard_score double, questions bigint, missing bigint, bad_tables bigint, bad_columns bigint",
    )
    runs = spark.createDataFrame(
        [("a", "a", "runs/2", ""), ("b", "b", "runs/10", "")],
        "run_id string, run_name string, adapter_dir string, base_model string",
    )
    assert [r.adapter_dir for r in E.leaderboard(scores, runs).collect()] == ["runs/10", "runs/2"]


# The published scores of six runs: P, R, F1 and score by table, the same by column, total.
PUBLISHED = [
    (0.4983, 0.4884, 0.4828, 0.4899, 0.3945, 0.4072, 0.385, 0.3955, 0.4427),
    (0.5033, 0.4835, 0.4776, 0.4881, 0.3836, 0.4039, 0.375, 0.3875, 0.4378),
    (0.4917, 0.4546, 0.4571, 0.4678, 0.4021, 0.4037, 0.3822, 0.396, 0.4319),
    (0.4818, 0.4612, 0.4571, 0.4667, 0.3526, 0.3636, 0.337, 0.3511, 0.4089),
    (0.462, 0.4554, 0.4425, 0.4533, 0.3433, 0.3493, 0.3288, 0.3405, 0.3969),
    (0.434, 0.3828, 0.3915, 0.4028, 0.1921, 0.1898, 0.1799, 0.1873, 0.295),
]


def test_published_scores(spark):
    df = spark.createDataFrame(
        [(i, *r[0:3], *r[4:7], r[3], r[7], r[8]) for i, r in enumerate(PUBLISHED)],
        "run_id int, p_t double, r_t double, f1_t double, p_c double, r_c double, f1_c double, t double, c double, l double",
    )
    for r in E._with_scores(df).collect():
        assert (r.table_score, r.column_score, r.leaderboard_score) == pytest.approx((r.t, r.c, r.l), abs=1.5e-4)


REPORT = """Evaluated:                  101 questions
Schema-invalid identifiers: tables=0, columns=0

---- Table-level (macro-averaged across questions) ----
  Precision_T : 0.6675
  Recall_T    : 0.6757
  F1_T        : 0.6509
  Table Score : 0.6647     ((P+R+F1)/3)

---- Column-level (Table.Column pairs, macro-averaged) ----
  Precision_C : 0.4705
  Recall_C    : 0.5046
  F1_C        : 0.4517
  Column Score: 0.4756     ((P+R+F1)/3)

==> Leaderboard Score : 0.5702   (0.5*Table + 0.5*Column)"""


def test_report_text_and_back(spark):
    scores = spark.createDataFrame(
        [(1, 0.6675, 0.6757, 0.6509, 0.4705, 0.5046, 0.4517, 0.6647, 0.4756, 0.5702, 101, 0, 0, 0)],
        "run_id int, p_t double, r_t double, f1_t double, p_c double, r_c double, f1_c double, table_score double,"
        "column_score double, leaderboard_score double, questions bigint, missing bigint, bad_tables bigint, bad_columns bigint",
    )
    report = E.eval_report(scores)
    assert report.first().report == REPORT
    back = E.parse_report(report).first()
    assert (back.leaderboard_score, back.table_score, back.f1_c) == (0.5702, 0.6647, 0.4517)
    empty = E.parse_report(spark.createDataFrame([("No questions evaluated.",)], "report string")).first()
    assert empty.leaderboard_score == -1.0 and empty.recall_c == -1.0
    missing = E.eval_report(scores.withColumn("missing", F.lit(3))).first().report
    assert "Missing prediction count:   3  (scored as empty)" in missing


def test_both_levels_from_one_scoring(spark):
    fields = ", ".join(f"{m} double" for m in E.METRICS)
    rows = [(r, db, *[(i + r) / 10] * 6, i, 1, i % 2 == 0) for i, (r, db) in enumerate([(1, "a"), (1, "b"), (1, None), (2, "a"), (2, "a")])]
    df = spark.createDataFrame(rows, f"run_id int, db_id string, {fields}, bad_tables bigint, bad_columns bigint, is_missing boolean")
    got = E.scores_by_level(df)
    of = lambda level: sorted(map(str, got.where(F.col("level") == level).drop("level").collect()))
    assert of("database") == sorted(map(str, E.by_database(df).select(got.drop("level").columns).collect()))
    runs = E.macro_scores(df).withColumn("db_id", F.lit(None).cast("string")).select(got.drop("level").columns)
    assert of("run") == sorted(map(str, runs.collect()))
