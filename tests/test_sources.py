import json
from pathlib import Path

import pytest
from helpers import doc, docs
from pyspark.sql import functions as F

from schemaloom.config import PRESETS, RunConfig
from schemaloom.operators import curate as U
from schemaloom.operators import evaluate as E
from schemaloom.sources import folders, readers, writers
from workloads import queries


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))
    return str(path)


EXAMPLES = [
    {"question_id": i, "db_id": "d", "question": "q;1", "gold_sql": 'select "a", count(*)', "schema_links": {"T": ["c"], "U": []}}
    for i in range(3)
]


def test_examples_and_questions(spark, tmp_path):
    path = put(tmp_path / "train.json", EXAMPLES)
    df = readers.check_examples(readers.read_examples(spark, path))
    assert df.count() == 3 and df.first().schema_links == {"T": ["c"], "U": []}
    assert readers.read_questions(spark, path).columns == ["file_path", "pos", "question_id", "db_id", "question", "question_key"]
    bad = put(tmp_path / "bad.json", EXAMPLES + [{"question_id": 9}])
    with pytest.raises(ValueError):
        readers.check_examples(readers.read_examples(spark, bad))


def test_predictions_keep_raw_values_and_places(spark, tmp_path):
    rows = [
        {"question_id": 1, "schema_links": {"T": ["c", 1, None]}},
        {"question_id": "2", "schema_links": {"T": []}},
        {"question_id": 1, "schema_links": "text"},
        {"question_id": 3},
    ]
    put(tmp_path / "exp" / "runA" / "preds.json", rows)
    put(tmp_path / "exp" / "runB" / "preds.json", rows[:1])
    df = readers.read_predictions(spark, str(tmp_path / "exp" / "*" / "preds.json"))
    got = [(r.question_id, r.links_json, r.pos) for r in df.where("run_id = 'runA'").orderBy("pos").collect()]
    assert got == [(1, '{"T":["c",1,null]}', 0), (None, '{"T":[]}', 1), (1, "text", 2), (3, None, 3)]
    assert df.where("run_id = 'runB'").count() == 1
    last = {r.question_id: r.links_json for r in E.last_wins(df.where("run_id = 'runA'")).collect()}
    assert last[1] == "text"
    # The text "2" is no number.
    keys = [r.question_key for r in df.where("run_id = 'runA'").orderBy("pos").collect()]
    assert keys == ["1", "text:2", "1", "3"]


def test_last_prediction_over_several_files(spark, tmp_path):
    for name, links in (("b", {"B": []}), ("a", {"A": []})):
        rows = [{"question_id": 9, "schema_links": {}}] * (3 if name == "a" else 0)
        put(tmp_path / "run" / f"{name}.json", [*rows, {"question_id": 1, "schema_links": links}])
    last = E.last_wins(readers.read_predictions(spark, str(tmp_path / "run" / "*.json")))
    assert {r.question_id: (r.links_json, r.entries) for r in last.collect()} == {1: ('{"B":[]}', 2), 9: ("{}", 3)}


def test_input_order(spark, tmp_path):
    ids = (9, 2, 5, 7, 1)
    path = put(tmp_path / "train.json", [EXAMPLES[0] | {"question_id": i} for i in ids])
    df = readers.read_examples(spark, path)
    copies = U.light_balance(df, threshold=6, order=readers.INPUT_ORDER).where("is_oversampled")
    assert [r.question_id for r in copies.collect()] == [9]
    picked = U.select_for_augmentation(U.difficulty(df), 0, 3, readers.INPUT_ORDER)
    assert [r.question_id for r in picked.collect()] == [9, 2, 5]


def test_line_forms(spark, tmp_path):
    lines = "\n".join(json.dumps(e | {"pos": i}) for i, e in enumerate(EXAMPLES))
    path = put(tmp_path / "train.jsonl", lines)
    examples = readers.read_example_lines(spark, path)
    assert [(r.question_id, r.pos, r.schema_links) for r in examples.orderBy("pos").collect()] == [
        (i, i, {"T": ["c"], "U": []}) for i in range(3)
    ]
    assert readers.read_question_lines(spark, path).count() == 3
    twice = lines + "\n" + json.dumps({"question_id": 0, "schema_links": {"Z": []}, "pos": 9})
    gold = {r.question_id: json.loads(r.links_json) for r in readers.read_gold_lines(spark, put(tmp_path / "gold.jsonl", twice)).collect()}
    assert gold[0] == {"Z": []} and gold[1] == {"T": ["c"], "U": []}
    broken = put(tmp_path / "broken.jsonl", lines[:-20])
    for read in (readers.read_question_lines, readers.read_example_lines, readers.read_gold_lines):
        with pytest.raises(Exception, match="broken.jsonl"):
            read(spark, broken).collect()


def test_gold_last_wins(spark, tmp_path):
    path = put(tmp_path / "gold.json", [{"question_id": 1, "schema_links": {"A": []}}, {"question_id": 1, "schema_links": {"B": []}}])
    assert readers.read_gold(spark, path).collect()[0].links_json == '{"B":[]}'


def test_runs(spark, tmp_path):
    settings = {"base_model_name_or_path": "base"}
    for run in ("1", "10"):
        put(tmp_path / "grid" / "my exp" / "runs" / run / "checkpoints" / "final_checkpoint" / "adapter_config.json", settings)
    put(tmp_path / "local" / "first" / "adapter" / "adapter_config.json", {})
    grid = readers.read_runs(spark, str(tmp_path / "grid"), "grid")
    assert sorted((r.run_name, r.base_model) for r in grid.collect()) == [("my_exp_run1", "base"), ("my_exp_run10", "base")]
    local = readers.read_runs(spark, str(tmp_path / "local"), "local").first()
    assert (local.run_name, local.base_model) == ("first", "")
    assert local.adapter_dir.endswith("/local/first/adapter")


def test_run_config_round_trip(spark, tmp_path):
    run = RunConfig(base_model="m", retrieval=PRESETS["final"], max_input_length=6144)
    writers.write_config(spark, run, str(tmp_path / "config"))
    assert readers.read_run_config(spark, str(tmp_path / "config")) == run
    assert readers.read_run_config(spark, str(tmp_path / "absent")) == RunConfig()


def test_reports(spark, tmp_path):
    put(tmp_path / "a.log", "  F1_T        : 0.5\n==> Leaderboard Score : 0.25")
    row = E.parse_report(readers.read_reports(spark, str(tmp_path / "*.log"))).first()
    assert (row.f1_t, row.leaderboard_score, row.f1_c) == (0.5, 0.25, -1.0)


def test_selection_outputs(spark, tmp_path):
    path = put(tmp_path / "train.json", EXAMPLES)
    scored = U.difficulty(readers.read_examples(spark, path))
    picked = U.select_for_augmentation(scored, max_examples=2)
    writers.write_selection(picked, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).orderBy("question_id").first()
    assert row.original_db_example_count == 3 and row.num_linked_tables == 2
    assert row.selection_reasons == ["underrepresented_db:3", "two_tables", "empty_column_table", "aggregate_or_distinct"]
    writers.write_review(picked, str(tmp_path / "review"))
    review = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "review")).collect()
    assert len(review) == 2
    assert review[0].reasons == "underrepresented_db:3;two_tables;empty_column_table;aggregate_or_distinct"
    assert review[0].gold_sql == 'select "a", count(*)'


def test_stats_and_splits(spark, tmp_path):
    path = put(tmp_path / "train.json", EXAMPLES)
    records = U.light_balance(readers.read_examples(spark, path))
    writers.write_stats(records, "training", str(tmp_path / "stats"))
    totals = spark.read.json(str(tmp_path / "stats" / "training" / "totals")).first()
    assert (totals.total_examples, totals.original_examples, totals.split) == (6, 3, "training")
    counts = spark.read.json(str(tmp_path / "stats" / "training" / "examples_per_db")).first()
    assert (counts.db_id, counts.n) == ("d", 6)
    writers.write_splits(records, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split" / "source=original")).count() == 3
    writers.write_jsonl(records, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 6
    settings = writers.preparation_settings(True, False, True)
    writers.write_config(spark, settings, str(tmp_path / "settings"))
    assert json.loads(spark.read.text(str(tmp_path / "settings")).first()[0]) == settings


def test_score_outputs(spark, tmp_path):
    questions = spark.createDataFrame([(1, "k")], "question_id bigint, db_id string")
    gold = spark.createDataFrame([(1, '{"A":["x"]}')], "question_id bigint, links_json string")
    preds = gold.select(F.lit("r").alias("run_id"), "question_id", "links_json", F.lit(0).alias("pos"))
    rows = E.per_question(questions, gold, preds, docs(spark, {"k": doc({"A": ["x"]})}), ["r"], 10)
    writers.write_per_question(rows, str(tmp_path / "rows"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rows")).first().f1_c == "1.0"
    runs = spark.createDataFrame([("r", "r", "runs/1", "m")], "run_id string, run_name string, adapter_dir string, base_model string")
    board = E.leaderboard(E.macro_scores(rows), runs)
    writers.write_leaderboard(board, str(tmp_path / "board"))
    head = spark.read.option("header", True).csv(str(tmp_path / "board")).columns
    assert head == sorted(head) and "leaderboard_score" in head
    writers.write_best_run(E.best_run(board), str(tmp_path / "best"))
    assert spark.read.json(str(tmp_path / "best")).first().run_name == "r"


def test_written_tables_read_back(spark, tmp_path):
    metrics = [c for c in readers.REPORT_METRICS]
    board = spark.createDataFrame(
        [("r", 'a "b", c', "runs/1", "m", "ok", *[0.5] * 9), ("s", None, "runs/2", "", "infer_failed", *[-1.0] * 9)],
        "run_id string, run_name string, adapter_dir string, base_model string, status string, "
        + ", ".join(f"{c} double" for c in metrics),
    )
    writers.write_leaderboard(board, str(tmp_path / "board"))
    got = {r.run_id: r for r in readers.read_leaderboard(spark, str(tmp_path / "board")).collect()}
    assert got["r"].run_name == 'a "b", c' and got["s"].run_name is None and got["s"].f1_t == -1.0
    writers.write_best_run(E.best_run(board), str(tmp_path / "best"))
    assert readers.read_best_run(spark, str(tmp_path / "best")).first().promote
    writers.write_best_run(E.best_run(board.where("status <> 'ok'")), str(tmp_path / "none"))
    assert readers.read_best_run(spark, str(tmp_path / "none")).count() == 0
    # Another table in the place of the leaderboard stops the job.
    board.select("run_id", "status").write.option("header", True).csv(str(tmp_path / "other"))
    with pytest.raises(Exception):
        readers.read_leaderboard(spark, str(tmp_path / "other")).collect()


def test_splits_read_one_folder(spark, tmp_path):
    records = spark.createDataFrame([(1, "original"), (2, "oversampled"), (3, "original")], "question_id long, source string")
    writers.write_splits(records, str(tmp_path / "split"))
    split = readers.read_splits(spark, str(tmp_path / "split"), "question_id bigint")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, records.collect()))
    assert "PartitionFilters: [isnotnull(source" in split.where("source = 'original'")._jdf.queryExecution().executedPlan().toString()


def test_catalog_files(spark, tmp_path):
    put(tmp_path / "s" / "my db.json", {"table_names_original": ["T"], "column_names_original": [[-1, "*"], [0, "c"]], "foreign_keys": [[1, 1]]})
    row = readers.read_catalog(spark, str(tmp_path / "s")).first()
    assert (row.db_key, row.column_names_original, row.foreign_keys) == ("my db", [["-1", "*"], ["0", "c"]], [[1, 1]])
    for name, text in (("cut", '{"table_names_original": ["T"'), ("empty", ""), ("list", "[1]")):
        put(tmp_path / name / f"{name}.json", text)
        if name != "empty":  # a file without text has no row
            with pytest.raises(Exception, match=f"{name}.json"):
                readers.read_catalog(spark, str(tmp_path / name)).collect()


def test_work_folder(spark, monkeypatch):
    assert folders.work_folder(spark, "a") != folders.work_folder(spark, "a")

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError):
        folders.work_folder(Cluster, "a")


def test_prediction_lines(spark, tmp_path):
    parsed = spark.createDataFrame([(1, [("A", ["x"])])], "question_id bigint, parsed array<struct<table_name:string,cols:array<string>>>")
    writers.write_predictions(parsed, str(tmp_path / "p"))
    assert readers.read_links(spark, put(tmp_path / "list.json", [{"question_id": 1, "schema_links": {}}])).count() == 1
    row = readers.read_prediction_lines(spark, str(tmp_path / "p")).first()
    assert (row.question_id, row.links_json) == (1, '{"A":["x"]}')


@pytest.mark.parametrize("read", [readers.read_catalog, readers.read_questions, readers.read_examples, readers.read_predictions])
def test_broken_files_are_named(spark, tmp_path, read):
    path = put(tmp_path / "broken.json", json.dumps(EXAMPLES)[:-30])
    with pytest.raises(Exception, match="broken.json"):
        read(spark, path).collect()


def test_predictions_with_equal_table_names(spark, tmp_path):
    entries = [("T", ["a"]), ("U", ["b"]), ("T", ["c"])]
    df = spark.createDataFrame([(1, entries)], "question_id int, parsed array<struct<table_name string, cols array<string>>>")
    writers.write_predictions(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["schema_links"] == {"U": ["b"], "T": ["c"]}


def test_a_cut_prediction_line_stops_the_job(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"run_id": "1", "question_id": 1, "pos": 0, "schema_links": "{}"}\n{"run_id": "1", "quest')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_prediction_lines(spark, str(tmp_path)).collect()


def test_text_ids_are_scored_by_key(spark, tmp_path):
    ids = [1, "1", "q-7", 8.5, None]
    asked = [{"question_id": i, "db_id": "k", "question": f"q{n}"} for n, i in enumerate(ids)]
    gold = [{"question_id": i, "schema_links": {"A": ["x"]}} for i in ids[:4]]
    wrong = {"schema_links": {"A": []}}
    answers = [{"question_id": i, "schema_links": {"A": ["x"]}} for i in ids[:3]] + [{"question_id": 1, **wrong}]
    keys = ["1", "text:1", "text:q-7", "text:8.5", None]
    lines = lambda rows: "\n".join(json.dumps(r | {"pos": n, "run_id": "r"}) for n, r in enumerate(rows))
    questions = readers.read_questions(spark, put(tmp_path / "q.json", asked))
    assert [(r.question_key, r.pos, r.question) for r in questions.orderBy("pos").collect()] == [
        (key, n, f"q{n}") for n, key in enumerate(keys)
    ]
    assert [r.question_id for r in questions.orderBy("pos").collect()] == [1, None, None, None, None]
    read = lambda: readers.read_question_lines(spark, put(tmp_path / "q.jsonl", lines(asked)))
    assert sorted((r.question, r.question_id, r.question_key) for r in read().collect()) == sorted(
        (r.question, r.question_id, r.question_key) for r in questions.collect()
    )
    whole = (
        readers.read_gold(spark, put(tmp_path / "g.json", gold)),
        readers.read_predictions(spark, put(tmp_path / "r" / "p.json", answers)),
    )
    split = (
        readers.read_gold_lines(spark, put(tmp_path / "g.jsonl", lines(gold))),
        readers.read_prediction_lines(spark, put(tmp_path / "p.jsonl", lines(answers))),
    )
    catalog = docs(spark, {"k": doc({"A": ["x"]})})
    for g, p in (whole, split):
        rows = E.per_question(readers.by_key(questions), readers.by_key(g), readers.by_key(p), catalog, ["r"], 10)
        got = {r.question_id: (r.f1_c, r.is_missing) for r in rows.collect()}
        assert got == {"1": (0.0, False), "text:1": (1.0, False), "text:q-7": (1.0, False), "text:8.5": (0.0, True)}


def test_compressed_lines(spark, tmp_path):
    """Records that repeat a schema take little disk as gzip, and read back whole."""
    schema = " ".join(f"table_{i} column_{i * 7919 % 1000}" for i in range(100))
    rows = spark.range(2_000).select(F.col("id").alias("question_id"), F.concat(F.lit(schema), "id").alias("text"))
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    writers.write_jsonl(rows, plain)
    writers.write_jsonl(rows, small, "gzip")
    read = lambda path: sorted(map(tuple, spark.read.schema("question_id bigint, text string").json(path).collect()))
    assert read(small) == read(plain) and len(read(small)) == 2_000
    size = lambda path, end: sum(f.stat().st_size for f in Path(path).glob(f"part-*{end}"))
    assert 0 < size(small, ".json.gz") < size(plain, ".json") / 10


def test_records_query_writes_whole_compressed_records(spark, tmp_path, monkeypatch):
    customers = [(i, f"Customer#{i:09d}", 0, 1.0, "BUILDING") for i in range(8)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    orders = spark.range(80).selectExpr(
        "id AS o_orderkey", "id % 8 AS o_custkey", "'O' AS o_orderstatus", "1D AS o_totalprice", "TIMESTAMP'1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    path = tmp_path / "records"
    monkeypatch.setattr(queries.folders, "work_folder", lambda spark, name: str(path))
    assert tuple(queries.QUERIES["records_written"](spark, str(tmp_path)).first()) == (68, 80, 12)
    assert list(path.glob("part-*")) and all(f.name.endswith(".json.gz") for f in path.glob("part-*"))
    written = spark.read.json(str(path))
    assert {r.question_id for r in written.collect()} == {i for i in range(80) if i % 7}
    assert written.where("size(messages) = 3 and schema_links is not null and source = 'original'").count() == 68
