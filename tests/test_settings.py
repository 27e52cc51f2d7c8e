"""Settings of many runs as rows, and candidates under all of them."""

import json

import pytest
from helpers import asked, doc, docs
from pyspark.sql import functions as F

from schemaloom.config import PRESETS, RetrievalConfig
from schemaloom.operators import budgets as B
from schemaloom.operators import retrieval as R
from schemaloom.plans import jobs
from schemaloom.sources import readers, settings

DB = doc(
    {"Shop": [("ShopID", "number"), "Name", "TownID", "Opened"], "Town": ["TownID", "Name"], "Staff": ["StaffID", "ShopID"]},
    pk=["Shop.ShopID"], fk=[("Shop.TownID", "Town.TownID"), ("Staff.ShopID", "Shop.ShopID")],
)
SMALL = {"max_tables": 1, "max_columns_per_table": 2, "min_columns_per_table": 1, "join_neighbor_limit": 1}
FILES = {
    "a": {"retrieval": SMALL, "unknown": 1},
    "b": {"output_format": "Names", "retrieval": {**SMALL, "include_join_neighbors": False, "include_types": False}},
    "c": {"retrieval": {**SMALL, "include_keys": False, "extra": [1]}, "train_config": {"lr": 0.1}, "base_model": "own"},
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for run in (*FILES, "d"):
        folder = root / run / "adapter"
        folder.mkdir(parents=True)
        (folder / "adapter_config.json").write_text(json.dumps({"base_model_name_or_path": f"base-{run}"}))
        if run in FILES:
            (folder / "run_config.json").write_text(json.dumps(FILES[run], indent=1))
    rows = settings.read_settings(spark, f"{root}/*/adapter/run_config.json")
    return settings.settings_of_runs(readers.read_runs(spark, str(root), "local"), rows)


def test_settings_of_runs(found):
    got = {r.run_id: r for r in found.collect()}
    assert {k: (r.base_model, r.output_format, r.max_input_length, r.train_config) for k, r in got.items()} == {
        "a": ("base-a", "ids", 2048, "{}"), "b": ("base-b", "names", 2048, "{}"),
        "c": ("own", "ids", 2048, '{"lr":0.1}'), "d": ("base-d", "ids", 2048, "{}"),
    }
    for run, file in FILES.items():
        assert got[run].retrieval.asDict() == RetrievalConfig.from_mapping(file["retrieval"]).to_dict()
    assert got["d"].retrieval.asDict() == PRESETS["grid"].to_dict()


def test_one_job_equals_one_job_per_run(spark, found):
    rows = asked(spark, [(1, "k", "name of the shop"), (2, "k", "staff"), (3, "gone", "x"), (4, "k", None)])
    catalog = docs(spark, {"k": DB})
    prompts = B.prompts_by_run(rows, catalog, found, 20)
    got = {(r.run_id, r.question_id): (r.candidates, r.prompt) for r in prompts.collect()}
    for run in (*FILES, "d"):
        cfg = RetrievalConfig.from_mapping(FILES[run]["retrieval"]) if run in FILES else PRESETS["grid"]
        one = jobs.prompts(rows, catalog, cfg, "names" if run == "b" else "ids", 20).collect()
        assert {r.question_id: (r.candidates, r.prompt) for r in one} == {q: v for (r, q), v in got.items() if r == run}
    assert len(got) == 12


def test_no_runs_and_too_many(spark, found, monkeypatch):
    scored = R.with_scores(asked(spark, [(1, "k", "name")]), docs(spark, {"k": DB}), 20)
    assert B.candidates_by_run(scored, found.where("false")).count() == 0
    monkeypatch.setattr(B, "MOST_RUNS", 3)
    with pytest.raises(Exception, match="more than 3 runs"):
        B.candidates_by_run(scored, found).collect()


@pytest.mark.parametrize(
    "text, message",
    [("{", "broken settings: /x/s.json"), ('{"output_format": "xml"}', "unsupported output_format: xml"),
     ('{"retrieval": {"max_tables": "many"}}', "many")],
)
def test_wrong_settings_stop_the_job(spark, text, message):
    files = spark.createDataFrame([("/x/s.json", text)], "path string, value string")
    with pytest.raises(Exception, match=message):
        settings.settings_rows(files).collect()


def test_empty_settings_are_the_defaults(spark):
    files = spark.createDataFrame([("file:///x/s.json", "{}"), ("/y/s.json", '{"retrieval": null, "train_config": null}')], "path string, value string")
    rows = settings.settings_rows(files).orderBy("adapter_dir").collect()
    assert [r.adapter_dir for r in rows] == ["/x", "/y"]
    assert all(r.retrieval.asDict() == PRESETS["default"].to_dict() and r.base_model is None for r in rows)
    assert settings.settings_rows(files.where("false")).count() == 0
