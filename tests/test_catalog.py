from helpers import doc, docs, write_docs
from pyspark.sql import functions as F

from schemaloom.operators import catalog as C
from schemaloom.sources import readers, writers

SITE = doc(
    {"Visits": [("VisitID", "number"), ("ObserverID", "number")], "Observers": [("ObserverID", "number"), "Name"], "Empty": []},
    pk=["Visits.VisitID", "Observers.ObserverID"],
    fk=[("Visits.ObserverID", "Observers.ObserverID")],
)


def columns(spark, d, **kw):
    rows = C.catalog_columns(docs(spark, {"k": d}), **kw).orderBy("col_idx").collect()
    return [(r.table_name, r.col_name, r.col_type, r.is_pk, r.is_fk) for r in rows]


def test_columns_and_keys(spark):
    assert columns(spark, SITE) == [
        ("Visits", "VisitID", "number", True, False),
        ("Visits", "ObserverID", "number", False, True),
        ("Observers", "ObserverID", "number", True, True),
        ("Observers", "Name", "text", False, False),
    ]
    assert [c[4] for c in columns(spark, SITE, fk_ends="source")] == [False, True, False, False]


def test_type_shift_only_when_one_short(spark):
    tables = {"t": ["a", "b", "c"]}
    kinds = lambda types: [c[2] for c in columns(spark, doc(tables, types=types))]
    assert kinds(["x", "number", "text", "time"]) == ["number", "text", "time"]
    assert kinds(["number", "text", "time"]) == ["number", "text", "time"]
    assert kinds(["x", "number"]) == ["number", "unknown", "unknown"]
    assert kinds(["x", "", "text", "time"]) == ["unknown", "text", "time"]
    assert kinds([]) == ["unknown"] * 3


def test_malformed_parts_are_skipped(spark):
    d = doc({"t": ["a", "b"]})
    d["column_names_original"] += [[0], [0, "c", "d"], [7, "far"]]
    d["foreign_keys"] = [[1], [1, 2, 3], [1, 2]]
    assert [c[1] for c in columns(spark, d)] == ["a", "b"]
    assert C.fk_edges(docs(spark, {"k": d})).count() == 0


def test_plain_names_are_the_fallback(spark):
    d = doc({"t": ["a"]})
    d["table_names"], d["column_names"] = d.pop("table_names_original"), d.pop("column_names_original")
    assert [c[:2] for c in columns(spark, d)] == [("t", "a")]


def test_tables_without_columns_are_kept(spark):
    rows = C.catalog_tables(docs(spark, {"k": SITE})).orderBy("table_idx").collect()
    assert [r.table_name for r in rows] == ["Visits", "Observers", "Empty"]


def test_edges_are_undirected_and_distinct(spark):
    d = doc(
        {"a": ["x", "y"], "b": ["x"]},
        fk=[("a.x", "b.x"), ("a.y", "b.x"), ("a.x", "a.y")],
    )
    rows = {tuple(r) for r in C.fk_edges(docs(spark, {"k": d})).select("src_table", "dst_table").collect()}
    assert rows == {("a", "b"), ("b", "a")}


def test_schema_map_keeps_order_and_last_of_equal_names(spark):
    d = doc({"z": ["b", "a"], "y": ["c"]})
    d["table_names_original"] = ["z", "z"]
    df = C.schema_map(docs(spark, {"k": doc({"z": ["b", "a"], "y": ["c"]}), "d": d}))
    got = {r[0]: list(zip(r[1], r[2])) for r in df.select("db_key", F.map_keys("schema"), F.map_values("schema")).collect()}
    assert got["k"] == [("z", ["b", "a"]), ("y", ["c"])]
    assert got["d"] == [("z", ["c"])]


def test_lookup_last_of_folded_names_wins(spark):
    d = doc({"T": ["Name", "NAME"]})
    rows = C.schema_lookup(C.catalog_columns(docs(spark, {"k": d}))).collect()
    assert [(r.col_lc, r.col_name) for r in rows] == [("name", "NAME")]


def test_columns_by_table_reads_types_by_position(spark):
    d = doc({"t": [("a", "number"), ("b", "text")]}, types=["number", "text"])
    plain = C.columns_by_table(docs(spark, {"k": d})).collect()
    assert [(r.col_name, r.col_type) for r in plain] == [("a", "text")]
    shifted = C.columns_by_table(docs(spark, {"k": d}), type_rule="shifted").collect()
    assert [(r.col_name, r.col_type) for r in shifted] == [("a", "number"), ("b", "text")]


def test_read_catalog_from_files(spark, tmp_path):
    write_docs(tmp_path / "schemas", {"field_survey_2024": SITE, "other": doc({"t": ["a"]})})
    read = readers.read_catalog(spark, str(tmp_path / "schemas"))
    assert {r.db_key for r in read.collect()} == {"field_survey_2024", "other"}
    same = docs(spark, {"field_survey_2024": SITE, "other": doc({"t": ["a"]})})
    a, b = (sorted(map(tuple, C.catalog_columns(d).collect())) for d in (read, same))
    assert a == b
    key = spark.createDataFrame([("field survey/2024",)], "db_id string").select(C.db_key(F.col("db_id"))).first()[0]
    assert key == "field_survey_2024"


def test_published_catalog_reads_back(spark, tmp_path):
    made = C.linking_catalog(docs(spark, {"k": SITE}))
    stored = writers.publish_catalog(made, str(tmp_path / "catalog"))
    assert stored.collect() == made.collect()


def test_catalog_size(spark):
    assert C.catalog_size(docs(spark, {"k": SITE, "l": doc({"t": ["a"]})})) == 5 + 2


def test_size_measures_more_than_columns(spark):
    size = lambda d: C.catalog_size(docs(spark, {"k": d}))
    assert C.catalog_size(docs(spark, {"k": SITE}).where("false")) == 0
    assert size(doc({f"t{i}": [] for i in range(1000)})) > 500
    assert size(doc({"t": ["x" * 100_000]})) > 1500
    assert size(doc({"t": [f"c{i}" for i in range(100)]})) == 101
    assert size({"table_names_original": ["t"]}) >= 1 and size({}) >= 1
