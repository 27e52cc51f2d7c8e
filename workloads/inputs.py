"""DataFrames of the workload, derived from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.links import LINKS_TYPE
from schemaloom.operators.catalog import DOCUMENT_SCHEMA, db_key
from schemaloom.sources import settings
from workloads import templates as X


# A column to spread the rows of a table by.
SPREAD_BY = {
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "documents": "doc_id",
    "conversations": "conv_id",
    "events": "event_id",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; rows of a file that Spark cannot split are spread over the tasks.

    A table with enough splits of its own is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    tasks = spark.sparkContext.defaultParallelism
    if name in SPREAD_BY and df.rdd.getNumPartitions() < tasks:
        return df.repartition(tasks, SPREAD_BY[name])
    return df


def _pick(family: Column, values: list[Column]) -> Column:
    out = F.when(family == 0, values[0])
    for f, value in enumerate(values[1:], start=1):
        out = out.when(family == f, value)
    return out


def _db_id() -> Column:
    family = _pick(F.col("family"), [F.lit(f) for f in X.FAMILIES])
    return F.concat_ws(" ", family, F.col("c_name"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").withColumn("family", (F.col("c_custkey") % 4).cast("int"))
    return rows.withColumn("db_id", _db_id())


def schema_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One schema document per customer."""
    documents = [
        F.from_json(F.lit(json.dumps(X.document(f))), DOCUMENT_SCHEMA.simpleString()) for f in X.FAMILIES
    ]
    return customers(spark, sf).select(
        "db_id", db_key(F.col("db_id")).alias("db_key"), _pick(F.col("family"), documents).alias("doc")
    ).select("db_id", "db_key", "doc.*")


def document_text() -> Column:
    """The text of a customer's schema file."""
    return _pick(F.col("family"), [F.lit(json.dumps(X.document(f))) for f in X.FAMILIES])


def _template() -> Column:
    """The template a question is made from, as a struct `q, links, sql`."""
    texts = {f"{row[0]}:{row[1]}": dict(zip(("q", "links", "sql"), row[2:])) for row in X.rows()}
    lookup = F.from_json(F.lit(json.dumps(texts)), "map<string,struct<q:string,links:string,sql:string>>")
    sizes = _pick(F.col("family"), [F.lit(len(X.TEMPLATES[f])) for f in X.FAMILIES])
    return F.element_at(lookup, F.concat_ws(":", F.col("family"), F.col("o_orderkey") % sizes))


def _filled(text: Column) -> Column:
    for mark, value in (
        ("{year}", F.year("o_orderdate").cast("string")),
        ("{seg}", F.col("c_mktsegment")),
        ("{prio}", F.col("o_orderpriority")),
        ("{key}", F.col("o_orderkey").cast("string")),
    ):
        text = F.replace(text, F.lit(mark), value)
    return text


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """One question per order to the database of its customer."""
    asked = table(spark, sf, "orders").join(
        customers(spark, sf).select("c_custkey", "c_mktsegment", "family", "db_id"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    return asked.withColumn("t", _template()).select(
        F.col("o_orderkey").alias("question_id"),
        "db_id",
        _filled(F.col("t.q")).alias("question"),
        _filled(F.col("t.sql")).alias("gold_sql"),
        F.col("t.links").alias("links_json"),
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return examples(spark, sf).select("question_id", "db_id", "question")


def repeated_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per event to one of few databases: few distinct texts, asked over and over."""
    asked = table(spark, sf, "events").join(
        customers(spark, sf).select("c_custkey", "db_id"), F.col("user_id") % X.SHARED_DATABASES == F.col("c_custkey")
    )
    value = (F.col("event_id") % X.REPEATED_VALUES).cast("string")
    text = F.concat(F.lit("Total o_totalprice and name for "), "event_type", F.lit(" events by month with value "), value)
    return asked.select(F.col("event_id").alias("question_id"), "db_id", text.alias("question"))


def linked_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples with `schema_links` as a map."""
    rows = examples(spark, sf).withColumn("schema_links", F.from_json("links_json", LINKS_TYPE))
    return rows.select("question_id", "db_id", "question", "gold_sql", "schema_links")


def ordered_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The same with an input order that differs from the ids."""
    rows = examples(spark, sf).withColumn("schema_links", F.from_json("links_json", LINKS_TYPE))
    return rows.select("question_id", "db_id", "question", "gold_sql", "schema_links", "o_totalprice")


def scored_questions(spark: SparkSession, sf: str) -> DataFrame:
    """All questions; expensive ones also asked again to a database without a schema."""
    rows = examples(spark, sf)
    lost = rows.where("o_totalprice > 492000").select(
        _again().alias("question_id"), F.concat(F.lit("lost "), "db_id").alias("db_id"), "question"
    )
    return rows.select("question_id", "db_id", "question").unionByName(lost)


def _again() -> Column:
    """The id of a question that is there a second time."""
    return -1 - F.col("question_id")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold links; the most expensive orders have none but where they are asked again."""
    rows = examples(spark, sf)
    again = rows.where("o_totalprice > 492000").select(_again().alias("question_id"), "links_json")
    return rows.where("o_totalprice <= 495000").select("question_id", "links_json").unionByName(again)


def all_pairs_of_runs(rows: DataFrame) -> DataFrame:
    """Every question once for each run; `v` is the kind of answer."""
    kind = F.pmod(F.floor(F.col("question_id") / 12) + F.col("run_id"), F.lit(8))
    return rows.withColumn("run_id", F.explode(F.array(*map(F.lit, X.RUNS)))).withColumn("v", kind)


def asked_of_runs(rows: DataFrame) -> DataFrame:
    """Question and run pairs that have an answer, for scoring.

    Each run left out open orders of one priority; run 4 also all finished ones.
    """
    left_out = (F.col("o_orderstatus") == "P") & (
        F.substring("o_orderpriority", 1, 1).cast("int") == F.col("run_id")
    )
    finished = (F.col("run_id") == 4) & (F.col("o_orderstatus") == "F")
    return all_pairs_of_runs(rows).where(~left_out & ~finished)


def with_responses(rows: DataFrame) -> DataFrame:
    """Rows of `examples` (and what was added to them) with the answers of the runs."""
    g = F.col("links_json")
    text = (
        F.when(F.col("v") == 0, g)
        .when(F.col("v") == 1, F.upper(g))
        .when(F.col("v") == 2, F.concat(F.lit("Sure: "), g, F.lit(" done {")))
        .when(F.col("v") == 3, F.concat(F.lit('```json {"schema_links":'), g, F.lit("}```")))
        .when(F.col("v") == 4, F.lit('{"ghost_table":["ghost_col"]}'))
        .when(F.col("v") == 5, F.replace(g, F.lit("]"), F.lit(',"no_such_col"]')))
        .when(F.col("v") == 6, F.left(g, F.length(g) - 3))
        .otherwise(F.lit(X.ODD_ANSWER))
    )
    return all_pairs_of_runs(rows).withColumn("response", text)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Free text answers of the runs."""
    return with_responses(examples(spark, sf)).select("run_id", "question_id", "db_id", "response")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of runs that left questions out, for scoring; some are there without links."""
    g = F.when(F.col("v") != 2, F.col("links_json"))
    return _predictions(asked_of_runs(examples(spark, sf)).withColumn("links_json", g))


def all_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of every run for every question."""
    return _predictions(all_pairs_of_runs(examples(spark, sf)))


def _predictions(answered: DataFrame) -> DataFrame:
    """`run_id, question_id, links_json, pos` with repeats and unknown ids.

    Cheap orders are answered twice, the later answer empty; expensive ones
    also under an id that belongs to a question without schema or to none.
    """
    g = F.col("links_json")
    text = (
        F.when(F.col("v") == 1, F.upper(g))
        .when(F.col("v") == 4, F.lit('{"ghost_table":["ghost_col"]}'))
        .when(F.col("v") == 5, F.replace(g, F.lit("]"), F.lit(',"no_such_col"]')))
        .when(F.col("v") == 6, F.lit("{}"))
        .when(F.col("v") == 7, F.lit(X.ODD_ANSWER))
        .otherwise(g)
    )
    row = lambda qid, links, pos: F.struct(
        qid.alias("question_id"), links.alias("links_json"), F.lit(pos).alias("pos")
    )
    qid = F.col("question_id")
    entries = F.array_compact(
        F.array(
            row(qid, text, 0),
            F.when(F.col("o_totalprice") < 10000, row(qid, F.lit("{}"), 1)),
            F.when(F.col("o_totalprice") > 490000, row(_again(), text, 2)),
        )
    )
    return answered.select("run_id", F.inline_outer(entries))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs that answered and one that failed."""
    found = spark.createDataFrame([(r,) for r in (*X.RUNS, X.FAILED_RUN)], "run_id int")
    name = F.concat(F.lit("sweep_run"), F.col("run_id").cast("string"))
    path = F.format_string("sweep/runs/%s/checkpoints/final_checkpoint", F.col("run_id").cast("string"))
    return found.select(
        "run_id", name.alias("run_name"), path.alias("adapter_dir"), F.lit("base-1.5b").alias("base_model")
    )


def run_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of the runs that answered, as `settings.settings_of_runs` reads them."""
    found = runs(spark, sf).where(F.col("run_id") != X.FAILED_RUN)
    text = F.element_at(F.create_map(*[F.lit(x) for pair in X.RUN_SETTINGS.items() for x in pair]), F.col("run_id"))
    files = found.select(F.concat("adapter_dir", F.lit("/run_config.json")).alias("path"), text.alias("value"))
    return settings.settings_of_runs(found, settings.settings_rows(files.where("value is not null")))
