"""Readers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from schemaloom.config import RunConfig
from schemaloom.functions.arrays import any_of
from schemaloom.functions.links import LINKS_TYPE
from schemaloom.operators.catalog import DOCUMENT_SCHEMA
from schemaloom.operators.evaluate import REPORT_LABELS

QUESTION_FIELDS = "question_id bigint, db_id string, question string"
EXAMPLE_FIELDS = f"{QUESTION_FIELDS}, gold_sql string, schema_links {LINKS_TYPE}"
# A nested value read as a string keeps its raw JSON text.
LINKS_FIELDS = "question_id bigint, schema_links string"
# Metrics that a leaderboard has for each run.
REPORT_METRICS = tuple(REPORT_LABELS)
# Columns that give the order of the input, over all files.
INPUT_ORDER = ("file_path", "pos")


def _decoded(location: Column) -> Column:
    """A file location without URL escapes."""
    return F.url_decode(F.replace(location, F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    """Where a row comes from."""
    return _decoded(F.col("_metadata.file_path"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Schema documents `<db_key>.json`, one row per file."""
    text = spark.read.text(path, wholetext=True)
    return document_rows(text.select(file_path().alias("path"), "value"))


# Where a text that is no document goes.
BROKEN = "_broken"


def document_rows(files: DataFrame) -> DataFrame:
    """Schema documents from the `path` and text (`value`) of their files; a broken one stops the job with its path."""
    fields = StructType([*DOCUMENT_SCHEMA.fields, StructField(BROKEN, StringType())])
    parsed = F.from_json("value", fields, {"columnNameOfCorruptRecord": BROKEN})
    rows = files.select("path", parsed.alias("doc"))
    # An empty text parses as null, and text behind the document as a broken record.
    failed = F.raise_error(F.concat(F.lit("not a schema document: "), F.col("path"))).cast(DOCUMENT_SCHEMA)
    whole = F.struct(*[F.col(f"doc.{name}").alias(name) for name in DOCUMENT_SCHEMA.fieldNames()])
    sound = F.col("doc").isNotNull() & F.col(f"doc.{BROKEN}").isNull()
    key = F.regexp_extract("path", r"([^/]*?)(?:\.json)?$", 1)
    return rows.select(key.alias("db_key"), F.when(sound, whole).otherwise(failed).alias("doc")).select("db_key", "doc.*")


def question_rows(text: Column) -> Column:
    """Entries of a questions file with `question_key`, the id as text.

    As in `links_rows`, ids that are not whole numbers are null in `question_id`.
    """
    keyed = json_rows(text, "question_id string")
    return F.zip_with(
        json_rows(text, QUESTION_FIELDS),
        keyed,
        lambda row, raw: F.struct(
            row.question_id.alias("question_id"),
            row.db_id.alias("db_id"),
            row.question.alias("question"),
            _key(row.question_id, raw.question_id).alias("question_key"),
        ),
    )


def _key(number: Column, raw: Column) -> Column:
    """The text "1" is not the number 1: it has a mark before it, and so has every other text."""
    return F.coalesce(number.cast("string"), F.concat(F.lit("text:"), raw))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON list files: `file_path, pos, question_id, db_id, question, question_key`."""
    return _json_list(spark, path, question_rows)


def by_key(rows: DataFrame) -> DataFrame:
    """Rows whose `question_id` is the id as text, so that questions, gold and predictions with text ids meet too."""
    return rows.withColumn("question_id", F.col("question_key")).drop("question_key")


def _lines(spark: SparkSession, fields: str, path: str) -> DataFrame:
    """JSON lines, which Spark splits; a broken line stops the job."""
    return spark.read.schema(fields).option("mode", "FAILFAST").json(path)


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """Questions as JSON lines: the form for large inputs."""
    return _keyed_lines(spark, "db_id string, question string", path)


def example_rows(text: Column) -> Column:
    """Entries of an examples file as structs."""
    return json_rows(text, EXAMPLE_FIELDS)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of JSON list files, with `file_path` and `pos` (`INPUT_ORDER`)."""
    return _json_list(spark, path, example_rows)


def read_example_lines(spark: SparkSession, path: str) -> DataFrame:
    """Examples as JSON lines with an explicit `pos`: the form for large inputs."""
    return _lines(spark, f"{EXAMPLE_FIELDS}, pos bigint", path)


# The fields that every example has to have.
REQUIRED = ("question_id", "db_id", "question", "gold_sql", "schema_links")


def _is_incomplete() -> Column:
    return any_of([F.col(c).isNull() for c in REQUIRED])


def incomplete_examples(examples: DataFrame) -> DataFrame:
    """Examples that lack a required field."""
    return examples.where(_is_incomplete())


def complete_examples(examples: DataFrame) -> DataFrame:
    """The examples unchanged; the job that reads them stops with an error at one that is incomplete."""
    shown = F.to_json(F.struct(*[c for c in examples.columns if c in (*REQUIRED, *INPUT_ORDER)]))
    stop = F.raise_error(F.concat(F.lit("example with missing fields: "), shown)).cast("boolean")
    return examples.where(F.when(_is_incomplete(), stop).otherwise(F.lit(True)))


def check_examples(examples: DataFrame) -> DataFrame:
    """The examples unchanged, or an error naming one that is incomplete."""
    bad = incomplete_examples(examples).limit(1).collect()
    if bad:
        raise ValueError(f"example with missing fields: {bad[0].asDict()}")
    return examples


def _json_list(spark: SparkSession, path: str, rows: Callable[[Column], Column]) -> DataFrame:
    """Elements of JSON list files with their place in the file.

    The place decides between repeated ids, so each file is parsed as the one
    document it is; files are spread over the tasks. A broken file stops the
    job with an error that names it.
    """
    text = spark.read.text(path, wholetext=True)
    broken = F.raise_error(F.concat(F.lit("not a JSON list: "), file_path()))
    return text.select(
        file_path().alias("file_path"),
        F.posexplode_outer(F.coalesce(rows(F.col("value")), broken)).alias("pos", "row"),
    ).where("pos is not null").select("file_path", "pos", "row.*")


def json_rows(text: Column, fields: str) -> Column:
    """The elements of a JSON list as structs; null if the text is broken."""
    return F.from_json(text, f"array<struct<{fields}>>")


def links_rows(text: Column) -> Column:
    """Entries of a links file: `question_id, schema_links` and `question_key`, the id as text.

    Ids that are not whole numbers are null; their key has a mark before it,
    so that the text "1" is not the number 1.
    """
    keyed = json_rows(text, "question_id string")
    return F.zip_with(
        json_rows(text, LINKS_FIELDS),
        keyed,
        lambda row, raw: F.struct(
            row.question_id.alias("question_id"),
            row.schema_links.alias("schema_links"),
            _key(row.question_id, raw.question_id).alias("question_key"),
        ),
    )


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """`file_path, pos, question_id, question_key, links_json` from JSON list files (gold or predictions).

    Ids that are not whole numbers read as null and match no question.
    """
    return _json_list(spark, path, links_rows).withColumnRenamed("schema_links", "links_json")


def _last(rows: DataFrame, links: str, *place: str) -> DataFrame:
    return rows.groupBy("question_id", "question_key").agg(F.max_by(links, F.struct(*place)).alias("links_json"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold links with `question_key`; of repeated ids the last one counts."""
    return _last(read_links(spark, path), "links_json", "file_path", "pos")


def _keyed_lines(spark: SparkSession, fields: str, path: str) -> DataFrame:
    """JSON lines whose `question_id` may be a number or a text, with `question_key`.

    The id is read as a VARIANT, which keeps the two apart.
    """
    rows = _lines(spark, f"question_id variant, {fields}", path)
    whole = F.schema_of_variant("question_id") == "BIGINT"
    number = F.when(whole, F.try_variant_get("question_id", "$", "bigint"))
    return rows.withColumns(
        {"question_id": number, "question_key": _key(number, F.try_variant_get("question_id", "$", "string"))}
    )


def read_gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """Gold links as JSON lines with an explicit `pos`, the last of repeated ids: the form for large inputs."""
    return _last(_keyed_lines(spark, "schema_links string, pos bigint", path), "schema_links", "pos")


def read_predictions(spark: SparkSession, path: str, run_id: Column | None = None) -> DataFrame:
    """Predictions with a `run_id`, by default the name of the file's folder.

    Places count within a file; `last_wins` takes the files of a run in the order of their paths.
    """
    folder = F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)
    return read_links(spark, path).withColumn("run_id", folder if run_id is None else run_id)


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as JSON lines with an explicit `pos`: the form for large runs. A broken line stops the job."""
    fields = "run_id string, pos bigint, schema_links string"
    return _keyed_lines(spark, fields, path).withColumnRenamed("schema_links", "links_json")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


# Where the settings file of a run lies under the root, by layout.
RUN_LAYOUTS = {
    "local": "*/adapter/adapter_config.json",
    "grid": "{runs,*/runs}/*/checkpoints/final_checkpoint/adapter_config.json",
}


def read_runs(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Runs below a root: `run_id, run_name, adapter_dir, base_model`."""
    text = spark.read.text(f"{root}/{RUN_LAYOUTS[layout]}", wholetext=True)
    return run_rows(text.select(file_path().alias("path"), "value"), layout)


def run_rows(settings: DataFrame, layout: str) -> DataFrame:
    """The same from the `path` and text (`value`) of settings files."""
    directory = F.regexp_replace(F.regexp_replace("path", r"/[^/]+$", ""), "^file:/+", "/")
    located = settings.select(directory.alias("adapter_dir"), "value").dropDuplicates(["adapter_dir"])
    parent = F.regexp_extract("adapter_dir", r"([^/]+)/[^/]+$", 1)
    numbered = F.concat(
        F.regexp_extract("adapter_dir", r".*/([^/]+)/runs/([^/]+)/", 1),
        F.lit("_run"),
        F.regexp_extract("adapter_dir", r".*/([^/]+)/runs/([^/]+)/", 2),
    )
    name = safe_name(parent if layout == "local" else numbered)
    return located.select(
        name.alias("run_id"),
        name.alias("run_name"),
        "adapter_dir",
        F.coalesce(F.get_json_object("value", "$.base_model_name_or_path"), F.lit("")).alias("base_model"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files as `path, report`; parse with `evaluate.parse_report`."""
    text = spark.read.text(path, wholetext=True)
    return text.select(file_path().alias("path"), F.col("value").alias("report"))


def _table_file(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A written table with a header; a row that does not fit `fields`, or another header, stops the job."""
    options = {"header": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    return spark.read.schema(fields).options(**options).csv(path)


def read_per_question(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `writers.write_per_question` over runs."""
    metrics = ", ".join(f"{metric}_{level} double" for level in ("t", "c") for metric in ("p", "r", "f1"))
    return _table_file(spark, path, f"run_id string, question_id bigint, db_id string, {metrics}")


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `writers.write_leaderboard`: runs with their metrics and status."""
    text = ("adapter_dir", "base_model", "run_id", "run_name", "status")
    fields = sorted([*[f"{c} string" for c in text], *[f"{c} double" for c in REPORT_METRICS]])
    return _table_file(spark, path, ", ".join(fields))


def read_best_run(spark: SparkSession, path: str) -> DataFrame:
    """The row of `writers.write_best_run`, or none."""
    metrics = ", ".join(f"{c} double" for c in REPORT_METRICS)
    text = "run_id string, run_name string, adapter_dir string, base_model string, status string"
    return _lines(spark, f"{text}, {metrics}, promote boolean", path)


def read_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The totals and the counts per database that `writers.write_stats` left for all splits below a path."""
    sizes = "total_examples unique_databases multi_table_examples single_table_examples empty_column_examples "
    sizes += "many_column_examples oversampled_examples original_examples"
    averages = "avg_tables_per_example double, avg_columns_per_example double, max_tables int, max_columns int"
    totals = ", ".join(["split string", *[f"{c} bigint" for c in sizes.split()], averages])
    return (
        _lines(spark, totals, f"{path}/*/totals"),
        _lines(spark, "split string, db_id string, n bigint", f"{path}/*/examples_per_db"),
    )


def read_splits(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Records of `writers.write_splits` with their `source`; a filter on it reads its folder only."""
    return _lines(spark, f"{fields}, source string", path)


def read_run_config(spark: SparkSession, path: str) -> RunConfig:
    """One run's settings; defaults when the file is missing."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as error:  # the reader raises its own class for a missing path
        if "PATH_NOT_FOUND" in str(error):
            return RunConfig()
        raise
    return RunConfig.from_json(row["value"])
