"""Settings of many runs as rows of one relation."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.config import OUTPUT_FORMATS, PRESETS, RetrievalConfig, RunConfig
from schemaloom.sources.readers import file_path

FILE_NAME = "run_config.json"
# What runs without settings of their own use.
SWEEP_DEFAULT = RunConfig(retrieval=PRESETS["grid"])


def _or(value: Column, default: object) -> Column:
    return value if default is None else F.coalesce(value, F.lit(default))


def _budget(parsed: Column, default: RetrievalConfig) -> Column:
    def setting(name: str) -> Column:
        value = getattr(default, name)
        kind = "boolean" if isinstance(value, bool) else "int"
        return _or(F.variant_get(parsed, f"$.retrieval.{name}", kind), value).alias(name)

    return F.struct(*[setting(f.name) for f in fields(RetrievalConfig)])


def settings_row(parsed: Column, default: RunConfig = RunConfig()) -> Column:
    """The known settings of a VARIANT as a struct, defaults where it has none.

    Unknown keys are dropped, null counts as absent. A value that is no number
    where one belongs, or an unknown answer format, stops the job. The free
    part, `train_config`, stays JSON text.
    """
    text = lambda name: F.variant_get(parsed, f"$.{name}", "string")
    answer = _or(F.lower(text("output_format")), default.output_format)
    refused = F.raise_error(F.concat(F.lit("unsupported output_format: "), answer))
    free = F.to_json(F.variant_get(parsed, "$.train_config", "variant"))
    return F.struct(
        _or(text("base_model"), default.base_model).alias("base_model"),
        F.when(answer.isin(*OUTPUT_FORMATS), answer).otherwise(refused).alias("output_format"),
        _or(F.variant_get(parsed, "$.max_input_length", "int"), default.max_input_length).alias("max_input_length"),
        _budget(parsed, default.retrieval).alias("retrieval"),
        _or(free, json.dumps(dict(default.train_config), separators=(",", ":"))).alias("train_config"),
    )


def settings_rows(files: DataFrame) -> DataFrame:
    """`adapter_dir` and settings from the `path` and text (`value`) of settings files; broken text stops the job."""
    directory = F.regexp_replace(F.regexp_replace("path", r"/[^/]+$", ""), "^file:/+", "/")
    broken = F.raise_error(F.concat(F.lit("broken settings: "), F.col("path")))
    parsed = files.select(
        directory.alias("adapter_dir"), F.coalesce(F.try_parse_json("value"), broken.cast("variant")).alias("_parsed")
    )
    return parsed.select("adapter_dir", settings_row(F.col("_parsed")).alias("_row")).select("adapter_dir", "_row.*")


def read_settings(spark: SparkSession, pattern: str) -> DataFrame:
    """Settings files of any number of runs, e.g. `root/*/adapter/run_config.json`."""
    text = spark.read.text(pattern, wholetext=True)
    return settings_rows(text.select(file_path().alias("path"), "value"))


def settings_of_runs(runs: DataFrame, settings: DataFrame, default: RunConfig = SWEEP_DEFAULT) -> DataFrame:
    """`run_id` with the settings of every run, those of `default` where it has no file.

    The base model of a run is that of its settings, or else of its adapter.
    """
    nothing = settings_row(F.lit(None).cast("variant"), default)
    found = settings.select("adapter_dir", F.struct(*[c for c in settings.columns if c != "adapter_dir"]).alias("_row"))
    joined = runs.join(found, "adapter_dir", "left").withColumn("_row", F.coalesce("_row", nothing))
    adapter = F.when(F.col("base_model") != "", F.col("base_model"))
    others = [f"_row.{c}" for c in ("output_format", "max_input_length", "retrieval", "train_config")]
    return joined.select("run_id", F.coalesce("_row.base_model", adapter).alias("base_model"), *others)
