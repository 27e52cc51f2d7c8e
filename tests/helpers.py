"""Small schema documents for the tests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from schemaloom.operators.catalog import DOCUMENT_SCHEMA


def doc(tables, pk=(), fk=(), types=None, **extra):
    """A document from `{table: [column | (column, type)]}`; keys are `table.column`."""
    pairs, kinds, place = [[-1, "*"]], ["text"], {}
    for i, (table, columns) in enumerate(tables.items()):
        for column in columns:
            name, kind = column if isinstance(column, tuple) else (column, "text")
            place[f"{table}.{name}"] = len(pairs)
            pairs.append([i, name])
            kinds.append(kind)
    return {
        "table_names_original": list(tables),
        "column_names_original": pairs,
        "column_types": kinds if types is None else types,
        "primary_keys": [place[k] for k in pk],
        "foreign_keys": [[place[a], place[b]] for a, b in fk],
        **extra,
    }


def docs(spark, by_key):
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in by_key.items()], "db_key string, text string")
    parsed = F.from_json("text", DOCUMENT_SCHEMA.simpleString())
    return rows.select("db_key", parsed.alias("d")).select("db_key", "d.*")


def write_docs(folder: Path, by_key):
    folder.mkdir(parents=True, exist_ok=True)
    for key, d in by_key.items():
        (folder / f"{key}.json").write_text(json.dumps(d))


def asked(spark, rows):
    return spark.createDataFrame(rows, "question_id bigint, db_id string, question string")


def one(df, column):
    (row,) = df.select(column).collect()
    return row[0]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
