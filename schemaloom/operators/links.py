"""Links against a catalog: normalising, validating, parsing, canonical sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions import links as L
from schemaloom.functions.arrays import inline_rows, let
from schemaloom.operators.catalog import db_key, name_index, name_tables, sorted_tables
from schemaloom.operators.joins import join_catalog


def with_catalog(
    df: DataFrame,
    catalog: DataFrame,
    columns: int | None,
    derive: dict[str, Column] | None,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    keyed = df.withColumn("db_key", db_key(F.col("db_id")))
    return join_catalog(keyed, catalog, columns, derive, how=how, counts=counts)


def with_names(df: DataFrame, docs: DataFrame, columns: int | None) -> DataFrame:
    """Rows with the names of their database's schema in `tables`."""
    return with_catalog(df, docs, columns, {"tables": name_tables()})


def with_name_index(
    df: DataFrame, docs: DataFrame, columns: int | None, counts: DataFrame | None = None
) -> DataFrame:
    """Rows with the look-up of their database's names in `names`."""
    return with_catalog(df, docs, columns, {"names": name_index()}, counts=counts)


def normalize_links(df: DataFrame, docs: DataFrame, links: str, columns: int | None = None) -> DataFrame:
    """`normalized` links with real names in schema order, from JSON text."""
    ordered = let(
        L.fold_links_json(F.col(links)), lambda folded: L.links_in_schema_order(F.col("tables"), folded)
    )
    return with_names(df, docs, columns).withColumn("normalized", ordered).drop("tables")


def parse_links(df: DataFrame, response: str) -> DataFrame:
    """`parsed` links of responses to rows that carry `candidates` and `tables`."""
    return df.withColumn(
        "parsed", L.response_links(F.col(response), F.col("candidates"), F.col("tables"))
    )


def validate_links(
    examples: DataFrame, docs: DataFrame, links: str, columns: int | None = None
) -> DataFrame:
    """One warning row per link that the schema does not have, by exact name.

    A table without columns counts as unknown.
    """
    joined = with_catalog(examples, docs, columns, {"tables": sorted_tables()})

    def problems(e: Column) -> Column:
        t = F.try_element_at(F.filter(F.col("tables"), lambda t: t.table_name == e.key), F.lit(1))
        return let(
            t,
            lambda t: F.when(
                t.isNull(),
                F.array(F.struct(e.key.alias("table_name"), F.lit(None).cast("string").alias("col_name"))),
            ).otherwise(
                F.transform(
                    F.filter(e.value, lambda c: ~F.exists(t.columns, lambda x: x.col_name == c)),
                    lambda c: F.struct(e.key.alias("table_name"), c.alias("col_name")),
                )
            ),
        )

    found = F.flatten(F.transform(F.map_entries(links), problems))
    unknown = inline_rows(joined, found, "table_name", "question_id", "db_id")
    where = F.format_string("question_id=%s db_id=%s: ", F.col("question_id").cast("string"), F.col("db_id"))
    return unknown.withColumn(
        "warning",
        F.concat(
            where,
            F.when(
                F.col("col_name").isNull(), F.format_string("table '%s' not in schema", F.col("table_name"))
            ).otherwise(
                F.format_string("column '%s' not in table '%s'", F.col("col_name"), F.col("table_name"))
            ),
        ),
    )


def canonical_links(
    df: DataFrame, docs: DataFrame, links: str, columns: int | None = None, is_gold: bool = False
) -> DataFrame:
    """Canonical sets of links JSON against the schema."""
    sets = L.canonical_sets(L.scorer_entries(F.col(links)), F.col("names"), is_gold)
    return with_name_index(df, docs, columns).withColumn("canonical", sets).drop("names")


def links_shape(df: DataFrame, links: str) -> DataFrame:
    m = F.col(links)
    return df.withColumns(
        {
            "num_tables": L.table_count(m),
            "num_columns": L.column_count(m),
            "is_multitable": L.table_count(m) > 1,
            "has_empty_columns": L.has_empty_table(m),
        }
    )
