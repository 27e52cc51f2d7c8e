"""Catalogs: schema documents to relations, and to the nested form for linking.

A schema document is one row per database (Spider layout): table names,
`[table position, column name]` pairs, types, primary keys and foreign keys by
column position. Its row bounds every per-database array below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom import vocabulary as V
from schemaloom.functions import tokens as tok
from schemaloom.functions.arrays import empty_if_null, inline_rows, let

STRINGS = T.ArrayType(T.StringType())
INTS = T.ArrayType(T.IntegerType())
NAME_FEATURES = ("name_lc", "words", "mask", "norm", "plain", "short")
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("table_names_original", STRINGS),
        T.StructField("table_names", STRINGS),
        # Pairs mix an int and a string; read as text, the position is cast back.
        T.StructField("column_names_original", T.ArrayType(STRINGS)),
        T.StructField("column_names", T.ArrayType(STRINGS)),
        T.StructField("column_types", STRINGS),
        T.StructField("primary_keys", INTS),
        T.StructField("foreign_keys", T.ArrayType(INTS)),
    ]
)


def db_key(db_id: Column) -> Column:
    """Database name as used for files. Not invertible, so join on the key."""
    return F.translate(db_id, " /", "__")


def _first_filled(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates])


def _tables(original: bool = True) -> Column:
    names = ["table_names_original", "table_names"]
    return empty_if_null(_first_filled(*map(F.col, names if original else names[::-1])), "string")


def _pairs(original: bool = True) -> Column:
    names = ["column_names_original", "column_names"]
    return empty_if_null(_first_filled(*map(F.col, names if original else names[::-1])), "array<string>")


def _position(pair: Column) -> Column:
    return F.get(pair, F.lit(0)).try_cast("int")


def _is_column(pair: Column) -> Column:
    """A two-element pair that is not the synthetic `*` column."""
    return F.coalesce((F.size(pair) == 2) & (_position(pair) != -1), F.lit(False))


def _links() -> Column:
    return F.filter(empty_if_null(F.col("foreign_keys"), "array<int>"), lambda p: F.size(p) == 2)


def _fk_positions(fk_ends: str) -> Column:
    if fk_ends == "both":
        return F.flatten(_links())
    if fk_ends == "source":
        return F.transform(_links(), lambda p: F.get(p, F.lit(0)))
    raise ValueError("fk_ends must be 'both' or 'source'")


def column_type(types: Column, pairs: Column, position: Column) -> Column:
    """Type of a column; positions shift by one when only `*` has no type."""
    shift = F.when(F.size(types) == F.size(pairs) - 1, F.lit(1)).otherwise(F.lit(0))
    return F.coalesce(F.nullif(F.get(types, position - shift), F.lit("")), F.lit("unknown"))


def _column_entries(fk_ends: str) -> Column:
    """All columns of a document as structs in schema order."""
    types = empty_if_null(F.col("column_types"), "string")
    primary = empty_if_null(F.col("primary_keys"), "int")
    bound = F.struct(
        _tables().alias("tables"),
        _pairs().alias("pairs"),
        types.alias("types"),
        primary.alias("primary"),
        empty_if_null(_fk_positions(fk_ends), "int").alias("foreign"),
    )

    def entries(d: Column) -> Column:
        numbered = F.transform(
            d.pairs,
            lambda p, i: F.struct(
                _position(p).alias("table_idx"),
                F.get(d.tables, _position(p)).alias("table_name"),
                i.alias("col_idx"),
                F.get(p, F.lit(1)).alias("col_name"),
                column_type(d.types, d.pairs, i).alias("col_type"),
                F.array_contains(d.primary, i).alias("is_pk"),
                F.array_contains(d.foreign, i).alias("is_fk"),
                _is_column(p).alias("real"),
            ),
        )
        return F.filter(numbered, lambda c: c.real & c.table_name.isNotNull())

    return let(bound, entries)


def catalog_columns(docs: DataFrame, fk_ends: str = "both") -> DataFrame:
    """One row per column, with type and key flags.

    `fk_ends='both'` flags both ends of a foreign key, `'source'` only the
    referring end.
    """
    return inline_rows(docs, _column_entries(fk_ends), "col_idx", "db_key").drop("real")


def catalog_tables(docs: DataFrame) -> DataFrame:
    """One row per table; tables without columns are kept."""
    return docs.select("db_key", F.posexplode(_tables()).alias("table_idx", "table_name"))


def _edges() -> Column:
    """Table pairs joined by a foreign key, in both directions, no loops."""

    def pairs(d: Column) -> Column:
        end = lambda p, k: let(F.get(d.pairs, F.get(p, F.lit(k))), lambda c: F.when(_is_column(c), _position(c)))
        joined = F.transform(
            d.links, lambda p: let(F.struct(end(p, 0).alias("a"), end(p, 1).alias("b")), lambda e: e)
        )
        real = F.filter(joined, lambda e: e.a.isNotNull() & e.b.isNotNull() & (e.a != e.b))
        both = F.transform(
            real,
            lambda e: F.array(
                F.struct(e.a.alias("src"), e.b.alias("dst")), F.struct(e.b.alias("src"), e.a.alias("dst"))
            ),
        )
        return F.array_distinct(F.flatten(both))

    return let(F.struct(_pairs().alias("pairs"), _links().alias("links")), pairs)


def fk_edges(docs: DataFrame) -> DataFrame:
    """Undirected table adjacency, one row per direction."""
    named = inline_rows(docs, _edges(), "src", "db_key", _tables().alias("tables"))
    return named.select(
        "db_key",
        F.get("tables", F.col("src")).alias("src_table"),
        F.get("tables", F.col("dst")).alias("dst_table"),
    ).where("src_table is not null and dst_table is not null and src_table <> dst_table")


def keep_last(arr: Column, key) -> Column:
    """Of elements with equal key only the last one."""
    return F.filter(
        arr,
        lambda x, i: ~F.exists(F.slice(arr, i + 2, F.size(arr)), lambda later: key(later) == key(x)),
    )


def schema_map(docs: DataFrame) -> DataFrame:
    """`{table: [columns]}` per database, in schema order."""
    whole = let(
        F.struct(_tables().alias("tables"), _column_entries("both").alias("columns")),
        lambda d: F.transform(
            d.tables,
            lambda name, i: F.struct(
                name.alias("table_name"),
                F.transform(F.filter(d.columns, lambda c: c.table_idx == i), lambda c: c.col_name).alias("cols"),
            ),
        ),
    )
    unique = let(whole, lambda tables: keep_last(tables, lambda t: t.table_name))
    return docs.select("db_key", F.map_from_entries(unique).alias("schema"))


def schema_lookup(columns: DataFrame) -> DataFrame:
    """Case-insensitive names; of names that fold together the last one wins."""
    folded = columns.select(
        "db_key",
        F.lower("table_name").alias("table_lc"),
        F.lower("col_name").alias("col_lc"),
        "table_idx",
        "table_name",
        "col_idx",
        "col_name",
    )
    last = F.struct("table_idx", "col_idx")
    return folded.groupBy("db_key", "table_lc", "col_lc").agg(
        F.max_by("table_name", last).alias("table_name"), F.max_by("col_name", last).alias("col_name")
    )


def columns_by_table(docs: DataFrame, type_rule: str = "position") -> DataFrame:
    """Flattening used for whole-schema prompts and link validation.

    Only the referring end of a foreign key is flagged. With `type_rule`
    `'position'` a column takes the type at its own position and columns
    beyond the type list are dropped; `'shifted'` types them like
    `catalog_columns`.
    """
    if type_rule == "shifted":
        return catalog_columns(docs, fk_ends="source")
    return inline_rows(docs, _plain_entries(), "col_idx", "db_key")


def _plain_entries() -> Column:
    bound = F.struct(
        _tables(original=False).alias("tables"),
        _pairs(original=False).alias("pairs"),
        empty_if_null(F.col("column_types"), "string").alias("types"),
        empty_if_null(F.col("primary_keys"), "int").alias("primary"),
        empty_if_null(_fk_positions("source"), "int").alias("foreign"),
    )

    def entries(d: Column) -> Column:
        numbered = F.transform(
            d.pairs,
            lambda p, i: F.struct(
                _position(p).alias("table_idx"),
                F.get(d.tables, _position(p)).alias("table_name"),
                i.alias("col_idx"),
                F.get(p, F.lit(1)).alias("col_name"),
                F.get(d.types, i).alias("col_type"),
                F.array_contains(d.primary, i).alias("is_pk"),
                F.array_contains(d.foreign, i).alias("is_fk"),
            ),
        )
        return F.filter(
            numbered,
            lambda c: (c.table_idx != -1) & c.table_name.isNotNull() & (c.col_idx < F.size(d.types)),
        )

    return let(bound, entries)


def tables_with_columns(entries: Column) -> Column:
    """Group column structs by table name, both in alphabetical order."""

    def group(columns: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(columns, lambda c: c.table_name)))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("table_name"),
                F.sort_array(
                    F.transform(
                        F.filter(columns, lambda c: c.table_name == n),
                        lambda c: F.struct(c.col_name, c.col_idx, c.col_type, c.is_pk, c.is_fk),
                    )
                ).alias("columns"),
            ),
        )

    return let(entries, group)


def sorted_tables(type_rule: str = "position") -> Column:
    """`columns_by_table` of a document, nested and sorted by name."""
    return tables_with_columns(_plain_entries() if type_rule == "position" else _column_entries("source"))


def _name_features(name: Column) -> Column:
    """What the scores need from a table or column name, worked out once."""
    words = F.array_distinct(tok.split_identifier(name))
    return let(
        F.struct(words.alias("words"), tok.plain_name(name).alias("plain")),
        lambda f: F.struct(
            F.lower(name).alias("name_lc"),
            F.transform(f.words, tok.padded).alias("words"),
            tok.word_mask(f.words).alias("mask"),
            F.greatest(F.sqrt(F.size(f.words)), F.lit(1.0)).alias("norm"),
            f.plain.alias("plain"),
            tok.compact_name(f.plain).alias("short"),
        ),
    )


def _column_features(c: Column) -> Column:
    return let(
        _name_features(c.col_name),
        lambda f: F.struct(
            c.table_idx,
            c.col_idx,
            c.col_name.alias("name"),
            c.col_type,
            c.is_pk,
            c.is_fk,
            tok.key_bonus(c.is_pk, c.is_fk).alias("key_bonus"),
            *[f[part].alias(part) for part in NAME_FEATURES],
            tok.offers(f.name_lc, V.DATE_HINT).alias("has_date"),
            tok.offers(f.name_lc, V.COUNT_HINT).alias("has_count"),
            tok.offers(f.name_lc, V.AVERAGE_HINT).alias("has_average"),
        ),
    )


def linking_tables() -> Column:
    """Nested tables of a document: columns, their features, neighbours.

    This is the catalog side of every question join. Names are tokenised here,
    once per column, not once per question.
    """
    bound = F.struct(
        _tables().alias("names"),
        F.transform(_column_entries("both"), _column_features).alias("columns"),
        _edges().alias("edges"),
    )

    def tables(d: Column) -> Column:
        return F.transform(
            d.names,
            lambda name, i: let(
                _name_features(name),
                lambda f: F.struct(
                    i.alias("table_idx"),
                    name.alias("name"),
                    *[f[part].alias(part) for part in NAME_FEATURES],
                    F.transform(F.filter(d.edges, lambda e: e.src == i), lambda e: e.dst).alias("neighbours"),
                    F.filter(d.columns, lambda c: c.table_idx == i).alias("columns"),
                ),
            ),
        )

    return let(bound, tables)


def linking_catalog(docs: DataFrame) -> DataFrame:
    """One row per database with `linking_tables`: a form to store."""
    return docs.select("db_key", linking_tables().alias("tables"))


def name_tables() -> Column:
    """Nested tables of a document with names only, to resolve identifiers."""
    bound = F.struct(_tables().alias("names"), _column_entries("both").alias("columns"))

    def tables(d: Column) -> Column:
        return F.transform(
            d.names,
            lambda name, i: F.struct(
                i.alias("table_idx"),
                name.alias("name"),
                F.lower(name).alias("name_lc"),
                F.transform(
                    F.filter(d.columns, lambda c: c.table_idx == i),
                    lambda c: F.struct(c.col_name.alias("name"), F.lower(c.col_name).alias("name_lc")),
                ).alias("columns"),
            ),
        )

    return let(bound, tables)


def name_catalog(docs: DataFrame) -> DataFrame:
    """One row per database with `name_tables`: a form to store."""
    return docs.select("db_key", name_tables().alias("tables"))


def name_index() -> Column:
    """Names of a document as parallel arrays, for case-insensitive look-ups.

    Tables and columns are in reverse order: the first match of a look-up is
    the last of the names that fold together.
    """
    bound = F.struct(_tables().alias("names"), _column_entries("both").alias("columns"))

    def index(d: Column) -> Column:
        names = F.transform(
            d.names,
            lambda _, i: F.reverse(
                F.transform(F.filter(d.columns, lambda c: c.table_idx == i), lambda c: c.col_name)
            ),
        )
        lower = lambda arr: F.transform(arr, lambda name: F.lower(name))
        return let(
            F.struct(F.reverse(d.names).alias("tables"), F.reverse(names).alias("cols")),
            lambda r: F.struct(
                r.tables.alias("tables"),
                lower(r.tables).alias("tables_lc"),
                r.cols.alias("cols"),
                F.transform(r.cols, lower).alias("cols_lc"),
            ),
        )

    return let(bound, index)


# What a document, a table and a character of a name take at most once features are made from them, in bytes.
DOCUMENT_BYTES, TABLE_BYTES, CHARACTER_BYTES = 128, 512, 16


def catalog_size(docs: DataFrame) -> int:
    """Size of all documents, the measure for broadcasting, in columns of about 1 KB.

    A document counts as its columns, or as its bytes in KB where tables
    without columns or long names make these more.
    """
    nested = [F.flatten("column_names_original"), F.flatten("column_names")]
    texts = F.concat_ws("", "table_names_original", "table_names", *nested, "column_types")
    tables = F.greatest(F.size("table_names_original"), F.size("table_names"), F.lit(0))
    size = DOCUMENT_BYTES + TABLE_BYTES * tables.cast("long") + CHARACTER_BYTES * F.length(texts).cast("long")
    largest = F.greatest(F.size(_pairs()).cast("long"), F.ceil(size / 1024))
    return docs.agg(F.coalesce(F.sum(largest), F.lit(0)).alias("n")).first()["n"]
