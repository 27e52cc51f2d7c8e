"""Links `{table: [columns]}`: folding, resolving, parsing, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.functions import jsontext as J
from schemaloom.functions.arrays import empty_if_null, last_of_each, let

LINKS_TYPE = "map<string,array<string>>"


def _last_per_table(entries: Column) -> Column:
    return last_of_each(entries, lambda e: e.table_lc)


def fold_links(links: Column) -> Column:
    """Links as lower-case entries; of keys that fold together the last wins."""
    folded = F.transform(
        F.map_entries(links),
        lambda e: F.struct(
            F.lower(e.key).alias("table_lc"),
            F.transform(empty_if_null(e.value, "string"), lambda c: F.lower(c)).alias("cols_lc"),
        ),
    )
    return F.coalesce(
        _last_per_table(folded), F.array().cast("array<struct<table_lc:string,cols_lc:array<string>>>")
    )


def fold_links_json(text: Column) -> Column:
    """`fold_links` for untrusted JSON text: values are coerced to names."""
    folded = F.transform(
        J.entries_last_wins(J.json_object(text)),
        lambda e: F.struct(
            F.lower(e.key).alias("table_lc"),
            F.transform(J.string_items(e.value), lambda c: F.lower(c)).alias("cols_lc"),
        ),
    )
    return F.coalesce(
        _last_per_table(folded), F.array().cast("array<struct<table_lc:string,cols_lc:array<string>>>")
    )


def links_in_schema_order(tables: Column, folded: Column) -> Column:
    """Folded links as real names in schema order; unknown names drop out."""
    matched = F.transform(
        tables,
        lambda t: let(
            F.try_element_at(F.filter(folded, lambda f: f.table_lc == t.name_lc), F.lit(-1)),
            lambda f: F.struct(
                t["name"].alias("table_name"),
                F.transform(
                    F.filter(t.columns, lambda c: F.array_contains(f.cols_lc, c.name_lc)),
                    lambda c: c["name"],
                ).alias("cols"),
                f.isNotNull().alias("linked"),
            ),
        ),
    )
    return F.transform(F.filter(matched, lambda m: m.linked), lambda m: F.struct(m.table_name, m.cols))


def response_links(response: Column, candidates: Column, tables: Column) -> Column:
    """Free response text to links with real names, in schema order.

    Keys and items may be IDs or names whatever was asked for. An ID wins over
    a name spelled the same way, names resolve against the whole schema, and
    keys that mean the same table are merged.
    """
    obj = J.unwrap_links(J.first_json_object(response))
    raw = F.transform(
        J.entries_last_wins(obj),
        lambda e: F.struct(
            J.trimmed_lower(e.key).alias("key"),
            F.transform(J.string_items(e.value), J.trimmed_lower).alias("items"),
        ),
    )

    def resolve(r: Column) -> Column:
        by_id = F.try_element_at(
            F.filter(candidates, lambda t: F.lower(t.table_id) == r.key), F.lit(1)
        )
        # The candidate a key leads to, by ID first and by name otherwise.
        table_lc = F.coalesce(by_id.name_lc, r.key)
        return let(
            table_lc,
            lambda name: let(
                F.try_element_at(F.filter(candidates, lambda t: t.name_lc == name), F.lit(1)).columns,
                lambda offered: F.struct(
                    name.alias("table_lc"),
                    F.transform(
                        r["items"],
                        lambda x: F.coalesce(
                            F.try_element_at(
                                F.filter(offered, lambda c: F.lower(c.column_id) == x), F.lit(1)
                            ).name_lc,
                            x,
                        ),
                    ).alias("cols_lc"),
                ),
            ),
        )

    def merged(entries: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(entries, lambda e: e.table_lc)),
            lambda t: F.struct(
                t.alias("table_lc"),
                F.flatten(
                    F.transform(F.filter(entries, lambda e: e.table_lc == t), lambda e: e.cols_lc)
                ).alias("cols_lc"),
            ),
        )

    none = F.array().cast("array<struct<table_name:string,cols:array<string>>>")
    resolved = let(F.transform(raw, resolve), merged)
    return F.coalesce(let(resolved, lambda f: links_in_schema_order(tables, f)), none)


def to_links_map(entries: Column) -> Column:
    """Entries as a map; of tables with equal names the last one stays."""
    later = lambda es, e, i: F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x.table_name == e.table_name)
    return F.map_from_entries(let(entries, lambda es: F.filter(es, lambda e, i: ~later(es, e, i))))


def compact_json(entries: Column) -> Column:
    """Links as compact JSON in the given order; also for repeated names."""
    body = F.transform(
        entries, lambda e: F.concat(J.quoted(e.table_name), F.lit(":"), F.to_json(e.cols))
    )
    return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))


def normalized_json(links: Column) -> Column:
    """Links as JSON sorted by table and column, with a blank after separators."""
    listed = lambda cols: F.concat(
        F.lit("["), F.array_join(F.transform(F.array_sort(cols), J.quoted), ", "), F.lit("]")
    )
    body = F.transform(
        F.array_sort(F.transform(F.map_entries(links), lambda e: F.struct(e.key, e.value))),
        lambda e: F.concat(J.quoted(e.key), F.lit(": "), listed(e.value)),
    )
    return F.concat(F.lit("{"), F.array_join(body, ", "), F.lit("}"))


def target_json(links: Column, candidates: Column, tables: Column, output_format: str) -> Column:
    """Gold links as the answer text, in schema order, candidates only.

    IDs cover the columns among the candidates; names cover every linked column.
    """
    real = links_in_schema_order(tables, fold_links(links))

    def answer(e: Column) -> Column:
        def entry(t: Column) -> Column:
            if output_format == "names":
                return F.struct(e.table_name, e.cols, t.isNotNull().alias("offered"))
            ids = F.transform(
                F.filter(t.columns, lambda c: F.array_contains(e.cols, c.col_name)), lambda c: c.column_id
            )
            return F.struct(
                t.table_id.alias("table_name"), ids.alias("cols"), t.isNotNull().alias("offered")
            )

        return let(
            F.try_element_at(F.filter(candidates, lambda t: t.table_name == e.table_name), F.lit(1)), entry
        )

    return compact_json(F.filter(F.transform(real, answer), lambda x: x.offered))


def table_count(links: Column) -> Column:
    return F.size(F.map_keys(links))


def column_count(links: Column) -> Column:
    return F.aggregate(F.map_values(links), F.lit(0), lambda acc, cols: acc + F.size(cols))


def has_empty_table(links: Column) -> Column:
    return F.exists(F.map_values(links), lambda cols: F.size(cols) == 0)


def scorer_entries(text: Column) -> Column:
    """Links text as the scorer reads it: items as text, only lists count."""
    entries = F.transform(
        J.entries_last_wins(J.json_object(text)),
        lambda e: F.struct(
            F.lower(e.key).alias("table_lc"),
            F.transform(J.as_list(e.value), J.text_or_none).alias("cols_lc"),
        ),
    )
    return F.coalesce(entries, F.array().cast("array<struct<table_lc:string,cols_lc:array<string>>>"))


# Joins a table and a column name into one set member; never part of a name.
PAIR_SEPARATOR = "\x1f"


def canonical_sets(entries: Column, index: Column, is_gold: bool = False) -> Column:
    """Table set, table/column pair set and counts of identifiers not in the schema.

    `index` is the `name_index` of the schema. Unknown identifiers of a
    prediction stay as marked members that match nothing; those of gold are
    left out.
    """
    marked = lambda name: F.concat(F.lit(V.UNKNOWN_MARK), name)
    unknown = lambda name: name.startswith(V.UNKNOWN_MARK)

    def columns(items: Column, at: Column) -> Column:
        return let(
            F.struct(F.get(index.cols_lc, at).alias("lc"), F.get(index.cols, at).alias("real")),
            lambda names: F.transform(
                empty_if_null(items, "string"),
                lambda c: F.coalesce(F.get(names.real, F.array_position(names.lc, c) - 1), marked(c)),
            ),
        )

    def resolve(e: Column) -> Column:
        return let(
            F.array_position(index.tables_lc, e.table_lc) - 1,
            lambda at: F.struct(
                F.coalesce(F.get(index.tables, at), marked(e.table_lc)).alias("label"),
                columns(e.cols_lc, at).alias("columns"),
            ),
        )

    def summarise(resolved: Column) -> Column:
        tables = F.transform(resolved, lambda r: r.label)
        pairs = F.flatten(
            F.transform(
                resolved,
                lambda r: F.transform(r.columns, lambda c: F.concat(r.label, F.lit(PAIR_SEPARATOR), c)),
            )
        )
        names = F.flatten(F.transform(resolved, lambda r: r.columns))
        if is_gold:
            tables = F.filter(tables, lambda t: ~unknown(t))
            pairs = F.filter(
                pairs, lambda p: ~unknown(p) & ~p.contains(PAIR_SEPARATOR + V.UNKNOWN_MARK)
            )
        return F.struct(
            F.array_distinct(tables).alias("tables"),
            F.array_distinct(pairs).alias("pairs"),
            F.size(F.filter(resolved, lambda r: unknown(r.label))).alias("bad_tables"),
            F.size(F.filter(names, unknown)).alias("bad_columns"),
        )

    return let(F.transform(entries, resolve), summarise)
