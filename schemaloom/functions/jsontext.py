"""JSON objects out of untrusted text, with JSON types kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.functions.arrays import empty_if_null, last_of_each, let

OBJECT_TYPE = "map<string,variant>"
# Only double quotes delimit strings, as in the JSON grammar.
STRICT = {"allowSingleQuotes": "false"}
# A brace that can open an object.
OPENING = r"\{(?=\s*[\"}])"
# Characters that count as white space around an identifier.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def json_object(text: Column) -> Column:
    """The object a text starts with, or null."""
    return F.from_json(text, OBJECT_TYPE, STRICT)


def first_json_object(text: Column) -> Column:
    """The first object that parses, trying the opening braces in turn.

    Only braces before a quote or a closing brace can open an object, and
    nothing behind the last closing brace belongs to one; no other place is
    tried. One pass finds these places. The scan keeps the text behind the
    current one and stops parsing after the first hit, so a response that
    starts with its answer is parsed once, and floods of braces never.
    """
    closed = F.left(text, F.length(text) - F.length(F.substring_index(text, "}", -1)))

    def scanned(t: Column, pieces: Column) -> Column:
        first = F.substring(t, F.length(F.get(pieces, 0)) + 1, F.length(t))
        start = F.struct(F.lit(None).cast(OBJECT_TYPE).alias("found"), first.alias("rest"))

        def step(state: Column, piece: Column) -> Column:
            # The piece behind the brace that `rest` begins with.
            further = F.substring(state.rest, F.length(piece) + 2, F.length(state.rest))
            return F.when(state.found.isNotNull(), state).otherwise(
                F.struct(json_object(state.rest).alias("found"), further.alias("rest"))
            )

        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda state: state.found)

    cut = let(closed, lambda t: F.struct(t.alias("t"), F.split(t, OPENING).alias("pieces")))
    # Most texts without an answer have no place to try.
    return F.when(F.regexp_like(text, F.lit(OPENING)), let(cut, lambda x: scanned(x.t, x.pieces)))


def entries_last_wins(obj: Column) -> Column:
    """Key/value pairs of an object; of equal keys only the last one counts."""
    return last_of_each(F.map_entries(obj), lambda p: p.key)


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT_TYPE)


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def string_items(value: Column) -> Column:
    """Names in a value: strings of a list, keys of an object, a lone string."""
    listed = F.transform(F.filter(as_list(value), is_string), as_string)
    lone = F.when(is_string(value), F.array(as_string(value)))
    return empty_if_null(F.coalesce(listed, F.map_keys(as_object(value)), lone), "string")


def unwrap_links(obj: Column) -> Column:
    """The object under `schema_links` when there is one, else the object itself."""

    def inner(o: Column) -> Column:
        wrapped = F.filter(F.map_entries(o), lambda p: p.key == "schema_links")
        return F.coalesce(as_object(F.try_element_at(wrapped, F.lit(-1)).value), o)

    return let(obj, inner)


def text_or_none(value: Column) -> Column:
    """Any JSON value as lower-case text; a JSON null reads `none`."""
    return F.lower(F.coalesce(as_string(value), F.lit("none")))


def quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def trimmed_lower(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(BLANKS)))
