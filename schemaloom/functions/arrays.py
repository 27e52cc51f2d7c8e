"""Small array helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Inside a higher-order function a plain reuse of an expression is evaluated
    again for every element. Here the value is the start of a fold over nothing
    and `body` its last step, which also spares a copy of the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def choose(condition: Column, value: Column, otherwise: Column) -> Column:
    """`value` where the condition holds, else `otherwise`.

    Inside a higher-order function, where nothing is compiled, this costs much
    less than a `CASE` with one branch.
    """
    return F.call_function("if", condition, value, otherwise)


def empty_if_null(arr: Column, element_type: str) -> Column:
    return F.coalesce(arr, F.array().cast(f"array<{element_type}>"))


def take(arr: Column, n: int | Column) -> Column:
    """The first n elements; none when n is not positive."""
    return F.slice(arr, F.lit(1), F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0)))


def take_last(arr: Column, n: Column) -> Column:
    """The last n elements; none when n is not positive."""
    kept = F.least(F.greatest(n, F.lit(0)), F.size(arr))
    return F.slice(arr, F.size(arr) - kept + 1, kept)


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([text.contains(part) for part in parts])


def last_of_each(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Of elements with equal key only the last one; no key is null."""
    later = lambda a, x, i: F.exists(F.slice(a, i + 2, F.size(a)), lambda y: key(y) == key(x))
    # Most arrays have nothing to drop, and need no element held against those behind it.
    return let(
        arr,
        lambda a: choose(
            F.size(F.array_distinct(F.transform(a, key))) == F.size(a), a, F.filter(a, lambda x, i: ~later(a, x, i))
        ),
    )


def inline_rows(df: DataFrame, structs: Column | str, required: str, *keep: Column | str) -> DataFrame:
    """One row per struct, beside the kept columns; `required` is never null in a struct.

    The plain generator makes the planner test the array for emptiness below
    it, which evaluates a costly array again, inside the join condition even.
    The outer one does not; its rows for empty arrays are dropped here.
    """
    return df.select(*keep, F.inline_outer(structs)).where(F.col(required).isNotNull())
