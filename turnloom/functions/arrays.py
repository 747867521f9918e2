"""Array expressions that the operators are built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(a: Column) -> Column:
    """0..size-1; empty for an empty array (a sequence would count down)."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def runs(a: Column, starts: Callable[[Column, Column, Column], Column]) -> Column:
    """Cut an array into consecutive runs. starts(previous, current, index) says where a run begins; the first element
    always begins one."""

    def cut(a: Column) -> Column:
        heads = F.filter(indexes(a), lambda i: (i == 0) | starts(F.get(a, i - 1), F.get(a, i), i))
        return let(heads, lambda h: F.transform(h, lambda s, g: F.slice(a, s + 1, F.coalesce(F.get(h, g + 1), F.size(a)) - s)))

    return let(a, cut)


def last_position(a: Column, x: Column) -> Column:
    """Zero-based place of the last element equal to x, nulls equal to null; null if there is none."""
    return F.array_max(F.filter(indexes(a), lambda i: F.get(a, i).eqNullSafe(x)))


def chunked(a: Column, n: int) -> Column:
    """Consecutive slices of n elements, the last one shorter."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return let(a, lambda a: F.transform(F.filter(indexes(a), lambda i: i % n == 0), lambda i: F.slice(a, i + 1, F.lit(n))))


def split_by_value(a: Column, value: Column) -> Column:
    """Parts of an array, each begun by `value`, except that the first element never begins a second part."""
    return runs(a, lambda before, x, i: x == value)


def first_present(errors: list[Column]) -> Column:
    return F.coalesce(*errors)


def error(code: str, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def when(condition: Column, code: str, message: Column | str) -> Column:
    """The error if the condition holds, else null; a null condition holds not."""
    return F.when(condition, error(code, message))
