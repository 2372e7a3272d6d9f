"""Small helpers over array columns, all linear or n log n in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain Column used twice is evaluated twice, and inside a lambda once per
    array element; a lambda variable is evaluated once. ``value`` is the start
    of a fold over nothing, which ``body`` finishes; nesting stays linear,
    unlike with ``transform`` over a one-element array.
    """
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def positions(arr: Column, test: Callable[[Column], Column]) -> Column:
    """0-based positions of the elements for which ``test`` holds."""
    marked = F.transform(arr, lambda x, i: F.when(test(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def first_position(arr: Column, test: Callable[[Column], Column]) -> Column:
    """0-based position of the first element that passes, or null."""
    return F.nullif(F.array_position(F.transform(arr, test), F.lit(True)), F.lit(0)) - 1


def head(arr: Column, n: Column) -> Column:
    return F.slice(arr, F.lit(1), n)


def after(arr: Column, pos: Column) -> Column:
    """Elements behind the 0-based position ``pos``."""
    return F.slice(arr, pos + 2, F.greatest(F.size(arr) - pos - 1, F.lit(0)))


def last_n(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - (n - 1), F.lit(1)), F.lit(n))


def spans(starts: Column, total: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Map ``body(start, length)`` over the spans that begin at each of ``starts``."""
    return F.transform(
        starts,
        lambda s, k: body(s, F.coalesce(F.get(starts, k + 1), total) - s),
    )


def runs(tagged: Column) -> Column:
    """Group a sorted ``array<struct<key, pos>>``: ``array<struct<key, n, first, at>>``.

    ``first`` is the first position of the key and ``at`` all its positions in
    order. Cutting a sorted array into runs keeps grouping inside the row: no
    explode, no shuffle.
    """

    def cut(t: Column) -> Column:
        starts = F.filter(
            F.transform(
                t,
                lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["key"] != x["key"]), i),
            ),
            lambda i: i.isNotNull(),
        )
        return bind(
            starts,
            lambda s: spans(
                s,
                F.size(t),
                lambda at, n: F.struct(
                    F.get(t, at)["key"].alias("key"),
                    n.alias("n"),
                    F.get(t, at)["pos"].alias("first"),
                    F.slice(t, at + 1, n)["pos"].alias("at"),
                ),
            ),
        )

    return bind(tagged, cut)


def occurrences(keys: Column) -> Column:
    """``runs`` of an array of strings: every value with all its positions."""
    return runs(
        F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos"))))
    )
