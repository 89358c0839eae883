"""Folds over an array, in its row, and columns worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` names it, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns worked out once per row.

    Spark moves a filter below the columns it names and writes their expressions into it, once for each mention, Python calls
    included. It does not do so for the rows of an array, so these columns come out of one.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def none_of(element: Column) -> Column:
    """An empty array of elements of this type."""
    return F.filter(F.array(element), lambda _: F.lit(False))


def part(items: Column, first: Column, end: Column) -> Column:
    """The elements from index ``first`` to before ``end``, looked up one by one: ``slice`` goes through the whole array."""
    return F.transform(F.sequence(first, end - 1), lambda k: F.get(items, k))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold, one after each item.

    Spark copies all of a fold's state at each step, so no fold here holds many: one finds the states at which runs of items begin,
    and then each run has a short fold of its own that keeps every state. n items cost about n^(4/3) copies, not n^2.
    """

    def last(states: Column) -> Column:
        return F.element_at(states, -1)

    def extended(states: Column, state: Column) -> Column:
        return F.concat(states, F.array(state))

    def in_runs(array: Column, width: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(array) - 1, width)
        runs = F.transform(firsts, lambda first: part(array, first, F.least(first + width, F.size(array))))

        def states(run: Column, begin: Column) -> Column:
            seen = F.aggregate(run, F.array(begin), lambda seen, item: extended(seen, step(last(seen), item)))
            return F.filter(seen, lambda _, k: k > 0)

        def each(all_: Column) -> Column:
            begins = F.aggregate(all_, F.array(start), lambda b, run: extended(b, F.aggregate(run, last(b), step)))
            return bound(begins, lambda b: F.flatten(F.transform(all_, lambda run, r: states(run, F.get(b, r)))))

        return bound(runs, each)

    def scan(array: Column) -> Column:
        width = F.ceil(F.cbrt(F.size(array) * F.lit(2.0))).cast("int")
        return F.when(F.size(array) == 0, none_of(start)).otherwise(bound(width, lambda w: in_runs(array, w)))

    return bound(items, scan)
