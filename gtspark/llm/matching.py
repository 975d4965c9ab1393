"""Positions and replacement of regular-expression matches with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` the gaps between them,
so the n-th match starts after the first n gaps and n - 1 matches.  Texts
without a match cost one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


SLICE = 256              # matches whose running value is built at once; arrays are copied as they grow


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Array of ``op`` over all values before each (``zero`` before the first); ``op`` is associative.

    Slices are run through by themselves and then moved on by the slices
    before them, so the work is linear in long arrays as well.
    """
    none = F.slice(F.array(zero), 1, 0)

    def scan(part, of):
        def step(acc, x):
            return F.struct(op(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(zero.alias("at"), none.alias("out")), step)

    def moved(slices):
        return let(scan(slices, lambda s: s["at"])["out"], lambda before: F.flatten(F.transform(
            slices, lambda s, i: F.transform(s["out"], lambda y: op(F.element_at(before, i + 1), y)))))

    def cut(v):
        n = F.floor((F.size(v) + (SLICE - 1)) / SLICE).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda i: scan(F.slice(v, i * SLICE + 1, F.lit(SLICE)), lambda x: x)), moved)

    return let(values, cut)


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def located(steps):
        lengths = F.transform(steps, lambda x: F.length(x["gap"]) + F.length(x["value"]))
        before = running(lengths, F.lit(0), lambda a, b: a + b)

        def one(x, at):
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))
        return F.zip_with(steps, before, one)

    return F.when(text.rlike(pattern), let(steps, located)).otherwise(none)


def distinct_sorted(items: Column) -> Column:
    """The different items in order, by comparing neighbours."""
    return let(F.array_sort(items), lambda s: F.filter(
        s, lambda x, i: F.when(i == 0, True).otherwise(F.get(s, i - 1) != x)))


def changed(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Array of ``change`` of each match; null where there is none."""
    return F.when(text.rlike(pattern), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change))


def joined(text: Column, pattern: str, values: Column) -> Column:
    """``text`` with its matches replaced by ``values`` in turn (null: unchanged)."""
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.when(values.isNull(), text).otherwise(F.array_join(both, ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)
