"""Greedy walks over sorted arrays without a state that grows: range search for each next step, pointer doubling for the walk.

A greedy rule such as "the next break that lies far enough behind the last one kept" makes every position point at the
next one. Following the pointers one by one in a fold copies all that was found at every step; here each round
doubles the part of the walk that is known and the length of the jumps, so n positions cost n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions import text as T

#: Two to the powers that positions of an array can need.
_POWERS = [1 << k for k in reversed(range(30))]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(sizes: Column) -> Column:
    """array: the sum of the items before each one, and of all."""
    return bound(sizes, lambda xs: F.concat(T.running_rows(xs, lambda x: x, lambda a, b: a + b, F.lit(0), lambda at, x: at), F.array(F.aggregate(xs, F.lit(0), lambda a, x: a + x))))


def last_within(values: Column, limit: Column, powers: Column) -> Column:
    """The place (from 1) of the last of the rising ``values`` that isn't above ``limit``, or 0; ``powers`` are those of ``powers_below``."""
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when(F.get(values, at + p - 1) <= limit, at + p).otherwise(at))


def powers_below(count: Column) -> Column:
    """The powers of two up to ``count``, largest first."""
    return F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p <= count)


def chain(nexts: Column) -> Column:
    """The positions (from 0) that a walk meets: 0, where 0 points, where that points, until a pointer leaves the array."""

    def walk(pointers: Column) -> Column:
        n = F.size(pointers)
        # n points at itself; ``seen`` holds the first positions of the walk, ``jump`` leads as many steps ahead as there are
        begin = F.struct(F.array(F.lit(0)).alias("seen"), F.concat(pointers, F.array(n)).alias("jump"))

        def double(acc: Column, _) -> Column:
            ahead = F.filter(F.transform(acc["seen"], lambda v: F.get(acc["jump"], v)), lambda v: v < n)
            return F.struct(F.concat(acc["seen"], ahead).alias("seen"), F.transform(acc["jump"], lambda v: F.get(acc["jump"], v)).alias("jump"))

        return F.when(n > 0, F.aggregate(powers_below(n), begin, double, lambda acc: acc["seen"])).otherwise(F.array().cast("array<int>"))

    return bound(nexts, walk)


def spaced(positions: Column, gap: int) -> Column:
    """Which of the rising ``positions`` stay (places from 0), if each must lie more than ``gap`` behind the last that stayed."""
    nexts = lambda ps: bound(powers_below(F.size(ps)), lambda powers: F.transform(ps, lambda p: last_within(ps, p + gap, powers)))
    return bound(positions, lambda ps: chain(nexts(ps)))


def packed(sizes: Column, budget: int, overlap: int) -> Column:
    """array<struct<first, end, total>>: items packed in order, each pack beginning with the ``overlap`` items before it.

    A pack takes its overlap and one item in any case, then items while their sum with it stays within ``budget``.
    """

    def pack(sums: Column) -> Column:
        n = F.size(sums) - 1
        first = lambda i: F.greatest(F.lit(0), i - overlap)
        # where the pack that begins with item i ends
        ends = bound(powers_below(n + 1), lambda powers: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(i + 1, last_within(sums, F.get(sums, first(i)) + budget, powers) - 1)))
        row = lambda i, e: F.struct(first(i).alias("first"), e.alias("end"), (F.get(sums, e) - F.get(sums, first(i))).alias("total"))
        packs = bound(ends, lambda es: F.transform(chain(es), lambda i: row(i, F.get(es, i))))
        return F.when(n > 0, packs)

    return bound(prefix_sums(sizes), pack)
