"""Array expressions that stay linear in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running merge.
STEP = 128


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x evaluated once, however often f names it and inside whichever lambda."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(a: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element the (associative) merge of all up to it. Blocks are merged first, then elements
    within their block, so no array grows element by element."""
    fold = lambda x: F.aggregate(x, zero, merge)
    block = lambda i: F.floor(i / STEP).cast("int")
    return let(a, lambda v: F.when(F.size(v) == 0, F.transform(v, lambda _: zero)).otherwise(let(
        F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: fold(F.slice(v, b * STEP + 1, F.lit(STEP)))),
        lambda sums: let(
            F.transform(sums, lambda _, b: fold(F.slice(sums, F.lit(1), b))),
            lambda before: F.transform(v, lambda _, i: merge(
                F.get(before, block(i)), fold(F.slice(v, block(i) * STEP + 1, i % STEP + 1))))))))


def running_sum(a: Column) -> Column:
    return running(a, F.lit(0).cast("long"), lambda x, y: x + y)


def running_max(a: Column, zero: Column) -> Column:
    """Nulls are passed over."""
    return running(a, zero, lambda x, y: F.greatest(x, y))
