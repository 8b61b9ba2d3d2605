"""Running sums and maxima over an array by Spark's own functions, without an array that grows element by element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are added up one by one; what lies before them is added up by blocks of so many.
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and in whatever loop the body asks for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, merge: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element of an array, ``start`` merged with all elements before it: of n elements in about 64 n + (n / 64)^2 steps."""

    def folded(part: Column) -> Column:
        return F.aggregate(part, start, merge)

    def placed(own: Column, earlier: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return merge(F.get(earlier, block), folded(F.slice(own, block * _BLOCK + 1, i - block * _BLOCK)))

        return F.transform(own, one)

    def blocked(own: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _BLOCK).cast("int"))
        return let(F.transform(blocks, lambda b: folded(F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK)))), lambda sums: let(F.transform(sums, lambda _, k: folded(F.slice(sums, F.lit(1), k))), lambda earlier: placed(own, earlier)))

    return let(values, lambda own: F.when(F.size(own) == 0, own).otherwise(blocked(own)))


def sums_before(values: Column) -> Column:
    """The sum of what comes before each element of an array of ints."""
    return before(values, lambda a, b: a + b, F.lit(0))


def most_before(values: Column) -> Column:
    """The largest of what comes before each element of an array of ints that aren't negative, 0 before the first."""
    return before(values, lambda a, b: F.greatest(a, b), F.lit(0))
