"""Column expressions that the operators are put together from. NULL is the only missing value within them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

FLOOR = 1e-12


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """Text or number as a finite double, NULL if it isn't one."""
    return finite(c.try_cast("double"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """``c`` within bounds; NULL stays NULL."""
    out = c
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    return out


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def mapped(c: Column, names: Mapping[str, str]) -> Column:
    """Values replaced as ``names`` says; others stay."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c) if pairs else c


def clean_label(c: Column, classes: Sequence[str], aliases: Mapping[str, str], none: str = "None") -> Column:
    """Trimmed, aliased label; anything but a class, NULL included, is ``none``."""
    label = mapped(strip(c), aliases)
    return F.when(label.isin(*classes), label).otherwise(none)


def to_group(c: Column, abnormal: Sequence[str]) -> Column:
    """``abnormal`` for the labels named so, else ``normal``, NULL and unknown labels too."""
    return F.when(c.isin(*abnormal), "abnormal").otherwise("normal")


def family(name: Column, prefixes: Sequence[tuple[str, str]], other: str) -> Column:
    """The family of the first prefix that a feature name starts with."""
    out = F.lit(other)
    for prefix, kind in reversed(prefixes):
        out = F.when(name.startswith(prefix), kind).otherwise(out)
    return out


# -- geometry ---------------------------------------------------------------------------------------------------------


def length(dx: Column, dy: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(dx * dx + dy * dy)


def distance(a: str, b: str) -> Column:
    """Distance of two points with ``_x`` and ``_y`` columns."""
    return length(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y"))


def angle(a: str, b: str, c: str, guarded: bool = False) -> Column:
    """Angle at ``b`` in degrees.

    The plain form adds 1e-8 to the product of the lengths; the guarded form divides only if it exceeds 1e-12, and is 0 otherwise.
    """
    ax, ay = F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y")
    cx, cy = F.col(f"{c}_x") - F.col(f"{b}_x"), F.col(f"{c}_y") - F.col(f"{b}_y")
    dot, size = ax * cx + ay * cy, length(ax, ay) * length(cx, cy)
    cosine = F.when(size > 1e-12, dot / size).otherwise(1.0) if guarded else dot / (size + 1e-8)
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def middle(a: str, b: str, axis: str) -> Column:
    """Coordinate of the point between two others."""
    return (F.col(f"{a}_{axis}") + F.col(f"{b}_{axis}")) / 2


# -- order within a subject -------------------------------------------------------------------------------------------


def diff(c: Column, order: WindowSpec) -> Column:
    """Difference to the frame before; NULL on the first."""
    return c - F.lag(c).over(order)


def zero(c: Column) -> Column:
    """0 for NULL."""
    return F.coalesce(c, F.lit(0.0))


# -- arrays of probabilities ------------------------------------------------------------------------------------------


def array_sum(a: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def normalised(a: Column) -> Column:
    """An array divided by its sum; an error for negative or non-finite values and for a sum that isn't positive."""
    total = array_sum(a)
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))) | ~(total > 0)
    return F.when(bad, F.raise_error(F.lit("probabilities must be finite, non-negative and have a positive sum"))).otherwise(F.transform(a, lambda x: x / total))


def argmax(a: Column) -> Column:
    """Index from 0 of the largest value, the lowest of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def in_class_order(values: Column, classes: Sequence[str]) -> Column:
    """A map of class -> probability as an array in a fixed order, 0 for absent classes."""
    return F.array(*(F.coalesce(F.element_at(values, c), F.lit(0.0)) for c in map(F.lit, classes)))


def group_fusion(flat: Column, group: Column, alpha: Column | float, classes: Sequence[str], abnormal: Sequence[str]) -> Column:
    """Class probabilities times the power ``alpha`` of their group's probability (``[normal, abnormal]``), floored and normalised."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    parts = []
    for i, c in enumerate(classes):
        gate = F.greatest(F.get(group, F.lit(int(c in abnormal))), F.lit(FLOOR))
        parts.append(F.greatest(F.get(flat, F.lit(i)) * F.pow(gate, alpha), F.lit(FLOOR)))
    return normalised(F.array(*parts))


def scale_fusion(by_scale: Sequence[Column], weights: Sequence[float], allowed: Sequence[Sequence[float]]) -> Column:
    """Weighted sum of arrays, normalised; weights that aren't on the list are refused."""
    if tuple(weights) not in {tuple(w) for w in allowed}:
        raise ValueError(f"weights {tuple(weights)} are not declared")
    total = None
    for a, w in zip(by_scale, weights, strict=True):
        part = F.transform(a, lambda x: x * w)  # noqa: B023
        total = part if total is None else F.zip_with(total, part, lambda x, y: x + y)
    return normalised(total)
