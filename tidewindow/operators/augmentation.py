"""Random changes of windows that are the same in every run: each number follows from a seed and the names of what it is for, not from where a row lies.

Windows are arrays of frames, each an array of the 34 coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.schema import JOINTS

#: Hexadecimal digits of a number between 0 and 1, of which a hash has four.
_DIGITS = 13
_PARTNER = [JOINTS.index(j.replace("left_", "#").replace("right_", "left_").replace("#", "right_")) for j in JOINTS]


@dataclass(frozen=True)
class Strength:
    """Ends and sizes of what is drawn: part of a window that is kept, factor, degrees, and shares of windows mirrored and joints dropped, and the deviation of noise."""

    crop: tuple[float, float] = (0.90, 1.0)
    scale: tuple[float, float] = (0.95, 1.05)
    degrees: float = 10.0
    mirror: float = 0.5
    dropout: float = 0.05
    noise: float = 0.005


def uniforms(seed: int, keys: Sequence[Column | str], *names: Column | str) -> list[Column]:
    """Four numbers above 0 and below 1 from SHA-256 of the seed, the keys and the names."""
    told = F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys), *(F.lit(n) if isinstance(n, str) else n.cast("string") for n in names)), 256)
    return [(F.conv(F.substring(told, 1 + _DIGITS * k, _DIGITS), 16, 10).cast("double") + 0.5) / float(1 << (4 * _DIGITS)) for k in range(4)]


def normals(seed: int, keys: Sequence[Column | str], *names: Column | str) -> tuple[Column, Column]:
    """Two independent normal numbers by Box and Muller's transformation."""
    a, b, *_ = uniforms(seed, keys, *names)
    far = F.sqrt(-2 * F.log(a))
    return far * F.cos(2 * math.pi * b), far * F.sin(2 * math.pi * b)


def cropped(frames: Column, seed: int, keys: Sequence[str], part: tuple[float, float] = (0.90, 1.0)) -> Column:
    """A random stretch of a window, drawn out to the window's length on straight lines between the middles of its frames; a single frame stays."""
    n = F.size(frames)
    share, start, *_ = uniforms(seed, keys, "crop")
    size = F.least(n, F.greatest(F.lit(2), F.bround(n * (part[0] + (part[1] - part[0]) * share)).cast("int")))
    first = F.floor(start * (n - size + 1)).cast("int")

    def frame(i: Column) -> Column:
        place = F.greatest((i + 0.5) * size / n - 0.5, F.lit(0.0))
        low = F.floor(place).cast("int")
        a, b = F.get(frames, first + low), F.get(frames, first + F.least(low + 1, size - 1))
        return F.zip_with(a, b, lambda v, w: v * (1 - (place - low)) + w * (place - low))

    return F.when(n < 2, frames).otherwise(F.transform(F.sequence(F.lit(0), n - 1), frame))


def moved(frames: Column, seed: int, keys: Sequence[str], strength: Strength) -> Column:
    """A window turned about the origin, scaled and mirrored, the same for all of its frames."""
    turn, size, side, _ = uniforms(seed, keys, "move")
    angle = F.radians((2 * turn - 1) * strength.degrees)
    k = strength.scale[0] + (strength.scale[1] - strength.scale[0]) * size
    mirror = side < strength.mirror

    def frame(v: Column) -> Column:
        x = [(F.get(v, 2 * j) * F.cos(angle) - F.get(v, 2 * j + 1) * F.sin(angle)) * k for j in range(len(JOINTS))]
        y = [(F.get(v, 2 * j) * F.sin(angle) + F.get(v, 2 * j + 1) * F.cos(angle)) * k for j in range(len(JOINTS))]
        turned = [c for j in range(len(JOINTS)) for c in (x[j], y[j])]
        other = [c for j in _PARTNER for c in (-x[j], y[j])]
        return F.when(mirror, F.array(*other)).otherwise(F.array(*turned))

    return F.transform(frames, frame)


def disturbed(frames: Column, seed: int, keys: Sequence[str], dropout: float = 0.05, noise: float = 0.005) -> Column:
    """A window in which some joints stand at 0 throughout, with normal noise on every coordinate of every frame."""
    kept = F.array(*(F.when(uniforms(seed, keys, "dropout", joint)[0] < dropout, 0.0).otherwise(1.0) for joint in JOINTS))

    def frame(v: Column, i: Column) -> Column:
        out = []
        for j, joint in enumerate(JOINTS):
            a, b = normals(seed, keys, "noise", joint, i)
            out += [F.get(v, 2 * j) * F.get(kept, j) + a * noise, F.get(v, 2 * j + 1) * F.get(kept, j) + b * noise]
        return F.array(*out)

    return F.transform(frames, frame)


def augmented(windows: DataFrame, keys: Sequence[str], seed: int, column: str = "coordinates", strength: Strength | None = None) -> DataFrame:
    """``windows`` with their coordinates cropped and drawn out, moved and disturbed: the same window and seed always give the same numbers."""
    s = strength or Strength()
    out = windows.withColumn(column, cropped(F.col(column), seed, keys, s.crop))
    out = out.withColumn(column, moved(F.col(column), seed, keys, s))
    return out.withColumn(column, disturbed(F.col(column), seed, keys, s.dropout, s.noise))
