"""Frame tables: positions, numbers, gaps, labels and normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.schema import COORDS
from tidewindow.storage import saved


def in_order(keys: Sequence[str] = ("subject_id",), by: str = "pos") -> WindowSpec:
    """Frames of a subject, earliest first."""
    return Window.partitionBy(*keys).orderBy(by)


def in_reverse(keys: Sequence[str] = ("subject_id",), by: str = "pos") -> WindowSpec:
    """Frames of a subject, latest first.

    A running frame over it looks ahead in one pass; the frame "from here to the end" would read the rest again for each row.
    """
    return Window.partitionBy(*keys).orderBy(F.desc(by))


def last_known(c: Column, order: WindowSpec) -> Column:
    """The nearest value that is not NULL, at this row or before it in ``order``."""
    return F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


#: Frames of a subject that one task orders at a time.
BLOCK = 16_384


def overlapping(df: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Frames in ``__block``s of a subject's positions, each block with copies of the frames right before and after it, so that :func:`in_parts` may look so far."""
    own, at = F.floor(F.col("pos") / BLOCK), F.pmod("pos", F.lit(BLOCK))
    places = F.array_compact(
        F.array(
            F.struct(own.alias("__block"), F.lit(False).alias("__copied")),
            F.when(at >= BLOCK - before, F.struct((own + 1).alias("__block"), F.lit(True).alias("__copied"))),
            F.when((at < after) & (own > 0), F.struct((own - 1).alias("__block"), F.lit(True).alias("__copied"))),
        )
    )
    return df.select("*", F.inline(places))


def in_parts() -> WindowSpec:
    """Frames of a block, earliest first."""
    return Window.partitionBy("subject_id", "__block").orderBy("pos")


def settled(df: DataFrame) -> DataFrame:
    """The frames of :func:`overlapping` without the copies. They keep ``__block``, by which they are dealt out, for :func:`known_around`."""
    return df.where(~F.col("__copied")).drop("__copied")


def known_around(df: DataFrame, columns: Mapping[str, Column]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """``df``, and for each name the position ``p`` and value ``v`` of the nearest row of the subject that has one, this row included, before and after it.

    Blocks are looked through side by side; what a block hands on is one row, and only these are put in order by subject. As both read ``df``, it is written once; columns
    that turn out to have no gaps are left as they are. The columns that are added begin with ``__lo_`` and ``__hi_``.
    """
    if "__block" not in df.columns:
        df = df.withColumn("__block", F.floor(F.col("pos") / BLOCK))
    df = saved(df, "scan")
    here = {k: F.struct(F.col("pos").alias("p"), c.alias("v")) for k, c in columns.items()}
    gaps = df.agg(*(F.count_if(c.isNull()).alias(k) for k, c in columns.items())).first()
    own = {k: F.when(c.isNotNull(), here[k]) for k, c in columns.items() if gaps[k]}
    if not own:
        return df.drop("__block"), {k: (h, h) for k, h in here.items()}
    ends = df.groupBy("subject_id", "__block").agg(*(e for k, c in own.items() for e in (F.max(c).alias(f"last_{k}"), F.min(c).alias(f"first_{k}"))))
    blocks, back = Window.partitionBy("subject_id").orderBy("__block"), Window.partitionBy("subject_id").orderBy(F.desc("__block"))
    handed = [
        e for k in own
        for e in (
            F.last(f"last_{k}", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__before_{k}"),
            F.last(f"first_{k}", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__after_{k}"),
        )
    ]
    ends = ends.select(F.col("subject_id").alias("__s"), F.col("__block").alias("__b"), *handed)
    order, reverse = in_parts(), Window.partitionBy("subject_id", "__block").orderBy(F.desc("pos"))
    df = df.withColumns({f"__lo_{k}": last_known(c, order) for k, c in own.items()}).withColumns({f"__hi_{k}": last_known(c, reverse) for k, c in own.items()})
    df = df.join(ends, F.col("subject_id").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    out = {f"__lo_{k}": F.coalesce(f"__lo_{k}", f"__before_{k}") for k in own} | {f"__hi_{k}": F.coalesce(f"__hi_{k}", f"__after_{k}") for k in own}
    df = df.withColumns(out).drop("__s", "__b", "__block", *(f"__{side}_{k}" for k in own for side in ("before", "after")))
    return df, {k: (F.col(f"__lo_{k}"), F.col(f"__hi_{k}")) if k in own else (h, h) for k, h in here.items()}


def without_known(df: DataFrame) -> DataFrame:
    """``df`` without what :func:`known_around` has added."""
    return df.drop(*(c for c in df.columns if c.startswith(("__lo_", "__hi_"))))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that a table lacks."""
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The table itself, or an error that names what it lacks."""
    if lacks := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(lacks)}")
    return df


def with_pos(df: DataFrame, subject: str, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``subject_id`` and ``pos`` 0, 1, ... in a total order within the subject."""
    place = F.row_number().over(Window.partitionBy(subject).orderBy(*order_by)) - 1
    return df.withColumns({"subject_id": F.col(subject), "pos": place.cast("long")})


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as finite doubles; what can't be read as one is NULL."""
    return df.withColumns({c: x.number(F.col(c)) for c in columns})


def fill_gaps(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """NULLs between known values on the straight line between them by position, NULLs at the ends as the nearest value.

    A subject whose column is NULL throughout is an error; with ``strict`` off it stays NULL.
    """
    seen, around = known_around(df, {str(i): F.col(c) for i, c in enumerate(columns)})
    out = {}
    for i, c in enumerate(columns):
        lo, hi = around[str(i)]
        line = lo["v"] + (hi["v"] - lo["v"]) * (F.col("pos") - lo["p"]) / (hi["p"] - lo["p"])
        none = F.raise_error(F.lit(f"a subject has no value of {c}")).cast("double") if strict else F.lit(None).cast("double")
        if f"__lo_{i}" in seen.columns:
            out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(lo.isNotNull() & hi.isNotNull(), line).when(lo.isNull() & hi.isNull(), none).otherwise(F.coalesce(lo["v"], hi["v"]))
    return without_known(seen.withColumns(out))


def carry(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Non-finite values and NULLs as the last known value, else the next, else ``default``."""
    seen, around = known_around(df.withColumns({c: x.finite(F.col(c)) for c in columns}), {str(i): F.col(c) for i, c in enumerate(columns)})
    out = {c: F.coalesce(around[str(i)][0]["v"], around[str(i)][1]["v"], F.lit(default)) for i, c in enumerate(columns) if f"__lo_{i}" in seen.columns}
    return without_known(seen.withColumns(out))


def prepare(df: DataFrame, columns: Sequence[str] = COORDS) -> DataFrame:
    """Required columns checked, read as numbers and their gaps filled."""
    return fill_gaps(numbers(require(df, columns), columns), columns)


# -- normalisation ----------------------------------------------------------------------------------------------------


def _scaled(df: DataFrame, scale: Column, columns: Sequence[str]) -> DataFrame:
    """Coordinates about the middle of the hips in units of ``scale``, where unknown its median over the subject, else 1."""
    df = df.withColumn("__scale", x.finite(scale))
    median = df.groupBy(F.col("subject_id").alias("__s")).agg(F.median("__scale").alias("__median"))
    df = df.join(median, F.col("subject_id").eqNullSafe(F.col("__s"))).drop("__s").withColumns(
        {
            "__scale": x.clip(F.coalesce("__scale", "__median", F.lit(1.0)), low=1e-6),
            "__hip_x": x.middle("left_hip", "right_hip", "x"),
            "__hip_y": x.middle("left_hip", "right_hip", "y"),
        }
    )
    out = {c: (F.col(c) - F.col(f"__hip_{c[-1]}")) / F.col("__scale") for c in columns}
    return df.withColumns(out).drop("__scale", "__median", "__hip_x", "__hip_y")


def torso() -> Column:
    """Distance from the middle of the shoulders to that of the hips."""
    return x.length(
        x.middle("left_shoulder", "right_shoulder", "x") - x.middle("left_hip", "right_hip", "x"),
        x.middle("left_shoulder", "right_shoulder", "y") - x.middle("left_hip", "right_hip", "y"),
    )


def shoulders_first() -> Column:
    """Shoulder width where it exceeds 1e-6, else the torso."""
    width = x.distance("left_shoulder", "right_shoulder")
    return F.when(width > 1e-6, width).otherwise(torso())


def normalise_pose(df: DataFrame, columns: Sequence[str] = COORDS) -> DataFrame:
    """Coordinates about the hips in units of the shoulder width."""
    return _scaled(df, shoulders_first(), columns)


def rolling_median(c: Column, width: int, order: WindowSpec) -> Column:
    """Median of the centred frame of ``width`` rows, of fewer at the ends."""
    half = width // 2
    return F.percentile(c, F.lit(0.5)).over(order.rowsBetween(-half, half))


def normalise_pose_robustly(df: DataFrame, columns: Sequence[str] = COORDS) -> DataFrame:
    """As :func:`normalise_pose`, of coordinates smoothed over 5 frames, with the scale smoothed over 15."""
    order = in_parts()
    df = overlapping(df, 9, 9).withColumns({c: rolling_median(F.col(c), 5, order) for c in columns})  # 7 frames on either side, whose own medians reach 2 further
    df = df.withColumn("__width", shoulders_first()).withColumn("__smooth", rolling_median(F.col("__width"), 15, order))
    return _scaled(settled(df).drop("__block"), F.col("__smooth"), columns).drop("__width", "__smooth")


def normalise_torso_first(df: DataFrame, columns: Sequence[str] = COORDS) -> tuple[DataFrame, list[str]]:
    """Coordinates in units of the torso where it exceeds 1e-5, else of the shoulder width, and their first differences.

    The scale's median over the subject stands in where it is no positive number. Returns the table and the 68 column names.
    """
    width = x.distance("left_shoulder", "right_shoulder")
    out = _scaled(df, F.when(torso() > 1e-5, torso()).when(width > 1e-5, width), columns)
    order = in_parts()
    out = settled(overlapping(out, 1).withColumns({f"{c}_delta": x.zero(x.diff(F.col(c), order)) for c in columns})).drop("__block")
    names = [*columns, *(f"{c}_delta" for c in columns)]
    return out.withColumns({c: x.zero(x.finite(F.col(c))) for c in names}), names
