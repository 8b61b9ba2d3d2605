"""Features of a window of one signal, over rows ``(keys..., signal, pos, x)`` in long form.

Long form keeps the plan narrow: a hundred signals with thirty features are one aggregate, not three thousand columns.
Spectra and autocorrelations work on a window's values as an array, in Arrow batches of many windows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

GROUP = ("subject_id", "start_pos", "signal")
SUMMARIES = ("mean", "std", "median", "iqr", "range", "slope", "energy", "q10", "q90")
STATISTICAL = (
    "abs_energy", "iqr", "max", "mean", "median", "min", "peak_to_peak", "rms", "std", "var", "mean_abs_deviation", "median_abs_deviation",
)
TEMPORAL = (
    "auc", "autocorrelation", "mean_abs_diff", "slope", "zero_crossings", "median_abs_diff", "negative_turning", "neighbourhood_peaks",
    "positive_turning", "signal_distance", "sum_abs_diff",
)
SPECTRAL = (
    "fundamental_frequency", "max_power", "max_frequency", "median_frequency", "spectral_centroid", "spectral_entropy", "spectral_rolloff",
    "spectral_spread",
)


def long_form(framed: DataFrame, signals: Sequence[str], keys: Sequence[str] = ("subject_id", "start_pos", "pos")) -> DataFrame:
    """``(keys..., signal, x)``: a row for each signal of each row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals))).alias("__s")
    return framed.select(*keys, pairs).select(*keys, "__s.signal", "__s.x")


def wide_form(features: DataFrame, names: Sequence[str], signals: Sequence[str], separator: str = "__") -> DataFrame:
    """``(subject_id, start_pos, {signal}{separator}{name}...)`` of features in long form."""
    aggs = [F.max(F.when(F.col("signal") == s, F.col(n))).alias(f"{s}{separator}{n}") for n in names for s in signals]
    return features.groupBy("subject_id", "start_pos").agg(*aggs)


def summaries(rows: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Nine numbers: mean, population std, median, iqr, range, slope over position, mean square, q10 and q90 (linear)."""
    quantiles = F.percentile("x", F.array(*(F.lit(q) for q in (0.10, 0.25, 0.50, 0.75, 0.90)))).alias("q")
    out = rows.groupBy(*keys).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        (F.max("x") - F.min("x")).alias("range"),
        F.coalesce(F.regr_slope("x", F.col("pos").cast("double")), F.lit(0.0)).alias("slope"),
        F.avg(F.col("x") * F.col("x")).alias("energy"),
        quantiles,
    )
    q = F.col("q")
    return out.withColumns({"q10": q[0], "iqr": q[3] - q[1], "median": q[2], "q90": q[4]}).select(*keys, *SUMMARIES)


def _summaries_of(values: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """The nine numbers of ``values`` (windows, frames, signals) at ``places`` (windows, frames): windows by signals. What is not a number is left out, a signal without any has none."""
    known = ~np.isnan(values)
    n = known.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, values, 0).sum(axis=1) / n
        apart = np.where(known, values - mean[:, None], 0)
        at = np.where(known, places[:, :, None] - np.where(known, places[:, :, None], 0).sum(axis=1, keepdims=True) / n[:, None], 0)
        spread = (at * at).sum(axis=1)
        slope = np.where(spread > 0, (at * apart).sum(axis=1) / spread, 0.0)
        energy = np.where(known, values * values, 0).sum(axis=1) / n
        std = np.sqrt((apart * apart).sum(axis=1) / n)
    if known.all():
        q10, q25, q50, q75, q90 = np.quantile(values, (0.10, 0.25, 0.50, 0.75, 0.90), axis=1)
        width = values.max(axis=1) - values.min(axis=1)
    else:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # of signals without a number
            q10, q25, q50, q75, q90 = np.nanquantile(values, (0.10, 0.25, 0.50, 0.75, 0.90), axis=1)
            width = np.nanmax(values, axis=1) - np.nanmin(values, axis=1)
    return {"mean": mean, "std": std, "median": q50, "iqr": q75 - q25, "range": width, "slope": slope, "energy": energy, "q10": q10, "q90": q90}


def window_summaries(framed: DataFrame, signals: Sequence[str], chosen: Sequence[str] = SUMMARIES, keys: Sequence[str] = ("subject_id", "start_pos")) -> DataFrame:
    """``(keys..., chosen...)``: of each window an array for each summary, a number a signal in their order. The same numbers as :func:`summaries`, from windows as arrays instead of a row for each
    signal and frame."""
    frame = F.struct(F.col("pos").cast("double").alias("pos"), F.array(*(F.col(f"`{c}`").cast("double") for c in signals)).alias("v"))
    rows = framed.groupBy(*keys).agg(F.collect_list(frame).alias("rows"))  # a window's frames; their order plays no part
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", `{c}` array<double>" for c in chosen)
    keys, chosen, width = list(keys), list(chosen), len(signals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("rows")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                own = b.take(pa.array(np.flatnonzero(lengths == n)))
                flat = own.column("rows").flatten()
                places = flat.field("pos").to_numpy(zero_copy_only=False).reshape(own.num_rows, n)
                values = flat.field("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(own.num_rows, n, width)
                found = _summaries_of(values, places)
                arrays = [
                    pa.ListArray.from_arrays(pa.array(np.arange(0, own.num_rows * width + 1, width, dtype=np.int32)), pa.array(found[c].ravel(), from_pandas=True)) for c in chosen
                ]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *arrays], [*keys, *chosen])

    return rows.mapInArrow(run, schema)


def summary_rows(summarised: DataFrame, signals: Sequence[str], chosen: Sequence[str] = SUMMARIES, keys: Sequence[str] = ("subject_id", "start_pos")) -> DataFrame:
    """``(keys..., signal, chosen...)`` of :func:`window_summaries`, a row a signal."""
    names = F.array(*map(F.lit, signals))
    return summarised.select(*keys, F.inline(F.arrays_zip(names.alias("signal"), *(F.col(c) for c in chosen))))


def summary_columns(summarised: DataFrame, signals: Sequence[str], chosen: Sequence[str] = SUMMARIES, keys: Sequence[str] = ("subject_id", "start_pos"), separator: str = "__") -> DataFrame:
    """``(keys..., {signal}{separator}{name}...)`` of :func:`window_summaries`, a column for each."""
    return summarised.select(*keys, *(F.get(F.col(c), i).alias(f"{s}{separator}{c}") for c in chosen for i, s in enumerate(signals)))


def _line(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("pos")


def statistical(rows: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Twelve statistics; deviations are from the mean and the median of the window."""
    own = Window.partitionBy(*keys)
    x = F.col("x")
    rows = rows.withColumns({"__mean": F.avg(x).over(own), "__median": F.percentile(x, F.lit(0.5)).over(own)})
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    return rows.groupBy(*keys).agg(
        F.sum(x * x).alias("abs_energy"),
        (q[1] - q[0]).alias("iqr"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.percentile(x, F.lit(0.5)).alias("median"),
        F.min(x).alias("min"),
        (F.max(x) - F.min(x)).alias("peak_to_peak"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.stddev_pop(x).alias("std"),
        F.var_pop(x).alias("var"),
        F.avg(F.abs(x - F.col("__mean"))).alias("mean_abs_deviation"),
        F.percentile(F.abs(x - F.col("__median")), F.lit(0.5)).alias("median_abs_deviation"),
    )


def temporal(rows: DataFrame, rate: float, keys: Sequence[str] = GROUP, neighbours: int = 10) -> DataFrame:
    """Ten features of neighbouring frames; :func:`autocorrelation` is apart.

    A neighbourhood peak exceeds all ``neighbours`` frames on both sides, so the first and last of these can't be one.
    """
    w = _line(keys)
    x = F.col("x")
    place = F.row_number().over(w)
    rows = rows.withColumns(
        {
            "__i": place,
            "__d": x - F.lag(x).over(w),
            "__area": F.abs(x + F.lag(x).over(w)) / 2 / rate,
            "__sign": F.signum(x) != F.signum(F.lag(x).over(w)),
            "__left": F.max(x).over(w.rowsBetween(-neighbours, -1)),
            "__right": F.max(x).over(w.rowsBetween(1, neighbours)),
            "__n": F.count("*").over(Window.partitionBy(*keys)),
        }
    )
    rows = rows.withColumn("__next", F.lead("__d").over(w))
    d, after, i, n = (F.col(c) for c in ("__d", "__next", "__i", "__n"))
    peak = (x > F.col("__left")) & (x > F.col("__right")) & (i > neighbours) & (i <= n - neighbours)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum("__area"), F.lit(0.0)).alias("auc"),
        F.avg(F.abs(d)).alias("mean_abs_diff"),
        F.coalesce(F.regr_slope("x", F.col("__i").cast("double")), F.lit(0.0)).alias("slope"),
        F.count_if("__sign").alias("zero_crossings"),
        F.percentile(F.abs(d), F.lit(0.5)).alias("median_abs_diff"),
        F.count_if((d < 0) & (after > 0)).alias("negative_turning"),
        F.count_if(peak).alias("neighbourhood_peaks"),
        F.count_if((d > 0) & (after < 0)).alias("positive_turning"),
        F.coalesce(F.sum(F.sqrt(1 + d * d)), F.lit(0.0)).alias("signal_distance"),
        F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("sum_abs_diff"),
    )


def _ordered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., xs)``: the values of each window as an array in order of position."""
    sorted_rows = F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("pos", "x"))))
    return rows.groupBy(*keys).agg(sorted_rows.alias("r")).select(*keys, F.transform("r", lambda r: r["x"]).alias("xs"))


def _by_length(xs: pd.Series, work: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What ``work`` makes of the rows of equal length, each length as one matrix; an empty array for an empty row."""
    sizes, out = xs.map(len).to_numpy(), [np.empty(0)] * len(xs)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        found = work(np.stack([np.asarray(xs.iat[i], dtype=np.float64) for i in at]))
        for i, row in zip(at, found, strict=True):
            out[i] = row
    return out


def _autocorrelation(x: np.ndarray) -> np.ndarray:
    """For each row the first lag whose autocorrelation is below 1/e, lag by lag for the rows that have none yet."""
    n = x.shape[1]
    c = x - x.mean(axis=1, keepdims=True)
    limit, out = (c * c).sum(axis=1) / math.e, np.full(len(x), n)
    open_ = np.arange(len(x))
    for lag in range(1, n):
        found = (c[open_, : n - lag] * c[open_, lag:]).sum(axis=1) < limit[open_]
        out[open_[found]] = lag
        open_ = open_[~found]
        if not len(open_):
            break
    return out[:, None]


@F.pandas_udf(LongType())
def _first_lags(xs: pd.Series) -> pd.Series:
    return pd.Series([int(v[0]) if len(v) else 0 for v in _by_length(xs, _autocorrelation)])


def autocorrelation(rows: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """``autocorrelation``: the first lag whose autocorrelation is below 1/e, the window's length if there is none. Missing values are left out."""
    return _ordered(rows, keys).select(*keys, _first_lags("xs").alias("autocorrelation"))


def _lines(x: np.ndarray) -> np.ndarray:
    """Magnitudes of the real Fourier transform of each row."""
    return np.abs(np.fft.rfft(x, axis=1))


@F.pandas_udf(ArrayType(DoubleType()))
def _magnitudes(xs: pd.Series) -> pd.Series:
    return pd.Series(_by_length(xs, _lines))


def spectrum(rows: DataFrame, rate: float, keys: Sequence[str] = GROUP) -> DataFrame:
    """``(keys..., k, frequency, magnitude, power)`` of the real Fourier transform, k from 0 to half the length. Missing values are left out."""
    lines = _ordered(rows, keys).select(*keys, F.size("xs").alias("n"), F.posexplode(_magnitudes("xs")).alias("k", "magnitude"))
    return lines.select(*keys, "k", (F.col("k") * rate / F.col("n")).alias("frequency"), "magnitude", (F.col("magnitude") * F.col("magnitude")).alias("power"))


def _spectral(x: np.ndarray, rate: float, share: float) -> np.ndarray:
    """The eight features of each row, in the order of SPECTRAL; equal magnitudes are told apart from the twelfth digit of the largest one on only."""
    n = x.shape[1]
    f = np.arange(n // 2 + 1) * rate / n
    none = np.zeros(len(x))

    def steady(m: np.ndarray) -> np.ndarray:
        top = m.max(axis=1, keepdims=True)
        return np.where(top > 0, np.round(m / np.where(top > 0, top, 1), 12), 0) * top

    centred = x - x.mean(axis=1, keepdims=True)
    m = steady(_lines(centred))
    peak = np.zeros(m.shape, dtype=bool)
    peak[:, 1:] = (m[:, 1:] > m[:, :-1]) & (m[:, 1:] > np.column_stack((m[:, 2:], none - 1))) & (m[:, 1:] >= share * m.max(axis=1, keepdims=True))
    fundamental = np.where(peak.any(axis=1), f[peak.argmax(axis=1)], 0)

    std = np.sqrt((centred * centred).mean(axis=1, keepdims=True))
    hann = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)
    power = _lines(np.where(std > 0, centred / np.where(std > 0, std, 1), 0) * hann) ** 2
    sides = np.where((np.arange(n // 2 + 1) == 0) | (np.arange(n // 2 + 1) * 2 == n), 1, 2)
    max_power = (power * sides / (rate * 0.375 * n)).max(axis=1)  # the squares of a Hann window of n points sum to 3/8 n

    m = _lines(x)
    total, running = m.sum(axis=1), m.cumsum(axis=1)
    some = np.where(total > 0, total, 1)
    at = [np.where(total > 0, f[(running >= s * total[:, None] * (1 - 1e-12)).argmax(axis=1)], 0) for s in (0.95, 0.5)]
    centroid = (f * m).sum(axis=1) / some
    spread = np.sqrt(((f - centroid[:, None]) ** 2 * m).sum(axis=1) / some)
    power = m * m
    p = power / np.where(total > 0, power.sum(axis=1), 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1) / np.log2(len(f)) if len(f) > 1 else none
    return np.column_stack((fundamental, max_power, at[0], at[1], centroid, entropy, at[0], spread))


def spectral(rows: DataFrame, rate: float, keys: Sequence[str] = GROUP, share: float = 0.3) -> DataFrame:
    """Eight features of the spectrum of each window, in one pass over its values.

    ``fundamental_frequency`` is the lowest peak above 0 of the centred spectrum that reaches ``share`` of its maximum, else 0; ``max_power`` the largest one-sided power
    density of the standardised signal under one Hann window; then the frequencies at 95 % and at half of the summed magnitude, centroid, entropy,
    roll-off (95 %) and spread. Missing values are left out; a window without values has nulls, one of zeros has zeros.
    """
    schema = ", ".join(f"{name} double" for name in SPECTRAL)

    @F.pandas_udf(schema)
    def features(xs: pd.Series) -> pd.DataFrame:
        found = _by_length(xs, partial(_spectral, rate=rate, share=share))
        return pd.DataFrame([v if len(v) else [None] * len(SPECTRAL) for v in found], columns=list(SPECTRAL), dtype="float64")

    return _ordered(rows, keys).select(*keys, features("xs").alias("f")).select(*keys, "f.*")
