"""Queries of windows, their labels and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.operators import features as ft
from tidewindow.operators import windows as wn
from tidewindow.plans.base import EV, SIZE, STRIDE, WIN, frames, framed_sql, query, round_sql, rounded, windows_sql
from tidewindow.storage import new_folder
from tidewindow.streaming.windows import replayed

CLASSES = ("click", "error", "purchase", "view")
RATE = 4.0
_NAMES = ", ".join(f"'{c}'" for c in CLASSES)


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of 8 by 4, the tail covered."""
    return wn.frames_in_windows(frames(spark, sf_dir), SIZE, STRIDE, cover_tail=True)


def cents(df: DataFrame) -> DataFrame:
    """The value as whole cents, so that sums are exact."""
    return df.withColumn("c", F.round(F.col("value") * 100).cast("long"))


def majority_sql(source: str, threshold: float, out: str = "mj") -> str:
    """``out(subject_id, start_pos, label, share)``."""
    return f"""{out}_c AS (SELECT subject_id, start_pos, event_type, count(*) AS n, min(pos) AS f FROM {source} GROUP BY ALL),
{out} AS (SELECT subject_id, start_pos, CASE WHEN best / total >= {threshold} THEN name END AS label, best / total AS share FROM (
  SELECT subject_id, start_pos, CAST(sum(n) AS DOUBLE) AS total, CAST((max(n) FILTER (event_type IN ({_NAMES}))) AS DOUBLE) AS best,
    arg_min(event_type, (-n, f)) FILTER (event_type IN ({_NAMES})) AS name FROM {out}_c GROUP BY subject_id, start_pos))"""


@query(
    "x_window_summary",
    f"""{WIN}, {majority_sql("fr", 0.5)}, s AS (SELECT subject_id, start_pos, max(end_pos) AS end_pos, min(event_id) AS least_id, arg_min(event_id, pos) AS frame_start, arg_max(event_id, pos) AS frame_end,
  count(*) AS n, CAST(sum(c) AS BIGINT) AS sx, CAST(sum(c * c) AS BIGINT) AS sxx, CAST(sum(c * pos) AS BIGINT) AS sxp, CAST(sum(pos) AS BIGINT) AS sp, CAST(sum(pos * pos) AS BIGINT) AS spp, min(c) AS least, max(c) AS greatest
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM fr) GROUP BY subject_id, start_pos)
SELECT subject_id, start_pos, end_pos, frame_start, frame_end, CAST(sx AS DOUBLE) / n AS mean, CAST(sxx AS DOUBLE) / n AS energy,
  CASE WHEN n * spp - sp * sp = 0 THEN 0.0 ELSE CAST(n * sxp - sx * sp AS DOUBLE) / (n * spp - sp * sp) END AS slope, greatest - least AS spread, label FROM s JOIN mj USING (subject_id, start_pos)""",
)
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: windows with the tail covered, their places, exact moments and majority label."""
    rows = cents(framed(spark, sf_dir))
    p, c = F.col("pos"), F.col("c")
    # by label first: the same rows give the labels' counts, and the windows' sums from theirs
    parts = rows.groupBy("subject_id", "start_pos", F.col("event_type").alias("label")).agg(
        F.min(F.struct("pos", "event_id")).alias("head"),
        F.max(F.struct("pos", "event_id")).alias("tail"),
        F.count("*").alias("n"),
        F.sum(c).alias("sx"),
        F.sum(c * c).alias("sxx"),
        F.sum(c * p).alias("sxp"),
        F.sum(p).alias("sp"),
        F.sum(p * p).alias("spp"),
        F.min(c).alias("least"),
        F.max(c).alias("most"),
    )
    valid = F.when(F.col("label").isin(*CLASSES), F.struct("n", (-F.col("head.pos")).alias("early"), "label"))
    own = parts.groupBy("subject_id", "start_pos").agg(
        (F.max("tail.pos") + 1).alias("end_pos"),
        F.min("head").alias("head"),
        F.max("tail").alias("tail"),
        *(F.sum(k).alias(k) for k in ("n", "sx", "sxx", "sxp", "sp", "spp")),
        (F.max("most") - F.min("least")).alias("spread"),
        F.max(valid).alias("best"),
    )
    n, spread_p = F.col("n"), F.col("n") * F.col("spp") - F.col("sp") * F.col("sp")
    own = own.select(
        "subject_id",
        "start_pos",
        "end_pos",
        F.col("head.event_id").alias("frame_start"),
        F.col("tail.event_id").alias("frame_end"),
        (F.col("sx").cast("double") / n).alias("mean"),
        (F.col("sxx").cast("double") / n).alias("energy"),
        F.when(spread_p == 0, 0.0).otherwise((n * F.col("sxp") - F.col("sx") * F.col("sp")).cast("double") / spread_p).alias("slope"),
        "spread",
        F.when(F.col("best.n") / n >= 0.5, F.col("best.label")).alias("label"),
    )
    return own


@query(
    "x1_window_starts",
    f"WITH {EV}, {windows_sql(16, 8, True, 'a')}, {windows_sql(10, 3, False, 'b')}, {windows_sql(200, 75, True, 'c')} SELECT 16 AS size, * FROM a UNION ALL SELECT 10, * FROM b UNION ALL SELECT 200, * FROM c",
)
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows on a grid, with and without their tails, and longer than the subject."""
    e = frames(spark, sf_dir)
    each = [wn.window_table(e, s, t, tail).withColumn("size", F.lit(s)) for s, t, tail in ((16, 8, True), (10, 3, False), (200, 75, True))]
    return wn.concatenated(each)


@query(
    "x2_padded_windows",
    f"""WITH {EV}, {windows_sql(60, 30, True)}, {framed_sql()}, t AS (SELECT subject_id, start_pos, list(CAST(round(value * 100) AS BIGINT) ORDER BY pos) AS v FROM fr GROUP BY subject_id, start_pos)
SELECT subject_id, start_pos, len(v) AS own, CAST(list_sum(v) + greatest(60 - len(v), 0) * v[-1] AS BIGINT) AS total, greatest(len(v), 60) AS size FROM t""",
)
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as arrays, repeated at the last value up to their size."""
    rows = wn.tensor_windows(cents(wn.frames_in_windows(frames(spark, sf_dir), 60, 30, True)), "c").withColumn("full", wn.padded(F.col("values"), 60))
    total = F.aggregate("full", F.lit(0).cast("long"), lambda acc, v: acc + v)
    return rows.select("subject_id", "start_pos", F.size("values").cast("long").alias("own"), total.alias("total"), F.size("full").cast("long").alias("size"))


@query("x3_window_metadata", f"{WIN} SELECT subject_id, start_pos, end_pos, arg_min(event_id, pos) AS frame_start, arg_max(event_id, pos) AS frame_end FROM fr GROUP BY subject_id, start_pos, end_pos")
def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of windows, and the ids of their first and last frames."""
    return wn.window_metadata(framed(spark, sf_dir), "event_id")


@query("a1_majority_label", f"{WIN}, {majority_sql('fr', 0.375)} SELECT subject_id, start_pos, label, share FROM mj")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority labels at a threshold that ties can reach; one type is no class."""
    return wn.majority_labels(framed(spark, sf_dir), CLASSES, 0.375, "event_type")


@query(
    "x4_labelled_windows",
    f"""WITH {EV}, {windows_sql(SIZE, STRIDE, False)}, {framed_sql()}, {majority_sql("fr", 0.5)}
SELECT subject_id, start_pos, label, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM fr JOIN mj USING (subject_id, start_pos) WHERE label IS NOT NULL GROUP BY subject_id, start_pos, label""",
)
def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the windows that have a label; the others are dropped first."""
    rows = wn.labelled_windows(cents(frames(spark, sf_dir)).withColumnRenamed("event_type", "label"), CLASSES, SIZE, STRIDE, 0.5)
    return rows.groupBy(*wn.KEYS, "label").agg(F.sum("c").alias("total"), F.count("*").alias("n"))


@query("x5_unlabelled_windows", f"{WIN} SELECT subject_id, start_pos, CAST(NULL AS VARCHAR) AS label, count(*) AS n FROM fr GROUP BY subject_id, start_pos")
def unlabelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows made without labels, the tail covered."""
    rows = wn.unlabelled_windows(frames(spark, sf_dir).withColumnRenamed("event_type", "label"), SIZE, STRIDE)
    return rows.groupBy(*wn.KEYS, "label").agg(F.count("*").alias("n"))


@query("x10_non_overlapping", f"WITH {EV}, {windows_sql(SIZE, STRIDE, True)} SELECT * FROM win WHERE start_pos % 8 = 0")
def non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that start at a multiple of their size."""
    return wn.non_overlapping(wn.window_table(frames(spark, sf_dir), SIZE, STRIDE, True), SIZE)


@query(
    "x11_subsampled_windows",
    f"""WITH {EV}, {windows_sql(SIZE, STRIDE, True)}, m AS (SELECT subject_id, max(end_pos - start_pos) AS longest, max(n) AS n FROM win JOIN win_n USING (subject_id) GROUP BY subject_id)
SELECT w.* FROM win w JOIN m USING (subject_id) WHERE start_pos % 16 = 0 OR start_pos = greatest(0, n - longest)""",
)
def subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth window and each subject's last."""
    e = frames(spark, sf_dir)
    n = e.groupBy("subject_id").agg(F.count("*").alias("n"))
    out = wn.subsampled(wn.window_table(e, SIZE, STRIDE, True).join(n, "subject_id"), 16, F.col("n"))
    return out.select("subject_id", "start_pos", "end_pos")


@query("x12_label_afterwards", f"{WIN}, {majority_sql('fr', 0.5)} SELECT subject_id, start_pos, end_pos, label FROM win JOIN mj USING (subject_id, start_pos) WHERE label IS NOT NULL")
def label_afterwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to windows that were made without them."""
    e = frames(spark, sf_dir).withColumnRenamed("event_type", "label")
    return wn.label_afterwards(wn.window_table(e, SIZE, STRIDE, True), e, CLASSES, 0.5)


@query(
    "x13_x14_window_grid",
    "WITH " + EV + ", " + ", ".join(windows_sql(w, s, True, f"g{w}_{s}") for w in (8, 16) for s in (4, 8)) + " "
    + " UNION ALL ".join(f"SELECT {w} AS window_size, {s} AS stride, count(*) AS n, CAST(sum(end_pos - start_pos) AS BIGINT) AS frames FROM g{w}_{s}" for w in (8, 16) for s in (4, 8)),
)
def window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all sizes and strides, counted."""
    grid = wn.window_grid(frames(spark, sf_dir), (8, 16), (4, 8))
    return grid.groupBy("window_size", "stride").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("frames"))


@query(
    "st_row_count_windows",
    f"""WITH {EV}, {windows_sql(SIZE, STRIDE, False)}, {framed_sql()} SELECT subject_id, start_pos, end_pos, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean, CAST(min(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS least, CAST(max(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS greatest FROM fr GROUP BY subject_id, start_pos, end_pos""",
)
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete windows by a stream with keyed state."""
    e = cents(frames(spark, sf_dir)).select("subject_id", "pos", F.col("c").cast("double").alias("x"))
    return replayed(e, SIZE, STRIDE, new_folder(spark, "stream"))


# -- features ---------------------------------------------------------------------------------------------------------

_LONG = f"""{WIN}, lg AS (SELECT subject_id, start_pos, pos, 'value' AS signal, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS x FROM fr
  UNION ALL SELECT subject_id, start_pos, pos, 'k', TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM fr)"""
_BY = "subject_id, start_pos, signal"


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals of events in windows, in long form."""
    rows = cents(framed(spark, sf_dir)).select(*wn.KEYS, "pos", F.col("c").alias("value"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return ft.long_form(rows, ["value", "k"])


def summaries_sql(source: str = "lg", out: str = "s") -> str:
    """``out``: nine numbers of each window and signal."""
    return f"""{out} AS (SELECT {_BY}, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, max(x) - min(x) AS range,
  coalesce(regr_slope(x, CAST(pos AS DOUBLE)), 0) AS slope, avg(x * x) AS energy, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.9) AS q90 FROM {source} GROUP BY {_BY})"""


@query(
    "a5_window_summaries",
    f"""{_LONG}, {summaries_sql()}
SELECT {_BY}, {round_sql(ft.SUMMARIES, 6)} FROM s""",
)
def window_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine numbers of each signal and window."""
    return rounded(ft.summaries(long_rows(spark, sf_dir)), ft.SUMMARIES, 6)


def statistical_sql(source: str = "lg", out: str = "s") -> str:
    """``out``: twelve statistics of each window and signal."""
    return f"""{out}_m AS (SELECT *, avg(x) OVER w AS mu, quantile_cont(x, 0.5) OVER w AS md FROM {source} WINDOW w AS (PARTITION BY {_BY})),
{out} AS (SELECT {_BY}, sum(x * x) AS abs_energy, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, max(x) AS max, avg(x) AS mean, quantile_cont(x, 0.5) AS median, min(x) AS min, max(x) - min(x) AS peak_to_peak,
  sqrt(avg(x * x)) AS rms, stddev_pop(x) AS std, var_pop(x) AS var, avg(abs(x - mu)) AS mean_abs_deviation, quantile_cont(abs(x - md), 0.5) AS median_abs_deviation FROM {out}_m GROUP BY {_BY})"""


@query(
    "f1_f12_statistical_features",
    f"""{_LONG}, {statistical_sql()}
SELECT {_BY}, {round_sql(ft.STATISTICAL, 6)} FROM s""",
)
def statistical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve statistical features."""
    return rounded(ft.statistical(long_rows(spark, sf_dir)), ft.STATISTICAL, 6)


_TEMPORAL_DOUBLES = ("auc", "mean_abs_diff", "slope", "median_abs_diff", "signal_distance", "sum_abs_diff")


def temporal_sql(source: str = "lg", rate: float = RATE, neighbours: int = 3, out: str = "s") -> str:
    """``out``: ten temporal features of each window and signal."""
    return f"""{out}_a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY {_BY}) AS n, x - lag(x) OVER w AS d, abs(x + lag(x) OVER w) / 2 / {rate} AS area, sign(x) <> sign(lag(x) OVER w) AS sg,
  max(x) OVER (PARTITION BY {_BY} ORDER BY pos ROWS BETWEEN {neighbours} PRECEDING AND 1 PRECEDING) AS l, max(x) OVER (PARTITION BY {_BY} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {neighbours} FOLLOWING) AS r FROM {source} WINDOW w AS (PARTITION BY {_BY} ORDER BY pos)),
{out}_b AS (SELECT *, lead(d) OVER (PARTITION BY {_BY} ORDER BY pos) AS e FROM {out}_a),
{out} AS (SELECT {_BY}, coalesce(sum(area), 0) AS auc, avg(abs(d)) AS mean_abs_diff, coalesce(regr_slope(x, CAST(i AS DOUBLE)), 0) AS slope, count(*) FILTER (sg) AS zero_crossings, quantile_cont(abs(d), 0.5) AS median_abs_diff,
  count(*) FILTER (d < 0 AND e > 0) AS negative_turning, count(*) FILTER (x > l AND x > r AND i > {neighbours} AND i <= n - {neighbours}) AS neighbourhood_peaks, count(*) FILTER (d > 0 AND e < 0) AS positive_turning,
  coalesce(sum(sqrt(1 + d * d)), 0) AS signal_distance, coalesce(sum(abs(d)), 0) AS sum_abs_diff FROM {out}_b GROUP BY {_BY})"""


@query(
    "f13_f23_temporal_features",
    f"""WITH {EV}, {windows_sql(16, 8, True)}, {framed_sql()}, lg AS (SELECT subject_id, start_pos, pos, 'value' AS signal, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS x FROM fr
  UNION ALL SELECT subject_id, start_pos, pos, 'k', TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM fr), {temporal_sql()}
SELECT {_BY}, zero_crossings, negative_turning, neighbourhood_peaks, positive_turning, {round_sql(_TEMPORAL_DOUBLES, 5)} FROM s""",
)
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten temporal features of two signals in windows of 16, peaks among three neighbours a side."""
    rows = cents(wn.frames_in_windows(frames(spark, sf_dir), 16, 8, True))
    rows = rows.select(*wn.KEYS, "pos", F.col("c").alias("value"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    out = ft.temporal(ft.long_form(rows, ["value", "k"]), RATE, neighbours=3)
    return rounded(out, _TEMPORAL_DOUBLES, 5)


@query(
    "f14_autocorrelation",
    f"""{_LONG}, c AS (SELECT {_BY}, x - avg(x) OVER (PARTITION BY {_BY}) AS x, row_number() OVER (PARTITION BY {_BY} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {_BY}) AS n FROM lg),
r AS (SELECT a.subject_id, a.start_pos, a.signal, b.i - a.i AS lag, sum(a.x * b.x) AS v, max(a.n) AS n FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.start_pos = b.start_pos AND a.signal = b.signal AND b.i >= a.i GROUP BY ALL),
z AS (SELECT {_BY}, v AS v0, n FROM r WHERE lag = 0)
SELECT z.subject_id, z.start_pos, z.signal, CAST(coalesce(min(r.lag) FILTER (r.lag > 0 AND r.v < v0 / exp(1)), max(z.n)) AS BIGINT) AS autocorrelation FROM z JOIN r USING ({_BY}) GROUP BY z.subject_id, z.start_pos, z.signal""",
)
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lag whose autocorrelation is below 1/e."""
    return ft.autocorrelation(long_rows(spark, sf_dir))


def _dft_sql(centred: bool, hann: bool = False) -> str:
    x = "x - avg(x) OVER p" if centred or hann else "x"
    weight = " * CASE WHEN sd > 0 THEN (0.5 - 0.5 * cos(2 * pi() * i / n)) / sd ELSE 0 END" if hann else ""
    return f"""{_LONG}, c AS (SELECT {_BY}, {x} AS x, row_number() OVER (PARTITION BY {_BY} ORDER BY pos) - 1 AS i, count(*) OVER p AS n, stddev_pop(x) OVER p AS sd FROM lg WINDOW p AS (PARTITION BY {_BY})),
k AS (SELECT {_BY}, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT {_BY}, n FROM c)),
t AS (SELECT c.subject_id, c.start_pos, c.signal, k.k, any_value(n) AS n, sum(x{weight} * cos(2 * pi() * ((k.k * i) % n) / n)) AS re, sum(x{weight} * sin(2 * pi() * ((k.k * i) % n) / n)) AS im FROM c JOIN k USING ({_BY}) GROUP BY c.subject_id, c.start_pos, c.signal, k.k),
sp AS (SELECT {_BY}, k, n, k * {RATE} / n AS frequency, sqrt(re * re + im * im) AS magnitude, re * re + im * im AS power FROM t)"""


@query("f32_spectrum", f"{_dft_sql(False)} SELECT {_BY}, CAST(k AS INTEGER) AS k, frequency, round(magnitude, 4) AS magnitude FROM sp")
def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real Fourier transform of each window."""
    out = ft.spectrum(long_rows(spark, sf_dir), RATE)
    return out.select(*ft.GROUP, "k", "frequency", F.round("magnitude", 4).alias("magnitude"))


_SPECTRAL = ("max_frequency", "median_frequency", "spectral_centroid", "spectral_entropy", "spectral_rolloff", "spectral_spread")


@query(
    "f26_f31_spectral_features",
    f"""{_dft_sql(False)}, q AS (SELECT *, sum(magnitude) OVER (PARTITION BY {_BY} ORDER BY k) AS run, sum(magnitude) OVER p AS tot, sum(power) OVER p AS pw, count(*) OVER p AS nl, CASE WHEN sum(magnitude) OVER p > 0 THEN sum(frequency * magnitude) OVER p / sum(magnitude) OVER p ELSE 0 END AS ce FROM sp WINDOW p AS (PARTITION BY {_BY})),
s AS (SELECT {_BY}, min(frequency) FILTER (run >= 0.95 * tot) AS max_frequency, min(frequency) FILTER (run >= 0.5 * tot) AS median_frequency, max(ce) AS spectral_centroid,
  coalesce(sum(CASE WHEN power > 0 THEN -power / pw * log2(power / pw) END) / log2(max(nl)), 0) AS spectral_entropy, min(frequency) FILTER (run >= 0.95 * tot) AS spectral_rolloff,
  CASE WHEN max(tot) > 0 THEN sqrt(sum((frequency - ce) * (frequency - ce) * magnitude) / max(tot)) ELSE 0 END AS spectral_spread FROM q GROUP BY {_BY})
SELECT {_BY}, {round_sql(_SPECTRAL, 6)} FROM s""",
)
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six features of the spectrum."""
    return rounded(ft.spectral(long_rows(spark, sf_dir), RATE).select(*ft.GROUP, *_SPECTRAL), _SPECTRAL, 6)


@query(
    "f24_fundamental_frequency",
    f"""{_dft_sql(True)}, q AS (SELECT *, lag(magnitude) OVER w AS b, lead(magnitude) OVER w AS a, max(magnitude) OVER (PARTITION BY {_BY}) AS m FROM sp WINDOW w AS (PARTITION BY {_BY} ORDER BY k))
SELECT {_BY}, coalesce(min(frequency) FILTER (k > 0 AND magnitude > b AND magnitude > coalesce(a, -1) AND magnitude >= 0.3 * m), 0) AS fundamental_frequency FROM q GROUP BY {_BY}""",
)
def fundamental_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest high peak of the centred spectrum."""
    return ft.spectral(long_rows(spark, sf_dir), RATE).select(*ft.GROUP, "fundamental_frequency")


@query(
    "f25_max_power_spectrum",
    f"""{_dft_sql(True, True)} SELECT {_BY}, round(max(power * CASE WHEN k = 0 OR k * 2 = n THEN 1 ELSE 2 END / ({RATE} * 0.375 * n)), 6) AS max_power FROM sp GROUP BY {_BY}""",
)
def max_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest power density under a Hann window."""
    return rounded(ft.spectral(long_rows(spark, sf_dir), RATE).select(*ft.GROUP, "max_power"), ["max_power"], 6)


@query(
    "p13_p14_feature_columns",
    f"""{_LONG} SELECT subject_id, start_pos, round(avg(x) FILTER (signal = 'value'), 6) AS value__mean, max(x) FILTER (signal = 'value') - min(x) FILTER (signal = 'value') AS value__range FROM lg GROUP BY subject_id, start_pos""",
)
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as columns, those of one signal by the prefix of their names, in an expected order."""
    wide = ft.wide_form(ft.summaries(long_rows(spark, sf_dir)), ["mean", "range"], ["value", "k"])
    out = wide.select("subject_id", "start_pos", *(c for c in wide.columns if c.startswith("value__")))
    return rounded(out, ["value__mean"], 6)
