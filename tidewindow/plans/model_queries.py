"""Queries that put frames, signals, windows, features, fusion and decoding together over poses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import augmentation as au
from tidewindow.operators import decode as dc
from tidewindow.operators import features as ft
from tidewindow.operators import frames as fr
from tidewindow.operators import windows as wn
from tidewindow.plans import inference as inf
from tidewindow.plans.base import SIZE, STRIDE, TYPES, framed_sql, poses, query, round_sql, rounded, windows_sql
from tidewindow.plans.decision_queries import filled_sql, viterbi_sql
from tidewindow.plans.frame_queries import COMPACT_NAMES, NORMAL, SET_B_NAMES, compact_sql, signals_sql, streams_sql
from tidewindow.plans.window_queries import majority_sql, statistical_sql, summaries_sql, temporal_sql
from tidewindow.schema import COORDS, JOINTS

#: Labels of poses: runs of eight frames of three of the types.
POSE_TYPES = TYPES[:3]
_LIST = "[" + ", ".join(f"'{t}'" for t in POSE_TYPES) + "]"
_LABEL = f"{_LIST}[(pos // 8) % 3 + 1]"
RATE = 30.0
_BY = "subject_id, start_pos, signal"


def labelled_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses with a label for each frame."""
    return poses(spark, sf_dir).withColumn("label", F.get(F.array(*map(F.lit, POSE_TYPES)), ((F.floor(F.col("pos") / 8)) % 3).cast("int")))


def _long_sql(source: str, columns, out: str = "lg") -> str:
    return f"{out} AS (SELECT subject_id, start_pos, pos, signal, x FROM (UNPIVOT (SELECT subject_id, start_pos, pos, {', '.join(columns)} FROM {source}) ON {', '.join(columns)} INTO NAME signal VALUE x))"


@query("x7_compact_windows", f"WITH {compact_sql()}, {windows_sql(SIZE, STRIDE, True, 'win', 'c2')}, {framed_sql('win', 'c2')}, {_long_sql('fr', COMPACT_NAMES)}, {summaries_sql()} SELECT {_BY}, {round_sql(ft.SUMMARIES, 3)} FROM s")
def compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine numbers of each of the 122 compact signals in each window, at a short window's own length."""
    rows, names = inf.compact_windows(poses(spark, sf_dir), SIZE, STRIDE)
    return rounded(ft.summary_rows(ft.window_summaries(rows, names), names), ft.SUMMARIES, 3)


_TEMPORAL = tuple(c for c in ft.TEMPORAL if c != "autocorrelation")
_COUNTED = ("zero_crossings", "negative_turning", "neighbourhood_peaks", "positive_turning")
_ROUNDED = tuple(c for c in _TEMPORAL if c not in _COUNTED and c != "slope")
_STATISTICAL = tuple(c for c in ft.STATISTICAL)


@query(
    "x6_experiment_windows",
    f"""WITH {signals_sql()}, lb AS (SELECT *, {_LABEL} AS event_type FROM s5), {windows_sql(SIZE, STRIDE, False, 'win', 'lb')}, {framed_sql('win', 'lb')}, {majority_sql('fr', 0.6)},
kp AS (SELECT fr.* FROM fr JOIN mj USING (subject_id, start_pos) WHERE label IS NOT NULL), {_long_sql('kp', SET_B_NAMES)}, {statistical_sql('lg', 'sa')}, {temporal_sql('lg', RATE, 3, 'te')}
SELECT {_BY}, label, {round_sql(_STATISTICAL, 3)}, {round_sql(_ROUNDED, 3)}, round(te.slope, 3) + 0.0 AS slope, {", ".join(_COUNTED)} FROM sa JOIN te USING ({_BY}) JOIN mj USING (subject_id, start_pos)""",
)
def experiment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 statistical and temporal features of set B's 70 signals in windows with a label, the label with them; :func:`~tidewindow.operators.features.autocorrelation` is apart."""
    rows, names = inf.experiment_windows(labelled_poses(spark, sf_dir), "B", SIZE, STRIDE, 0.6, POSE_TYPES)
    long = ft.long_form(rows, names)
    labels = rows.groupBy(*wn.KEYS).agg(F.first("label").alias("label"))
    out = ft.statistical(long).join(ft.temporal(long, RATE, neighbours=3), list(ft.GROUP)).join(labels, list(wn.KEYS))
    return rounded(out, (*_STATISTICAL, *_ROUNDED, "slope"), 3)


_ARRAYS = ("coordinates", "bones", "velocity")


@query(
    "x8_stream_windows",
    f"""WITH {streams_sql()}, {windows_sql(SIZE, STRIDE, True, 'win', 'sv')}, {framed_sql('win', 'sv')}
SELECT subject_id, start_pos, end_pos, count(*) AS n, {", ".join(f"round(sum(list_sum(list_transform({c}, lambda v: abs(v))) * (pos - start_pos + 1)), 4) AS {c}" for c in _ARRAYS)} FROM fr GROUP BY subject_id, start_pos, end_pos""",
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three streams as arrays of frames, told by sums weighted with the frame's place."""
    rows = inf.stream_windows(poses(spark, sf_dir), SIZE, STRIDE)
    place = lambda a: F.transform(a, lambda v, i: x.array_sum(F.transform(v, F.abs)) * (i + 1))
    n = F.size("coordinates").cast("long")
    return rows.select("subject_id", "start_pos", (F.col("start_pos") + n).alias("end_pos"), n.alias("n"), *(F.round(x.array_sum(place(F.col(c))), 4).alias(c) for c in _ARRAYS))


#: A window's first velocity is 0 here, as nothing before the window is seen.
_INSIDE = "list_sum(list_transform(velocity, lambda v: abs(v))) * (pos - start_pos + 1) * CAST(pos > start_pos AS INTEGER)"


@query(
    "n20_tensor_streams",
    f"""WITH {streams_sql()}, {windows_sql(SIZE, STRIDE, True, 'win', 'sv')}, {framed_sql('win', 'sv')}
SELECT subject_id, start_pos, count(*) AS n, {", ".join(f"round(sum(list_sum(list_transform({c}, lambda v: abs(v))) * (pos - start_pos + 1)), 4) AS {c}" for c in _ARRAYS[:2])}, round(sum({_INSIDE}), 4) AS velocity FROM fr GROUP BY subject_id, start_pos, end_pos""",
)
def tensor_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams worked out of whole windows' coordinates, many windows at once, told by sums weighted with the frame's place."""
    rows = inf.tensor_windows(poses(spark, sf_dir), SIZE, STRIDE)
    place = lambda a: F.transform(a, lambda v, i: x.array_sum(F.transform(v, F.abs)) * (i + 1))
    return rows.select("subject_id", "start_pos", F.size("coordinates").cast("long").alias("n"), *(F.round(x.array_sum(place(F.col(c))), 4).alias(c) for c in _ARRAYS))


_SEED = 11
_NOISE, _DROPOUT = 0.05, 0.2


def _drawn(k: int, *names: str) -> str:
    """The k-th number that a hash of the seed, a window and names gives."""
    told = f"sha256(concat_ws(':', '{_SEED}', subject_id, start_pos, {', '.join(names)}))"
    return f"((CAST('0x' || substr({told}, {1 + 13 * k}, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


_FAR = f"sqrt(-2 * ln({_drawn(0, chr(39) + 'noise' + chr(39), 'joint', 'i')}))"
_AROUND = f"2 * pi() * {_drawn(1, chr(39) + 'noise' + chr(39), 'joint', 'i')}"
_KEPT = f"CASE WHEN {_drawn(0, chr(39) + 'dropout' + chr(39), 'joint')} < {_DROPOUT} THEN 0 ELSE 1 END"


@query(
    "l13_crop_dropout_noise",
    f"""WITH {NORMAL}, {windows_sql(SIZE, STRIDE, False, 'win', 'np')}, {framed_sql('win', 'np')},
wl AS (SELECT subject_id, start_pos, count(*) AS n, list([{", ".join(COORDS)}] ORDER BY pos) AS f FROM fr GROUP BY subject_id, start_pos),
cr AS (SELECT *, least(n, greatest(2, CAST(round_even(n * (0.9::DOUBLE + (1.0::DOUBLE - 0.9::DOUBLE) * {_drawn(0, "'crop'")}), 0) AS BIGINT))) AS size FROM wl),
cs AS (SELECT *, CAST(floor({_drawn(1, "'crop'")} * (n - size + 1)) AS BIGINT) AS first FROM cr),
ci AS (SELECT *, unnest(range(n)) AS i FROM cs), cp AS (SELECT *, greatest((i + 0.5::DOUBLE) * size / n - 0.5::DOUBLE, 0) AS place FROM ci),
cl AS (SELECT *, CAST(floor(place) AS BIGINT) AS low FROM cp), cf AS (SELECT subject_id, start_pos, i, f[first + low + 1] AS a, f[first + least(low + 1, size - 1) + 1] AS b, place - low AS w FROM cl),
cj AS (SELECT subject_id, start_pos, i, a, b, w, unnest([{", ".join(f"'{j}'" for j in JOINTS)}]) AS joint, unnest(range({len(JOINTS)})) AS j FROM cf)
SELECT subject_id, start_pos, i AS frame, joint, round((a[2 * j + 1] * (1 - w) + b[2 * j + 1] * w) * {_KEPT} + {_FAR} * cos({_AROUND}) * {_NOISE}, 6) + 0.0 AS x,
  round((a[2 * j + 2] * (1 - w) + b[2 * j + 2] * w) * {_KEPT} + {_FAR} * sin({_AROUND}) * {_NOISE}, 6) + 0.0 AS y FROM cj""",
)
def disturbed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of poses cropped and drawn out, with joints left out and noise, all of which follow from a seed and the window."""
    clean = fr.normalise_pose(fr.prepare(poses(spark, sf_dir))).select("subject_id", "pos", F.array(*COORDS).alias("c"))
    framed = wn.frames_in_windows(clean, SIZE, STRIDE)
    own = framed.groupBy(*wn.KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("f")).select(*wn.KEYS, F.col("f.c").alias("f"))  # a window's frames
    own = own.withColumn("f", au.cropped(F.col("f"), _SEED, wn.KEYS))
    own = own.select(*wn.KEYS, F.posexplode(au.disturbed(F.col("f"), _SEED, wn.KEYS, _DROPOUT, _NOISE)).alias("frame", "v"))
    joints = F.inline(F.array(*(F.struct(F.lit(j).alias("joint"), F.get("v", 2 * k).alias("x"), F.get("v", 2 * k + 1).alias("y")) for k, j in enumerate(JOINTS))))
    return rounded(own.select(*wn.KEYS, F.col("frame").cast("long").alias("frame"), joints), ["x", "y"], 6)


_FEATURES = {f"{c}__{k}": f"{f}({c})" for k, f in (("mean", "avg"), ("std", "stddev_pop")) for c in COORDS}
_MEASURED = ", ".join(f"{f} AS {k}" for k, f in _FEATURES.items())
_APART = " + ".join(f"(u.{k} - m.{k}) * (u.{k} - m.{k})" for k in _FEATURES)


@query(
    "l15_predicted_frames",
    f"""WITH RECURSIVE {NORMAL}, ev AS (SELECT *, {_LABEL} AS event_type FROM np), {windows_sql(SIZE, STRIDE, False, 'tw')}, {framed_sql('tw', 'ev', 'tf')}, {majority_sql('tf', 0.6)},
tm AS (SELECT subject_id, start_pos, {_MEASURED} FROM tf GROUP BY subject_id, start_pos), cm AS (SELECT label, {", ".join(f"avg({k}) AS {k}" for k in _FEATURES)} FROM tm JOIN mj USING (subject_id, start_pos) WHERE label IS NOT NULL GROUP BY label),
{windows_sql(SIZE, SIZE, True, 'uw')}, {framed_sql('uw', 'ev', 'uf')}, um AS (SELECT subject_id, start_pos, end_pos, {_MEASURED} FROM uf GROUP BY subject_id, start_pos, end_pos),
ds AS (SELECT subject_id, start_pos, end_pos, label, exp(-({_APART}) / {len(_FEATURES)}) AS w FROM um u CROSS JOIN cm m),
wp AS (SELECT subject_id, start_pos, end_pos, {", ".join(f"max(w) FILTER (label = '{t}') / sum(w) AS p{i}" for i, t in enumerate(POSE_TYPES))} FROM ds GROUP BY subject_id, start_pos, end_pos),
{filled_sql(POSE_TYPES)}, e1 AS (SELECT subject_id, pos, probs, 1.0::DOUBLE AS strength FROM fl), {viterbi_sql('e1', '', POSE_TYPES)}
SELECT subject_id, pos, {_LIST}[cls] AS label, round(e.probs[cls], 8) AS confidence, coverage FROM vp JOIN em e USING (subject_id, strength, pos) JOIN fl USING (subject_id, pos)""",
)
def predicted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From poses to a label for each frame: windows with labels train class means, windows without a look at them are scored, fused and decoded."""
    rows = labelled_poses(spark, sf_dir)
    train, used = inf.training_windows(rows, "A", SIZE, STRIDE, 0.6, POSE_TYPES, ("mean", "std"))
    model = inf.learning.class_means(train, used, POSE_TYPES)
    initial, moves = dc.transition_model(rows, POSE_TYPES)
    first, step = {r["class"]: r["p"] for r in initial.collect()}, {(r["before"], r["class"]): r["p"] for r in moves.collect()}  # classes squared numbers
    transition = np.array([[step[a, b] for b in POSE_TYPES] for a in POSE_TYPES])
    out = inf.predict_frames(model, rows, transition, np.array([first[t] for t in POSE_TYPES]), "A", SIZE, SIZE, 1.0, POSE_TYPES, ("mean", "std"))
    return rounded(out, ["confidence"])
