"""Queries of cleaning, normalisation and frame-level signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import frames as fr
from tidewindow.operators import signals as sg
from tidewindow.operators.frames import in_order
from tidewindow.plans.base import EV, GAPPY, POSE, TYPES, frames, gappy, poses, query, round_sql, rounded, table
from tidewindow.schema import COORDS, JOINTS

KNOWN = ("click", "error", "view")
ALIASES = {"purchase": "click"}


@query(
    "p1_clean_labels",
    """SELECT event_id, CASE WHEN l IN ('click', 'error', 'view') THEN l ELSE 'None' END AS label
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'click' ELSE event_type END AS l FROM events)""",
)
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with white space at their ends, an alias, and one type that is no class."""
    spaced = F.concat(F.lit(" \t"), "event_type", F.lit("\n"))
    return table(spark, sf_dir, "events").select("event_id", x.clean_label(spaced, KNOWN, ALIASES).alias("label"))


@query(
    "p3_numeric_coercion",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS mixed FROM events""",
)
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from JSON and from text that is not always one."""
    e = table(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", x.number(F.get_json_object("props", "$.k")).alias("k"), x.number(mixed).alias("mixed"))


@query(
    "p4_gap_fill",
    f"""WITH {EV}, g AS (SELECT subject_id, pos, {GAPPY} AS v FROM ev), s AS (SELECT *,
  last_value(v IGNORE NULLS) OVER up AS lo, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER up AS lp,
  first_value(v IGNORE NULLS) OVER dn AS hi, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER dn AS hp FROM g
  WINDOW up AS (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT subject_id, pos, CASE WHEN v IS NOT NULL THEN v WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo + (hi - lo) * (pos - lp) / (hp - lp) ELSE coalesce(lo, hi) END AS v FROM s""",
)
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation by position with ends carried."""
    return fr.fill_gaps(frames(spark, sf_dir).select("subject_id", "pos", gappy().alias("v")), ["v"])


@query(
    "p16_carry_forward_backward",
    f"""WITH {EV}, g AS (SELECT subject_id, pos, CASE WHEN pos % 7 IN (0, 1) THEN NULL WHEN pos % 7 = 3 THEN NULL ELSE value END AS v FROM ev)
SELECT subject_id, pos, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM g""",
)
def carry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, infinite and NaN values carried from the last known one, else the next."""
    k = F.col("pos") % 7
    odd = F.when(k.isin(0, 1), None).when(k == 3, F.lit(float("inf"))).otherwise(F.col("value"))
    return fr.carry(frames(spark, sf_dir).select("subject_id", "pos", odd.alias("v")), ["v"])


def _scaled_sql(source: str, scale: str, out: str = "np") -> str:
    hip = {a: f"(left_hip_{a} + right_hip_{a}) / 2" for a in "xy"}
    cols = ", ".join(f"({c} - {hip[c[-1]]}) / sc AS {c}" for c in COORDS)
    return f"""{out}_s AS (SELECT *, {scale} AS raw FROM {source}), {out}_m AS (SELECT subject_id, median(raw) AS med FROM {out}_s GROUP BY subject_id),
{out} AS (SELECT subject_id, pos, {cols} FROM (SELECT s.*, greatest(coalesce(raw, med, 1.0), 1e-6) AS sc FROM {out}_s s JOIN {out}_m USING (subject_id)))"""


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}_x - {b}_x) * ({a}_x - {b}_x) + ({a}_y - {b}_y) * ({a}_y - {b}_y))"


_MID = {(p, a): f"((left_{p}_{a} + right_{p}_{a}) / 2)" for p in ("shoulder", "hip") for a in "xy"}
_TORSO = "sqrt(" + " + ".join(f"({_MID['shoulder', a]} - {_MID['hip', a]}) * ({_MID['shoulder', a]} - {_MID['hip', a]})" for a in "xy") + ")"
_WIDTH = _dist("left_shoulder", "right_shoulder")
_SCALE = f"CASE WHEN {_WIDTH} > 1e-6 THEN {_WIDTH} ELSE {_TORSO} END"
NORMAL = f"{POSE}, {_scaled_sql('pose', _SCALE)}"


@query("p5_pose_normalize", f"WITH {NORMAL} SELECT subject_id, pos, {round_sql(COORDS)} FROM np")
def pose_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates about the hips in shoulder widths."""
    return rounded(fr.normalise_pose(poses(spark, sf_dir)), COORDS).select("subject_id", "pos", *COORDS)


def _rolling(c: str, half: int) -> str:
    return f"quantile_cont({c}, 0.5) OVER (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


_SMOOTH = f"sm AS (SELECT subject_id, pos, {', '.join(f'{_rolling(c, 2)} AS {c}' for c in COORDS)} FROM pose), sw AS (SELECT *, {_SCALE} AS w FROM sm)"
ROBUST = f"{POSE}, {_SMOOTH}, {_scaled_sql('sw', _rolling('w', 7))}"


@query("p6_robust_pose_normalize", f"WITH {ROBUST} SELECT subject_id, pos, {round_sql(COORDS)} FROM np")
def robust_pose_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of coordinates and scales smoothed by rolling medians."""
    return rounded(fr.normalise_pose_robustly(poses(spark, sf_dir)), COORDS).select("subject_id", "pos", *COORDS)


_TORSO_FIRST = f"CASE WHEN {_TORSO} > 1e-5 THEN {_TORSO} WHEN {_WIDTH} > 1e-5 THEN {_WIDTH} END"
_DELTAS = [f"{c}_delta" for c in COORDS]


@query(
    "p8_torso_first_features",
    f"""WITH {POSE}, {_scaled_sql("pose", _TORSO_FIRST)}, d AS (SELECT *, {", ".join(f"coalesce({c} - lag({c}) OVER (PARTITION BY subject_id ORDER BY pos), 0) AS {c}_delta" for c in COORDS)} FROM np)
SELECT subject_id, pos, {round_sql([*COORDS, *_DELTAS])} FROM d""",
)
def torso_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in torso lengths with their first differences."""
    out, names = fr.normalise_torso_first(poses(spark, sf_dir))
    return rounded(out.select("subject_id", "pos", *names), names)


@query(
    "p9_p10_group_labels",
    """SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'abnormal' ELSE 'normal' END AS grp, count(*) AS n FROM events WHERE event_type IN ('click', 'error', 'purchase', 'view') GROUP BY grp""",
)
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of known classes by their group."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "purchase", "view"))
    return e.groupBy(x.to_group(F.col("event_type"), ["error", "purchase"]).alias("grp")).agg(F.count("*").alias("n"))


@query(
    "p12_label_encoding",
    f"""SELECT event_id, CASE event_type {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES))} END AS class_idx FROM events""",
)
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of a label in a fixed order of classes; an unknown one is an error."""
    at = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type"))
    known = F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit("unknown label")).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", known.cast("int").alias("class_idx"))


@query(
    "p17_feature_family",
    """SELECT p_partkey, CASE WHEN starts_with(p_name, 'part 1') THEN 'ones' WHEN starts_with(p_name, 'part') THEN 'parts' WHEN starts_with(p_name, 'Part') THEN 'Parts' ELSE 'other' END AS family FROM part""",
)
def feature_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of a name by the first prefix that fits."""
    prefixes = [("part 1", "ones"), ("part", "parts"), ("Part", "Parts")]
    return table(spark, sf_dir, "part").select("p_partkey", x.family(F.col("p_name"), prefixes, "other").alias("family"))


# -- signals ----------------------------------------------------------------------------------------------------------


def _angle_sql(a: str, b: str, c: str, guarded: bool = False) -> str:
    dot = f"(({a}_x - {b}_x) * ({c}_x - {b}_x) + ({a}_y - {b}_y) * ({c}_y - {b}_y))"
    size = f"({_dist(a, b)} * {_dist(c, b)})"
    cosine = f"CASE WHEN {size} > 1e-12 THEN {dot} / {size} ELSE 1.0 END" if guarded else f"{dot} / ({size} + 1e-8)"
    return f"degrees(acos(greatest(-1.0, least(1.0, {cosine}))))"


def _d(e: str) -> str:
    return f"({e} - lag({e}) OVER o)"


_GEO = {
    **{k: _dist(*v) for k, v in sg.DISTANCES.items()},
    **{k: _angle_sql(*v) for k, v in sg.ANGLES.items()},
    "angle_shoulder_tilt": "degrees(atan2(right_shoulder_y - left_shoulder_y, right_shoulder_x - left_shoulder_x))",
    "angle_torso": f"degrees(atan2({_MID['shoulder', 'y']} - {_MID['hip', 'y']}, {_MID['shoulder', 'x']} - {_MID['hip', 'x']}))",
    "dist_lw_floor_norm": f"(greatest(left_ankle_y, right_ankle_y) - left_wrist_y) / greatest({_WIDTH}, 1e-6)",
    "dist_rw_floor_norm": f"(greatest(left_ankle_y, right_ankle_y) - right_wrist_y) / greatest({_WIDTH}, 1e-6)",
    "com_x": "(left_hip_x + right_hip_x + left_shoulder_x + right_shoulder_x) / 4",
    "com_y": "(left_hip_y + right_hip_y + left_shoulder_y + right_shoulder_y) / 4",
    "pelvis_y": _MID["hip", "y"],
    "head_vertical": "nose_y",
    "wrist_y_diff": "abs(left_wrist_y - right_wrist_y)",
}


def _speed(p: str) -> str:
    return f"coalesce(sqrt({_d(p + '_x')} * {_d(p + '_x')} + {_d(p + '_y')} * {_d(p + '_y')}), 0)"


_FIRST = {
    **{f"vel_{p}": _speed(p) for p in ("left_wrist", "right_wrist", "left_ankle", "right_ankle", "com")},
    **{f"vel_{k}": f"coalesce(abs({_d(e)}), 0)" for k, e in (("dist_lw_nose", "dist_lw_nose"), ("dist_rw_nose", "dist_rw_nose"), ("head_nod", "nose_y"), ("knee_angle", "((angle_knee_l + angle_knee_r) / 2)"), ("torso_angle", "angle_torso"), ("shoulder_tilt", "angle_shoulder_tilt"))},
    **{f"delta_knee_{s}_y": f"coalesce({_d(f'{w}_knee_y')}, 0)" for s, w in (("l", "left"), ("r", "right"))},
    **{f"d_{c}": _d(c) for c in ("left_wrist_x", "left_wrist_y", "right_wrist_x", "right_wrist_y", "nose_y")},
}
_SECOND = {
    **{f"{s}_wrist_jerk": f"coalesce(abs({_d(f'd_{s}_wrist_x')}) + abs({_d(f'd_{s}_wrist_y')}), 0)" for s in ("left", "right")},
    "jerk_nose_y": f"coalesce(abs({_d('d_nose_y')}), 0)",
    "jerk_com": f"coalesce(abs({_d('vel_com')}), 0)",
    **{f"accel_{s}_wrist": f"coalesce(abs({_d(f'vel_{s}_wrist')}), 0)" for s in ("left", "right")},
}
_TOTAL = "(vel_dist_lw_nose + vel_dist_rw_nose + vel_head_nod + left_wrist_jerk + right_wrist_jerk)"
_BOTH = {
    "duck_proxy": "abs(least(delta_knee_l_y, delta_knee_r_y))",
    "max_frame_jerk_rw": "greatest(left_wrist_jerk, right_wrist_jerk)",
    "min_dist_wrist_head": "least(dist_lw_nose, dist_rw_nose)",
    "total_movement": _TOTAL,
    **{k: f"CAST({e} AS DOUBLE)" for k, e in {
        "hand_near_head": "(least(dist_lw_nose, dist_rw_nose) < 0.10)",
        "micro_bite": "((vel_dist_lw_nose > 0.01 AND vel_dist_lw_nose < 0.05) OR (vel_dist_rw_nose > 0.01 AND vel_dist_rw_nose < 0.05))",
        "strong_bite": "(vel_dist_lw_nose > 0.10 OR vel_dist_rw_nose > 0.10)",
        "knee_flex": "(angle_knee_l < 140 AND angle_knee_r < 140)",
        "knee_extend": "(angle_knee_l > 170 AND angle_knee_r > 170)",
        "elbow_flex": "(least(angle_elbow_l, angle_elbow_r) < 100)",
        "static_wrist": "(vel_left_wrist < 0.005 AND vel_right_wrist < 0.005)",
        "low_motion": f"({_TOTAL} < 0.01)",
        "ground_mask_l": "(dist_lw_floor_norm < 0.15)",
        "ground_mask_r": "(dist_rw_floor_norm < 0.15)",
        "both_on_ground": "(dist_lw_floor_norm < 0.15 AND dist_rw_floor_norm < 0.15)",
    }.items()},
    "ratio_rwjerk_comjerk": "least(right_wrist_jerk / (jerk_com + 1e-4), 1000)",
}
_SYMMETRIC = {
    "dist_wrists": _dist("left_wrist", "right_wrist"),
    "dist_lw_lhip": _dist("left_wrist", "left_hip"),
    "dist_rw_rhip": _dist("right_wrist", "right_hip"),
    "dist_lw_lknee": _dist("left_wrist", "left_knee"),
    "dist_rw_rknee": _dist("right_wrist", "right_knee"),
    "max_dist_wrist_head": "greatest(dist_lw_nose, dist_rw_nose)",
    "wrist_head_distance_diff": "abs(dist_lw_nose - dist_rw_nose)",
    "both_hands_near_head": "CAST((dist_lw_nose < 1.0 AND dist_rw_nose < 1.0) AS DOUBLE)",
    "one_hand_near_head": "CAST((dist_lw_nose < 1.0) <> (dist_rw_nose < 1.0) AS DOUBLE)",
    "wrist_speed_diff": "abs(vel_left_wrist - vel_right_wrist)",
    "wrist_speed_max": "greatest(vel_left_wrist, vel_right_wrist)",
    "wrist_motion_sync": "vel_left_wrist * vel_right_wrist",
    "mean_knee_angle": "(angle_knee_l + angle_knee_r) / 2",
    "knee_angle_asymmetry": "abs(angle_knee_l - angle_knee_r)",
    "torso_height": f"abs({_MID['shoulder', 'y']} - {_MID['hip', 'y']})",
}


def _step(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {source} WINDOW o AS (PARTITION BY subject_id ORDER BY pos))"


def signals_sql(base: str = NORMAL) -> str:
    """``s5``: all signals of a normalised pose."""
    steps = [_step("s1", "np", _GEO), _step("s2", "s1", _FIRST), _step("s3", "s2", _SECOND), _step("s4", "s3", _BOTH), _step("s5", "s4", _SYMMETRIC)]
    return f"{base}, {', '.join(steps)}"


SET_B_NAMES = (*COORDS, *sg.SET_B)


def _signals_sql(base: str, names: list[str] | tuple[str, ...]) -> str:
    return f"WITH {signals_sql(base)} SELECT subject_id, pos, {round_sql(names, 6)} FROM s5"


@query("n1_n14_pose_signals", _signals_sql(NORMAL, sg.POSE_SIGNALS))
def pose_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 61 signals of a normalised pose."""
    out, names = sg.pose_signals(fr.normalise_pose(poses(spark, sf_dir)))
    return rounded(out.select("subject_id", "pos", *names), names, 6)


@query("n15_signal_set_b", _signals_sql(NORMAL, (*COORDS, *sg.SET_B)))
def signal_set_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set B: coordinates and 36 signals."""
    out, names = sg.signal_set(sg.normalised_for(poses(spark, sf_dir), "b"), "b")
    return rounded(out.select("subject_id", "pos", *names), names, 6)


@query("n16_signal_set_c", _signals_sql(ROBUST, (*COORDS, *sg.SET_B, *sg.ADDED_BY_C)))
def signal_set_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set C: 85 signals of a smoothed pose."""
    out, names = sg.signal_set(sg.normalised_for(poses(spark, sf_dir), "C"), "C")
    return rounded(out.select("subject_id", "pos", *names), names, 6)


_COMPACT1 = {
    **{f"{k}_{p}": e for k, (a, b) in sg.BONES.items() for p, e in (("dx", f"{b}_x - {a}_x"), ("dy", f"{b}_y - {a}_y"), ("length", _dist(a, b)))},
    **{k: _angle_sql(*v, guarded=True) for k, v in sg.COMPACT_ANGLES.items()},
    **{k: _dist(*v) for k, v in sg.COMPACT_DISTANCES.items()},
    **{f"{j}_speed": f"sqrt(coalesce({_d(f'{j}_x')}, 0) * 30 * coalesce({_d(f'{j}_x')}, 0) * 30 + coalesce({_d(f'{j}_y')}, 0) * 30 * coalesce({_d(f'{j}_y')}, 0) * 30)" for j in JOINTS},
}
_COMPACT2 = {f"{j}_acceleration": f"coalesce(abs({_d(f'{j}_speed')}), 0) * 30" for j in JOINTS}
COMPACT_NAMES = (*COORDS, *_COMPACT1, *_COMPACT2)


def compact_sql() -> str:
    """``c2``: the compact signals of a normalised pose."""
    return f"{NORMAL}, {_step('c1', 'np', _COMPACT1)}, {_step('c2', 'c1', _COMPACT2)}"


@query("n18_compact_signals", f"WITH {compact_sql()} SELECT subject_id, pos, {round_sql(COMPACT_NAMES, 6)} FROM c2")
def compact_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 122 compact signals."""
    out, names = sg.compact_signals(fr.normalise_pose(poses(spark, sf_dir)))
    return rounded(out.select("subject_id", "pos", *names), names, 6)


_BONES = ", ".join(f"{b}_x - {a}_x, {b}_y - {a}_y, {_dist(a, b)}" for a, b in sg.BONES.values())


def streams_sql() -> str:
    """``sv(subject_id, pos, coordinates, bones, velocity)``."""
    return f"""{NORMAL}, v AS (SELECT *, {", ".join(f"coalesce({c} - lag({c}) OVER (PARTITION BY subject_id ORDER BY pos), 0) * 30 AS v_{c}" for c in COORDS)} FROM np),
sv AS (SELECT subject_id, pos, [{", ".join(COORDS)}] AS coordinates, [{_BONES}] AS bones, [{", ".join(f"v_{c}" for c in COORDS)}] AS velocity FROM v)"""


@query(
    "n19_model_streams",
    f"""WITH {streams_sql()}
SELECT subject_id, pos, round(list_sum(coordinates), 6) AS coordinates, round(list_sum(bones), 6) AS bones, round(list_sum(list_transform(velocity, lambda v: abs(v))), 6) AS velocity FROM sv""",
)
def model_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrays for each frame, told by their sums."""
    out = sg.streams(fr.normalise_pose(poses(spark, sf_dir)))
    total = {"coordinates": F.col("coordinates"), "bones": F.col("bones"), "velocity": F.transform("velocity", F.abs)}
    return out.select("subject_id", "pos", *(F.round(x.array_sum(a), 6).alias(k) for k, a in total.items()))


@query(
    "n7_n10_scalar_motion",
    f"""WITH {EV}, a AS (SELECT subject_id, pos, CAST(round(value * 100) AS BIGINT) AS v FROM ev), b AS (SELECT *, v - lag(v) OVER o AS d FROM a WINDOW o AS (PARTITION BY subject_id ORDER BY pos)),
c AS (SELECT *, abs(d - lag(d) OVER o) AS jerk, abs(abs(d) - lag(abs(d)) OVER o) AS accel FROM b WINDOW o AS (PARTITION BY subject_id ORDER BY pos))
SELECT subject_id, pos, coalesce(abs(d), 0) AS speed, coalesce(jerk, 0) AS jerk, coalesce(accel, 0) AS accel FROM c""",
)
def scalar_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed, jerk and acceleration of a value in cents."""
    order = fr.in_parts()
    e = fr.overlapping(frames(spark, sf_dir).select("subject_id", "pos", F.round(F.col("value") * 100).cast("long").alias("v")), 2)
    e = e.withColumn("d", x.diff(F.col("v"), order))
    zero = F.lit(0).cast("long")
    out = e.select(
        "subject_id",
        "pos",
        "__copied",
        F.coalesce(F.abs("d"), zero).alias("speed"),
        F.coalesce(F.abs(x.diff(F.col("d"), order)), zero).alias("jerk"),
        F.coalesce(F.abs(x.diff(F.abs("d"), order)), zero).alias("accel"),
    )
    return fr.settled(out)
