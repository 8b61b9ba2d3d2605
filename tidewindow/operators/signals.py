"""Frame-level signals of a pose: distances, angles, motion, masks.

Signals are Column expressions in stages, each a projection over the one before, so that no generated method grows too
large; the windows of all stages share one partitioning by subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators.frames import carry, in_parts, normalise_pose, normalise_pose_robustly, overlapping, settled
from tidewindow.schema import COORDS, FPS, JOINTS

# -- fixed values: signals and the points that they are made of -------------------------------------------------------
DISTANCES = {
    "dist_shoulders": ("left_shoulder", "right_shoulder"),
    "dist_hips": ("left_hip", "right_hip"),
    "dist_knees": ("left_knee", "right_knee"),
    "dist_ankles": ("left_ankle", "right_ankle"),
    "dist_wrist_to_hip": ("right_wrist", "right_hip"),
    "dist_lw_nose": ("left_wrist", "nose"),
    "dist_rw_nose": ("right_wrist", "nose"),
    "dist_lw_ear": ("left_wrist", "left_ear"),
    "dist_rw_ear": ("right_wrist", "right_ear"),
    "dist_la_lhip": ("left_ankle", "left_hip"),
    "dist_ra_rhip": ("right_ankle", "right_hip"),
}
ANGLES = {
    "angle_elbow_l": ("left_shoulder", "left_elbow", "left_wrist"),
    "angle_elbow_r": ("right_shoulder", "right_elbow", "right_wrist"),
    "angle_knee_l": ("left_hip", "left_knee", "left_ankle"),
    "angle_knee_r": ("right_hip", "right_knee", "right_ankle"),
    "angle_hip_l": ("left_shoulder", "left_hip", "left_knee"),
    "angle_hip_r": ("right_shoulder", "right_hip", "right_knee"),
}
OTHER_SIGNALS = (
    "angle_shoulder_tilt", "angle_torso", "com_x", "com_y", "pelvis_y", "head_vertical", "wrist_y_diff", "vel_dist_lw_nose", "vel_dist_rw_nose",
    "vel_head_nod", "vel_left_wrist", "vel_right_wrist", "vel_left_ankle", "vel_right_ankle", "vel_com", "vel_knee_angle", "vel_torso_angle",
    "vel_shoulder_tilt", "left_wrist_jerk", "right_wrist_jerk", "jerk_nose_y", "jerk_com", "accel_left_wrist", "accel_right_wrist",
    "delta_knee_l_y", "delta_knee_r_y", "duck_proxy", "max_frame_jerk_rw", "min_dist_wrist_head", "total_movement", "hand_near_head", "micro_bite",
    "strong_bite", "knee_flex", "knee_extend", "elbow_flex", "static_wrist", "low_motion", "ground_mask_l", "ground_mask_r", "both_on_ground",
    "ratio_rwjerk_comjerk",
)
FLOOR_DISTANCES = ("dist_lw_floor_norm", "dist_rw_floor_norm")
SET_B = (
    *DISTANCES, *FLOOR_DISTANCES, *ANGLES, "angle_shoulder_tilt", "angle_torso", "pelvis_y", "wrist_y_diff", "vel_dist_lw_nose",
    "vel_dist_rw_nose", "vel_head_nod", "vel_left_wrist", "vel_right_wrist", "left_wrist_jerk", "right_wrist_jerk", "jerk_nose_y", "vel_com",
    "total_movement", "min_dist_wrist_head", "static_wrist", "elbow_flex",
)
ADDED_BY_C = (
    "dist_wrists", "dist_lw_lhip", "dist_rw_rhip", "dist_lw_lknee", "dist_rw_rknee", "max_dist_wrist_head", "wrist_head_distance_diff",
    "both_hands_near_head", "one_hand_near_head", "wrist_speed_diff", "wrist_speed_max", "wrist_motion_sync", "mean_knee_angle",
    "knee_angle_asymmetry", "torso_height",
)
BONES = {
    "left_upper_arm": ("left_shoulder", "left_elbow"),
    "left_forearm": ("left_elbow", "left_wrist"),
    "right_upper_arm": ("right_shoulder", "right_elbow"),
    "right_forearm": ("right_elbow", "right_wrist"),
    "left_torso": ("left_shoulder", "left_hip"),
    "right_torso": ("right_shoulder", "right_hip"),
    "shoulders": ("left_shoulder", "right_shoulder"),
    "hips": ("left_hip", "right_hip"),
    "left_thigh": ("left_hip", "left_knee"),
    "left_shin": ("left_knee", "left_ankle"),
    "right_thigh": ("right_hip", "right_knee"),
    "right_shin": ("right_knee", "right_ankle"),
    "nose_left_wrist": ("nose", "left_wrist"),
    "nose_right_wrist": ("nose", "right_wrist"),
}
COMPACT_ANGLES = {
    "left_elbow_angle": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow_angle": ("right_shoulder", "right_elbow", "right_wrist"),
    "left_knee_angle": ("left_hip", "left_knee", "left_ankle"),
    "right_knee_angle": ("right_hip", "right_knee", "right_ankle"),
    "left_hip_angle": ("left_shoulder", "left_hip", "left_knee"),
    "right_hip_angle": ("right_shoulder", "right_hip", "right_knee"),
}
COMPACT_DISTANCES = {
    "left_wrist_to_nose": ("left_wrist", "nose"),
    "right_wrist_to_nose": ("right_wrist", "nose"),
    "left_wrist_to_left_hip": ("left_wrist", "left_hip"),
    "right_wrist_to_right_hip": ("right_wrist", "right_hip"),
    "left_wrist_to_right_wrist": ("left_wrist", "right_wrist"),
    "left_ankle_to_right_ankle": ("left_ankle", "right_ankle"),
}
# -- end of fixed values ----------------------------------------------------------------------------------------------

POSE_SIGNALS = (*DISTANCES, *FLOOR_DISTANCES, *ANGLES, *OTHER_SIGNALS)


def _flag(condition: Column) -> Column:
    """1.0 where a condition holds, 0.0 where it doesn't or is unknown."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def geometry() -> dict[str, Column]:
    """Distances, angles and places of one frame."""
    tilt = F.atan2(F.col("right_shoulder_y") - F.col("left_shoulder_y"), F.col("right_shoulder_x") - F.col("left_shoulder_x"))
    up = F.atan2(
        x.middle("left_shoulder", "right_shoulder", "y") - x.middle("left_hip", "right_hip", "y"),
        x.middle("left_shoulder", "right_shoulder", "x") - x.middle("left_hip", "right_hip", "x"),
    )
    floor = F.greatest("left_ankle_y", "right_ankle_y")
    width = x.clip(x.distance("left_shoulder", "right_shoulder"), low=1e-6)
    com = {a: (F.col(f"left_hip_{a}") + F.col(f"right_hip_{a}") + F.col(f"left_shoulder_{a}") + F.col(f"right_shoulder_{a}")) / 4 for a in "xy"}
    return {
        **{k: x.distance(*points) for k, points in DISTANCES.items()},
        **{k: x.angle(*points) for k, points in ANGLES.items()},
        "angle_shoulder_tilt": F.degrees(tilt),
        "angle_torso": F.degrees(up),
        "dist_lw_floor_norm": (floor - F.col("left_wrist_y")) / width,
        "dist_rw_floor_norm": (floor - F.col("right_wrist_y")) / width,
        "com_x": com["x"],
        "com_y": com["y"],
        "pelvis_y": x.middle("left_hip", "right_hip", "y"),
        "head_vertical": F.col("nose_y"),
        "wrist_y_diff": F.abs(F.col("left_wrist_y") - F.col("right_wrist_y")),
    }


def first_differences() -> dict[str, Column]:
    """Speeds, 0 on a subject's first frame, and the differences that second differences are made of."""
    order = in_parts()
    change = lambda c: x.diff(F.col(c) if isinstance(c, str) else c, order)
    knees = (F.col("angle_knee_l") + F.col("angle_knee_r")) / 2
    speeds = {p: x.zero(x.length(change(f"{p}_x"), change(f"{p}_y"))) for p in ("nose", "left_wrist", "right_wrist", "left_ankle", "right_ankle", "com")}
    return {
        **{f"vel_{p}": c for p, c in speeds.items()},
        "vel_dist_lw_nose": x.zero(F.abs(change("dist_lw_nose"))),
        "vel_dist_rw_nose": x.zero(F.abs(change("dist_rw_nose"))),
        "vel_head_nod": x.zero(F.abs(change("nose_y"))),
        "vel_knee_angle": x.zero(F.abs(change(knees))),
        "vel_torso_angle": x.zero(F.abs(change("angle_torso"))),
        "vel_shoulder_tilt": x.zero(F.abs(change("angle_shoulder_tilt"))),
        "delta_knee_l_y": x.zero(change("left_knee_y")),
        "delta_knee_r_y": x.zero(change("right_knee_y")),
        **{f"__d_{c}": change(c) for c in ("left_wrist_x", "left_wrist_y", "right_wrist_x", "right_wrist_y", "nose_y")},
    }


def second_differences() -> dict[str, Column]:
    """Jerks and accelerations: differences of differences, 0 where a subject has too few frames before."""
    order = in_parts()
    again = lambda c: F.abs(x.diff(F.col(c), order))
    return {
        "left_wrist_jerk": x.zero(again("__d_left_wrist_x") + again("__d_left_wrist_y")),
        "right_wrist_jerk": x.zero(again("__d_right_wrist_x") + again("__d_right_wrist_y")),
        "jerk_nose_y": x.zero(again("__d_nose_y")),
        "jerk_com": x.zero(again("vel_com")),
        "accel_left_wrist": x.zero(again("vel_left_wrist")),
        "accel_right_wrist": x.zero(again("vel_right_wrist")),
    }


def combinations() -> dict[str, Column]:
    """Signals made of other signals of the same frame."""
    c = F.col
    approach = [c("vel_dist_lw_nose"), c("vel_dist_rw_nose")]
    total = c("vel_dist_lw_nose") + c("vel_dist_rw_nose") + c("vel_head_nod") + c("left_wrist_jerk") + c("right_wrist_jerk")
    nearest = F.least("dist_lw_nose", "dist_rw_nose")
    ground = [_flag(c(k) < 0.15) for k in FLOOR_DISTANCES]
    return {
        "duck_proxy": F.abs(F.least("delta_knee_l_y", "delta_knee_r_y")),
        "max_frame_jerk_rw": F.greatest("left_wrist_jerk", "right_wrist_jerk"),
        "min_dist_wrist_head": nearest,
        "total_movement": total,
        "hand_near_head": _flag(nearest < 0.10),
        "micro_bite": _flag(((approach[0] > 0.01) & (approach[0] < 0.05)) | ((approach[1] > 0.01) & (approach[1] < 0.05))),
        "strong_bite": _flag((approach[0] > 0.10) | (approach[1] > 0.10)),
        "knee_flex": _flag((c("angle_knee_l") < 140) & (c("angle_knee_r") < 140)),
        "knee_extend": _flag((c("angle_knee_l") > 170) & (c("angle_knee_r") > 170)),
        "elbow_flex": _flag(F.least("angle_elbow_l", "angle_elbow_r") < 100),
        "static_wrist": _flag((c("vel_left_wrist") < 0.005) & (c("vel_right_wrist") < 0.005)),
        "low_motion": _flag(total < 0.01),
        "ground_mask_l": ground[0],
        "ground_mask_r": ground[1],
        "both_on_ground": ground[0] * ground[1],
        "ratio_rwjerk_comjerk": x.clip(c("right_wrist_jerk") / (c("jerk_com") + 1e-4), high=1000.0),
    }


def symmetric() -> dict[str, Column]:
    """The signals that set C adds: both hands against each other and against the body."""
    c = F.col
    near = [c("dist_lw_nose") < 1.0, c("dist_rw_nose") < 1.0]
    return {
        "dist_wrists": x.distance("left_wrist", "right_wrist"),
        "dist_lw_lhip": x.distance("left_wrist", "left_hip"),
        "dist_rw_rhip": x.distance("right_wrist", "right_hip"),
        "dist_lw_lknee": x.distance("left_wrist", "left_knee"),
        "dist_rw_rknee": x.distance("right_wrist", "right_knee"),
        "max_dist_wrist_head": F.greatest("dist_lw_nose", "dist_rw_nose"),
        "wrist_head_distance_diff": F.abs(c("dist_lw_nose") - c("dist_rw_nose")),
        "both_hands_near_head": _flag(near[0] & near[1]),
        "one_hand_near_head": _flag(near[0] != near[1]),
        "wrist_speed_diff": F.abs(c("vel_left_wrist") - c("vel_right_wrist")),
        "wrist_speed_max": F.greatest("vel_left_wrist", "vel_right_wrist"),
        "wrist_motion_sync": c("vel_left_wrist") * c("vel_right_wrist"),
        "mean_knee_angle": (c("angle_knee_l") + c("angle_knee_r")) / 2,
        "knee_angle_asymmetry": F.abs(c("angle_knee_l") - c("angle_knee_r")),
        "torso_height": F.abs(x.middle("left_shoulder", "right_shoulder", "y") - x.middle("left_hip", "right_hip", "y")),
    }


def _with_pose_signals(df: DataFrame) -> DataFrame:
    out = overlapping(df, 2).withColumns(geometry()).withColumns(first_differences()).withColumns(second_differences())
    return settled(out).withColumns(combinations())


def _scratch(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("__d_")]


def pose_signals(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """A normalised pose with its 61 signals, gaps carried over, and their names."""
    out = _with_pose_signals(df)
    return carry(out.drop(*_scratch(out)), POSE_SIGNALS), list(POSE_SIGNALS)


def signal_set(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """A normalised pose with signal set A (34 coordinates), B (70 signals) or C (85), and the names."""
    name = name.upper()
    if name not in ("A", "B", "C"):
        raise ValueError(f"unknown signal set: {name}")
    if name == "A":
        return carry(df, COORDS), list(COORDS)
    names = [*COORDS, *SET_B, *(ADDED_BY_C if name == "C" else ())]
    out = _with_pose_signals(df)
    out = out.withColumns(symmetric()) if name == "C" else out
    return carry(out.drop(*_scratch(out)), names), names


def normalised_for(df: DataFrame, name: str) -> DataFrame:
    """The pose normalised as a signal set asks: C smooths first."""
    return normalise_pose_robustly(df) if name.upper() == "C" else normalise_pose(df)


def compact_signals(df: DataFrame, fps: int = FPS) -> tuple[DataFrame, list[str]]:
    """A normalised pose with 122 compact signals: coordinates, bones, angles, speeds by the second, distances."""
    order = in_parts()
    bones = {}
    for name, (a, b) in BONES.items():
        dx, dy = F.col(f"{b}_x") - F.col(f"{a}_x"), F.col(f"{b}_y") - F.col(f"{a}_y")
        bones |= {f"{name}_dx": dx, f"{name}_dy": dy, f"{name}_length": x.length(dx, dy)}
    angles = {k: x.angle(*points, guarded=True) for k, points in COMPACT_ANGLES.items()}
    speeds = {f"{j}_speed": x.length(x.zero(x.diff(F.col(f"{j}_x"), order)) * fps, x.zero(x.diff(F.col(f"{j}_y"), order)) * fps) for j in JOINTS}
    changes = {f"{j}_acceleration": x.zero(F.abs(x.diff(F.col(f"{j}_speed"), order))) * fps for j in JOINTS}
    distances = {k: x.distance(*points) for k, points in COMPACT_DISTANCES.items()}
    names = [*COORDS, *bones, *angles, *(f"{j}_{k}" for j in JOINTS for k in ("speed", "acceleration")), *distances]
    return carry(settled(overlapping(df, 2).withColumns(bones | angles | distances).withColumns(speeds).withColumns(changes)), names), names


def streams(df: DataFrame, fps: int = FPS) -> DataFrame:
    """Three arrays for each frame: 34 ``coordinates``, 42 ``bones`` and 34 ``velocity`` by the second; an error for what isn't finite."""
    order = in_parts()
    bones = []
    for a, b in BONES.values():
        dx, dy = F.col(f"{b}_x") - F.col(f"{a}_x"), F.col(f"{b}_y") - F.col(f"{a}_y")
        bones += [dx, dy, x.length(dx, dy)]
    arrays = {
        "coordinates": F.array(*COORDS),
        "bones": F.array(*bones),
        "velocity": F.array(*(x.zero(x.diff(F.col(c), order)) * fps for c in COORDS)),
    }

    def checked(a: Column) -> Column:
        bad = F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return F.when(bad, F.raise_error(F.lit("a stream has values that aren't finite"))).otherwise(a)

    return settled(overlapping(df, 1).select("subject_id", "pos", "__copied", *(checked(a).alias(k) for k, a in arrays.items())))
