"""Names and constants of pose streams.

A frame table has ``subject_id``, ``pos`` (0, 1, ... within a subject) and signals; row order carries no meaning.
"""

from __future__ import annotations

# -- fixed values: names of keypoints, activities and their spellings, and the settings of the standard windows -------
JOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
CLASSES = (
    "Attacking", "Biting", "Eating snacks", "Head banging", "Sitting quietly", "Throwing things", "Using phone", "Walking",
)
ABNORMAL = ("Attacking", "Biting", "Head banging", "Throwing things")
LABEL_ALIASES = {
    "Throwing": "Throwing things",
    "Throwing object": "Throwing things",
    "Throwing objects": "Throwing things",
    "Biting Nails": "Biting",
    "Biting nails": "Biting",
    "Head-Banging": "Head banging",
    "Sitting Quietly": "Sitting quietly",
    "Eating Snacks": "Eating snacks",
    "Using Phone": "Using phone",
}
NO_LABEL = "None"
FPS = 30
WINDOW, TRAIN_STRIDE, TEST_STRIDE, MAJORITY = 150, 75, 150, 0.70
SCALES = (60, 150, 300)
# -- end of fixed values ----------------------------------------------------------------------------------------------

COORDS = tuple(f"{joint}_{axis}" for joint in JOINTS for axis in "xy")
