"""Streams of many windows at once: coordinates of a batch as one array (windows, frames, coordinates), from which bones and velocities are worked out together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.operators.signals import BONES
from tidewindow.schema import FPS, JOINTS

_SIDES = np.array([[JOINTS.index(a), JOINTS.index(b)] for a, b in BONES.values()])


def streams_of(coordinates: np.ndarray, fps: float = FPS) -> tuple[np.ndarray, np.ndarray]:
    """Bones (dx, dy, length of each) and velocities by the second, 0 at the first frame, of ``coordinates`` (windows, frames, 2 x joints)."""
    points = coordinates.reshape(*coordinates.shape[:2], len(JOINTS), 2)
    apart = points[:, :, _SIDES[:, 1]] - points[:, :, _SIDES[:, 0]]
    bones = np.concatenate([apart, np.sqrt((apart**2).sum(axis=3, keepdims=True))], axis=3)
    return bones.reshape(*coordinates.shape[:2], -1), np.diff(coordinates, axis=1, prepend=coordinates[:, :1]) * fps


def _nested(values: np.ndarray) -> pa.Array:
    """(windows, frames, numbers) as lists of lists."""
    n, frames, width = values.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * frames * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * frames + 1, frames, dtype=np.int32)), inner)


def with_streams(windows: DataFrame, fps: float = FPS) -> DataFrame:
    """``windows`` with arrays of frames ``bones`` and ``velocity`` beside their ``coordinates``. Windows of one length in a batch are one tensor; what isn't finite is an error.

    A window without coordinates, or without frames, has no streams: null, or empty arrays.
    """
    columns = [c for c in windows.columns if c not in ("bones", "velocity")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("coordinates")
            lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
            for n in np.unique(lengths):
                own = b.take(pa.array(np.flatnonzero(lengths == n)))
                if n <= 0:
                    made = [pa.array([None if n < 0 else []] * own.num_rows, pa.list_(pa.list_(pa.float64())))] * 2
                else:
                    values = own.column("coordinates").flatten().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, n, -1)
                    if values.shape[2] != 2 * len(JOINTS) or not np.isfinite(values).all():
                        raise ValueError(f"a window needs {2 * len(JOINTS)} finite coordinates a frame")
                    made = [_nested(v) for v in streams_of(values, fps)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in columns), *made], [*columns, "bones", "velocity"])

    return windows.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, f"{kinds}, bones array<array<double>>, velocity array<array<double>>")
