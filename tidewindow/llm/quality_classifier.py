"""Operator 12: a quality classifier over document statistics.

Each text becomes a few dozen statistics. Random Fourier features stand in for a Gaussian kernel over them, so that a ridge regression on the features is a kernel
regression whose size doesn't grow with the rows: tasks add up normal equations, and only their sums reach the driver. They are kept by fold, so that the sums of all
other folds give scores of rows that a fit has not seen, without another pass. Those choose the ridge and fit an isotonic curve from scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.shared import Scratch, small_batches
from tidewindow.llm.textvec import word_hashes

#: Names of the statistics of a text, in order.
STATISTICS = (
    "log_words", "log_chars", "log_lines", "word_length", "word_length_sd", "log_longest_word", "short_words", "letterless_words",
    "capital_words", "upper", "digits", "signs", "symbols", "shouts", "stops", "blanks", "wide_chars", "byte_entropy",
    "distinct_words", "commonest_word", "doubled_words", "repeated_triples", "words_a_line", "repeated_lines",
)
#: Random features, width of the kernel (in units of the root of the number of statistics), folds, and the ridges to choose from, a row each.
FEATURES, WIDTH, FOLDS, RIDGES, SEED = 256, 1.0, 5, (1e-5, 1e-4, 1e-3, 1e-2, 1e-1), 12
#: Scores are counted in so many steps between these ends for the isotonic curve.
BINS, LOW, HIGH = 2048, -0.5, 1.5

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SIGNS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[c for c in range(256) if chr(c).isalpha() and c < 128 or c >= 128]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def _repeats(items: np.ndarray) -> tuple[int, int, int]:
    """Distinct items, the count of the commonest, and how many items are found more than once."""
    counts = np.unique(items, return_counts=True)[1]
    return len(counts), int(counts.max(initial=0)), int(counts[counts > 1].sum())


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; null is the empty text, for which all are 0. Shares are of words, or of bytes of UTF-8 that are not blank."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    counts = np.bincount(raw, minlength=256)
    inside = ~_SPACES[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    n, lengths = len(starts), ends - starts
    body = max(int(inside.sum()), 1)
    words = max(n, 1)
    letters = np.add.reduceat(_LETTER[raw], starts, dtype=np.int64) if n else np.zeros(0)
    hashes = word_hashes(text)
    distinct, commonest, _ = _repeats(hashes)
    triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if n > 2 else hashes[:0]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    shares = counts[counts > 0] / len(raw)
    return [
        float(np.log1p(n)),
        float(np.log1p(len(raw) - int(counts[0x80:0xC0].sum()))),
        float(np.log1p(len(lines))),
        float(lengths.mean()) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        float(np.log1p(lengths.max(initial=0))),
        float((lengths <= 3).sum()) / words,
        float((letters == 0).sum()) / words,
        float(_UPPER[raw[starts]].sum()) / words,
        float(counts[65:91].sum()) / body,
        float(counts[48:58].sum()) / body,
        float(counts[_SIGNS].sum()) / body,
        float(counts[_SYMBOLS].sum()) / body,
        float(counts[ord("!")]) / words,
        float(counts[ord(".")]) / words,
        1 - body / len(raw) if inside.any() else 1.0,
        float(counts[0x80:].sum()) / body,
        float(-(shares * np.log2(shares)).sum()),
        distinct / words**0.75,
        commonest / words,
        float((hashes[1:] == hashes[:-1]).sum()) / words,
        _repeats(triples)[2] / words,
        float(np.log1p(n / max(len(lines), 1))),
        1 - len(set(lines)) / max(len(lines), 1),
    ]


def document_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fold, stats`` of each row. Equal texts have equal folds, so that no fit sees a copy of a row that it is judged on."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("fold"), stats], ["id", "fold", "stats"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fold int, stats array<double>")


# -- random features ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Kernel:
    """Standardises statistics and maps them to random Fourier features, a constant last."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def of(self, stats: np.ndarray) -> np.ndarray:
        """Rows of features. Far values are drawn in by a logarithm, else one odd statistic would make a text unlike any other."""
        z = (stats - self.mean) / self.deviation
        z = np.sign(z) * np.log1p(np.abs(z))
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])


def kernel_of(stats: DataFrame) -> Kernel:
    """The kernel for the spread of the statistics over all rows; its random directions follow a seed."""
    k = len(STATISTICS)
    row = stats.agg(*(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k))).first()
    rng = np.random.default_rng(SEED)
    deviation = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    return Kernel(
        np.array([row[f"m{i}"] or 0.0 for i in range(k)]),
        np.where(deviation > 1e-9, deviation, 1.0),
        rng.standard_normal((k, FEATURES)) / (WIDTH * np.sqrt(k)),
        rng.uniform(0, 2 * np.pi, FEATURES),
    )


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


# -- ridge ----------------------------------------------------------------------------------------------------------------


def normal_equations(train: DataFrame, kernel: Kernel) -> np.ndarray:
    """Sums over ``fold, stats, label`` by fold: for each feature its products with all features and, last, with the label.

    A task adds up its rows; the parts of a row of the matrix meet in one group, a row each a task, and are added in order of their tasks.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for b in batches:
            x, fold = kernel.of(_stacked(b)), b.column("fold").to_numpy()
            y = b.column("label").to_numpy()[:, None]
            for f in np.unique(fold):
                own = x[fold == f]
                total[f] += own.T @ np.hstack([own, y[fold == f]])
        cells = total.reshape(FOLDS * (FEATURES + 1), FEATURES + 2)
        size = len(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, TaskContext.get().partitionId(), dtype=np.int32)), pa.array(cells.tolist())], ["at", "task", "sums"]
        )

    def added(parts: pa.Table) -> pa.Table:
        rows = parts.sort_by("task").column("sums").to_pylist()
        return pa.table({"at": parts.column("at").slice(0, 1), "sums": pa.array([np.sum(rows, axis=0).tolist()])})

    found = train.mapInArrow(parts, "at int, task int, sums array<double>").groupBy("at").applyInArrow(added, "at int, sums array<double>").toArrow().sort_by("at")
    flat = found.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(FOLDS, FEATURES + 1, FEATURES + 2) if len(flat) else np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))


def _solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the features; the constant is not drawn towards 0. All are 0 where there are no rows."""
    n = sums[-1, -2]
    if n == 0:
        return np.zeros(len(sums))
    penalty = np.full(len(sums), ridge * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1])


def ridge_weights(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The ridge whose fits without a fold are nearest to the labels of that fold (of equals the larger), the weights of all rows, and those without each fold."""

    def loss(ridge: float) -> float:
        out = 0.0
        for own in sums:
            w = _solved(sums.sum(axis=0) - own, ridge)
            out += float(w @ own[:, :-1] @ w - 2 * w @ own[:, -1])
        return out

    ridge = min(sorted(RIDGES, reverse=True), key=loss)
    return ridge, _solved(sums.sum(axis=0), ridge), np.array([_solved(sums.sum(axis=0) - own, ridge) for own in sums])


# -- isotonic curve -------------------------------------------------------------------------------------------------------


def isotonic(scores: np.ndarray, weights: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to ``values`` (means of so many rows each, ordered by score): pools of neighbours, as their mean scores and values."""
    pools: list[list[float]] = []
    for s, w, v in zip(scores, weights, values, strict=True):
        pools.append([s * w, w, v * w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def calibration(train: DataFrame, kernel: Kernel, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic curve over the scores of all labelled rows, each by the fit without its fold. Rows are counted by steps of the score."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for b in batches:
            score = (kernel.of(_stacked(b)) * without[b.column("fold").to_numpy()]).sum(axis=1)
            at = np.clip((score - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            for k, w in enumerate((None, score, b.column("label").to_numpy())):
                total[k] += np.bincount(at, weights=w, minlength=BINS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(t[used]) for t in total)], ["bin", "n", "score", "label"])

    rows = train.mapInArrow(counted, "bin int, n double, score double, label double").groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("n", "score", "label")))
    found = np.array([[r["n"], r["score"], r["label"]] for r in rows.orderBy("bin").collect()]).reshape(-1, 3)
    return isotonic(found[:, 1] / found[:, 0], found[:, 0], found[:, 2] / found[:, 0])


# -- the classifier -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Classifier:
    """Scores statistics; without labels in training every score is one half."""

    kernel: Kernel
    ridge: float
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def of(self, stats: np.ndarray) -> np.ndarray:
        """Probabilities. Raw scores are rounded, so that equal texts are equal whatever batch they are in."""
        x, y = self.curve
        return np.interp(np.round(self.kernel.of(stats) @ self.weights, 9), x, y) if len(x) else np.full(len(stats), 0.5)


def label_means(labels: DataFrame, label: Column, id_col: str = "doc_id") -> DataFrame:
    """``id, label``: an id's labels that are 0 or 1, by their mean; ids that have none or are null are left out."""
    rows = labels.select(F.col(id_col).alias("id"), label.cast("double").alias("label"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isin(0.0, 1.0)).groupBy("id").agg(F.avg("label").alias("label"))


def fit_classifier(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> Classifier:
    """Fitted on every row of ``stats`` whose id is in ``labels(id, label)``, an id of several rows each time."""
    train = scratch.save("train", stats.join(labels, "id").select("fold", "stats", "label"))
    kernel = kernel_of(stats)
    ridge, weights, without = ridge_weights(normal_equations(train, kernel))
    out = Classifier(kernel, ridge, weights, calibration(train, kernel, without))
    scratch.drop("train")
    return out


def score(stats: DataFrame, model: Classifier) -> DataFrame:
    """``id, score, predicted`` for each row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.of(_stacked(b)))], ["id", "score"])

    out = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for each row of ``documents``, learned from ``labels(id, label)``.

    Null and empty texts have statistics of 0 and a score like any other. Repeated rows return each time; other columns are not read. The statistics of the
    kernel's spread cover all rows. They are a written table, about a twentieth of the texts, which the result reads.
    """
    scratch = Scratch(documents.sparkSession, "quality_classifier")
    stats = scratch.save("stats", document_statistics(documents, id_col, text_col))
    return score(stats, fit_classifier(stats, labels, scratch))
