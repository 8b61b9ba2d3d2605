"""Feature selection, class models and augmentation with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexerModel, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import augmentation, information, metrics, scans, selection
from tidewindow.schema import COORDS


# -- feature selection ------------------------------------------------------------------------------------------------


def medians(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """The exact median of each feature over its finite values; 0 where there is none."""
    return {c: v if v is not None else 0.0 for c, v in scans.medians(rows, features).items()}


def imputed(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    """Features with missing and non-finite values replaced."""
    return rows.withColumns({c: F.coalesce(x.finite(F.col(c)), F.lit(float(v))) for c, v in values.items()})


def varying(rows: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that have more than one value."""
    row = rows.agg(*(F.min(c).alias(f"lo_{i}") for i, c in enumerate(features)), *(F.max(c).alias(f"hi_{i}") for i, c in enumerate(features))).first()
    return [c for i, c in enumerate(features) if row[f"lo_{i}"] != row[f"hi_{i}"]]


def rank_correlations(rows: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Spearman's correlations of the features."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="__v").transform(rows).select("__v")
    return Correlation.corr(vectors, "__v", "spearman").first()[0].toArray()


def without_correlated(correlations: np.ndarray, features: Sequence[str], limit: float = 0.98) -> list[str]:
    """The features that no earlier one, kept or not, correlates with beyond the limit."""
    over = np.triu(np.abs(correlations) > limit, k=1)
    return [c for i, c in enumerate(features) if not over[:, i].any()]


def binned_information(rows: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10) -> DataFrame:
    """``(feature, information)``: mutual information, in nats, of the label and each feature cut into bins of equal width.

    A constant feature has one bin and no information.
    """
    bounds = rows.agg(*(F.min(c).alias(f"lo_{c}") for c in features), *(F.max(c).alias(f"hi_{c}") for c in features))
    rows = rows.select(label, *features).crossJoin(F.broadcast(bounds))  # one row

    def cell(c: str) -> Column:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) * bins / width), F.lit(bins - 1))).otherwise(0).cast("int")

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), cell(c).alias("bin")) for c in features))).alias("s")
    n = rows.select(F.col(label).alias("label"), pairs).groupBy("s.feature", "s.bin", "label").agg(F.count("*").alias("n"))
    own, by_bin, by_label = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "label")
    n = n.withColumns({"t": F.sum("n").over(own), "nb": F.sum("n").over(by_bin), "nl": F.sum("n").over(by_label)})
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("nl")))
    return n.groupBy("feature").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("information"))


@dataclass
class Selector:
    """What a training set says about features: fill values, and the useful ones, most informative first."""

    values: dict[str, float]
    ranking: list[str]
    budget: int | None = None
    scores: dict[str, float] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.ranking[: self.budget]

    def restricted(self, budget: int) -> Selector:
        """The same with the first ``budget`` features."""
        if not 1 <= budget <= len(self.ranking):
            raise ValueError(f"the budget must be between 1 and {len(self.ranking)}")
        return Selector(self.values, self.ranking, budget, self.scores)

    def transform(self, rows: DataFrame, others: Sequence[str] = ()) -> DataFrame:
        """The selected features and other columns, with non-finite values as NULL."""
        return rows.select(*others, *(x.finite(F.col(c)).alias(c) for c in self.features))


def fit_selector(rows: DataFrame, features: Sequence[str], budget: int | None = None, label: str = "label", limit: float = 0.98, binned: bool = False) -> Selector:
    """Median fill, constants out, later ones of correlated features out, the rest by information (of nearest neighbours, or of bins), then by name."""
    informed = binned_information if binned else information.neighbour_information
    values = medians(rows, features)
    filled = imputed(rows, values).persist()
    try:
        kept = varying(filled, features)
        if not kept:
            raise ValueError("all features are constant")
        kept = without_correlated(rank_correlations(filled, kept), kept, limit) if len(kept) > 1 else kept
        scores = dict.fromkeys(kept, 0.0) | {r["feature"]: r["information"] for r in informed(filled, kept, label).collect()}  # a row a feature
    finally:
        filled.unpersist()
    ranking = sorted(kept, key=lambda c: (-scores[c], c))
    return Selector(values, ranking, budget, scores)


# -- models -----------------------------------------------------------------------------------------------------------


def balanced_weights(rows: DataFrame, classes: Sequence[str], label: str = "label", root: bool = False) -> DataFrame:
    """Rows with ``weight``: rows / (classes present * rows of the class), or its root."""
    table = metrics.class_weights(metrics.class_counts(rows, classes, label))
    weight = F.col("root_balanced" if root else "balanced").alias("weight")
    return rows.join(F.broadcast(table.select(F.col("class").alias(label), weight)), label)


def _filling(values: dict[str, float]) -> SQLTransformer:
    """A stage that adds ``__c`` for each feature c: its value, or the fill value where it is missing."""
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(`{c}`, double('{v!r}')) AS `__{c}`" for c, v in values.items()) + " FROM __THIS__")


def fit_model(rows: DataFrame, features: Sequence[str], classes: Sequence[str], label: str = "label", trees: int = 60, depth: int = 8, seed: int = 42, root: bool = False) -> PipelineModel:
    """Median fill, features without variance out, a weighted random forest over classes in a fixed order."""
    index = StringIndexerModel.from_labels(list(classes), inputCol=label, outputCol="__y", handleInvalid="error")
    clean = rows.withColumns({c: x.finite(F.col(c).cast("double")) for c in features})
    stages = [
        _filling(medians(clean, features)),
        VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="__all"),
        VarianceThresholdSelector(varianceThreshold=1e-10, featuresCol="__all", outputCol="__features"),
        RandomForestClassifier(featuresCol="__features", labelCol="__y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred"),
    ]
    return Pipeline(stages=stages).fit(index.transform(balanced_weights(clean, classes, label, root)))


def fit_perceptron(rows: DataFrame, features: Sequence[str], classes: Sequence[str], label: str = "label", hidden: Sequence[int] = (64,), epochs: int = 60, seed: int = 42) -> PipelineModel:
    """Median fill, standard scores, a perceptron over classes in a fixed order: the nearest of Spark's models to a network over flattened windows."""
    index = StringIndexerModel.from_labels(list(classes), inputCol=label, outputCol="__y", handleInvalid="error")
    clean = rows.withColumns({c: x.finite(F.col(c).cast("double")) for c in features})
    stages = [
        _filling(medians(clean, features)),
        VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="__all"),
        StandardScaler(withMean=True, inputCol="__all", outputCol="__features"),
        MultilayerPerceptronClassifier(layers=[len(features), *hidden, len(classes)], featuresCol="__features", labelCol="__y", maxIter=epochs, seed=seed, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred"),
    ]
    return Pipeline(stages=stages).fit(index.transform(clean))


@dataclass(frozen=True)
class ClassMeans:
    """The mean of each feature over each class's rows: classes times features numbers, in class order; None for a class without rows."""

    means: tuple[tuple[float, ...] | None, ...]

    def apart(self, features: Sequence[str]) -> Column:
        """The mean squared difference from each class's means; infinite for a class without rows."""
        each = []
        for own in self.means:
            if own is None:
                each.append(F.lit(float("inf")))
                continue
            each.append(x.array_sum(F.zip_with(F.array(*features), F.array(*map(F.lit, own)), lambda a, b: (a - b) * (a - b))) / len(features))
        return F.array(*each)


def class_means(rows: DataFrame, features: Sequence[str], classes: Sequence[str], label: str = "label") -> ClassMeans:
    """The nearest-mean model of rows with a label."""
    found = {r[label]: tuple(r[1:]) for r in rows.where(F.col(label).isin(*classes)).groupBy(label).agg(*(F.avg(c) for c in features)).collect()}  # a row a class
    return ClassMeans(tuple(found.get(c) for c in classes))


def predict(model: PipelineModel | ClassMeans, rows: DataFrame, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Rows with ``probs`` in class order, ``pred`` and ``confidence``."""
    if isinstance(model, ClassMeans):
        # weights exp(-difference), which are all 0 far from every class, times exp(least difference): normalised they are the same
        weights = F.transform("__apart", lambda d: F.exp(F.array_min("__apart") - d))
        told = rows.withColumn("__apart", model.apart(features)).withColumn("__weights", weights).withColumn("probs", x.normalised(F.col("__weights"))).drop("__apart", "__weights")
        return told.withColumns({"pred": F.get(F.array(*map(F.lit, classes)), x.argmax(F.col("probs"))), "confidence": F.array_max("probs")})
    clean = rows.withColumns({c: x.finite(F.col(c).cast("double")) for c in features})
    probs = vector_to_array("__p")
    some = F.concat(probs, F.array_repeat(F.lit(0.0), F.greatest(F.lit(len(classes)) - F.size(probs), F.lit(0))))
    out = model.transform(clean).withColumn("probs", x.normalised(some))
    names = F.array(*map(F.lit, classes))
    return out.select(*rows.columns, "probs", F.get(names, x.argmax(F.col("probs"))).alias("pred"), F.array_max("probs").alias("confidence"))


def leave_one_subject_out(rows: DataFrame, features: Sequence[str], classes: Sequence[str], abnormal: Sequence[str], subjects: Sequence[int], **settings) -> tuple[DataFrame, DataFrame]:
    """``(held_out_subject, truth, pred)`` of every row by a model of the other subjects, and the metrics by fold and pooled."""
    parts = []
    for s in subjects:
        train, test = selection.leave_one_out(rows, s)
        model = fit_model(train, features, classes, **settings)
        told = predict(model, test, features, classes)
        parts.append(told.select(F.lit(s).alias("held_out_subject"), F.col("label").alias("truth"), "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, metrics.pooled_and_folds(metrics.valid_truth(out, classes), classes, abnormal)


def focal_loss(logits: Column, target: Column, gamma: float = 2.0, weights: Column | None = None) -> Column:
    """Focal cross-entropy of an array of logits for a class index."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    log_p = F.get(logits, target) - top - F.log(total)
    loss = -F.pow(1 - F.exp(log_p), F.lit(gamma)) * log_p
    return loss * F.get(weights, target) if weights is not None else loss


# -- augmentation of poses --------------------------------------------------------------------------------------------


def mirrored(df: DataFrame) -> DataFrame:
    """A pose with left and right exchanged and x turned around."""

    def source(c: str) -> str:
        return c.replace("left_", "#").replace("right_", "left_").replace("#", "right_")

    return df.withColumns({c: -F.col(source(c)) if c.endswith("_x") else F.col(source(c)) for c in COORDS})


def rotated_and_scaled(df: DataFrame, degrees: Column | float, factor: Column | float) -> DataFrame:
    """A pose turned about the origin and scaled."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    k = factor if isinstance(factor, Column) else F.lit(float(factor))
    out = {}
    for cx, cy in zip(COORDS[::2], COORDS[1::2], strict=True):
        out[cx] = (F.col(cx) * F.cos(a) - F.col(cy) * F.sin(a)) * k
        out[cy] = (F.col(cx) * F.sin(a) + F.col(cy) * F.cos(a)) * k
    return df.withColumns(out)


def noisy(df: DataFrame, sigma: float, dropout: float, seed: int, keys: Sequence[str] = ("subject_id", "pos")) -> DataFrame:
    """A pose with normal noise, and each joint of a frame set to 0 with a probability. Both follow from the seed and the ``keys`` of a row, so that they are the same in every run."""
    out = {}
    for cx, cy in zip(COORDS[::2], COORDS[1::2], strict=True):
        gone = augmentation.uniforms(seed, keys, "dropout", cx)[0] < dropout
        for c, n in zip((cx, cy), augmentation.normals(seed, keys, "noise", cx), strict=True):
            out[c] = F.when(gone, 0.0).otherwise(F.col(c) + n * sigma)
    return df.withColumns(out)


def resampled(values: Column, size: int) -> Column:
    """An array of doubles at ``size`` equally spaced places, on straight lines between its elements."""
    n = F.size(values)

    def at(i: Column) -> Column:
        place = i * (n - 1) / F.lit(max(1, size - 1))
        low = F.least(F.floor(place).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        return F.get(values, low) + (F.get(values, high) - F.get(values, low)) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)
