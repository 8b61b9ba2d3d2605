"""Operator 2: language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams, most frequent first. The distance of a document to
a language sums, over the document's own profile, how far each n-gram is out of its place in the language's
profile, or the profile's length where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.llm.shared import Scratch, small_batches

#: N-grams in a profile.
TOP = 300
#: Languages that a model may have: with TOP, the bound of what is collected and broadcast.
MAX_LANGUAGES = 2_000
_FLUSH = 300_000
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or the space for what is no letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, dtype=np.int64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS = table
    return _LETTERS


def ngrams(text: str | None) -> np.ndarray:
    """All 1- to 3-grams of the letters of a text as integers, 21 bits a letter; words are set off by single spaces."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _letters()[np.concatenate(([32], raw, [32]))]
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    if len(x) < 3:
        return np.empty(0, dtype=np.int64)
    two = (x[:-1] << 21) | x[1:]
    three = (x[:-2] << 42) | two[1:]
    return np.concatenate((x[x != 32], two, three[x[1:-1] != 32]))


def profile(text: str | None, top: int) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first; ties by n-gram."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed within the task as far as memory is bounded."""
    waiting: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def fold(lang: str) -> None:
        grams, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        if lang in sums:
            both = np.concatenate((sums[lang][0], grams))
            grams, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate((sums[lang][1], counts))).astype(np.int64)
        sums[lang] = grams, counts

    def out() -> Iterator[pa.RecordBatch]:
        for lang in list(waiting):
            fold(lang)
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "uses"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams = ngrams(text.as_py())
            waiting.setdefault(lang, []).append(grams)
            held += len(grams)
            if held > _FLUSH:
                held = 0
                for x in list(waiting):
                    fold(x)
                if sum(len(g) for g, _ in sums.values()) > _FLUSH:
                    yield from out()
    yield from out()


def train_profiles(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """``(lang, gram, place)``: for each language its ``top`` n-grams over all rows, place 0 the most frequent.

    Rows with a null text or language, and texts without letters, teach nothing.
    """
    rows = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body")).where(
        "lang is not null and body is not null"
    )
    sums = rows.mapInArrow(_count, "lang string, gram long, uses long").groupBy("lang", "gram").agg(F.sum("uses").alias("uses"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("uses"), "gram"))
    return sums.withColumn("place", place).where(F.col("place") <= top).select("lang", "gram", (F.col("place") - 1).alias("place"))


def collect_profiles(profiles: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The profiles as lists, after a check that there are few enough. The table is read twice."""
    n = profiles.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if their profiles fit in memory")
    out: dict[str, list[int]] = {}
    for row in profiles.where(F.col("place") < top).orderBy("lang", "place").toLocalIterator():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Classifier:
    """Out-of-place distances of texts to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP) -> None:
        self.langs, self.top = sorted(profiles), top
        self.known = np.unique(np.array([g for x in profiles.values() for g in x], dtype=np.int64))
        self.places = np.full((len(self.known), len(self.langs)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.known, np.array(profiles[lang], dtype=np.int64)), i] = np.arange(len(profiles[lang]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """To each language, from a document's profile."""
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        there = self.known[at] == grams
        places = self.places[at[there]]
        off = np.where(places < 0, self.top, np.abs(places - np.flatnonzero(there)[:, None]))
        return off.sum(axis=0) + self.top * int((~there).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name among equals, and 1 - distance / largest distance; ``und`` without letters."""
        grams = profile(text, self.top)
        if not len(grams) or not self.langs:
            return "und", 0.0
        d = self.distances(grams)
        best = int(d.argmin())
        return self.langs[best], 1.0 - float(d[best]) / (self.top * len(grams))


def predictor(profiles: dict[str, list[int]], context, top: int = TOP):
    """A pandas UDF of a text: ``struct<lang_pred, score>``.

    It is marked as not deterministic, though it is, so that Spark doesn't repeat it in a filter on its columns: that would take twice the time, and two Python workers a task,
    which then stay until the executor rests for a minute.
    """
    model = context.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(model.value, top)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(x) for x in texts], columns=["lang_pred", "score"])

    return predict.asNondeterministic()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of an id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def identify(documents: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """``documents`` under a struct ``doc``, with ``lang_pred`` and ``score`` learned from ``train``.

    A null text or one without letters is ``und`` with score 0, as is every text where nothing could be learned. Every
    row returns, repeated ones too, and the language column of ``documents`` is not read.
    """
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "language")
    model = collect_profiles(scratch.save("profiles", train_profiles(train, text_col, lang_col, top)), top)
    scratch.drop("profiles")
    predict = predictor(model, documents.sparkSession.sparkContext, top)
    rows = documents.select(F.struct("*").alias("doc"), predict(F.col(text_col).cast("string")).alias("p"))
    return rows.select("doc", "p.lang_pred", "p.score")
