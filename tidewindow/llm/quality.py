"""Operator 10: quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Rows are counted by their pattern of votes, a table of at most
3 ** rules rows whatever the input. Expectation-maximisation over it fits latent classes, the good texts and a few kinds of
bad text: how common each is, and how often each rule that votes on such a text votes bad. Each rule says of which kinds it
speaks, which is where the fit starts from; what it learns from there may differ. A text is kept if it is more probably good than bad.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.shared import saved

_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Printable ASCII but for letters.
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha())
#: Name -> SQL of a vote over the measures. Where published rules for web text give a limit (symbols to words 0.1, words with a letter 80 %, repeated
#: lines 30 %, mean word length 3 to 10), that is the limit of a bad vote; votes for good keep well clear of it, and between the two a rule abstains.
RULES = {
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 50 * n_symbols <= n_words THEN 1 ELSE 0 END",
    "letterless": "CASE WHEN 10 * n_letter_words < 8 * n_words THEN -1 WHEN 20 * n_letter_words >= 19 * n_words THEN 1 ELSE 0 END",
    "signs": "CASE WHEN 4 * n_signs > word_chars THEN -1 WHEN 10 * n_signs <= word_chars THEN 1 ELSE 0 END",
    "dup_lines": "CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_lines >= 4 AND 20 * n_dup_lines <= n_lines THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 WHEN 10 * n_repeat_words <= n_words THEN 1 ELSE 0 END",
    "variety": "CASE WHEN 5 * n_distinct < n_words THEN -1 WHEN 2 * n_distinct >= n_words THEN 1 ELSE 0 END",
    "capitals": "CASE WHEN 10 * n_upper > 3 * word_chars THEN -1 WHEN 10 * n_upper <= word_chars THEN 1 ELSE 0 END",
    "shouts": "CASE WHEN 10 * n_shouts > n_words THEN -1 WHEN 50 * n_shouts <= n_words THEN 1 ELSE 0 END",
    "lengths": "CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN -1 WHEN 2 * word_chars >= 7 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END",
    "digits": "CASE WHEN 5 * n_digits > word_chars THEN -1 WHEN 20 * n_digits <= word_chars THEN 1 ELSE 0 END",
}
#: The kinds of bad text and the rules that speak of each.
KINDS = {
    "symbols": ("symbols", "letterless", "signs"),
    "repetition": ("dup_lines", "repeats", "variety"),
    "shouting": ("capitals", "shouts", "signs"),
    "words": ("lengths", "digits", "letterless"),
}
#: Where the fit starts: the share of good texts, and how often a rule votes bad on a good text, on a text of a kind that it speaks of and on other bad texts. The start
#: counts as one text of each class in every round, which keeps all estimates between 0 and 1; there are no other bounds.
START_GOOD, BAD_ON_GOOD, BAD_ON_OWN, BAD_ON_OTHER = 0.8, 0.05, 0.7, 0.1
ROUNDS = 40


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text that is not null; ``words`` and ``lines`` are arrays."""
    plain = F.translate(text, _SPACE[1:], " " * (len(_SPACE) - 1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)

    def count_of(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    return {
        "words": F.filter(F.split(plain, " "), lambda w: w != ""),
        "lines": lines,
        "word_chars": F.length(F.translate(text, _SPACE, "")).cast("long"),
        "n_letter_words": F.regexp_count(F.translate(plain, SIGNS, ""), F.lit("[^ ]+")).cast("long"),
        "n_symbols": count_of(SYMBOLS),
        "n_signs": count_of(SIGNS),
        "n_upper": count_of(UPPER),
        "n_shouts": count_of("!"),
        "n_digits": count_of("0123456789"),
    }


_COUNTS = ("word_chars", "n_letter_words", "n_symbols", "n_signs", "n_upper", "n_shouts", "n_digits")


def _windows(words: Column) -> Column:
    """64-bit hashes of the three-word windows of a text, in order."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) >= 4, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))


def _placed(windows: Column) -> Column:
    """The windows of a text that repeats any, as structs of hash and place in that order; none of other texts, which most are."""
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(some, placed).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))


def _repeated_places(placed: Column) -> Column:
    """The sorted places of windows that are found twice or more: those equal to a neighbour."""
    repeated = F.filter(placed, lambda w, k: (w["h"] == F.get(placed, k - 1)["h"]) | (w["h"] == F.get(placed, k + 1)["h"]))
    return F.sort_array(F.transform(repeated, lambda w: w["i"]))


def _covered_words(places: Column) -> Column:
    """How many words lie in a window at one of the sorted places: up to the next place, three at most."""
    gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of each text; null is the empty text."""
    x = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    x = x.select("doc_id", *(c.alias(k) for k, c in measures(F.col("body")).items()))
    x = x.select(
        "doc_id",
        *_COUNTS,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words")).alias("windows"),
    )
    x = x.withColumn("placed", _placed(F.col("windows"))).drop("windows")
    x = x.withColumn("places", _repeated_places(F.col("placed"))).drop("placed")
    return x.withColumn("n_repeat_words", _covered_words(F.col("places"))).drop("places")


@dataclass(frozen=True)
class Model:
    """The shares of the classes, the good texts first, and for each class how often each rule votes bad where it votes."""

    shares: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    def likelihood(self, cls: int, rule: int, vote: int) -> float:
        """Of a vote in a class; an abstention says nothing."""
        b = self.bad[cls][rule]
        return {1: 1 - b, -1: b}.get(vote, 1.0)

    def posterior(self, votes: Sequence[Column]) -> Column:
        """P(good) for a row's votes, by sums of logarithms against the good class."""
        out = F.lit(1.0)
        for c in range(1, len(self.shares)):
            odds = F.lit(math.log(self.shares[c] / self.shares[0]))
            for i, vote in enumerate(votes):
                good, bad = (math.log(self.likelihood(c, i, v) / self.likelihood(0, i, v)) for v in (1, -1))
                odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
            out = out + F.exp(odds)
        return 1 / out


def start_model(rules: Sequence[str], kinds: Mapping[str, Sequence[str]]) -> Model:
    """What the fit starts from."""
    own = [tuple(BAD_ON_OWN if r in spoken else BAD_ON_OTHER for r in rules) for spoken in kinds.values()]
    return Model((START_GOOD, *([(1 - START_GOOD) / len(kinds)] * len(kinds))), ((BAD_ON_GOOD,) * len(rules), *own))


def fit(patterns: DataFrame, rules: Sequence[str], kinds: Mapping[str, Sequence[str]], rounds: int = ROUNDS) -> Model:
    """The model after so many rounds over ``patterns(rules..., n)``; the starting model where there are no rows.

    The table has at most 3 ** rules rows, which are collected.
    """
    rows = sorted(tuple(r) for r in patterns.groupBy(*rules).agg(F.sum("n").alias("n")).collect())
    total = sum(n for *_, n in rows)
    model = start = start_model(rules, kinds)
    classes, k = range(len(start.shares)), range(len(rules))
    for _ in range(rounds if total else 0):
        logs = [[{v: math.log(model.likelihood(c, i, v)) for v in (-1, 0, 1)} for i in k] for c in classes]
        weight = [0.0 for _ in classes]
        bad, voted = [[0.0] * len(rules) for _ in classes], [[0.0] * len(rules) for _ in classes]
        for *votes, n in rows:
            at = [reduce(lambda x, y: x + y, (logs[c][i][v] for i, v in enumerate(votes)), math.log(model.shares[c])) for c in classes]
            of = [math.exp(x - max(at)) for x in at]
            for c in classes:
                w = of[c] / sum(of) * n
                weight[c] += w
                for i, v in enumerate(votes):
                    if v:
                        voted[c][i] += w
                        bad[c][i] += w if v < 0 else 0.0
        model = Model(
            tuple((weight[c] + start.shares[c]) / (total + 1) for c in classes),
            tuple(tuple((bad[c][i] + start.bad[c][i]) / (voted[c][i] + 1) for i in k) for c in classes),
        )
    return model


def judge(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, str] | None = None, kinds: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """``doc_id``, the measures, the votes, ``base_failed``, ``quality`` (the posterior) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word windows. Null and empty texts have no words and
    fail. A text whose posterior is exactly one half is kept. Every row returns, repeated ones too; other columns are not read. The rules learn from all rows.
    """
    rules, kinds = RULES if rules is None else rules, KINDS if kinds is None else kinds
    rows = saved(measured(documents, id_col, text_col), "measures")
    voted = rows.withColumns({f"vote_{k}": F.expr(v) for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    patterns = voted.groupBy(*names).agg(F.count("*").alias("n"))
    model = fit(patterns, names, {k: [f"vote_{r}" for r in spoken] for k, spoken in kinds.items()})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "quality": model.posterior([F.col(n) for n in names])})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
