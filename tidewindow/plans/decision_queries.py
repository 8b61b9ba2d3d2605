"""Queries of fusion, decoding, evaluation, selection and learning."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import boosting
from tidewindow.operators import decode as dc
from tidewindow.operators import frames as fr
from tidewindow.operators import fusion as fu
from tidewindow.operators import information
from tidewindow.operators import learning as ln
from tidewindow.operators import metrics as mt
from tidewindow.operators import selection as sl
from tidewindow.plans import search
from tidewindow.plans.base import (
    BAD_TYPES, EV, ORACLES, POSE, PRED, PROBS, SCORES, TYPES, frames, poses, predictions, probs_sql, query, round_sql, rounded, scores, scores_sql, table, window_probs,
)
from tidewindow.schema import COORDS
from tidewindow.sources import files

K = range(len(TYPES))
_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_BAD = ", ".join(f"'{t}'" for t in BAD_TYPES)

# -- fusion -----------------------------------------------------------------------------------------------------------

def _covered(n: int) -> str:
    return f"""fm AS (SELECT subject_id, pos, {", ".join(f"avg(p{i}) AS p{i}" for i in range(n))}, count(*) AS coverage FROM (SELECT w.*, unnest(range(start_pos, end_pos)) AS pos FROM wp w) GROUP BY subject_id, pos)"""


COVERED = f"{PROBS}, {_covered(len(TYPES))}"


def _nearest(c: str) -> str:
    return f"CASE WHEN rp IS NULL OR pos - lp <= rp - pos THEN coalesce(l_{c}, r_{c}) ELSE r_{c} END AS {c}"


def filled_sql(types: Sequence[str]) -> str:
    """``fl(subject_id, pos, coverage, probs, label, confidence)`` of windows ``wp`` and frames ``ev``."""
    n = range(len(types))
    names = ", ".join(f"p{i}" for i in n)
    return f"""{_covered(len(types))}, fj AS (SELECT e.subject_id, e.pos, {names}, coverage FROM ev e LEFT JOIN fm USING (subject_id, pos)),
fs AS (SELECT *, {", ".join(f"last_value(p{i} IGNORE NULLS) OVER up AS l_p{i}, first_value(p{i} IGNORE NULLS) OVER dn AS r_p{i}" for i in n)},
  last_value(CASE WHEN coverage IS NOT NULL THEN pos END IGNORE NULLS) OVER up AS lp, first_value(CASE WHEN coverage IS NOT NULL THEN pos END IGNORE NULLS) OVER dn AS rp FROM fj
  WINDOW up AS (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ff AS (SELECT subject_id, pos, coalesce(coverage, 0) AS coverage, {", ".join(_nearest(f"p{i}") for i in n)} FROM fs),
fp AS (SELECT subject_id, pos, coverage, [{", ".join(f"p{i} / ({' + '.join(f'p{j}' for j in n)})" for i in n)}] AS probs FROM ff),
fl AS (SELECT *, [{", ".join(f"'{t}'" for t in types)}][list_position(probs, list_max(probs))] AS label, list_max(probs) AS confidence FROM fp)"""


_FILLED = f"{PROBS}, {filled_sql(TYPES)}"
FRAME_LABELS = f"WITH {_FILLED}"


def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with probabilities from windows that leave some ends uncovered."""
    return fu.frame_probabilities(window_probs(spark, sf_dir), frames(spark, sf_dir), TYPES)


@query("a2_j4_frame_probabilities", f"{FRAME_LABELS} SELECT subject_id, pos, coverage, label, round(confidence, 8) AS confidence, round(probs[1], 8) AS first FROM fl")
def frame_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window probabilities to frames, the nearest covered frame's where none covers, and the likeliest class."""
    out = frame_labels(spark, sf_dir)
    return out.select("subject_id", "pos", "coverage", "label", F.round("confidence", 8).alias("confidence"), F.round(F.col("probs")[0], 8).alias("first"))


@query("a4_vote_means", f"WITH {COVERED} SELECT e.subject_id, e.pos, coalesce(coverage, 0) AS coverage, round(coalesce(p1, 0), 8) AS second FROM ev e LEFT JOIN fm USING (subject_id, pos)")
def vote_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with zeros where no window covers (A3, A4)."""
    windows = window_probs(spark, sf_dir).withColumn("probs", x.normalised(F.col("probs")))
    out = fu.vote_means(windows, frames(spark, sf_dir), TYPES)
    return out.select("subject_id", "pos", "coverage", F.round(F.col("probs")[1], 8).alias("second"))


@query(
    "a19_group_majority",
    f"""{FRAME_LABELS}, g AS (SELECT CASE WHEN subject_id % 10 < 9 THEN subject_id % 10 END AS grp, label, confidence FROM fl), c AS (SELECT grp, label, count(*) AS n, avg(confidence) AS confidence FROM g GROUP BY grp, label)
SELECT grp, arg_max(label, (n, -list_position({_TYPE_LIST}, label))) AS label, CAST(sum(n) AS BIGINT) AS frames, round(arg_max(confidence, (n, -list_position({_TYPE_LIST}, label))), 6) AS confidence FROM c GROUP BY grp""",
)
def group_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label of each group of frames, NULL a group too."""
    rows = frame_labels(spark, sf_dir).withColumn("grp", F.when(F.col("subject_id") % 10 < 9, F.col("subject_id") % 10))
    return rounded(fu.group_majority(rows, "grp", TYPES), ["confidence"], 6)


_SQUARES = [f"CAST(embedding[{i + 1}] AS DOUBLE) * CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(8)]
_EIGHT = "e8 AS (SELECT vec_id, label, [" + ", ".join(f"{s} / ({' + '.join(_SQUARES)})" for s in _SQUARES) + "] AS p FROM embeddings)"


def eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, p``: squares of eight numbers of an embedding, normalised."""
    e = table(spark, sf_dir, "embeddings")
    value = lambda i: F.col("embedding")[i].cast("double")
    return e.select("vec_id", "label", x.normalised(F.array(*(value(i) * value(i) for i in range(8)))).alias("p"))


@query("m2_r1_normalised_argmax", f"WITH {_EIGHT} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS best, round(list_max(p), 8) AS confidence FROM e8")
def normalised_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised rows and their largest class."""
    return eight(spark, sf_dir).select("vec_id", x.argmax(F.col("p")).alias("best"), F.round(F.array_max("p"), 8).alias("confidence"))


@query(
    "m3_class_order",
    f"SELECT user_id, {', '.join(f"CAST(count(*) FILTER (event_type = '{t}') AS DOUBLE) AS {t}" for t in reversed(TYPES))} FROM events GROUP BY user_id",
)
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of class and value put into a fixed order, absent classes 0."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # an entry a class
    ordered = maps.select("user_id", x.in_class_order(F.col("m"), TYPES).alias("v"))
    return ordered.select("user_id", *(F.col("v")[i].alias(t) for i, t in enumerate(TYPES)))


_GATE = "[p[1] + p[3] + p[5] + p[7], p[2] + p[4] + p[6] + p[8]]"
_ODD = (1, 3, 5, 7)
_FUSED = "[" + ", ".join(f"greatest(p[{i + 1}] * power(greatest(g[{2 if i in _ODD else 1}], 1e-12), 0.5), 1e-12)" for i in range(8)) + "]"


@query(
    "m4_group_fusion",
    f"""WITH {_EIGHT}, gt AS (SELECT vec_id, p, {_GATE} AS g FROM e8), fu AS (SELECT vec_id, {_FUSED} AS u FROM gt)
SELECT vec_id, round(u[1] / list_sum(u), 8) AS first, round(u[8] / list_sum(u), 8) AS last, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS best FROM fu""",
)
def group_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities gated by those of two groups."""
    p = F.col("p")
    names = [str(i) for i in range(8)]
    gate = F.array(p[0] + p[2] + p[4] + p[6], p[1] + p[3] + p[5] + p[7])
    out = eight(spark, sf_dir).withColumn("u", x.group_fusion(p, gate, 0.5, names, [names[i] for i in _ODD]))
    u = F.col("u")
    return out.select("vec_id", F.round(u[0], 8).alias("first"), F.round(u[7], 8).alias("last"), x.argmax(u).alias("best"))


#: Weights that scales may be fused with.
FUSION_WEIGHTS = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.2, 0.6, 0.2), (0.5, 0.3, 0.2), (0.2, 0.3, 0.5))


@query(
    "m5_scale_fusion",
    f"""WITH {_EIGHT}, a AS (SELECT vec_id, [p[i] * 0.5 + p[9 - i] * 0.3 + p[i] * 0.2 FOR i IN range(1, 9)] AS u FROM e8)
SELECT vec_id, round(u[1] / list_sum(u), 8) AS first, round(u[4] / list_sum(u), 8) AS fourth FROM a""",
)
def scale_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scales' probabilities by declared weights."""
    out = eight(spark, sf_dir).withColumn("u", x.scale_fusion([F.col("p"), F.reverse("p"), F.col("p")], (0.5, 0.3, 0.2), FUSION_WEIGHTS))
    return out.select("vec_id", F.round(F.col("u")[0], 8).alias("first"), F.round(F.col("u")[3], 8).alias("fourth"))


_SCALES = ((8, 4), (16, 8), (24, 12))


def _scale_sql(i: int, size: int, stride: int) -> str:
    return f"z{i} AS (WITH {probs_sql(size, stride)}, {filled_sql(TYPES)} SELECT subject_id, pos, probs FROM fl)"


@query(
    "e12_fused_scales",
    f"""WITH {", ".join(_scale_sql(i, *s) for i, s in enumerate(_SCALES))}, u AS (SELECT subject_id, pos, [a.probs[i] * 0.2 + b.probs[i] * 0.6 + c.probs[i] * 0.2 FOR i IN range(1, {len(TYPES) + 1})] AS u
  FROM z0 a JOIN z1 b USING (subject_id, pos) JOIN z2 c USING (subject_id, pos)), v AS (SELECT subject_id, pos, [round(w / list_sum(u), 12) FOR w IN u] AS p FROM u)
SELECT subject_id, pos, {_TYPE_LIST}[list_position(p, list_max(p))] AS label, round(list_max(p), 8) AS confidence, CAST(1 AS BIGINT) AS coverage FROM v""",
)
def fused_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three sizes, put to frames one by one and fused by weights; equal probabilities are told from the twelfth digit on only."""
    told = [window_probs(spark, sf_dir, *s) for s in _SCALES]
    out = search.fused_scale_frames(told, (0.2, 0.6, 0.2), FUSION_WEIGHTS, frames(spark, sf_dir), TYPES)
    out = fu.labelled(out.withColumn("probs", F.transform("probs", lambda p: F.round(p, 12))), TYPES)
    return rounded(out.select("subject_id", "pos", "label", "confidence", "coverage"), ["confidence"])


# -- decoding ---------------------------------------------------------------------------------------------------------

_VALID = ("click", "error", "purchase", "view")
_VALID_SQL = ", ".join(f"'{t}'" for t in _VALID)
_STEPS = f"""{EV}, st AS (SELECT event_type AS label, lag(event_type) OVER (PARTITION BY subject_id ORDER BY pos) AS before FROM ev),
dim AS (SELECT unnest([{_VALID_SQL}]) AS class), mv AS (SELECT before, label, count(*) AS n FROM st WHERE label IN ({_VALID_SQL}) AND before IN ({_VALID_SQL}) GROUP BY before, label),
op AS (SELECT label, count(*) AS n FROM st WHERE label IN ({_VALID_SQL}) AND (before IS NULL OR before NOT IN ({_VALID_SQL})) GROUP BY label)"""


@query(
    "a22_transition_model",
    f"""WITH {_STEPS}, w AS (SELECT a.class AS before, b.class, CAST(coalesce(n, 0) + 1 AS DOUBLE) AS w FROM dim a CROSS JOIN dim b LEFT JOIN mv ON mv.before = a.class AND mv.label = b.class
  UNION ALL SELECT NULL, class, CAST(coalesce(n, 0) + 1 AS DOUBLE) FROM dim LEFT JOIN op ON op.label = class)
SELECT before, class, w / sum(w) OVER (PARTITION BY before) AS p FROM w""",
)
def transition_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed probabilities of first labels and of steps; one type ends runs."""
    initial, moves = dc.transition_model(frames(spark, sf_dir).withColumnRenamed("event_type", "label"), _VALID)
    return moves.unionByName(initial.select(F.lit(None).cast("string").alias("before"), "class", "p"))


def model_arrays(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """Transition and initial probabilities of all types as arrays: classes squared numbers."""
    initial, moves = dc.transition_model(frames(spark, sf_dir).withColumnRenamed("event_type", "label"), TYPES)
    both = initial.withColumn("before", F.lit(None).cast("string")).unionByName(moves).collect()  # one job: the frames are put in order once
    first = {r["class"]: r["p"] for r in both if r["before"] is None}
    step = {(r["before"], r["class"]): r["p"] for r in both if r["before"] is not None}
    return np.array([[step[a, b] for b in TYPES] for a in TYPES]), np.array([first[t] for t in TYPES])


@query("v1_viterbi_without_transitions", f"{FRAME_LABELS} SELECT subject_id, pos, label, round(confidence, 8) AS confidence FROM fl")
def viterbi_without_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At strength 0 the decoder takes each frame's likeliest class."""
    transition, initial = model_arrays(spark, sf_dir)
    out = dc.decode(frame_labels(spark, sf_dir).select("subject_id", "pos", "probs"), transition, initial, TYPES, 0.0)
    return rounded(out, ["confidence"])


_UNITS = "CAST(round_even(ln(greatest({}, 1e-12)) * {} * 4294967296, 0) AS BIGINT)"


def viterbi_sql(emissions: str, keys: str, types: Sequence[str]) -> str:
    """``vp(keys, subject_id, strength, pos, cls)``: the best path over ``emissions(keys, subject_id, pos, probs, strength)``, forwards frame by frame and back again, with
    the transitions of the labels of ``ev``."""
    k, by = len(types) + 1, ", ".join(filter(None, (keys, "subject_id")))
    return f"""sa AS (SELECT event_type AS label, lag(event_type) OVER (PARTITION BY subject_id ORDER BY pos) AS before FROM ev),
dim AS (SELECT unnest([{", ".join(f"'{t}'" for t in types)}]) AS class, unnest(range(1, {k})) AS i),
mv AS (SELECT before, label, count(*) AS n FROM sa WHERE before IS NOT NULL GROUP BY before, label), op AS (SELECT label, count(*) AS n FROM sa WHERE before IS NULL GROUP BY label),
wm AS (SELECT a.class AS before, a.i AS bi, b.class, b.i, CAST(coalesce(n, 0) + 1 AS DOUBLE) AS w FROM dim a CROSS JOIN dim b LEFT JOIN mv ON mv.before = a.class AND mv.label = b.class),
wi AS (SELECT i, CAST(coalesce(n, 0) + 1 AS DOUBLE) AS w FROM dim LEFT JOIN op ON op.label = class),
pm AS (SELECT bi, i, w / sum(w) OVER (PARTITION BY bi) AS p FROM wm), pi AS (SELECT i, w / sum(w) OVER () AS p FROM wi),
st_all AS (SELECT DISTINCT strength FROM {emissions}),
md AS (SELECT strength, (SELECT list(u ORDER BY i) FROM (SELECT i, {_UNITS.format("p", "strength")} AS u FROM pi)) AS first,
  (SELECT list(r ORDER BY bi) FROM (SELECT bi, list({_UNITS.format("p", "strength")} ORDER BY i) AS r FROM pm GROUP BY bi)) AS mv FROM st_all),
em AS MATERIALIZED (SELECT {by}, pos, probs, e.strength, first, mv, [{_UNITS.format("p", "1")} FOR p IN probs] AS u FROM {emissions} e JOIN md USING (strength)),
vt AS (
  SELECT {by}, strength, pos, [u[i] + first[i] FOR i IN range(1, {k})] AS s, CAST([] AS BIGINT[]) AS b FROM em WHERE pos = 0
  UNION ALL
  SELECT {by}, strength, pos, [list_max(r[j]) + u[j] FOR j IN range(1, {k})], [list_position(r[j], list_max(r[j])) FOR j IN range(1, {k})]
  FROM (SELECT {", ".join(f"e.{c}" for c in by.split(", "))}, e.strength, e.pos, e.u, [[v.s[i] + e.mv[i][j] FOR i IN range(1, {k})] FOR j IN range(1, {k})] AS r
    FROM vt v JOIN em e ON {" AND ".join(f"e.{c} = v.{c}" for c in by.split(", "))} AND e.strength = v.strength AND e.pos = v.pos + 1)
),
vl AS (SELECT {by}, strength, max(pos) AS pos, arg_max(list_position(s, list_max(s)), pos) AS cls FROM vt GROUP BY {by}, strength),
vp AS (
  SELECT {by}, strength, pos, cls FROM vl
  UNION ALL
  SELECT {", ".join(f"p.{c}" for c in by.split(", "))}, p.strength, p.pos - 1, v.b[p.cls] FROM vp p JOIN vt v ON {" AND ".join(f"v.{c} = p.{c}" for c in by.split(", "))} AND v.strength = p.strength AND v.pos = p.pos WHERE p.pos > 0
)"""


_RECURSIVE = f"WITH RECURSIVE {_FILLED}"


@query("v1_viterbi", f"{_RECURSIVE}, e1 AS (SELECT subject_id, pos, probs, 1.0::DOUBLE AS strength FROM fl), {viterbi_sql('e1', '', TYPES)} SELECT subject_id, pos, {_TYPE_LIST}[cls] AS label, round(probs[cls], 8) AS confidence FROM vp JOIN em USING (subject_id, strength, pos)")
def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels smoothed by the transition model."""
    transition, initial = model_arrays(spark, sf_dir)
    out = dc.decode(frame_labels(spark, sf_dir).select("subject_id", "pos", "probs"), transition, initial, TYPES, 1.0)
    return rounded(out, ["confidence"])


#: Settings of gate and decoder that are searched.
GATE_ALPHAS, DECODER_STRENGTHS = (0.0, 0.5, 1.0, 2.0), (0.0, 0.25, 0.5, 1.0, 2.0)


def _grid_sql() -> str:
    bad = [t in BAD_TYPES for t in TYPES]
    gate = {True: " + ".join(f"probs[{i + 1}]" for i in K if bad[i]), False: " + ".join(f"probs[{i + 1}]" for i in K if not bad[i])}
    fused = ", ".join(f"greatest(probs[{i + 1}] * power(greatest({gate[bad[i]]}, 1e-12), alpha), 1e-12)" for i in K)
    alphas, strengths = (f"[{', '.join(f'{v}::DOUBLE' for v in x)}]" for x in (GATE_ALPHAS, DECODER_STRENGTHS))
    return f"""{_RECURSIVE}, gs AS (SELECT a.alpha, s.strength FROM (SELECT unnest({alphas}) AS alpha) a, (SELECT unnest({strengths}) AS strength) s),
gf AS (SELECT subject_id, pos, alpha, strength, [{fused}] AS g FROM fl CROSS JOIN gs), ge AS (SELECT subject_id, pos, alpha, strength, [v / list_sum(g) FOR v IN g] AS probs FROM gf), {viterbi_sql("ge", "alpha", TYPES)},
pr AS (SELECT alpha, strength, subject_id, pos, event_type AS truth, {_TYPE_LIST}[cls] AS pred FROM vp JOIN ev USING (subject_id, pos))
{{evaluate}}"""


@query("v2_gate_decoder_grid")
def gate_decoder_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 of each setting of gate and decoder."""
    transition, initial = model_arrays(spark, sf_dir)
    own = frame_labels(spark, sf_dir).select("subject_id", "pos", "probs")
    p = F.col("probs")
    gate = own.select("subject_id", "pos", F.array(p[0] + p[3] + p[4], p[1] + p[2]).alias("probs"))
    truth = frames(spark, sf_dir).select("subject_id", "pos", F.col("event_type").alias("truth"))
    told = dc.decode_grid(own, gate, truth, transition, initial, TYPES, BAD_TYPES, GATE_ALPHAS, DECODER_STRENGTHS)
    return rounded(mt.evaluate(mt.counts(told, ["alpha", "strength"], pred="label"), TYPES, BAD_TYPES, ["alpha", "strength"]), ["macro_f1"])


# -- evaluation -------------------------------------------------------------------------------------------------------


def _evaluate_sql(group: str = "", present: bool = False) -> str:
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    f1 = [
        f"coalesce(2.0::DOUBLE * count(*) FILTER (truth = '{t}' AND pred = '{t}') / nullif(count(*) FILTER (truth = '{t}') + count(*) FILTER (pred = '{t}'), 0), 0)"
        for t in TYPES
    ]
    there = " + ".join(f"CAST(count(*) FILTER (truth = '{t}' OR pred = '{t}') > 0 AS INTEGER)" for t in TYPES) if present else str(len(TYPES))
    tp, said, real = (f"count(*) FILTER ({c})" for c in (f"truth IN ({_BAD}) AND pred IN ({_BAD})", f"pred IN ({_BAD})", f"truth IN ({_BAD})"))
    return f"""SELECT {g}CAST(count(*) FILTER (truth = pred) AS DOUBLE) / count(*) AS accuracy, round(({" + ".join(f1)}) / ({there}), 8) AS macro_f1,
coalesce(CAST({tp} AS DOUBLE) / nullif({said}, 0), 0) AS abnormal_precision, coalesce(CAST({tp} AS DOUBLE) / nullif({real}, 0), 0) AS abnormal_recall, coalesce(2.0::DOUBLE * {tp} / nullif({said} + {real}, 0), 0) AS abnormal_f1 FROM pr {by}"""


ORACLES["v2_gate_decoder_grid"] = _grid_sql().replace("{evaluate}", _evaluate_sql("alpha, strength"))


@query("a7_a9_evaluate", f"WITH {PRED} {_evaluate_sql('subject_id')}")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each subject over all classes, rows without a true class left out."""
    rows = mt.valid_truth(predictions(spark, sf_dir), TYPES)
    return rounded(mt.evaluate(mt.counts(rows, ["subject_id"]), TYPES, BAD_TYPES, ["subject_id"]), ["macro_f1"])


@query("a8_evaluate_present_classes", f"WITH {PRED} {_evaluate_sql('subject_id, part', True)}".replace("FROM pr GROUP", "FROM (SELECT *, pos // 4 AS part FROM pr) pr GROUP"))
def evaluate_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every four rows of each subject over the classes found in them."""
    rows = predictions(spark, sf_dir).withColumn("part", F.floor(F.col("pos") / 4))
    by = ["subject_id", "part"]
    return rounded(mt.evaluate(mt.counts(rows, by), TYPES, BAD_TYPES, by, present_only=True), ["macro_f1"])


@query(
    "a10_confusion_matrix",
    f"""WITH {PRED}, d AS (SELECT unnest(range({len(TYPES)})) AS i) SELECT CAST(i AS INTEGER) AS class_idx, {_TYPE_LIST}[i + 1] AS truth, {", ".join(f"count(*) FILTER (pred = '{t}') AS {t}" for t in TYPES)} FROM d LEFT JOIN pr ON pr.truth = {_TYPE_LIST}[i + 1] GROUP BY i""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth by prediction, filled with zeros."""
    return mt.confusion(mt.counts(predictions(spark, sf_dir)), TYPES)


_CELLS = f"""{PRED}, dm AS (SELECT unnest({_TYPE_LIST}) AS c), cl AS (SELECT a.c AS truth, b.c AS pred, count(pr.pos) AS frames FROM dm a CROSS JOIN dm b LEFT JOIN (SELECT * FROM pr WHERE truth <> 'view') pr ON pr.truth = a.c AND pr.pred = b.c GROUP BY a.c, b.c),
rt AS (SELECT truth, pred, frames, coalesce(CAST(frames AS DOUBLE) / nullif(sum(frames) OVER (PARTITION BY truth), 0), 0) AS rate FROM cl)"""


@query("a12_confusion_rates", f"WITH {_CELLS} SELECT * FROM rt")
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each true class; one class has no rows."""
    return mt.confusion_rates(mt.counts(predictions(spark, sf_dir).where("truth <> 'view'")), TYPES)


@query("r7_top_confusions", f"WITH {_CELLS} SELECT * FROM rt WHERE truth <> pred ORDER BY rate DESC, frames DESC, truth, pred LIMIT 10")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest confusions by rate."""
    return mt.top_confusions(mt.counts(predictions(spark, sf_dir).where("truth <> 'view'")), TYPES, 10)


_PR = f"""{PRED}, cs AS (SELECT c AS name, count(*) FILTER (pred = c AND truth = c) AS hit, count(*) FILTER (pred = c) AS said, count(*) FILTER (truth = c) AS support FROM pr, (SELECT unnest({_TYPE_LIST}) AS c) GROUP BY c),
pc AS (SELECT name, coalesce(CAST(hit AS DOUBLE) / nullif(said, 0), 0) AS precision, coalesce(CAST(hit AS DOUBLE) / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * hit / nullif(said + support, 0), 0) AS f1, support FROM cs),
al AS (SELECT * FROM pc UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT CAST(count(*) FILTER (truth = pred) AS DOUBLE) / count(*) AS a, count(*) AS n FROM pr)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc)"""


@query("a11_classification_report", f"WITH {_PR} SELECT name, {round_sql(['precision', 'recall', 'f1'])}, support FROM al")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support by class, and their averages."""
    return rounded(mt.report(mt.counts(predictions(spark, sf_dir)), TYPES), ["precision", "recall", "f1"])


@query(
    "a13_a14_class_weights",
    f"""WITH n AS (SELECT c, i, count(event_id) AS n FROM (SELECT unnest({_TYPE_LIST}) AS c, unnest(range({len(TYPES)})) AS i) LEFT JOIN (SELECT * FROM events WHERE event_type <> 'view') e ON e.event_type = c GROUP BY c, i),
t AS (SELECT *, sum(n) OVER () AS t, count(*) FILTER (n > 0) OVER () AS present, count(*) OVER () AS k FROM n), w AS (SELECT *, CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / (present * n) END AS balanced, CAST(t AS DOUBLE) / greatest(n, 1) AS inv FROM t)
SELECT CAST(i AS INTEGER) AS class_idx, c AS class, n, balanced, sqrt(balanced) AS root_balanced, round(inv / avg(inv) OVER (), 8) AS mean_scaled, sqrt(CAST(t AS DOUBLE) / (k * greatest(n, 1))) AS root_all FROM w""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weightings of classes, one of which has no rows."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'")
    return rounded(mt.class_weights(mt.class_counts(rows, TYPES, "event_type")), ["mean_scaled"])


@query("a15_channel_stats", f"WITH {POSE} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, round(avg({c}), 8) AS mean, round(CASE WHEN stddev_pop({c}) <= 1e-5 THEN 1.0 ELSE stddev_pop({c}) END, 8) AS std FROM pose" for c in COORDS))
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of channels."""
    return rounded(mt.channel_stats(poses(spark, sf_dir), COORDS), ["mean", "std"])


_FOLD = "(SELECT CAST(subject_id % 4 AS BIGINT) AS held_out_subject, truth, pred FROM pr)"


@query("a16_e1_pooled_and_folds", f"WITH {PRED} {_evaluate_sql('held_out_subject').replace('FROM pr', f'FROM {_FOLD}')} UNION ALL SELECT NULL, * FROM ({_evaluate_sql()})")
def pooled_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of folds and of all rows."""
    rows = predictions(spark, sf_dir).withColumn("held_out_subject", F.col("subject_id") % 4)
    return rounded(mt.pooled_and_folds(rows, TYPES, BAD_TYPES), ["macro_f1"])


@query(
    "a17_r10_fold_summary",
    f"""WITH {PRED}, f AS ({_evaluate_sql("held_out_subject").replace("FROM pr", f"FROM {_FOLD}")}), u AS (UNPIVOT (SELECT held_out_subject, accuracy, macro_f1, abnormal_f1 FROM f) ON accuracy, macro_f1, abnormal_f1 INTO NAME metric VALUE v)
SELECT metric, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, round(min(v), 7) AS least, arg_min(held_out_subject, (v, held_out_subject)) AS worst_subject FROM u GROUP BY metric""",
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and worst subject of fold metrics."""
    rows = predictions(spark, sf_dir).withColumn("held_out_subject", F.col("subject_id") % 4)
    folds = mt.evaluate(mt.counts(rows, ["held_out_subject"]), TYPES, BAD_TYPES, ["held_out_subject"])
    return rounded(mt.fold_summary(folds, ["accuracy", "macro_f1", "abnormal_f1"]), ["mean", "std", "least"], 7)


# -- selection --------------------------------------------------------------------------------------------------------

_SUMMARY = "avg(accuracy) AS mean_accuracy, min(accuracy) AS least_accuracy, avg(macro_f1) AS mean_macro_f1, avg(abnormal_f1) AS mean_abnormal_f1, count(*) AS n_scores"
_RANK = "mean_accuracy DESC, least_accuracy DESC, mean_macro_f1 DESC, mean_abnormal_f1 DESC, candidate_index"
_MEANS = ("mean_accuracy", "least_accuracy", "mean_macro_f1", "mean_abnormal_f1")


@query("a6_r2_ranked_settings", f"WITH {SCORES}, s AS (SELECT candidate_index, {_SUMMARY} FROM sc GROUP BY candidate_index), r AS (SELECT *, row_number() OVER (ORDER BY {_RANK}) AS place FROM s) SELECT candidate_index, CAST(place AS INTEGER) AS place, n_scores, {round_sql(_MEANS)} FROM r")
def ranked_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by four keys, equals by index."""
    out = sl.ranked(sl.summarise(scores(spark, sf_dir), ["candidate_index"]), ["candidate_index"])
    return rounded(out, _MEANS)


@query("r3_r4_top_settings", f"WITH {SCORES}, s AS (SELECT validation_subject, candidate_index, {_SUMMARY} FROM sc GROUP BY ALL) SELECT validation_subject, candidate_index, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY validation_subject ORDER BY {_RANK}) AS place FROM s) WHERE place <= 2")
def top_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best settings of each group."""
    return sl.best(scores(spark, sf_dir), ["candidate_index"], ["validation_subject"], 2).select("validation_subject", "candidate_index", "place")


_SUBJ = "su AS (SELECT DISTINCT CAST(l_suppkey % 4 + 1 AS INTEGER) AS s FROM lineitem)"
_SPLITS = f"{_SUBJ}, sp AS (SELECT o.s AS outer_subject, v.s AS validation_subject, string_agg(CAST(t.s AS VARCHAR), '_' ORDER BY t.s) AS train_subjects FROM su o JOIN su v ON o.s <> v.s JOIN su t ON t.s NOT IN (o.s, v.s) GROUP BY o.s, v.s)"


def four_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of the score table."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4 + 1).cast("int").alias("subject_id")).distinct()


@query("e2_e3_inner_splits", f"WITH {_SUBJ} SELECT o.s AS outer_subject, v.s AS validation_subject, string_agg(CAST(t.s AS VARCHAR), '_' ORDER BY t.s) AS train FROM su o JOIN su v ON o.s <> v.s JOIN su t ON t.s NOT IN (o.s, v.s) GROUP BY o.s, v.s")
def inner_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner splits of every outer subject, checked for leaks."""
    out = sl.checked_audit(sl.inner_split_table(four_subjects(spark, sf_dir)))
    return out.select("outer_subject", "validation_subject", F.array_join("train_subjects", "_").alias("train"))


@query("j9_j7_subject_pairs", f"WITH {_SUBJ} SELECT a.s AS a, b.s AS b FROM su a JOIN su b ON a.s < b.s")
def subject_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of subjects."""
    return sl.unordered_pairs(four_subjects(spark, sf_dir))


@query(
    "e8_outer_choices",
    f"""WITH {_SUBJ}, {SCORES}, sp AS (SELECT o.s AS outer_subject, v.s AS validation_subject, string_agg(CAST(t.s AS VARCHAR), '_' ORDER BY t.s) AS train_subjects FROM su o JOIN su v ON o.s <> v.s JOIN su t ON t.s NOT IN (o.s, v.s) GROUP BY o.s, v.s),
s AS (SELECT outer_subject, candidate_index, {_SUMMARY} FROM sc JOIN sp USING (validation_subject, train_subjects) GROUP BY ALL)
SELECT outer_subject, candidate_index, n_scores, {round_sql(_MEANS)} FROM (SELECT *, row_number() OVER (PARTITION BY outer_subject ORDER BY {_RANK}) AS place FROM s) WHERE place = 1""",
)
def outer_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outer subject's setting by scores that never saw it."""
    out = sl.outer_choices(scores(spark, sf_dir), sl.inner_split_table(four_subjects(spark, sf_dir)))
    return rounded(out.select("outer_subject", "candidate_index", "n_scores", *_MEANS), _MEANS)


_SETTING = ("candidate_index", "threshold", "stride")


@query(
    "e9_e11_scale_settings",
    f"""WITH {_SPLITS}, {scores_sql(("scale", "threshold", "stride"))}, s AS (SELECT outer_subject, scale, {", ".join(_SETTING)}, {_SUMMARY} FROM sc JOIN sp USING (validation_subject, train_subjects) GROUP BY ALL)
SELECT outer_subject, scale, {", ".join(_SETTING)}, n_scores, {round_sql(_MEANS)} FROM (SELECT *, row_number() OVER (PARTITION BY outer_subject, scale ORDER BY {_RANK}, threshold, stride) AS place FROM s) WHERE place = 1""",
)
def scale_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outer subject's candidate, threshold and stride for each scale; every setting must have all of its scores."""
    s = scores(spark, sf_dir, ("scale", "threshold", "stride"))
    out = sl.outer_choices(s, sl.inner_split_table(four_subjects(spark, sf_dir)), _SETTING, ("scale",))
    return rounded(out.select("outer_subject", "scale", *_SETTING, "n_scores", *_MEANS), _MEANS)


@query("e7_c8_remaining_settings", f"WITH {SCORES} SELECT DISTINCT candidate_index, validation_subject FROM sc WHERE (candidate_index, validation_subject) NOT IN (SELECT candidate_index, validation_subject FROM sc WHERE accuracy > 0.05)")
def remaining_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a grid that a resumed search still has to score."""
    s = scores(spark, sf_dir)
    keys = ["candidate_index", "validation_subject"]
    return sl.remaining(s.select(*keys).distinct(), s.where("accuracy > 0.05"), keys)


@query("a18_median_setting", f"WITH {SCORES} SELECT greatest(CAST(round_even(median(candidate_index), 0) AS BIGINT), 1) AS candidate_index FROM sc")
def median_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a setting, halves to the even number."""
    return sl.median_setting(scores(spark, sf_dir), "candidate_index")


_EXPERIMENTS = "ex AS (SELECT 'c' || candidate_index AS experiment, candidate_index, avg(abnormal_f1) AS pooled_abnormal_f1, min(accuracy) AS worst_subject_accuracy, avg(macro_f1) AS pooled_macro_f1, avg(accuracy) AS accuracy FROM sc GROUP BY candidate_index)"


@query("r5_best_experiment", f"WITH {SCORES}, {_EXPERIMENTS} SELECT experiment FROM ex ORDER BY pooled_abnormal_f1 DESC, worst_subject_accuracy DESC, pooled_macro_f1 DESC, experiment LIMIT 1")
def best_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several experiments."""
    s = scores(spark, sf_dir).groupBy(F.concat(F.lit("c"), F.col("candidate_index").cast("string")).alias("experiment")).agg(
        F.avg("abnormal_f1").alias("pooled_abnormal_f1"), F.min("accuracy").alias("worst_subject_accuracy"), F.avg("macro_f1").alias("pooled_macro_f1")
    )
    return sl.best_experiment(s).select("experiment")


@query(
    "r6_e15_eligible_candidates",
    f"""WITH {SCORES}, pv AS (SELECT candidate_index, validation_subject, avg(accuracy) AS a FROM sc GROUP BY ALL), c AS (SELECT candidate_index, round(avg(accuracy), 8) AS accuracy, round(avg(macro_f1), 8) AS macro_f1, round(avg(abnormal_f1), 8) AS abnormal_f1, round((SELECT min(a) FROM pv WHERE pv.candidate_index = sc.candidate_index), 8) AS worst FROM sc GROUP BY candidate_index),
b AS (SELECT * FROM c WHERE candidate_index = 3), r AS (SELECT c.candidate_index, c.accuracy, c.worst, c.macro_f1, c.abnormal_f1, c.candidate_index = 3 OR (c.abnormal_f1 >= b.abnormal_f1 - 0.005 AND c.worst >= b.worst
  AND (SELECT count(*) FROM pv x WHERE x.candidate_index = c.candidate_index) = (SELECT count(*) FROM pv x WHERE x.candidate_index = 3)
  AND NOT EXISTS (SELECT 1 FROM pv x JOIN pv y ON x.validation_subject = y.validation_subject WHERE x.candidate_index = c.candidate_index AND y.candidate_index = 3 AND x.a < y.a - 0.05)) AS eligible FROM c, b)
SELECT 'c' || candidate_index AS name, eligible, CAST(CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY accuracy DESC, worst DESC, macro_f1 DESC, abnormal_f1 DESC, candidate_index) END AS INTEGER) AS place FROM r""",
)
def eligible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that may replace a baseline, and their order."""
    s = scores(spark, sf_dir).withColumn("name", F.concat(F.lit("c"), F.col("candidate_index").cast("string")))
    own = s.groupBy("name", "validation_subject").agg(F.avg("accuracy").alias("a"))
    maps = own.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("validation_subject", "a"))).alias("subjects"), F.round(F.min("a"), 8).alias("worst_accuracy"))
    mean = s.groupBy("name").agg(*(F.round(F.avg(c), 8).alias(c) for c in ("accuracy", "macro_f1", "abnormal_f1")))
    return sl.eligible_candidates(mean.join(maps, "name"), "c3").select("name", "eligible", "place")


def _metric_table(spark: SparkSession, sf_dir: str, index: int) -> DataFrame:
    s = scores(spark, sf_dir).where(F.col("candidate_index") == index)
    return s.groupBy(F.col("validation_subject").alias("held_out_subject")).agg(F.round(F.avg("accuracy"), 8).alias("accuracy"))


@query(
    "j1_j2_fold_deltas",
    f"WITH {SCORES}, m AS (SELECT candidate_index AS i, validation_subject AS held_out_subject, round(avg(accuracy), 8) AS accuracy FROM sc GROUP BY ALL) SELECT a.held_out_subject, a.accuracy AS accuracy_a, b.accuracy AS accuracy_b, c.accuracy AS accuracy_c, round(b.accuracy - a.accuracy, 8) + 0.0 AS delta_accuracy_b, round(c.accuracy - a.accuracy, 8) + 0.0 AS delta_accuracy_c FROM m a JOIN m b USING (held_out_subject) JOIN m c USING (held_out_subject) WHERE a.i = 1 AND b.i = 2 AND c.i = 3",
)
def fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three experiments side by side by fold, and their differences."""
    out = sl.deltas({n: _metric_table(spark, sf_dir, i) for i, n in enumerate("abc", 1)}, "held_out_subject", ["accuracy"], "a")
    return rounded(out, ["delta_accuracy_b", "delta_accuracy_c"])


@query("e10_fusion_weights", f"WITH {SCORES}, w AS (SELECT unnest([0, 1, 2]) AS weight_index, unnest([0.2, 0.5, 0.8]) AS w), s AS (SELECT weight_index, candidate_index, w * accuracy + (1 - w) * macro_f1 AS v FROM sc CROSS JOIN w) SELECT weight_index, candidate_index, round(avg(v), 8) AS mean FROM s GROUP BY ALL")
def fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight of a small grid with every score, summarised."""
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("weight_index"), F.lit(w).alias("w")) for i, w in enumerate((0.2, 0.5, 0.8)))))
    s = scores(spark, sf_dir).withColumn("g", grid).withColumn("v", F.col("g.w") * F.col("accuracy") + (1 - F.col("g.w")) * F.col("macro_f1"))
    return s.groupBy("g.weight_index", "candidate_index").agg(F.round(F.avg("v"), 8).alias("mean"))


# -- files, keys ------------------------------------------------------------------------------------------------------


@query("k1_k2_filled_predictions", f"{FRAME_LABELS} SELECT e.event_id, label AS predicted_label, round(confidence, 8) AS prediction_confidence FROM ev e JOIN fl USING (subject_id, pos)")
def filled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their predictions, as the writers put them."""
    out = files.filled(frames(spark, sf_dir), frame_labels(spark, sf_dir), TYPES)
    return out.select("event_id", "predicted_label", F.round("prediction_confidence", 8).alias("prediction_confidence"))


@query("m6_m7_signatures", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS signature, CAST(user_id AS VARCHAR) || '_' || event_type AS key FROM events")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of settings as JSON with sorted names, and joined keys."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("signature"), F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("key"))


@query("j10_u3_tables_equal", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ FROM (SELECT DISTINCT o_custkey FROM orders)")
def tables_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to the same table, and the rows that only one has."""
    a = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey")
    differ = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differ"))
    return a.agg(F.count("*").alias("n")).crossJoin(differ)  # one row with one row


# -- learning ---------------------------------------------------------------------------------------------------------

_FEATURES = tuple(COORDS)


def learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled windows: 34 features, three classes, four subjects."""
    p = fr.with_pos(table(spark, sf_dir, "embeddings"), "label", ["vec_id"])
    label = F.concat(F.lit("c"), (F.col("label") % 3).cast("string"))
    return p.select("vec_id", (F.col("vec_id") % 4).cast("int").alias("subject_id"), label.alias("label"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_FEATURES)))


_FEAT = "ft AS (SELECT 'c' || (label % 3) AS label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(_FEATURES)) + " FROM embeddings)"
_BINS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, label, CAST(least(floor(({c} - min({c}) OVER ()) * 10 / (max({c}) OVER () - min({c}) OVER ())), 9) AS INTEGER) AS bin FROM ft" for c in _FEATURES
)


@query(
    "l7_binned_information",
    f"""WITH {_FEAT}, b AS ({_BINS}), n AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl FROM n)
SELECT feature, round(greatest(sum(n / t * ln(n * t / (nb * nl))), 0), 8) AS information FROM t GROUP BY feature""",
)
def binned_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of features and label."""
    return rounded(ln.binned_information(learning_rows(spark, sf_dir), _FEATURES), ["information"])


def _psi(n: str) -> str:
    """The digamma function in SQL: the asymptotic series ten steps on, less the steps."""
    far = f"({n} + 10.0::DOUBLE)"
    steps = " + ".join(f"1 / ({n} + {i}.0::DOUBLE)" for i in range(10))
    return f"(ln({far}) - 1 / (2 * {far}) - 1 / (12 * {far} * {far}) + 1 / (120 * power({far}, 4)) - 1 / (252 * power({far}, 6)) - ({steps}))"


@query(
    "l7_neighbour_information",
    f"""WITH {_FEAT}, fl AS (UNPIVOT (SELECT row_number() OVER () AS id, * FROM ft) ON {", ".join(_FEATURES)} INTO NAME feature VALUE v), nl AS (SELECT label, count(*) AS n FROM ft GROUP BY label HAVING count(*) > 1),
dd AS (SELECT a.feature, a.id, a.v, abs(b.v - a.v) AS d, a.label = b.label AND a.id <> b.id AS own, nl.n FROM fl a JOIN fl b USING (feature) JOIN nl ON nl.label = a.label WHERE b.label IN (SELECT label FROM nl)),
rr AS (SELECT feature, id, n, list(d ORDER BY d) FILTER (own)[least(3, n - 1)] AS r FROM dd GROUP BY feature, id, n),
mm AS (SELECT feature, id, n, count(*) FILTER (d < r OR d = 0) AS m FROM dd JOIN rr USING (feature, id, n) GROUP BY feature, id, n)
SELECT feature, round(greatest({_psi("count(*)")} + avg({_psi("least(3, n - 1)")}) - avg({_psi("n")}) - avg({_psi("m")}), 0), 8) AS information FROM mm GROUP BY feature""",
)
def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of features and label by the third neighbour of the own label."""
    return rounded(information.neighbour_information(learning_rows(spark, sf_dir), _FEATURES), ["information"])


_RANKS = "rk AS MATERIALIZED (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _FEATURES) + " FROM ft)"
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rk" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :])


@query("l6_rank_correlations", f"WITH {_FEAT}, {_RANKS} SELECT a, b, round(r, 6) AS r FROM ({_CORR})")
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's correlation of each pair of features."""
    r = ln.rank_correlations(learning_rows(spark, sf_dir), _FEATURES)
    rows = [(a, b, round(float(r[i, j]), 6)) for i, a in enumerate(_FEATURES) for j, b in enumerate(_FEATURES) if i < j]
    return spark.createDataFrame(rows, "a string, b string, r double")


@query("l3_l8_selected_features")
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by information, after constant and correlated ones are gone."""
    rows = learning_rows(spark, sf_dir).withColumns({"copy": F.col(_FEATURES[0]) * 2, "constant": F.lit(1.0)})
    chosen = ln.fit_selector(rows, [*_FEATURES, "copy", "constant"], budget=6)
    return spark.createDataFrame([(i, c, chosen.scores[c]) for i, c in enumerate(chosen.features)], "place int, feature string, information double")


#: Small trees and few rounds of them, as the rows are few.
_TREES = boosting.Settings(rounds=8, rate=0.3, leaves=6, min_leaf=10, bins=64)


@query("l1_e1_leave_one_subject_out")
def leave_one_subject_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of boosted trees by held-out subject and pooled."""
    rows = learning_rows(spark, sf_dir)
    subjects = sorted(r["subject_id"] for r in rows.select("subject_id").distinct().collect())  # a row a subject
    return boosting.leave_one_subject_out(rows, _FEATURES, ("c0", "c1", "c2"), ("c1",), subjects, ["vec_id"], _TREES)[1]


@query("l1_l2_boosted_rows")
def boosted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's class and confidence by the trees of the other subjects, with early stopping (L1, L2)."""
    rows = learning_rows(spark, sf_dir)
    model = boosting.fit_boosted(rows, _FEATURES, ("c0", "c1", "c2"), ["vec_id"], settings=_TREES, weighting="root", fold=F.col("subject_id"), folds=(0,))[0]
    return model.predict(rows.where("subject_id = 0")).select("vec_id", "label", "pred", F.round("confidence", 8).alias("confidence"))


@query("l10_perceptron")
def perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of perceptrons by held-out subject and pooled."""
    rows, names, told = learning_rows(spark, sf_dir), ("c0", "c1", "c2"), []
    for held in sorted(r["subject_id"] for r in rows.select("subject_id").distinct().collect()):  # a row a subject
        train, test = sl.leave_one_out(rows, held)
        own = ln.predict(ln.fit_perceptron(train, _FEATURES, names), test, _FEATURES, names)
        told.append(own.select(F.lit(held).alias("held_out_subject"), F.col("label").alias("truth"), "pred"))
    return mt.pooled_and_folds(reduce(DataFrame.unionByName, told), names, ("c1",))


_TURN = math.radians(30.0)


@query(
    "l13_mirror_rotate_scale",
    f"""WITH {POSE} SELECT subject_id, pos, round((-right_wrist_x * cos({_TURN!r}) - right_wrist_y * sin({_TURN!r})) * 1.1, 8) AS left_wrist_x, round((-right_wrist_x * sin({_TURN!r}) + right_wrist_y * cos({_TURN!r})) * 1.1, 8) AS left_wrist_y FROM pose""",
)
def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose mirrored, turned and scaled."""
    out = ln.rotated_and_scaled(ln.mirrored(poses(spark, sf_dir)), 30.0, 1.1)
    return rounded(out.select("subject_id", "pos", "left_wrist_x", "left_wrist_y"), ["left_wrist_x", "left_wrist_y"])


@query(
    "l14_focal_loss",
    """WITH e AS (SELECT vec_id, label % 4 + 1 AS t, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 5)] AS z FROM embeddings), l AS (SELECT vec_id, z[t] - list_max(z) - ln(list_sum([exp(v - list_max(z)) FOR v IN z])) AS lp FROM e)
SELECT vec_id, round(-power(1 - exp(lp), 2) * lp, 8) AS loss FROM l""",
)
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal cross-entropy of four logits."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.array(*(F.col("embedding")[i].cast("double") for i in range(4)))
    return e.select("vec_id", F.round(ln.focal_loss(logits, F.col("label") % 4), 8).alias("loss"))
