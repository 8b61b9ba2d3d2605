"""Where queries register, and how the driver's tables stand in for frames, labels, probabilities and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewindow.operators.frames import with_pos
from tidewindow.operators.windows import frames_in_windows
from tidewindow.schema import COORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
BAD_TYPES = ("error", "purchase")
SIZE, STRIDE = 8, 4


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir), and SQL for its rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 8) -> DataFrame:
    """Doubles whose last bits depend on the order of sums, rounded; -0 is 0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def round_sql(columns: Sequence[str], digits: int = 8) -> str:
    """The same in SQL."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# -- events: a subject is a user, a frame one of its events ------------------------------------------------------------


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, pos, event_id, ts, event_type, value, props`` of events."""
    return with_pos(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).drop("user_id")


def gappy() -> Column:
    """The value with two of seven frames missing."""
    return F.when(~(F.col("pos") % 7).isin(2, 3), F.col("value"))


EV = """ev AS (SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id, ts, event_type, value, props FROM events)"""
GAPPY = "CASE WHEN pos % 7 NOT IN (2, 3) THEN value END"


def windows_sql(size: int, stride: int, tail: bool, name: str = "win", source: str = "ev") -> str:
    """``name(subject_id, start_pos, end_pos)``."""
    more = f" UNION SELECT subject_id, greatest(n - {size}, 0) FROM {name}_n" if tail else ""
    return f"""{name}_n AS (SELECT subject_id, count(*) AS n FROM {source} GROUP BY subject_id),
{name}_s AS (SELECT subject_id, unnest(range(0, greatest(n - {size}, 0) + 1, {stride})) AS start_pos FROM {name}_n{more}),
{name} AS (SELECT s.subject_id, s.start_pos, least(s.start_pos + {size}, n) AS end_pos FROM {name}_s s JOIN {name}_n USING (subject_id))"""


def framed_sql(name: str = "win", source: str = "ev", out: str = "fr") -> str:
    """``out``: frames with the windows that hold them."""
    return f"{out} AS (SELECT w.start_pos, w.end_pos, e.* FROM {name} w JOIN {source} e ON e.subject_id = w.subject_id AND e.pos >= w.start_pos AND e.pos < w.end_pos)"


WIN = f"WITH {EV}, {windows_sql(SIZE, STRIDE, True)}, {framed_sql()}"

# -- embeddings: a subject is a label, the first 34 numbers are a pose -------------------------------------------------


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, pos`` and 34 coordinates of embeddings."""
    rows = with_pos(table(spark, sf_dir, "embeddings"), "label", ["vec_id"])
    return rows.select("subject_id", "pos", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COORDS)))


_VALUES = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(COORDS))
POSE = f"pose AS (SELECT label AS subject_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, {_VALUES} FROM embeddings)"

# -- predictions, probabilities, scores ---------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, pos, truth, pred``: an event's type, and the type before it as its prediction."""
    before = F.lag("event_type").over(Window.partitionBy("subject_id").orderBy("pos"))
    rows = frames(spark, sf_dir).select("subject_id", "pos", F.col("event_type").alias("truth"), before.alias("pred"))
    return rows.where("pred is not null")


PRED = f"{EV}, pr AS (SELECT * FROM (SELECT subject_id, pos, event_type AS truth, lag(event_type) OVER (PARTITION BY subject_id ORDER BY pos) AS pred FROM ev) WHERE pred IS NOT NULL)"


def window_probs(spark: SparkSession, sf_dir: str, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """``subject_id, start_pos, end_pos, probs``: shares of the event types in a window, each counted once more."""
    framed = frames_in_windows(frames(spark, sf_dir), size, stride)
    counts = [(F.count_if(F.col("event_type") == t) + 1).cast("double") for t in TYPES]
    own = framed.groupBy("subject_id", "start_pos").agg((F.max("pos") + 1).alias("end_pos"), F.array(*counts).alias("probs"))
    return own


_COUNTS = ", ".join(f"CAST(count(*) FILTER (event_type = '{t}') + 1 AS DOUBLE) AS c{i}" for i, t in enumerate(TYPES))
_TOTAL = "(" + " + ".join(f"c{i}" for i in range(len(TYPES))) + ")"


def probs_sql(size: int = SIZE, stride: int = STRIDE) -> str:
    """``wp(subject_id, start_pos, end_pos, p0, p1, ...)``."""
    return f"""{EV}, {windows_sql(size, stride, False)}, {framed_sql()},
wc AS (SELECT subject_id, start_pos, end_pos, {_COUNTS} FROM fr GROUP BY subject_id, start_pos, end_pos),
wp AS (SELECT subject_id, start_pos, end_pos, {", ".join(f"c{i} / {_TOTAL} AS p{i}" for i in range(len(TYPES)))} FROM wc)"""


PROBS = probs_sql()


#: Each pair of four training subjects with each of the other two as validation.
FOLDS = tuple((a, b, v) for a in range(1, 5) for b in range(a + 1, 5) for v in range(1, 5) if v not in (a, b))
SCALES, THRESHOLDS, STRIDES = (60, 150, 300), (0.70, 0.85), (15, 30)
_SETTINGS = {"scale": SCALES, "threshold": THRESHOLDS, "stride": STRIDES}


def scores(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """``candidate_index, validation_subject, train_subjects`` and metrics, made of order lines: each line falls to one of the twelve folds.

    ``extra`` names further settings that lines are told apart by: ``scale``, ``threshold`` and ``stride``. With them, every setting has a row for each fold, with metrics
    of 0 where no line falls to it.
    """
    li = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / (F.count("*") * 100.0)
    number = (F.col("l_orderkey") + F.col("l_partkey") + F.col("l_suppkey")) % 12
    li = li.select(
        F.col("l_linenumber").alias("candidate_index"),
        F.get(F.array(*(F.struct(F.lit(v).alias("validation_subject"), F.lit(f"{a}_{b}").alias("train_subjects")) for a, b, v in FOLDS)), number.cast("int")).alias("fold"),
        F.get(F.array(*map(F.lit, SCALES)), (F.col("l_suppkey") % 3).cast("int")).alias("scale"),
        F.get(F.array(*map(F.lit, THRESHOLDS)), (F.col("l_partkey") % 2).cast("int")).alias("threshold"),
        F.get(F.array(*map(F.lit, STRIDES)), (F.col("l_orderkey") % 2).cast("int")).alias("stride"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    found = li.groupBy(*extra, "candidate_index", "fold.validation_subject", "fold.train_subjects").agg(
        cents("l_discount").alias("accuracy"), cents("l_tax").alias("macro_f1"), (cents("l_quantity") / 50).alias("abnormal_f1")
    )
    if not extra:
        return found
    every = li.select("candidate_index").distinct()
    for name in extra:
        every = every.withColumn(name, F.explode(F.array(*map(F.lit, _SETTINGS[name]))))
    folds = F.explode(F.array(*(F.struct(F.lit(v).alias("validation_subject"), F.lit(f"{a}_{b}").alias("train_subjects")) for a, b, v in FOLDS)))
    every = every.withColumn("fold", folds).select(*extra, "candidate_index", "fold.*")
    return every.join(found, every.columns, "left").fillna(0.0, ["accuracy", "macro_f1", "abnormal_f1"])


def _cents(c: str) -> str:
    return f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE)"


def scores_sql(extra: Sequence[str] = ()) -> str:
    """``sc``: the same in SQL."""
    keys = ", ".join((*extra, "candidate_index", "validation_subject", "train_subjects"))
    numbers = {"scale": (SCALES, "l_suppkey % 3"), "threshold": (THRESHOLDS, "l_partkey % 2"), "stride": (STRIDES, "l_orderkey % 2")}
    more = "".join(f", [{', '.join(f'{v}::DOUBLE' if name == 'threshold' else str(v) for v in values)}][{place} + 1] AS {name}" for name, (values, place) in numbers.items())
    name = "found" if extra else "sc"
    found = f"""{name} AS (SELECT {keys}, {_cents("l_discount")} AS accuracy, {_cents("l_tax")} AS macro_f1, {_cents("l_quantity")} / 50 AS abnormal_f1
  FROM (SELECT l_linenumber AS candidate_index, CAST([{", ".join(str(v) for *_, v in FOLDS)}][n + 1] AS INTEGER) AS validation_subject, [{", ".join(f"'{a}_{b}'" for a, b, _ in FOLDS)}][n + 1] AS train_subjects{more}, l_discount, l_tax, l_quantity
    FROM (SELECT *, (l_orderkey + l_partkey + l_suppkey) % 12 AS n FROM lineitem)) GROUP BY {keys})"""
    if not extra:
        return found
    folds = ", ".join(f"({v}, '{a}_{b}')" for a, b, v in FOLDS)
    grids = ", ".join(f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' if e == 'threshold' else str(v) for v in numbers[e][0])}]) AS {e}) AS g_{e}" for e in extra)
    metrics = ", ".join(f"coalesce({m}, 0) AS {m}" for m in ("accuracy", "macro_f1", "abnormal_f1"))
    return f"""{found}, sc AS (SELECT {keys}, {metrics} FROM (SELECT * FROM (SELECT DISTINCT l_linenumber AS candidate_index FROM lineitem) c, (VALUES {folds}) f(validation_subject, train_subjects), {grids}) k
  LEFT JOIN found USING ({keys}))"""


SCORES = scores_sql()
