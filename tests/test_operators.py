"""Cases by hand for operators that the queries don't show at their edges."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import decode, features, frames, fusion, learning, metrics, selection, signals, windows
from tidewindow.schema import ABNORMAL, CLASSES, COORDS, JOINTS, LABEL_ALIASES


def pose(spark, n=40, subject=1):
    t = F.col("pos")
    xy = {}
    for j, joint in enumerate(JOINTS):
        xy[f"{joint}_x"] = 100 + 3 * j + 0.05 * t
        xy[f"{joint}_y"] = 200 + 2 * j + F.sin(t / 15)
    return spark.range(n).select(F.lit(subject).alias("subject_id"), F.col("id").alias("pos")).withColumns(xy)


def test_labels(spark):
    df = spark.createDataFrame([("Throwing",), (" Throwing things\t",), (None,), ("None",), ("Walking",), ("walking",)], "l string")
    got = [r[0] for r in df.select(x.clean_label(F.col("l"), CLASSES, LABEL_ALIASES)).collect()]
    assert got == ["Throwing things", "Throwing things", "None", "None", "Walking", "None"]


def test_gap_fill_by_position_and_at_ends(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 5.0, None])], "subject_id int, pos long, v double")
    got = [r["v"] for r in frames.fill_gaps(df, ["v"]).orderBy("pos").collect()]
    assert got == pytest.approx([1, 1, 1 + 4 / 3, 1 + 8 / 3, 5, 5])


def test_gap_fill_refuses_a_column_without_values(spark):
    df = spark.createDataFrame([(1, 0, None)], "subject_id int, pos long, v double")
    with pytest.raises(SparkRuntimeException, match="no value of v"):
        frames.fill_gaps(df, ["v"]).collect()
    assert frames.fill_gaps(df, ["v"], strict=False).first()["v"] is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nose_x"):
        frames.require(spark.range(1), ["nose_x"])


def test_normalised_hips_are_centred(spark):
    for normalise in (frames.normalise_pose, frames.normalise_pose_robustly):
        row = normalise(pose(spark)).agg(F.max(F.abs(F.col("left_hip_x") + F.col("right_hip_x"))).alias("m")).first()
        assert row["m"] < 1e-9


def test_signal_sets(spark):
    p = frames.normalise_pose(pose(spark))
    assert len(signals.pose_signals(p)[1]) == 61
    assert [len(signals.signal_set(p, s)[1]) for s in "abc"] == [34, 70, 85]
    assert len(signals.compact_signals(p)[1]) == 122
    row = signals.streams(p).first()
    assert (len(row["coordinates"]), len(row["bones"]), len(row["velocity"])) == (34, 42, 34)
    assert set(row["velocity"]) == {0.0}
    with pytest.raises(ValueError, match="unknown signal set"):
        signals.signal_set(p, "d")


@pytest.mark.parametrize("n,size,stride,tail,expected", [(301, 150, 150, True, [0, 150, 151]), (300, 150, 75, False, [0, 75, 150]), (0, 5, 5, True, []), (4, 5, 5, True, [0]), (5, 5, 2, True, [0]), (10, 4, 6, True, [0, 6])])
def test_window_starts(spark, n, size, stride, tail, expected):
    row = spark.range(1).select(windows.window_starts(F.lit(n), size, stride, tail).alias("s")).first()
    assert row["s"] == expected


@pytest.mark.parametrize("size,stride", [(8, 4), (10, 3), (60, 15), (4, 6), (200, 75)])
@pytest.mark.parametrize("tail", [True, False])
def test_frames_name_their_windows(spark, size, stride, tail):
    f = spark.range(61).select(F.lit(1).alias("subject_id"), F.col("id").alias("pos"))
    got = {(r["start_pos"], r["pos"]) for r in windows.frames_in_windows(f, size, stride, tail).collect()}
    expected = {(w["start_pos"], p) for w in windows.window_table(f, size, stride, tail).collect() for p in range(w["start_pos"], w["end_pos"])}
    assert got == expected


@pytest.mark.parametrize("good,label", [(105, "Walking"), (104, None)])
def test_majority_at_its_threshold(spark, good, label):
    f = spark.range(150).select(F.lit(1).alias("subject_id"), F.lit(0).alias("start_pos"), F.col("id").alias("pos"), F.when(F.col("id") < good, "Walking").otherwise("None").alias("label"))
    assert windows.majority_labels(f, CLASSES).first()["label"] == label


def test_majority_takes_the_first_of_equals(spark):
    rows = [(1, 0, i, c) for i, c in enumerate(["Biting", "Attacking", "Attacking", "Biting"])]
    f = spark.createDataFrame(rows, "subject_id int, start_pos int, pos long, label string")
    assert windows.majority_labels(f, CLASSES, 0.5).first()["label"] == "Biting"


def test_overlapping_windows_and_gaps(spark):
    f = spark.range(6).select(F.lit(1).alias("subject_id"), F.col("id").alias("pos"))
    w = spark.createDataFrame([(1, 0, 4, [0.8, 0.2]), (1, 2, 6, [0.2, 0.8])], "subject_id int, start_pos long, end_pos long, probs array<double>")
    got = fusion.frame_probabilities(w, f, ["A", "B"]).orderBy("pos").collect()
    assert [r["coverage"] for r in got] == [1, 1, 2, 2, 1, 1]
    assert [r["label"] for r in got] == ["A", "A", "A", "A", "B", "B"]
    w = spark.createDataFrame([(1, 1, 2, [0.9, 0.1]), (1, 3, 4, [0.1, 0.9])], "subject_id int, start_pos long, end_pos long, probs array<double>")
    got = fusion.frame_probabilities(w, f.where("pos < 5"), ["A", "B"]).orderBy("pos").collect()
    assert [r["label"] for r in got] == ["A", "A", "A", "B", "B"]
    assert [r["coverage"] for r in got] == [0, 1, 0, 1, 0]
    with pytest.raises(SparkRuntimeException, match="under no window"):
        fusion.plain_frame_means(w, f, ["A", "B"]).collect()


def test_transitions_break_at_a_gap(spark):
    f = spark.createDataFrame([(1, 0, "A"), (1, 1, None), (1, 2, "B")], "subject_id int, pos long, label string")
    initial, moves = decode.transition_model(f, ["A", "B"])
    assert {r["p"] for r in initial.collect()} == {0.5}
    assert {r["p"] for r in moves.collect()} == {0.5}


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    e, t, i = rng.dirichlet([1, 1, 1], 5), rng.dirichlet([1, 1, 1], 3), rng.dirichlet([1, 1, 1])

    def score(p):
        return sum(math.log(e[k, s]) for k, s in enumerate(p)) + 0.5 * (math.log(i[p[0]]) + sum(math.log(t[a, b]) for a, b in itertools.pairwise(p)))

    assert tuple(decode.viterbi(e, t, i, 0.5)) == max(itertools.product(range(3), repeat=5), key=score)


def test_decoding_in_blocks_is_decoding_in_one(spark):
    rng = np.random.default_rng(3)
    t, i = np.array([[0.5, 0.25, 0.25], [0.25, 0.5, 0.25], [0.25, 0.25, 0.5]]), np.array([0.25, 0.5, 0.25])
    kinds = [[0.5, 0.25, 0.25], [0.25, 0.5, 0.25], [0.25, 0.25, 0.5], [0.4, 0.4, 0.2]]  # many paths are equally good
    e = {s: [kinds[k] for k in rng.integers(0, 4, n)] for s, n in ((1, 1), (2, 8), (3, 61), (4, 64))}
    f = spark.createDataFrame([(s, p, v) for s, own in e.items() for p, v in enumerate(own)], "subject_id int, pos long, probs array<double>")
    got = {(r["subject_id"], r["pos"]): r["label"] for r in decode.decode(f, t, i, "ABC", 1.0, block=8).collect()}
    want = {(s, p): "ABC"[k] for s, own in e.items() for p, k in enumerate(decode.viterbi(np.array(own), t, i, 1.0))}
    assert got == want


@pytest.mark.parametrize("block", [8, 4096])
def test_all_settings_are_decoded_as_one_by_one(spark, block):
    rng = np.random.default_rng(4)
    t, i = rng.dirichlet([1, 1, 1], 3), rng.dirichlet([1, 1, 1])
    e = {s: rng.dirichlet([1, 1, 1], n) for s, n in ((1, 3), (2, 30))}
    g = {s: rng.dirichlet([1, 1], len(own)) for s, own in e.items()}
    rows = [(s, p, e[s][p].tolist(), g[s][p].tolist(), "A") for s in e for p in range(len(e[s]))]
    f = spark.createDataFrame(rows, "subject_id int, pos long, probs array<double>, gate array<double>, truth string")
    out = decode.decode_grid(f.select("subject_id", "pos", "probs"), f.select("subject_id", "pos", F.col("gate").alias("probs")), f.select("subject_id", "pos", "truth"), t, i, "ABC", "B", (0.0, 1.0), (0.0, 0.5, 2.0), block=block)
    got = {(r["alpha"], r["strength"], r["subject_id"], r["pos"]): r["label"] for r in out.collect()}
    want = {}
    for alpha in (0.0, 1.0):
        for s in e:
            fused = e[s] * np.maximum(g[s][:, [0, 1, 0]], 1e-12) ** alpha
            for strength in (0.0, 0.5, 2.0):
                want |= {(alpha, strength, s, p): "ABC"[k] for p, k in enumerate(decode.viterbi(fused / fused.sum(axis=1, keepdims=True), t, i, strength))}
    assert got == want


def test_probabilities_are_checked(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "p array<double>")
    with pytest.raises(SparkRuntimeException, match="positive sum"):
        df.select(x.normalised(F.col("p"))).collect()
    with pytest.raises(ValueError, match="not declared"):
        x.scale_fusion([F.col("p")], (0.4,), ((1.0,),))


def test_absent_classes_count_in_the_fixed_average(spark):
    t = spark.createDataFrame([("Walking", "Walking", 4)], "truth string, pred string, n long")
    assert metrics.evaluate(t, CLASSES, ABNORMAL).first()["macro_f1"] == pytest.approx(1 / 8)
    assert metrics.evaluate(t, CLASSES, ABNORMAL, present_only=True).first()["macro_f1"] == 1.0


def test_a_leak_is_refused(spark):
    audit = spark.createDataFrame([(1, [2, 3], 4), (1, [1, 3], 4)], "outer_subject int, train_subjects array<int>, validation_subject int")
    assert selection.leaks(audit).count() == 1
    with pytest.raises(ValueError, match="leaks"):
        selection.checked_audit(audit)
    assert selection.inner_splits([1, 2, 3, 5], 5) == [((2, 3), 1), ((1, 3), 2), ((1, 2), 3)]
    with pytest.raises(ValueError):
        selection.inner_splits([1, 2, 3], 3)


def test_a_held_out_score_cannot_win(spark):
    rows = [("1_2", 0, 3, 0.6), ("1_3", 0, 2, 0.6), ("2_3", 0, 1, 0.6), ("1_2", 1, 3, 0.5), ("1_3", 1, 2, 0.5), ("2_3", 1, 1, 0.5), ("1_2", 1, 5, 0.99)]
    others = [("1_2", 0, 5), ("1_3", 0, 5), ("1_3", 1, 5), ("2_3", 0, 5), ("2_3", 1, 5), *((f"{a}_5", c, v) for a in (1, 2, 3) for v in (1, 2, 3) if a != v for c in (0, 1))]
    rows += [(*o, 0.1) for o in others]
    s = spark.createDataFrame([(*r, r[3], r[3]) for r in rows], "train_subjects string, candidate_index int, validation_subject int, accuracy double, macro_f1 double, abnormal_f1 double")
    subjects = spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "subject_id int")
    best = {r["outer_subject"]: r["candidate_index"] for r in selection.outer_choices(s, selection.inner_split_table(subjects)).collect()}
    assert best[5] == 0
    with pytest.raises(ValueError, match="incomplete"):
        selection.outer_choices(s.where("accuracy <> 0.99"), selection.inner_split_table(subjects))
    with pytest.raises(ValueError, match="too many"):
        selection.unordered_pairs(spark.range(500).select(F.col("id").alias("subject_id")))


def test_grid_sample_is_stable(spark):
    values = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    one, two = (selection.parameter_grid(spark, values, 4).orderBy("candidate_index").collect() for _ in range(2))
    assert one == two and len(one) == 4


def test_selector_drops_copies_and_constants(spark):
    rows = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"),
        (F.col("id") % 2 + F.rand(1) * 0.1).alias("useful"),
        F.rand(2).alias("noise"),
        F.lit(1.0).alias("constant"),
    ).withColumn("copy", F.col("useful") * 3)
    chosen = learning.fit_selector(rows, ["useful", "copy", "noise", "constant"])
    assert chosen.features[0] == "useful" and "copy" not in chosen.features and "constant" not in chosen.features
    assert chosen.restricted(1).features == ["useful"]
    with pytest.raises(ValueError):
        chosen.restricted(9)


def test_resampling_and_mirroring(spark):
    row = spark.createDataFrame([([0.0, 2.0, 4.0],)], "v array<double>").select(learning.resampled(F.col("v"), 5).alias("r")).first()
    assert row["r"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    p = pose(spark, 3)
    twice = learning.mirrored(learning.mirrored(p)).orderBy("pos").select(*COORDS).collect()
    assert twice == p.orderBy("pos").select(*COORDS).collect()


def test_noise_and_dropout(spark):
    p = pose(spark, 400)
    out = learning.noisy(p, 0.0, 0.25, 7)
    gone = out.select(*((F.col(c) == 0).cast("int").alias(c) for c in COORDS[:2])).agg(F.avg(COORDS[0]), F.avg(COORDS[1])).first()
    assert gone[0] == gone[1] and 0.15 < gone[0] < 0.35  # a joint goes as a whole
    moved = learning.noisy(p, 0.5, 0.0, 7).select("pos", F.col(COORDS[0]).alias("v")).join(p.select("pos", COORDS[0]), "pos")
    assert 0.4 < moved.agg(F.stddev_pop(F.col("v") - F.col(COORDS[0]))).first()[0] < 0.6
    assert learning.noisy(p, 0.5, 0.1, 7).orderBy("pos").collect() == learning.noisy(p, 0.5, 0.1, 7).orderBy("pos").collect()


def test_spectral_features_of_odd_windows(spark):
    rows = [("none", 0, None), ("one", 0, 3.0), *(("zeros", i, 0.0) for i in range(5)), *(("flat", i, 2.0) for i in range(8)), *(("wave", i, math.sin(2 * math.pi * i / 8)) for i in range(64)), ("gap", 0, 1.0), ("gap", 1, None), ("gap", 2, -1.0)]
    long = spark.createDataFrame([(1, 0, s, p, v) for s, p, v in rows], "subject_id int, start_pos int, signal string, pos long, x double")
    got = {r["signal"]: r for r in features.spectral(long, 16.0).collect()}
    assert got["none"]["fundamental_frequency"] is None and got["zeros"]["spectral_centroid"] == got["flat"]["max_power"] == got["one"]["spectral_entropy"] == 0
    assert got["wave"]["fundamental_frequency"] == 2.0 == got["wave"]["max_frequency"]
    lags = {r["signal"]: r["autocorrelation"] for r in features.autocorrelation(long).collect()}
    assert (lags["none"], lags["one"], lags["wave"], lags["gap"]) == (0, 1, 2, 1)


def test_summaries_of_one_value(spark):
    r = spark.createDataFrame([(1, 0, "s", 0, 2.0)], "subject_id int, start_pos int, signal string, pos long, x double")
    row = features.summaries(r).first()
    assert (row["mean"], row["std"], row["slope"], row["q90"]) == (2.0, 0.0, 0.0, 2.0)


def test_one_long_subject_is_the_same_in_blocks(spark, monkeypatch):
    """Gaps, carried values, differences, medians, nearest frames and steps over block ends equal those of one block."""
    rng = random.Random(6)
    rows = [(s, p, *((None if rng.random() < 0.5 else rng.random()) for _ in COORDS), rng.choice(["A", "B", None])) for s, n in ((1, 61), (None, 9), (2, 1)) for p in range(n)]
    rows = [(s, p, *((0.5 if p in (0, 8) else v) for v in own[: len(COORDS)]), own[-1]) for s, p, *own in rows]
    df = spark.createDataFrame(rows, "subject_id int, pos long, " + ", ".join(f"{c} double" for c in COORDS) + ", label string")

    def results():
        own = df.select("subject_id", "pos", *COORDS[:3], "label")
        probs = df.select("subject_id", "pos", F.when(F.col("nose_x").isNotNull(), F.array("nose_x", F.lit(1.0))).alias("probs"))
        whole = df.fillna(0.25, COORDS)
        tables = [
            frames.fill_gaps(own, COORDS[:3]), frames.carry(own, COORDS[:3]), frames.normalise_pose_robustly(whole), signals.signal_set(whole, "B")[0],
            fusion.fill_nearest(probs), *decode.transition_counts(df, ["A", "B"]), windows.frames_in_windows(own, 8, 3, True),
        ]
        return [sorted(map(repr, t.collect())) for t in tables]

    whole = results()
    monkeypatch.setattr(frames, "BLOCK", 20)
    assert results() == whole


def test_no_window_over_a_subject_alone(spark):
    """But for those over the rows that blocks hand on."""
    df = spark.createDataFrame([(1, p, *([0.5] * len(COORDS))) for p in range(30)], "subject_id int, pos long, " + ", ".join(f"{c} double" for c in COORDS))
    for out in (frames.prepare(df), signals.pose_signals(df)[0], windows.frames_in_windows(df, 8, 4)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        over = [line for line in plan.splitlines() if "windowspecdefinition(subject_id" in line and "__block" not in line]
        assert not over


def test_summaries_of_windows_as_arrays(spark):
    """The same numbers as by rows, with gaps, a signal without numbers, short windows and one frame."""
    rng = random.Random(4)
    rows = [(1, s, p, rng.gauss(0, 3), None if rng.random() < 0.3 else rng.random(), None, float(p)) for s, n in ((0, 12), (5, 12), (10, 4), (20, 1)) for p in range(s, s + n)]
    df = spark.createDataFrame(rows, "subject_id int, start_pos int, pos long, a double, b double, c double, `d.e` double")
    names = ["a", "b", "c", "d.e"]
    long = df.select("subject_id", "start_pos", "pos", F.inline(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(f"`{n}`").alias("x")) for n in names))))
    want = {(r["start_pos"], r["signal"]): r for r in features.summaries(long).collect()}
    made = features.window_summaries(df, names)
    for r in features.summary_rows(made, names).collect():
        for c in features.SUMMARIES:
            expected = want[r["start_pos"], r["signal"]][c]
            if r["signal"] == "c":
                assert r[c] is None or c == "slope" and r[c] == 0
            else:
                assert r[c] == pytest.approx(expected, abs=1e-9)
    wide = features.summary_columns(made, names, ["mean"]).where("start_pos = 20").first()
    assert (wide["d.e__mean"], wide["c__mean"]) == (20.0, None)


def test_class_means_far_from_every_class(spark):
    """Where exp(-difference) is 0 for all classes, or as small as doubles get, the shares of near and far classes are those of exact numbers."""
    model = learning.ClassMeans(((0.0, 0.0), (0.001, 0.0), None))
    df = spark.createDataFrame([(v, 0.0) for v in (0.0, 38.6, 1000.0, -1e5)], "f double, g double")
    for r in learning.predict(model, df, ["f", "g"], ["a", "b", "c"]).collect():
        ahead = (r["f"] ** 2 - (r["f"] - 0.001) ** 2) / 2  # how much nearer b is
        assert r["probs"] == pytest.approx([1 / (1 + math.exp(ahead)), 1 / (1 + math.exp(-ahead)), 0.0], rel=1e-4)
        assert r["pred"] == ("b" if ahead > 0 else "a") and r["confidence"] == max(r["probs"])
    lone = learning.ClassMeans((None, None))
    with pytest.raises(SparkRuntimeException, match="positive sum"):
        learning.predict(lone, df, ["f", "g"], ["a", "b"]).select("probs").collect()
