"""Models of all signal sets saved, loaded and used, and what a store refuses."""

import pytest
from pyspark.sql import functions as F

from tidewindow.operators import boosting, learning
from tidewindow.plans import inference as inf
from tidewindow.schema import JOINTS
from tidewindow.sources.models import ModelStore, predicted

CLASSES = ["Attacking", "Walking"]


@pytest.mark.parametrize("signal_set", ["A", "C"])
def test_sets_are_trained_stored_and_used(spark, tmp_path, signal_set):
    t = F.col("pos")
    fast = (t / 40 % 2).cast("int") == 1
    xy = {}
    for j, joint in enumerate(JOINTS):
        xy[f"{joint}_x"] = 100.0 + 3 * j + F.when(fast, 9 * F.sin(t * 1.3 + j)).otherwise(0.2 * F.sin(t / 9 + j))
        xy[f"{joint}_y"] = 200.0 + 5 * j + F.cos(t / 11 + j)
    poses = spark.range(160).select(F.lit(1).alias("subject_id"), F.col("id").alias("pos")).withColumns(xy).withColumn("label", F.when(fast, "Attacking").otherwise("Walking"))
    rows, names = inf.training_windows(poses, signal_set, 20, 10, classes=CLASSES, chosen=("mean", "std"))
    rows = rows.persist()
    model = boosting.fit_boosted(rows, names, CLASSES, ["subject_id", "start_pos"], settings=boosting.Settings(rounds=2, rate=0.5, leaves=3, min_leaf=2, bins=16))[None]
    store = ModelStore(spark, f"{tmp_path}/m")
    contract = {"schema_version": "1", "signal_set": signal_set, "classes": CLASSES, "features": names, "window": 20, "stride": 10}
    store.publish(model, contract)
    loaded, told = store.load(schema_version="1", signal_set=signal_set, classes=CLASSES, features=names)
    assert loaded == model
    out = predicted(loaded, told, rows, ["start_pos", "label"]).collect()
    assert len(out) == rows.count() and sum(r["label"] == r["pred"] for r in out) >= 0.9 * len(out)
    rows.unpersist()


def test_versions_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), "Attacking" if i % 2 else "Walking") for i in range(20)], "id int, f double, label string")
    store = ModelStore(spark, f"{tmp_path}/m")
    contract = {"schema_version": "1", "signal_set": "A", "classes": CLASSES, "features": ["f"], "window": 20, "stride": 10}
    with pytest.raises(ValueError, match="no version"):
        store.load()
    one = store.publish(learning.fit_model(rows, ["f"], CLASSES, trees=1, depth=1), contract)
    two = store.publish(boosting.fit_boosted(rows, ["f"], CLASSES, ["id"], settings=boosting.Settings(rounds=1, held_out=0.0))[None], contract | {"stride": 5})
    spark.createDataFrame([("half",)], "value string").write.text(f"{tmp_path}/m/99999999-half/model")
    assert store.versions() == [one, two]
    assert store.load()[1]["stride"] == 5 and store.load(one)[1]["stride"] == 10
    out = predicted(*store.load(one), rows.withColumn("more", F.lit(1)), ["id"])
    assert out.count() == 20 and set(out.columns) >= {"id", "f", "pred"}
    for wrong in ({"signal_set": "B"}, {"classes": CLASSES[::-1]}, {"features": ["g"]}, {"schema_version": "2"}):
        with pytest.raises(ValueError, match="the model's"):
            store.load(**wrong)
    with pytest.raises(ValueError, match="lacks"):
        store.publish(store.load()[0], {k: v for k, v in contract.items() if k != "signal_set"})
    with pytest.raises(ValueError, match="features"):
        store.publish(store.load()[0], contract | {"features": ["g"]})
    with pytest.raises(ValueError, match="missing features"):
        predicted(*store.load(), rows.drop("f"))
