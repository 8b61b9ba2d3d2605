"""A store of models: each version with its contract, of which the last one that was committed is current."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidewindow.operators import learning
from tidewindow.operators.boosting import Boosted
from tidewindow.sources.files import aligned

#: What a contract has to name.
REQUIRED = ("schema_version", "signal_set", "classes", "features", "window", "stride")


class ModelStore:
    """Versions in a folder of the shared file system. A version's contract is written after its model, and its job's success mark is what makes it current, so that a reader never
    finds half a version; older ones stay."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def versions(self) -> list[str]:
        """The committed versions, oldest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at))
        return [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/contract/_SUCCESS"))]

    def publish(self, model: PipelineModel | Boosted, contract: Mapping) -> str:
        """Saves a model under the next number; the name of its version."""
        if lacks := [k for k in REQUIRED if k not in contract]:
            raise ValueError(f"the contract lacks {', '.join(lacks)}")
        if isinstance(model, Boosted) and list(contract["features"]) != model.features:
            raise ValueError("the model has other features, or another order of them")
        last = int(self.versions()[-1].split("-")[0]) if self.versions() else 0
        name = f"{last + 1:08d}-{uuid.uuid4().hex[:8]}"
        told = dict(contract) | {"kind": "boosted" if isinstance(model, Boosted) else "pipeline"}
        if isinstance(model, Boosted):
            self._text(model.to_json(), f"{self.folder}/{name}/model")
        else:
            model.write().save(f"{self.folder}/{name}/model")
        self._text(json.dumps(told, sort_keys=True), f"{self.folder}/{name}/contract")
        return name

    def _text(self, text: str, path: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)

    def load(self, version: str | None = None, **expected: object) -> tuple[PipelineModel | Boosted, dict]:
        """A version, the current one if none is named, and its contract. What is ``expected`` of the contract has to be in it, lists in the same order."""
        names = self.versions()
        if not names or version is not None and version not in names:
            raise ValueError(f"there is no version {version or 'yet'}")
        path = f"{self.folder}/{version or names[-1]}"
        contract = json.loads(self.spark.read.text(f"{path}/contract").first()["value"])
        for k, v in expected.items():
            found, wanted = contract.get(k), list(v) if isinstance(v, (list, tuple)) else v
            if found != wanted:
                raise ValueError(f"the model's {k} is {found}, not {wanted}")
        if contract["kind"] == "boosted":
            return Boosted.from_json(self.spark.read.text(f"{path}/model").first()["value"]), contract
        return PipelineModel.load(f"{path}/model"), contract


def predicted(model: PipelineModel | Boosted, contract: Mapping, windows: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Windows with ``probs``, ``pred`` and ``confidence`` by a stored model; a feature of its contract that they lack is an error, further ones are left out."""
    rows = aligned(windows, contract["features"], others)
    if isinstance(model, Boosted):
        return model.predict(rows)
    return learning.predict(model, rows, contract["features"], contract["classes"])
