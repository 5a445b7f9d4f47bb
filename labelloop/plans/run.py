"""Train, then evaluate, then predict, each if requested, over one root.

Every stage is a committed step. A stage that is requested and complete is read, not
run again; evaluation and prediction use the trained head if the root has one, from
this run or an earlier one, and the initial head otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloop.functions import vectors as V
from labelloop.operators.metrics import eval_report
from labelloop.operators.score import LinearHead, head_table, read_head, score
from labelloop.sources.commits import Commits

STAGES = ("train", "eval", "predict")


class Run:
    """``splits``: (split, id, label, embedding) with train, dev and test rows; ``trainer``
    gives a head from the train rows, ``initial`` is the head before any training."""

    def __init__(self, spark: SparkSession, root: str, splits: DataFrame, trainer: Callable[[DataFrame], LinearHead], initial: LinearHead):
        self.spark, self.commits, self.splits, self.trainer, self.initial = spark, Commits(spark, root), splits, trainer, initial

    def complete(self) -> list[str]:
        """Stages that are done, in their order."""
        done = {s.split("/")[0] for s in self.commits.steps()}
        return [s for s in STAGES if s in done]

    def _rows(self, split: str) -> DataFrame:
        return self.splits.filter(F.col("split") == split)

    def _head(self) -> tuple[str, LinearHead]:
        """The head to use and its name: results of one head are not taken for another's."""
        if "train" in self.commits.steps():
            return "trained", read_head(self.commits.table("train", lambda: None))
        return "initial", self.initial

    def _scored(self, split: str, head: LinearHead) -> DataFrame:
        return score(self._rows(split).select("id", "label", "embedding"), head).withColumn("pred", V.argmax("logits"))

    def __call__(self, *, do_train: bool = False, do_eval: bool = False, do_predict: bool = False) -> dict[str, DataFrame]:
        """The tables of the requested stages: train (cls, weights), eval (key, value), predict (id, pred)."""
        out = {}
        if do_train:
            out["train"] = self.commits.table("train", lambda: head_table(self.spark, self.trainer(self._rows("train"))))
        name, head = self._head()
        if do_eval:
            out["eval"] = self.commits.table(f"eval/{name}", lambda: eval_report(self._scored("dev", head)).select("key", "value"))
        if do_predict:
            out["predict"] = self.commits.table(f"predict/{name}", lambda: self._scored("test", head).select("id", "pred"))
        return out
