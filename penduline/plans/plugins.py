"""What may be exchanged in a run: adapters of cases, builders of instances, baselines that predict, and metrics.

All of them work on DataFrames; a plugin is named as "module:attribute" and must be of the kind that is asked for."""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penduline.operators import evaluation, lineage, prompts
from penduline.plans import runs
from penduline.plans.config import Task


class DataAdapter(ABC):
    """Brings cases into the form a baseline takes. Cases of the generic conditioning never carry their parameters."""

    #: settings on which the pictures depend; all others change what is said about them only
    picture_settings: tuple[str, ...] = ("buckets", "fps", "min_frames", "max_frames", "pad_colour")

    def __init__(self, settings: dict[str, Any]) -> None:
        self.settings = settings

    def fingerprint(self) -> str:
        return lineage.digest({"adapter": type(self).__name__, "settings": self.settings})

    def materialization_fingerprint(self) -> str:
        return lineage.digest({k: self.settings.get(k) for k in self.picture_settings})

    @abstractmethod
    def bucket(self, cases: DataFrame) -> Column:
        """The size class of a case, as a text."""

    def adapt(self, cases: DataFrame, role: str, conditioning: str, speed: Column | None = None, prompt: Column | None = None) -> DataFrame:
        """The adaptation of each case: see prompts.adaptations. Generic prompts are those of the cases, not of parameters."""
        if conditioning == "generic" and "physics" in cases.columns:
            cases = cases.drop("physics")
        return prompts.adaptations(cases, role, conditioning, self.bucket(cases), F.lit(1.0) if speed is None else speed, F.lit(None).cast("string") if prompt is None else prompt)


@dataclass(frozen=True)
class Instance:
    """A plan made concrete for a baseline: its sealed document, jobs and adaptations."""

    document: dict[str, Any]
    jobs: DataFrame
    adapted: DataFrame


class TaskBuilder(ABC):
    """Makes instances: the canonical plan, the adaptations of its cases, and the builder's own part of the document."""

    def __init__(self, adapter: DataAdapter) -> None:
        self.adapter = adapter

    @abstractmethod
    def compile(self, task: Task, jobs: DataFrame) -> dict[str, Any]:
        """What the baseline needs to know beside jobs and adaptations."""

    def build(self, task: Task, members: DataFrame, cases: DataFrame) -> Instance:
        jobs = runs.plan(task, members)
        planned = cases.join(jobs.select("case_id"), "case_id", "left_semi")
        document = {"task": task.fingerprint(), "adapter": self.adapter.fingerprint(), "builder": type(self).__name__, "plan": runs.pairing_signature(jobs), "compiled": self.compile(task, jobs)}
        return Instance(lineage.seal(document), jobs, self.adapter.adapt(planned, "eval", task.conditioning))


class BaselinePlugin(ABC):
    @abstractmethod
    def predict(self, instance: Instance) -> DataFrame:
        """(job_id, complete, score, ...): a row for each job that was tried."""


class Planned(BaselinePlugin):
    """Predicts nothing: every job is planned and stays incomplete."""

    def predict(self, instance: Instance) -> DataFrame:
        return instance.jobs.select("job_id", F.lit(False).alias("complete"), F.lit(None).cast("double").alias("score"))


class Given(BaselinePlugin):
    """Takes predictions that were made elsewhere; those of jobs that aren't planned stay, and are reported as orphans."""

    def __init__(self, predictions: DataFrame) -> None:
        self.predictions = predictions

    def predict(self, instance: Instance) -> DataFrame:
        return self.predictions


#: Metrics by name: results -> (job_id, metric, weight, status, score).
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def metric(name: str) -> Callable:
    """Register a metric; a name can be taken once."""
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in METRICS:
            raise ValueError(f"metric {name} is there already")
        METRICS[name] = f
        return f

    return add


@metric("score")
def score_metric(results: DataFrame) -> DataFrame:
    return results.select("job_id", F.lit("score").alias("metric"), F.lit(1.0).alias("weight"), "status", "score")


@metric("manual_scores")
def manual_scores(results: DataFrame) -> DataFrame:
    """A metric for each entry of manual_scores, a map; a null is not applicable, values beyond 0..1 are errors."""
    rows = results.select("job_id", F.explode("manual_scores").alias("metric", "score"))
    status = F.when(F.col("score").isNull(), "not_applicable").when(F.col("score").between(0, 1), evaluation.EVALUATED).otherwise(evaluation.ERROR)
    return rows.select("job_id", "metric", F.lit(1.0).alias("weight"), status.alias("status"), F.when(status == evaluation.EVALUATED, F.col("score")).alias("score"))


def measure(results: DataFrame, *names: str) -> DataFrame:
    """(job_id, applicable, weight_coverage, score) over some metrics; an unknown name is an error."""
    unknown = sorted(set(names) - set(METRICS))
    if unknown or not names:
        raise ValueError(f"unknown metrics {unknown}" if unknown else "no metric is named")
    rows = METRICS[names[0]](results)
    for name in names[1:]:
        rows = rows.unionByName(METRICS[name](results))
    return evaluation.weighted_metrics(rows, "job_id")


def load(name: str, kind: type) -> Any:
    """The attribute that "module:attribute" names; it must be a class or an instance of a kind."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name} is not of the form module:attribute")
    found = getattr(importlib.import_module(module), attribute, None)
    if not (isinstance(found, kind) or (isinstance(found, type) and issubclass(found, kind))):
        raise TypeError(f"{name} is no {kind.__name__}")
    return found
