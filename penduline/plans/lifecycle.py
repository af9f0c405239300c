"""Whole runs: build, freeze, predict, evaluate and report, one task or a matrix of them. Every stage leaves a line in the run's
state, a folder in use is an error, and evaluation can be repeated from what was frozen."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from penduline.operators import evaluation as ev
from penduline.operators import prompts
from penduline.plans import runs
from penduline.plans.config import Task
from penduline.plans.plugins import BaselinePlugin, Instance, TaskBuilder, measure
from penduline.sources import sinks


def _staged(folder: str, stage: str, work: Callable[[], Any]) -> Any:
    """The result of a stage, whose begin and end are appended to state.jsonl; a failure is written there and raised on."""
    def say(state: str, **more: str) -> None:
        with (Path(folder) / "state.jsonl").open("a", encoding="utf-8") as f:
            f.write(json.dumps({"stage": stage, "state": state, "at": time.time(), **more}, ensure_ascii=False, sort_keys=True) + "\n")

    say("started")
    try:
        out = work()
    except Exception as e:
        say("failed", reason=f"{type(e).__name__}: {e}"[:2000])
        raise
    say("complete")
    return out


def run_atomic(spark: SparkSession, folder: str, task: Task, members: DataFrame, cases: DataFrame, builder: TaskBuilder, baseline: BaselinePlugin, supported: list[str] | None = None) -> Row:
    """One task from plan to report. folder is one that driver and executors share. Gives the task's row, as runs.evaluate()."""
    Path(folder).mkdir(parents=True)  # in use: FileExistsError
    instance: Instance = _staged(folder, "build", lambda: builder.build(task, members, cases))
    run = runs.Run(folder)

    def freeze() -> None:
        sinks.write_document(Path(folder) / "instance.json", instance.document)
        for name, rows in (("jobs", instance.jobs), ("cases", cases), ("adaptations", instance.adapted)):
            rows.write.mode("errorifexists").parquet(f"{folder}/{name}")

    _staged(folder, "freeze", freeze)
    frozen = Instance(instance.document, run.table(spark, "jobs"), run.table(spark, "adaptations"))
    _staged(folder, "predict", lambda: baseline.predict(frozen).write.mode("errorifexists").parquet(f"{folder}/predictions"))
    return _staged(folder, "evaluate", lambda: evaluate_again(spark, folder, task, supported))


def evaluate_again(spark: SparkSession, folder: str, task: Task, supported: list[str] | None = None) -> Row:
    """Evaluate a frozen run and write its report; jobs, cases and predictions stay as they are, so it may be repeated."""
    run = runs.Run(folder)
    row = runs.evaluate(spark, run, supported).first()
    facts = {"task": task.task_id, "conditioning": task.conditioning, "score": "—" if row.score is None else f"{row.score:.4f}", "coverage": f"{row.coverage:.4f}"}
    text = sinks.report(task.task_id, facts, run.table(spark, "breakdown"))
    (Path(folder) / "report.md").write_text(text, encoding="utf-8")
    sinks.write_document(Path(folder) / "summary.json", row.asDict())
    return row


def run_matrix(spark: SparkSession, folder: str, tasks: list[Task], members: DataFrame, cases: DataFrame, builder: TaskBuilder, baselines: dict[str, BaselinePlugin], supported: list[str] | None = None) -> list[dict[str, Any]]:
    """The same plan under several conditionings: each task is a run of its own, baselines goes by conditioning. index.json is
    written anew after each run. The plans must agree before anything runs."""
    runs.check_matrix(tasks, [runs.plan(t, members) for t in tasks])
    Path(folder).mkdir(parents=True)
    index: list[dict[str, Any]] = []
    for task in tasks:
        row = run_atomic(spark, f"{folder}/{task.conditioning}", task, members, cases, builder, baselines[task.conditioning], supported)
        index.append({"task_id": task.task_id, "conditioning": task.conditioning, **row.asDict()})
        sinks.write_document(Path(folder) / "index.json", {"runs": index, "complete": len(index) == len(tasks)})
    return index


def compare(spark: SparkSession, folder: str, first: str, second: str) -> DataFrame:
    """(case_id, evaluation_partition, seed, first_score, second_score, gain) of the jobs of two runs of a matrix."""
    def side(conditioning: str, name: str) -> DataFrame:
        return runs.Run(f"{folder}/{conditioning}").table(spark, "results").select("case_id", "evaluation_partition", "seed", F.col("score").alias(name))

    both = side(first, "first_score").join(side(second, "second_score"), ["case_id", "evaluation_partition", "seed"])
    return both.withColumn("gain", F.col("second_score") - F.col("first_score"))


def run_benchmark(task: Task, members: DataFrame, cases: DataFrame, clauses: DataFrame, predictions: DataFrame, *metrics: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs with their prompt, metric scores by job, breakdown): the run of the first version, which goes by predictions: plan,
    prompts, then whatever metrics are named over the predictions of planned jobs. cases: case_id, scene_id, physics, base_prompt."""
    said = prompts.rendered(cases, clauses, task.conditioning).select("case_id", "prompt", F.col("fault").alias("prompt_fault"))
    jobs = runs.plan(task, members).join(said, "case_id", "left")
    held = predictions.join(jobs.select("job_id"), "job_id", "left_semi")
    scores = measure(held, *metrics)
    cells = jobs.join(scores.select("job_id", "score"), "job_id", "left")
    return jobs, scores, ev.breakdown(cells)
