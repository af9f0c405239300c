"""Runs: plan, predictions, evaluation and report in one folder; evaluation can be repeated from what was frozen."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import evaluation as ev
from penduline.operators import splits
from penduline.operators.lineage import digest
from penduline.plans.config import Task


@dataclass(frozen=True)
class Run:
    """Where a run lies. jobs, cases and predictions are written once; the evaluation may be overwritten."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def plan(task: Task, members: DataFrame) -> DataFrame:
    """The jobs of a task over view members; held-out scenes come as test_ood2."""
    rows = members if not task.case_ids else members.where(F.col("case_id").isin(*task.case_ids)).withColumn("grp", F.lit("explicit"))
    groups = task.partitions or (("test_id", "test_ood1") if task.family == "finetune_eval" else None)
    jobs = splits.plan_jobs(rows, task.task_id, task.conditioning, task.inference_seeds, groups, task.scenes)
    if task.held_out_scenes:
        beyond = members.where(F.col("scene_id").isin(*task.held_out_scenes)).withColumn("grp", F.lit("test_ood2"))
        jobs = jobs.unionByName(splits.plan_jobs(beyond, task.task_id, task.conditioning, task.inference_seeds))
    return jobs


def freeze(path: str, jobs: DataFrame, cases: DataFrame, predictions: DataFrame) -> Run:
    """Write the inputs; a path that is in use is an error."""
    for name, df in (("jobs", jobs), ("cases", cases), ("predictions", predictions)):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return Run(path)


def evaluate(spark: SparkSession, run: Run, supported: list[str] | None = None) -> DataFrame:
    """Evaluate what was frozen and give the task's row: coverage over all jobs, score over the scenes planned. Doing it
    again gives the same."""
    jobs = run.table(spark, "jobs")
    ev.ladder(jobs, run.table(spark, "cases"), run.table(spark, "predictions"), supported).write.mode("overwrite").parquet(f"{run.path}/results")
    results = run.table(spark, "results")
    official = ev.official(results)
    ev.breakdown(official).write.mode("overwrite").parquet(f"{run.path}/breakdown")
    ev.orphan_predictions(jobs, run.table(spark, "predictions")).write.mode("overwrite").parquet(f"{run.path}/orphans")
    selected = ev.official(jobs).where("evaluation_partition <> 'test_ood2'").select("scene_id")
    by_scene = ev.scene_macro(run.table(spark, "breakdown").where("evaluation_partition <> 'test_ood2'"))
    return ev.task_score(selected, by_scene).crossJoin(official.agg(*ev.summary()).select("expected_jobs", "evaluated_jobs", "coverage", "observed_mean_score"))


def pairing_signature(jobs: DataFrame) -> str:
    """Equal for plans of the same cases, partitions and seeds under different conditionings."""
    parts = F.concat_ws("|", "case_id", "scene_id", "evaluation_partition", F.col("seed").cast("string"))
    part = F.conv(F.substring(F.sha2(parts, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    row = jobs.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("s")).first()
    return digest([row.n, row.s])


def check_matrix(tasks: list[Task], plans: list[DataFrame]) -> None:
    """Tasks to be compared must share a plan and differ in conditioning."""
    if len(tasks) < 2 or len({t.conditioning for t in tasks}) != len(tasks):
        raise ValueError("a matrix needs two or more tasks of different conditioning")
    if len({pairing_signature(p) for p in plans}) != 1:
        raise ValueError("the plans of a matrix must agree")


def operations(jobs: DataFrame, trains: bool) -> DataFrame:
    """(operation_id, kind, depends_on): train, infer a job, evaluate."""
    spark = jobs.sparkSession
    first = spark.createDataFrame([("train", "train", [])] if trains else [], "operation_id string, kind string, depends_on array<string>")
    infer = jobs.select(F.concat(F.lit("infer:"), "job_id").alias("operation_id"), F.lit("infer").alias("kind"), F.array(*([F.lit("train")] if trains else [])).cast("array<string>").alias("depends_on"))
    last = infer.select(F.concat(F.lit("evaluate:"), F.substring("operation_id", 7, 1 << 20)).alias("operation_id"), F.lit("evaluate").alias("kind"), F.array("operation_id").alias("depends_on"))
    return first.unionByName(infer).unionByName(last)


def stamp() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
