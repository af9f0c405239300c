"""Planned jobs left-joined with predictions, a total ladder of states, and strict aggregation.

Nothing is dropped or filled with zero: a job without a score keeps a null score, and a mean over jobs is null unless
every one of them has a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States and reasons.
EVALUATED, UNAVAILABLE, ERROR, UNSUPPORTED = "evaluated", "unavailable", "error", "unsupported"
CASE_MISSING, DUPLICATES = "case_missing_from_frozen_dataset", "duplicate_prediction_records"
NO_RECORD, INCOMPLETE = "prediction_record_missing", "prediction_incomplete"
NOT_IMPLEMENTED, UNHANDLED = "scene_evaluator_not_implemented", "unhandled_case_evaluator_error"
UNKNOWN_JOB = "unknown_prediction_job"
TRAIN_SEEN = "train_seen"


def per_job(predictions: DataFrame) -> DataFrame:
    """(job_id, records, complete, score): predictions counted before the join, so that a job joins one row at most.
    complete and score mean something only where records = 1. Predictions without job_id belong to no job."""
    return predictions.where("job_id IS NOT NULL").groupBy("job_id").agg(
        F.count("*").alias("records"), F.bool_or(F.coalesce("complete", F.lit(False))).alias("complete"), F.max("score").alias("score"))


def ladder(jobs: DataFrame, cases: DataFrame, predictions: DataFrame, supported: list[str] | None = None) -> DataFrame:
    """jobs with scene_id (of the case, if the job has none), status, reason_code, score; the first rung that holds counts.

    jobs: job_id, case_id, evaluation_partition, ... cases: case_id, scene_id. predictions: job_id, complete, score.
    Columns of jobs that are named like a result are replaced by it.
    supported: the scenes that have an evaluator, all by default. A complete prediction without a score is an error of
    its evaluator.
    """
    scene = cases.select(F.col("case_id"), F.col("scene_id").alias("case_scene"), F.lit(True).alias("known")).dropDuplicates(["case_id"])
    jobs = jobs.drop("known", "case_scene", "records", "complete", "score", "status", "reason_code")
    own = "scene_id" in jobs.columns
    rows = jobs.join(per_job(predictions), "job_id", "left").join(scene, "case_id", "left")
    rows = rows.withColumn("scene_id", F.coalesce("scene_id", "case_scene") if own else F.col("case_scene"))
    has = F.lit(True) if supported is None else F.coalesce(F.col("scene_id").isin(supported), F.lit(False))
    rungs: list[tuple[Column, str, str | None]] = [
        (F.col("known").isNull(), ERROR, CASE_MISSING),
        (F.col("records") > 1, ERROR, DUPLICATES),
        (has & F.col("records").isNull(), UNAVAILABLE, NO_RECORD),
        (has & ~F.col("complete"), UNAVAILABLE, INCOMPLETE),
        (~has, UNSUPPORTED, NOT_IMPLEMENTED),
        (F.col("score").isNull(), ERROR, UNHANDLED),
    ]
    status, reason = F.lit(EVALUATED), F.lit(None).cast("string")
    for condition, state, code in reversed(rungs):
        status, reason = F.when(condition, state).otherwise(status), F.when(condition, code).otherwise(reason)
    return rows.withColumn("status", status).withColumn("reason_code", reason).withColumn(
        "score", F.when(F.col("status") == EVALUATED, F.col("score"))).drop("known", "case_scene", "records", "complete")


def orphan_predictions(jobs: DataFrame, predictions: DataFrame) -> DataFrame:
    """(job_id, records, code): predictions of jobs that were never planned."""
    return predictions.join(jobs.select("job_id").distinct(), "job_id", "left_anti").groupBy("job_id").agg(
        F.count("*").alias("records")).withColumn("code", F.lit(UNKNOWN_JOB))


def official(results: DataFrame) -> DataFrame:
    """Without the diagnostics on training cases."""
    return results.where(~F.col("evaluation_partition").eqNullSafe(F.lit(TRAIN_SEEN)))


def strict_mean(score: str = "score") -> Column:
    """The mean if every row has a score, else null."""
    return F.when(F.count(score) == F.count("*"), F.avg(score))


def summary(score: str = "score") -> list[Column]:
    """expected_jobs, evaluated_jobs, coverage, score, observed_mean_score of a group."""
    return [
        F.count("*").alias("expected_jobs"), F.count(score).alias("evaluated_jobs"),
        F.coalesce(F.try_divide(F.count(score).cast("double"), F.count("*")), F.lit(0.0)).alias("coverage"),
        strict_mean(score).alias("score"), F.avg(score).alias("observed_mean_score"),
    ]


def breakdown(results: DataFrame, *keys: str) -> DataFrame:
    """summary() by keys, (scene_id, evaluation_partition) by default."""
    return results.groupBy(*(keys or ("scene_id", "evaluation_partition"))).agg(*summary())


def status_counts(results: DataFrame, *keys: str) -> DataFrame:
    """keys, statuses: 'status=count' sorted by status and joined by commas."""
    counts = results.groupBy(*keys, "status").count()
    return counts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "count"))), ",").alias("statuses"))


def scene_macro(cells: DataFrame) -> DataFrame:
    """(scene_id, partitions, score): mean over the partitions that are there; null if any of theirs is null."""
    return cells.groupBy("scene_id").agg(F.count("*").alias("partitions"), strict_mean().alias("score"))


def task_score(scenes: DataFrame, by_scene: DataFrame) -> DataFrame:
    """One row (scenes, scored_scenes, score, status): mean over the selected scenes. A scene without jobs makes it null."""
    return scenes.select("scene_id").distinct().join(by_scene.select("scene_id", "score"), "scene_id", "left").agg(
        F.count("*").alias("scenes"), F.count("score").alias("scored_scenes"), strict_mean().alias("score")).withColumn(
        "status", F.when(F.col("score").isNotNull(), "complete").otherwise("partial"))


def weighted_metrics(metrics: DataFrame, *keys: str, require_all: bool = True) -> DataFrame:
    """keys, applicable, weight_coverage, score from metrics(keys, weight, status, score). Not applicable metrics and
    those without weight leave the denominator; with require_all the score is null unless all others are evaluated."""
    applies = (F.col("status") != "not_applicable") & (F.col("weight") > 0)
    done = applies & (F.col("status") == EVALUATED) & F.col("score").isNotNull()
    total, got = F.sum(F.when(applies, F.col("weight"))), F.sum(F.when(done, F.col("weight")))
    coverage = F.coalesce(F.try_divide(got, total), F.lit(0.0))
    mean = F.try_divide(F.sum(F.when(done, F.col("weight") * F.col("score"))), got)
    return metrics.groupBy(*keys).agg(F.count_if(applies).alias("applicable"), coverage.alias("weight_coverage"),
                                      (F.when(coverage >= 1 - 1e-12, mean) if require_all else mean).alias("score"))
