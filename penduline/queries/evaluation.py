"""Evaluation queries over orders (jobs), customers (cases) and line items (predictions), and over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import evaluation as ev
from penduline.queries.registry import query
from penduline.session import table


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("evaluation_partition"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("scene_id"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linestatus") == "F").alias("complete"), (F.col("l_discount") * 10).alias("score"))


def _results(spark: SparkSession, d: str, supported: list[str] | None = None) -> DataFrame:
    return ev.ladder(_jobs(spark, d), _cases(spark, d), _predictions(spark, d), supported)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with one prediction, and of two partitions those without any: some cells are complete, some aren't."""
    return _results(spark, d).where("status = 'evaluated' OR (reason_code = 'prediction_record_missing' AND evaluation_partition IN ('1-URGENT', '2-HIGH'))")


_PRED = "pred AS (SELECT l_orderkey AS job_id, count(*) AS n, bool_or(l_linestatus = 'F') AS done, max(l_discount) * 10 AS sc FROM lineitem GROUP BY l_orderkey)"
_R = _PRED + """, r AS (SELECT o_orderkey AS job_id, o_custkey AS case_id, c_mktsegment AS scene_id, o_orderpriority AS evaluation_partition,
  CASE WHEN c_custkey IS NULL THEN 'error' WHEN n > 1 THEN 'error' WHEN n IS NULL OR NOT done THEN 'unavailable' WHEN sc IS NULL THEN 'error' ELSE 'evaluated' END AS status,
  CASE WHEN c_custkey IS NULL THEN 'case_missing_from_frozen_dataset' WHEN n > 1 THEN 'duplicate_prediction_records' WHEN n IS NULL THEN 'prediction_record_missing' WHEN NOT done THEN 'prediction_incomplete' WHEN sc IS NULL THEN 'unhandled_case_evaluator_error' END AS reason_code,
  CASE WHEN c_custkey IS NOT NULL AND n = 1 AND done THEN sc END AS score
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN pred ON job_id = o_orderkey)"""
_MIXED = _R + ", m AS (SELECT * FROM r WHERE status = 'evaluated' OR (reason_code = 'prediction_record_missing' AND evaluation_partition IN ('1-URGENT', '2-HIGH')))"
_SUMMARY = "count(*) AS expected_jobs, count(score) AS evaluated_jobs, count(score)::DOUBLE / count(*) AS coverage, CASE WHEN count(score) = count(*) THEN round(avg(score), 6) END AS score, round(avg(score), 6) AS observed_mean_score"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {_R} SELECT job_id, case_id, scene_id, evaluation_partition, status, reason_code, score FROM r")
def status_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


@query(f"""WITH {_R} SELECT job_id, CASE WHEN reason_code IN ('case_missing_from_frozen_dataset', 'duplicate_prediction_records') OR scene_id IN ('BUILDING', 'MACHINERY') THEN status ELSE 'unsupported' END AS status,
  CASE WHEN reason_code IN ('case_missing_from_frozen_dataset', 'duplicate_prediction_records') OR scene_id IN ('BUILDING', 'MACHINERY') THEN reason_code ELSE 'scene_evaluator_not_implemented' END AS reason_code FROM r""")
def evaluator_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d, ["BUILDING", "MACHINERY"]).select("job_id", "status", "reason_code")


@query(f"WITH {_R} SELECT scene_id, evaluation_partition, {_SUMMARY} FROM r GROUP BY ALL")
def partition_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.breakdown(_results(spark, d)), "score", "observed_mean_score")


@query(f"WITH {_MIXED} SELECT scene_id, evaluation_partition, {_SUMMARY} FROM m GROUP BY ALL")
def partition_breakdown_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.breakdown(_mixed(spark, d)), "score", "observed_mean_score")


@query(f"WITH {_MIXED}, c AS (SELECT scene_id, evaluation_partition, CASE WHEN count(score) = count(*) THEN avg(score) END AS score FROM m WHERE evaluation_partition > '1-URGENT' GROUP BY ALL) SELECT scene_id, count(*) AS partitions, CASE WHEN count(score) = count(*) THEN round(avg(score), 6) END AS score FROM c GROUP BY scene_id")
def scene_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.scene_macro(ev.breakdown(_mixed(spark, d).where("evaluation_partition > '1-URGENT'"))), "score")


@query(f"WITH {_MIXED} SELECT scene_id, {_SUMMARY} FROM m WHERE evaluation_partition > '2-HIGH' GROUP BY scene_id")
def scene_direct_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.breakdown(_mixed(spark, d).where("evaluation_partition > '2-HIGH'"), "scene_id"), "score", "observed_mean_score")


@query(f"""WITH {_MIXED}, c AS (SELECT scene_id, evaluation_partition, CASE WHEN count(score) = count(*) THEN avg(score) END AS score FROM m WHERE evaluation_partition > '2-HIGH' GROUP BY ALL),
  s AS (SELECT scene_id, CASE WHEN count(score) = count(*) THEN avg(score) END AS score FROM c GROUP BY scene_id), a AS (SELECT DISTINCT c_mktsegment AS scene_id FROM customer)
  SELECT count(*) AS scenes, count(score) AS scored_scenes, CASE WHEN count(score) = count(*) THEN round(avg(score), 6) END AS score, CASE WHEN count(score) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM a LEFT JOIN s USING (scene_id)""")
def task_score(spark: SparkSession, d: str) -> DataFrame:
    by_scene = ev.scene_macro(ev.breakdown(_mixed(spark, d).where("evaluation_partition > '2-HIGH'")))
    return _rounded(ev.task_score(_cases(spark, d), by_scene), "score")


@query(f"WITH {_R}, c AS (SELECT scene_id, status, count(*) AS n FROM r GROUP BY ALL) SELECT scene_id, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM c GROUP BY scene_id")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.status_counts(_results(spark, d), "scene_id")


@query("SELECT l_orderkey AS job_id, count(*) AS records, 'unknown_prediction_job' AS code FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey")
def orphan_predictions(spark: SparkSession, d: str) -> DataFrame:
    planned = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job_id"))
    return ev.orphan_predictions(planned, _predictions(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Long form of the manual scores with the weights of the default metric set."""
    weights = F.create_map(*(F.lit(x) for kv in {"common_sense": 0.25, "physical": 0.45, "visual": 0.30}.items() for x in kv))
    names = F.array(*(F.lit(n) for n in ("common_sense", "physical", "visual")))
    p = table(spark, d, "predictions")
    rows = p.select("prediction_no", "case_id", "evaluation_partition", "prompt_profile_id", F.explode(names).alias("metric"), "manual_scores")
    score = F.col("manual_scores")[F.col("metric")]
    return rows.withColumn("weight", weights[F.col("metric")]).withColumn("score", F.when(score.between(0, 1), score)).withColumn(
        "status", F.when((F.col("metric") == "visual") & (F.col("evaluation_partition") == "test_ood1"), "not_applicable").when(F.col("score").isNotNull(), "evaluated").otherwise("unavailable")).drop("manual_scores")


_METRICS = """names AS (SELECT unnest(['common_sense', 'physical', 'visual']) AS metric, unnest([0.25::DOUBLE, 0.45, 0.30]) AS weight),
  raw AS (SELECT prediction_no, evaluation_partition, prompt_profile_id, metric, weight, manual_scores[metric] AS s FROM predictions, names),
  metrics AS (SELECT *, CASE WHEN s BETWEEN 0 AND 1 THEN s END AS score, CASE WHEN metric = 'visual' AND evaluation_partition = 'test_ood1' THEN 'not_applicable' WHEN s BETWEEN 0 AND 1 THEN 'evaluated' ELSE 'unavailable' END AS status FROM raw)"""
_APPLIES = "status <> 'not_applicable' AND weight > 0"
_DONE = "status = 'evaluated' AND weight > 0"
_COVERAGE = f"coalesce(sum(weight) FILTER ({_DONE}) / sum(weight) FILTER ({_APPLIES}), 0)"
_MEAN = f"sum(weight * score) FILTER ({_DONE}) / sum(weight) FILTER ({_DONE})"
_JOB_SCORES = f"js AS (SELECT prediction_no, any_value(evaluation_partition) AS evaluation_partition, any_value(prompt_profile_id) AS prompt_profile_id, {_COVERAGE} AS wc, CASE WHEN {_COVERAGE} >= 1 - 1e-12 THEN {_MEAN} END AS score FROM metrics GROUP BY prediction_no)"


@query(f"WITH {_METRICS} SELECT prediction_no, count(*) FILTER ({_APPLIES}) AS applicable, round({_COVERAGE}, 6) AS weight_coverage, CASE WHEN {_COVERAGE} >= 1 - 1e-12 THEN round({_MEAN}, 6) END AS score FROM metrics GROUP BY prediction_no")
def weighted_metric_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.weighted_metrics(_metrics(spark, d), "prediction_no"), "weight_coverage", "score")


@query(f"WITH {_METRICS} SELECT prediction_no, count(*) FILTER ({_APPLIES}) AS applicable, round({_COVERAGE}, 6) AS weight_coverage, round({_MEAN}, 6) AS score FROM metrics GROUP BY prediction_no")
def reweighted_metric_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.weighted_metrics(_metrics(spark, d), "prediction_no", require_all=False), "weight_coverage", "score")


def _job_scores(spark: SparkSession, d: str) -> DataFrame:
    return ev.weighted_metrics(_metrics(spark, d), "prediction_no", "evaluation_partition", "prompt_profile_id")


@query(f"WITH {_METRICS}, {_JOB_SCORES} SELECT evaluation_partition, prompt_profile_id, count(*) AS jobs, count(score) AS scored_jobs, round(avg(score), 6) AS mean_score, round(avg(wc), 6) AS mean_coverage FROM js GROUP BY ALL")
def metric_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_job_scores(spark, d).groupBy("evaluation_partition", "prompt_profile_id").agg(
        F.count("*").alias("jobs"), F.count("score").alias("scored_jobs"), F.avg("score").alias("mean_score"), F.avg("weight_coverage").alias("mean_coverage")), "mean_score", "mean_coverage")


@query(f"WITH {_METRICS}, {_JOB_SCORES} SELECT CASE WHEN evaluation_partition IS NOT DISTINCT FROM 'train_seen' THEN 'auxiliary' ELSE 'official' END AS part, count(*) AS jobs, count(score) AS scored_jobs, round(avg(score), 6) AS mean_score FROM js GROUP BY ALL")
def official_vs_auxiliary(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("evaluation_partition").eqNullSafe(F.lit(ev.TRAIN_SEEN)), "auxiliary").otherwise("official")
    return _rounded(_job_scores(spark, d).groupBy(part.alias("part")).agg(F.count("*").alias("jobs"), F.count("score").alias("scored_jobs"), F.avg("score").alias("mean_score")), "mean_score")


@query(f"WITH {_METRICS}, {_JOB_SCORES} SELECT coalesce(prompt_profile_id, '') AS prompt_profile_id, count(*) AS jobs, round(avg(score), 6) AS mean_score FROM js WHERE evaluation_partition IS DISTINCT FROM 'train_seen' GROUP BY 1")
def conditioning_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.official(_job_scores(spark, d)).groupBy(F.coalesce("prompt_profile_id", F.lit("")).alias("prompt_profile_id")).agg(
        F.count("*").alias("jobs"), F.avg("score").alias("mean_score")), "mean_score")


@query("SELECT scene_id, coalesce(view_a_split, '') AS split, count(*) AS n_rows, count(DISTINCT case_id) AS n_cases FROM cases GROUP BY ALL")
def scene_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").groupBy("scene_id", F.coalesce("view_a_split", F.lit("")).alias("split")).agg(F.count("*").alias("n_rows"), F.countDistinct("case_id").alias("n_cases"))


@query("SELECT baseline_id, count(*) AS planned, count(video_path) AS recorded, count(*) FILTER (lower(status) = 'completed') AS completed, count(*) FILTER (lower(status) = 'failed') AS failed FROM predictions GROUP BY baseline_id")
def worker_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower("status")
    return table(spark, d, "predictions").groupBy("baseline_id").agg(F.count("*").alias("planned"), F.count("video_path").alias("recorded"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"))
