import pytest
from penduline.operators import evaluation as ev

JOBS = "job_id string, case_id string, evaluation_partition string, score string"
PREDICTIONS = "job_id string, complete boolean, score double"


def _ladder(spark, jobs, cases, predictions, supported=None):
    return ev.ladder(spark.createDataFrame([(*j, None) for j in jobs], JOBS), spark.createDataFrame(cases, "case_id string, scene_id string"), spark.createDataFrame(predictions, PREDICTIONS), supported)


def test_every_rung(spark):
    jobs = [(f"j{k}", "c1" if k else "nowhere", "test_id") for k in range(7)] + [("other", "c2", "test_id"), ("nulled", None, None)]
    predictions = [("j0", True, 1.0), ("j1", True, 0.1), ("j1", False, 0.2), ("j3", False, 0.5), ("j4", True, 0.8), ("j5", None, 0.7), ("j6", True, None), ("stray", True, 0.3), (None, True, 0.3)]
    got = {r.job_id: (r.status, r.reason_code, r.score) for r in _ladder(spark, jobs, [("c1", "s"), ("c2", "t"), ("c1", "s")], predictions, ["s"]).collect()}
    assert got == {
        "j0": ("error", "case_missing_from_frozen_dataset", None), "j1": ("error", "duplicate_prediction_records", None), "j2": ("unavailable", "prediction_record_missing", None),
        "j3": ("unavailable", "prediction_incomplete", None), "j4": ("evaluated", None, 0.8), "j5": ("unavailable", "prediction_incomplete", None), "j6": ("error", "unhandled_case_evaluator_error", None),
        "other": ("unsupported", "scene_evaluator_not_implemented", None), "nulled": ("error", "case_missing_from_frozen_dataset", None)}


def test_partial_task(spark):
    results = _ladder(spark, [("a", "c1", "test_id"), ("b", "c2", "test_id")], [("c1", "s"), ("c2", "s")], [("a", True, 0.8)])
    r = ev.breakdown(results).first()
    assert (r.expected_jobs, r.evaluated_jobs, r.coverage, r.score, r.observed_mean_score) == (2, 1, 0.5, None, 0.8)
    task = ev.task_score(spark.createDataFrame([("s",), ("unseen",)], "scene_id string"), ev.scene_macro(ev.breakdown(results.where("score IS NOT NULL")))).first()
    assert (task.scenes, task.scored_scenes, task.score, task.status) == (2, 1, None, "partial")


def test_weighted_metrics(spark):
    rows = [("j", 0.25, "evaluated", 0.8), ("j", 0.45, "evaluated", 0.6), ("j", 0.30, "evaluated", 0.9), ("k", 0.25, "evaluated", 0.8), ("k", 0.45, "evaluated", 0.6), ("k", 0.30, "not_applicable", None), ("l", 0.25, "evaluated", 0.8), ("l", 0.45, "unavailable", None), ("l", 0.0, "evaluated", 1.0)]
    m = spark.createDataFrame(rows, "job_id string, weight double, status string, score double")
    strict = {r.job_id: r.score for r in ev.weighted_metrics(m, "job_id").collect()}
    assert strict["j"] == pytest.approx(0.74) and strict["k"] == pytest.approx((0.8 * 0.25 + 0.6 * 0.45) / 0.70) and strict["l"] is None
    assert {r.job_id: r.score for r in ev.weighted_metrics(m, "job_id", require_all=False).collect()}["l"] == pytest.approx(0.8)


def test_empty(spark):
    assert _ladder(spark, [], [], []).count() == 0
    assert ev.task_score(spark.createDataFrame([], "scene_id string"), spark.createDataFrame([], "scene_id string, score double")).first().scenes == 0
