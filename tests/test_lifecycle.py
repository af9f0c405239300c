import json
from pathlib import Path

import pytest
from penduline.operators import lineage
from penduline.plans import config, lifecycle, plugins
from pyspark.sql import functions as F


class Adapter(plugins.DataAdapter):
    def bucket(self, cases):
        return F.col("scene_id")


class Builder(plugins.TaskBuilder):
    def compile(self, task, jobs):
        return {"scenes": sorted(task.scenes or ()), "seeds": list(task.inference_seeds)}


class Broken(plugins.BaselinePlugin):
    def predict(self, instance):
        raise RuntimeError("no card")


def _tables(spark):
    members = spark.createDataFrame([("a", "s", "group_1"), ("b", "s", "group_2"), ("d", "u", "group_1")], "case_id string, scene_id string, grp string")
    cases = spark.createDataFrame([("a", "s", "A ball"), ("b", "s", "B ball"), ("d", "u", "D ball"), ("x", "u", "not planned")], "case_id string, scene_id string, base_prompt string").withColumn(
        "physics", F.map_from_arrays(F.array(F.lit("l")), F.array(F.struct(F.lit(1.0).alias("value"), F.lit("m").alias("unit"), F.lit(True).alias("annotated")))))
    return members, cases


def _task(conditioning="generic"):
    return config.Task("t", "direct_eval", conditioning, (7,))


def _builder():
    return Builder(Adapter({"fps": 24, "note": "x"}))


def _states(folder):
    return [(r["stage"], r["state"]) for r in map(json.loads, (Path(folder) / "state.jsonl").read_text().splitlines())]


def test_fingerprints_of_adapters():
    one, other, faster = Adapter({"fps": 24, "note": "x"}), Adapter({"fps": 24, "note": "y"}), Adapter({"fps": 25, "note": "x"})
    assert one.fingerprint() != other.fingerprint() and one.materialization_fingerprint() == other.materialization_fingerprint() != faster.materialization_fingerprint()


def test_a_run_from_plan_to_report(spark, tmp_path):
    members, cases = _tables(spark)
    instance = _builder().build(_task(), members, cases)
    lineage.verify(instance.document)
    assert {r.case_id for r in instance.adapted.collect()} == {"a", "b", "d"}
    given = instance.jobs.select("job_id", F.lit(True).alias("complete"), F.when(F.col("case_id") == "a", 0.5).otherwise(1.0).alias("score"))
    folder = str(tmp_path / "run")
    row = lifecycle.run_atomic(spark, folder, _task(), members, cases, _builder(), plugins.Given(given))
    assert (row.status, row.coverage, row.score) == ("complete", 1.0, pytest.approx((0.75 + 1) / 2))
    assert _states(folder) == [(s, w) for s in ("build", "freeze", "predict", "evaluate") for w in ("started", "complete")]
    assert "| s | group_1 | 1 | 1 |" in (Path(folder) / "report.md").read_text()
    assert lifecycle.evaluate_again(spark, folder, _task()) == row
    with pytest.raises(FileExistsError):
        lifecycle.run_atomic(spark, folder, _task(), members, cases, _builder(), plugins.Given(given))


def test_failures_and_plans_are_kept(spark, tmp_path):
    members, cases = _tables(spark)
    with pytest.raises(RuntimeError, match="no card"):
        lifecycle.run_atomic(spark, str(tmp_path / "broken"), _task(), members, cases, _builder(), Broken())
    assert _states(tmp_path / "broken")[-1] == ("predict", "failed")
    row = lifecycle.run_atomic(spark, str(tmp_path / "planned"), _task(), members, cases, _builder(), plugins.Planned())
    assert (row.status, row.score, row.evaluated_jobs, row.expected_jobs) == ("partial", None, 0, 3)


def test_a_matrix(spark, tmp_path):
    members, cases = _tables(spark)
    tasks = [_task(c) for c in config.CONDITIONINGS]
    made = {}
    for t, score in zip(tasks, (0.25, 0.75), strict=True):
        jobs = _builder().build(t, members, cases).jobs
        made[t.conditioning] = plugins.Given(jobs.select("job_id", F.lit(True).alias("complete"), F.lit(score).alias("score")))
    index = lifecycle.run_matrix(spark, str(tmp_path / "m"), tasks, members, cases, _builder(), made)
    assert [(r["conditioning"], r["score"]) for r in index] == [("generic", 0.25), ("physics", 0.75)]
    assert json.loads((tmp_path / "m" / "index.json").read_text())["complete"] is True
    assert {r.gain for r in lifecycle.compare(spark, str(tmp_path / "m"), "generic", "physics").collect()} == {0.5}
    with pytest.raises(ValueError, match="two or more"):
        lifecycle.run_matrix(spark, str(tmp_path / "n"), tasks[:1], members, cases, _builder(), made)


def test_the_first_version_goes_by_predictions(spark):
    members, cases = _tables(spark)
    clauses = spark.createDataFrame([("s", 0, "l", "m", True, 2), ("u", 0, "gone", None, True, 1)], "scene_id string, pos int, name string, unit string, required boolean, precision int")
    jobs = _builder().build(_task("physics"), members, cases).jobs
    first = jobs.where("case_id = 'a'").select("job_id", F.create_map(F.lit("m1"), F.lit(0.5), F.lit("m2"), F.lit(None).cast("double")).alias("manual_scores"))
    stray = spark.createDataFrame([("stray", {"m1": 1.0})], "job_id string, manual_scores map<string, double>")
    planned, scores, cells = lifecycle.run_benchmark(_task("physics"), members, cases, clauses, first.unionByName(stray), "manual_scores")
    assert {r.case_id: (r.prompt, r.prompt_fault) for r in planned.collect()} == {"a": ("A ball with l 1.00 m.", None), "b": ("B ball with l 1.00 m.", None), "d": (None, "missing_required_parameter")}
    assert [(r.applicable, r.score) for r in scores.collect()] == [(1, 0.5)]
    assert {(r.scene_id, r.evaluation_partition): r.score for r in cells.collect()} == {("s", "group_1"): 0.5, ("s", "group_2"): None, ("u", "group_1"): None}
    with pytest.raises(ValueError, match="unknown metrics"):
        plugins.measure(first, "nothing")
    with pytest.raises(ValueError, match="there already"):
        plugins.metric("score")(lambda r: r)


def test_plugins_are_loaded_by_name():
    assert plugins.load("penduline.plans.plugins:Planned", plugins.BaselinePlugin) is plugins.Planned
    with pytest.raises(TypeError, match="no BaselinePlugin"):
        plugins.load("penduline.plans.plugins:Instance", plugins.BaselinePlugin)
    with pytest.raises(ValueError, match="module:attribute"):
        plugins.load("penduline.plans.plugins", plugins.BaselinePlugin)
