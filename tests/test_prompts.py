from penduline.operators import etl, prompts
from pyspark.sql import functions as F

CASES = "case_id string, scene_id string, base_prompt string, physics map<string, struct<value: double, unit: string, annotated: boolean>>"
CLAUSES = "scene_id string, pos int, name string, unit string, required boolean, precision int"


def test_clauses_and_faults(spark):
    q = lambda v, u="m", a=True: (v, u, a)
    cases = spark.createDataFrame([
        ("good", "s", "A ball", {"r": q(2.675), "h": q(1.0, "m", None)}), ("optional", "s", "A ball", {"r": q(0.25), "h": q(1.0, "m", False)}), ("missing", "s", "A ball", {"r": q(None)}),
        ("unit", "s", "A ball", {"r": q(1.0, "cm")}), ("none", "other", "A wave", None)], CASES)
    clauses = spark.createDataFrame([("s", 1, "r", "m", True, 2), ("s", 0, "h", None, False, 1)], CLAUSES)
    got = {r.case_id: r for r in prompts.rendered(cases, clauses, "physics").collect()}
    assert got["good"].prompt == "A ball with h 1.0 m, r 2.67 m." and got["good"].used_parameters == ["h", "r"]
    assert got["optional"].prompt == "A ball with r 0.25 m." and got["none"].prompt == "A wave"
    assert (got["missing"].prompt, got["missing"].fault) == (None, "missing_required_parameter") and (got["unit"].prompt, got["unit"].fault) == (None, "unit_mismatch")
    assert prompts.rendered(cases.where("false"), clauses, "physics").count() == 0


def test_pictures_are_shared_between_conditionings(spark):
    cases = spark.createDataFrame([("a", "480x832"), ("b", "832x480")], "case_id string, bucket string")
    made = [prompts.adaptations(cases, "eval", c, F.col("bucket"), F.lit(1.0), F.lit(p)).orderBy("case_id").collect() for c, p in (("generic", "x"), ("physics", "y"))]
    assert [r.materialization for r in made[0]] == [r.materialization for r in made[1]] and not {r.fingerprint for r in made[0]} & {r.fingerprint for r in made[1]}
    assert set(made[0][0].stages) == set(prompts.STAGES)


def test_etl(spark):
    cases = spark.createDataFrame([("a", 10, "white"), ("b", 20, "white"), ("c", 20, "black"), ("d", 33, "black")], "case_id string, value int, bg string")
    got = {r.case_id: (r.split, r.reason) for r in etl.factor_pure(cases, F.col("bg"), "white", F.col("value") == 10).collect()}
    assert got == {"a": ("test_id", None), "b": ("train", None), "c": ("test_ood1", None), "d": (None, "value_not_trained_on")}
    rows, faults = etl.staging(spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string"), spark.createDataFrame([("a", "train", "p"), ("b", "train", " "), ("c", "eval", "p")], "case_id string, role string, prompt string"))
    assert [r.case_id for r in rows.collect()] == ["a"] and sorted(r.case_id for r in faults.collect()) == ["b", "c"]
    assert etl.newest(spark.createDataFrame([("p1", 1), ("p3", 2), ("p2", 2)], "path string, modified int")).first().path == "p3"
    loss = spark.createDataFrame([(1, k, float(k)) for k in range(1, 61)], "run int, step int, value double")
    last = etl.loss_table(loss, 20).where("step = 60").first()
    assert (last.epoch, last.mean25, last.median25, last.mean100) == (3, 48.0, 48.0, 30.5)
    migrated = etl.migrate_views(spark.createDataFrame([("A",), ("B",)], "view string"))
    assert sorted(r.view_id for r in migrated.collect()) == ["view_a", "view_b"]
