from dataclasses import replace

import pytest
from penduline.functions import media
from penduline.operators import evaluators as ev
from penduline.operators import scoring, validation
from pyspark.sql import functions as F

GOOD = (25.0, 126)


def _requests(spark, rows):
    """rows: job_id, scene, complete (None: no record), prediction's and reference's (fps, frames) or None, reference's fault."""
    jobs = spark.createDataFrame([(r[0], f"c{r[0]}") for r in rows], "job_id string, case_id string")
    cases = spark.createDataFrame([(f"c{r[0]}", r[1]) for r in rows], "case_id string, scene_id string")
    predictions = spark.createDataFrame([(r[0], r[2], None if r[3] == "none" else f"{r[0]}.mp4") for r in rows if r[2] is not None], "job_id string, complete boolean, video_path string")
    references = spark.createDataFrame([(f"c{r[0]}", None if r[5] else f"{r[0]}.ref", r[5]) for r in rows], "case_id string, path string, reason_code string")
    files = [(f"{r[0]}.{kind}", *m) for r in rows for kind, m in (("mp4", r[3]), ("ref", r[4])) if isinstance(m, tuple)]
    return ev.requests(jobs, cases, predictions, spark.createDataFrame(files, "path string, fps double, frame_count int"), references)


def test_every_rung_of_the_ladder(spark):
    rows = [
        ("ok", "free_fall", True, GOOD, GOOD, None, None), ("scene", "pendulum", None, None, None, None, "wrong_scene"), ("record", "free_fall", None, GOOD, GOOD, None, "prediction_record_missing"),
        ("part", "free_fall", False, GOOD, GOOD, None, "prediction_incomplete"), ("path", "free_fall", True, "none", GOOD, None, "prediction_video_missing"),
        ("file", "free_fall", True, None, GOOD, None, "prediction_video_missing"), ("parent", "free_fall", True, GOOD, GOOD, "ood_parent_missing", "ood_parent_missing"),
        ("noref", "free_fall", True, GOOD, None, None, "reference_video_missing"), ("open", "free_fall", True, GOOD, (None, None), None, "video_open_failed"),
        ("meta", "free_fall", True, GOOD, (0.0, 5), None, "invalid_video_metadata"), ("short", "free_fall", True, GOOD, (25.0, 5), None, "reference_too_short"),
        ("slow", "free_fall", True, GOOD, (7.0, 50), None, "source_fps_too_low"), ("popen", "free_fall", True, (None, 3), GOOD, None, "video_open_failed"),
        ("pmeta", "free_fall", True, (25.0, 0), GOOD, None, "invalid_video_metadata"), ("pslow", "free_fall", True, (5.0, 50), GOOD, None, "source_fps_too_low"),
        ("pshort", "free_fall", True, (25.0, 20), GOOD, None, "insufficient_duration"),
    ]
    got = {r.job_id: (r.status, r.reason_code) for r in ev.checked(_requests(spark, rows), "free_fall", ev.TIMELINES["free_fall"]).collect()}
    assert {k: v[1] for k, v in got.items()} == {r[0]: r[6] for r in rows}
    assert got["scene"][0] == "error" and got["part"][0] == "unavailable" and got["ok"][0] is None
    lasts = {r.job_id: r.last_time for r in ev.checked(_requests(spark, rows[:1]), "free_fall", ev.TIMELINES["free_fall"]).collect()}
    assert lasts == {"ok": 1.0}
    fixed = ev.checked(_requests(spark, [("ok", "pendulum", True, GOOD, (25.0, 100), None)]), "pendulum", ev.TIMELINES["pendulum"]).first()
    assert (fixed.last_time, fixed.reason_code) == (5.0, "insufficient_duration")


def _fall(job, lift=0.0):
    rows = []
    for role in ("reference", "prediction"):
        for k in range(33):
            t = k / 32
            rows.append((job, role, 0, k, t, 10.0, 20 + 150 * t * t * (1 + (lift if role == "prediction" else 0)), True))
    return rows


def test_scores_and_reasons(spark):
    rows = [("a", "free_fall", True, GOOD, GOOD, None), ("b", "free_fall", True, GOOD, GOOD, None), ("c", "free_fall", False, GOOD, GOOD, None), ("d", "free_fall", True, GOOD, GOOD, None), ("e", "slide", True, GOOD, GOOD, None)]
    still = [(j, r, o, k, t, x, 20.0, v) for j, r, o, k, t, x, _, v in _fall("b")]
    points = spark.createDataFrame(_fall("a") + still + _fall("c"), "job_id string, role string, obj int, frame int, time_s double, x double, y double, valid boolean")
    got = {r.job_id: r for r in ev.evaluate(_requests(spark, rows), {"free_fall": (points,)}).collect()}
    assert (got["a"].status, got["a"].score) == ("evaluated", pytest.approx(1.0))
    assert (got["b"].status, got["b"].reason_code, got["b"].score) == ("error", "insufficient_vertical_motion", None)
    assert (got["c"].status, got["c"].reason_code) == ("unavailable", "prediction_incomplete")
    assert (got["d"].status, got["d"].reason_code) == ("error", "unhandled_case_evaluator_error")
    assert (got["e"].status, got["e"].reason_code) == ("unsupported", "scene_evaluator_not_implemented")
    assert len(got) == 5


def test_another_registry(spark):
    """A double in place of a scorer: half a point for every job that has any."""
    half = ev.Evaluator("free_fall", ev.TIMELINES["free_fall"], lambda p: p.groupBy("job_id").agg(F.lit(0.5).alias("score")).withColumn("status", F.lit("evaluated")).withColumn("reason_code", F.lit(None).cast("string")))
    points = spark.createDataFrame([("a", 1)], "job_id string, frame int")
    rows = _requests(spark, [("a", "free_fall", True, GOOD, GOOD, None), ("p", "pendulum", True, GOOD, GOOD, None)])
    got = {r.job_id: (r.status, r.score) for r in ev.evaluate(rows, {"free_fall": (points,)}, {"free_fall": half}).collect()}
    assert got == {"a": ("evaluated", 0.5), "p": ("unsupported", None)}
    assert ev.describe(replace(half, score=scoring.score_orbits)) == {"scene_id": "free_fall", "scorer": "score_orbits", "timeline": {"fps": 32.0, "longest": 1.0, "shortest": 0.2, "least_fps": 8.0, "tolerance": 0.02}}


def test_pendulum_reference(spark):
    kind = "case_id string, physical_parameters map<string, struct<value double, unit string, annotated boolean>>, assets map<string,string>, ood struct<level string, factors array<string>>, provenance struct<source_kind string, parent_case_id string>, received_at timestamp_ntz"
    length = lambda v: {"l": (v, "m", True)}
    case = lambda i, v, video, level, parent: (i, length(v), {"physics_reference_video": video}, (level, []), ("x", parent), None)
    rows = [case("p", 1.0, "p.mp4", "id", None), case("none", 1.0, None, "id", None), case("own", 1.0, "own.mp4", "id", "gone"), case("lost", 1.0, "p.mp4", "ood1", "gone"), case("alone", 1.0, "p.mp4", "ood1", None),
            case("other", 2.0, "p.mp4", "ood1", "p"), case("wrong", 1.0, "x.mp4", "ood1", "p"), case("child", 1.0, "p.mp4", "ood1", "p")]
    got = {r.case_id: (r.mode, r.path, r.reason_code) for r in ev.pendulum_reference(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        "p": ("same_case_reference", "p.mp4", None), "none": (None, None, "no_trustworthy_physics_reference"), "own": ("same_case_reference", "own.mp4", None), "lost": (None, None, "ood_parent_missing"),
        "alone": (None, None, "ood_parent_missing"), "other": (None, None, "ood_parent_physics_mismatch"), "wrong": (None, None, "ood_parent_reference_mismatch"), "child": ("parent_physics_reference", "p.mp4", None)}


def test_overlaps_of_instances_and_their_union(spark):
    rows = [("j", 0, 0, [3], [1]), ("j", 1, 0, [12], [6]), ("j", 0, 1, [0], None), ("j", 1, 1, [], [0])]
    frames = spark.createDataFrame(rows, "job_id string, obj int, frame int, reference array<bigint>, prediction array<bigint>")
    got = {r.obj: (r.mean, r.observed_frame_ratio) for r in ev.instance_ious(frames).collect()}
    assert got == {0: (0.5, 0.5), 1: (pytest.approx(1 / 3), 0.5), -1: (0.75, 0.5)}


def test_frames_of_one_side_are_kept(spark):
    points = spark.createDataFrame([("j", "reference", 0, 0.0, 1.0, 2.0, True), ("j", "prediction", 1, 0.5, 3.0, 4.0, False)], "job_id string, role string, frame int, time_s double, x double, y double, valid boolean")
    ious = spark.createDataFrame([("j", 1, 0.25)], "job_id string, frame int, iou double")
    got = {r.frame: (r.time_s, r.reference_x, r.prediction_y, r.iou) for r in ev.per_frame(points, ious).collect()}
    assert got == {0: (0.0, 1.0, None, None), 1: (0.5, None, 4.0, 0.25)}


def test_size_classes_and_adapter_settings(spark):
    buckets = {"tall": (480, 832, ("a",)), "wide": (832, 480, ("b",))}
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "s string").select("s", media.bucket(F.col("s"), buckets).alias("b")).collect()
    assert [(r.b and (r.b.name, r.b.width)) for r in rows] == [("tall", 480), ("wide", 832), None, None]
    with pytest.raises(ValueError, match="several"):
        media.bucket(F.col("s"), {**buckets, "x": (16, 16, ("a",))})
    with pytest.raises(ValueError, match="multiple"):
        media.bucket(F.col("s"), {"x": (17, 16, ())})
    document = {"spatial": {"width": 480, "height": 832}, "temporal": {"fps": 24, "max_frames": 121}}
    assert media.adapter_media(document)["max_pixels"] == 480 * 832 and media.adapter_media(document)["min_frames"] == 5
    document["spatial"]["aspect_ratio_buckets"] = {"enabled": True, "buckets": {"tall": {"width": 480, "height": 832, "scene_ids": ["a"]}}}
    assert media.adapter_media(document)["buckets"] == {"tall": (480, 832, ("a",))}
    with pytest.raises(ValueError, match="4n"):
        media.adapter_media({**document, "temporal": {"fps": 24, "max_frames": 120}})
    with pytest.raises(ValueError, match="cache or a run"):
        media.media_path(F.col("s"), "/x", name=F.col("s"))
    paths = spark.createDataFrame([("/abs/v.mp4",), ("v.mp4",), (None,)], "p string").select(media.media_path(F.col("p"), "/home/").alias("p"), media.media_path(F.col("p"), "/home", run="/run", name=F.lit("n.mp4")).alias("d")).collect()
    assert [(r.p, r.d) for r in paths] == [("/abs/v.mp4", "/run/media/n.mp4"), ("/home/v.mp4", "/run/media/n.mp4"), (None, "/run/media/n.mp4")]
    assert media.scale_filter(480, 832) == "scale=480:832:force_original_aspect_ratio=decrease,pad=480:832:(ow-iw)/2:(oh-ih)/2:color=black,setsar=1"


def test_issues_of_optional_columns(spark):
    cases = spark.sql("""SELECT '1.0' AS schema_version, 'c' AS case_id, 's' AS scene_id, 'train' AS view_a_split, map('p', named_struct('value', 1.0D, 'unit', 'm', 'annotated', true)) AS physical_parameters,
      map('reference_video', 'v', 'source_video', 'v') AS assets, map('i2v', named_struct('first_frame', ''), 'ti2v', named_struct('first_frame', 'f')) AS input_views, true AS has_real_reference_video,
      named_struct('level', 'id', 'factors', array()) AS ood, named_struct('source_kind', 'real_capture', 'parent_case_id', null) AS provenance, null AS received_at,
      named_struct('encoded_to_physical_speed', 0.0D) AS temporal, named_struct('source_start_frame', -1, 'review_status', 'draft') AS alignment""")
    scenes = spark.createDataFrame([("s", ["p", "q"], ["x"])], "scene_id string, id_parameters array<string>, ood1_factors array<string>")
    codes = {r.code for r in validation.case_issues(cases, scenes).collect()}
    assert codes == {"invalid_i2v", "missing_physics", "invalid_time_scale", "invalid_alignment_frame", "unreviewed_alignment", "alignment_not_materialized"}
    fine = cases.withColumn("alignment", F.lit(None).cast("struct<source_start_frame: int, review_status: string>")).withColumn("temporal", F.lit(None).cast("struct<encoded_to_physical_speed: double>"))
    assert {r.code for r in validation.case_issues(fine, scenes).collect()} == {"invalid_i2v", "missing_physics"}


def test_required_keys_and_counts(spark):
    rows = spark.createDataFrame([('{"a": 1, "c": null}',), ("[]",), ("{broken",), (None,), ("{}",)], "body string")
    assert [r.m for r in rows.select(validation.missing_keys(F.col("body"), ("c", "b", "a")).alias("m")).collect()] == [["b"], None, None, None, ["a", "b", "c"]]
    counts = spark.createDataFrame([("x", 3), ("y", 2), ("new", 1)], "k string, n bigint")
    assert {tuple(r) for r in validation.count_faults(counts, {"x": 3, "y": 5, "z": 1}, "k").collect()} == {("y", 5, 2), ("z", 1, 0), ("new", None, 1)}
