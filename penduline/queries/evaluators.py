"""Scene evaluators, their references and diagnostics, adapter columns and ids over the domain tables and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.functions import media, text
from penduline.operators import evaluators, scoring, validation
from penduline.queries.registry import query
from penduline.queries.scoring import _FREE_FALL, _points
from penduline.queries.validation import _PHYSICS
from penduline.session import materialize, table

# Size classes of an adapter and its frame rate and limits.
BUCKETS = {"portrait": (480, 832, ("pendulum", "free_fall", "uniform_circular_motion")), "landscape": (832, 480, ("collision_1d", "inclined_plane_slide"))}
FPS, MOST_FRAMES, LEAST_FRAMES = 24.0, 121, 5

_PHYS_REF = f"""last AS (SELECT case_id, arg_max({{'scene': scene_id, 'physics': {_PHYSICS}, 'video': nullif(assets['physics_reference_video'], ''), 'is_real': coalesce(has_real_reference_video, false), 'level': ood.level, 'parent_id': nullif(provenance.parent_case_id, '')}}, received_at) AS c FROM cases GROUP BY case_id),
  refs AS (SELECT l.case_id, l.c.scene AS scene_id, l.c.parent_id AS parent_id, l.c.video AS video, p.c.video AS p_video, l.c.video IS NOT NULL AND l.c.is_real AS own, coalesce(l.c.level = 'ood1', false) AS ood,
    CASE WHEN l.c.video IS NOT NULL AND l.c.is_real THEN NULL WHEN l.c.parent_id IS NULL THEN 'no_trustworthy_physics_reference' WHEN p.case_id IS NULL THEN 'ood_parent_missing'
      WHEN p.c.physics IS DISTINCT FROM l.c.physics THEN 'ood_parent_physics_mismatch' WHEN p.c.video IS NULL THEN 'no_trustworthy_physics_reference' END AS common_reason,
    CASE WHEN l.c.video IS NULL THEN 'no_trustworthy_physics_reference' WHEN NOT coalesce(l.c.level = 'ood1', false) THEN NULL WHEN p.case_id IS NULL THEN 'ood_parent_missing'
      WHEN p.c.physics IS DISTINCT FROM l.c.physics THEN 'ood_parent_physics_mismatch' WHEN p.c.video IS DISTINCT FROM l.c.video THEN 'ood_parent_reference_mismatch' END AS pendulum_reason
    FROM last l LEFT JOIN last p ON p.case_id = l.c.parent_id)"""

_TIMELINES = ", ".join(f"('{k}', {t.fps}::DOUBLE, {t.longest}::DOUBLE, {'NULL' if t.shortest is None else t.shortest}::DOUBLE)" for k, t in evaluators.TIMELINES.items())


def _bad_media(fps: str, n: str) -> str:
    return f"""WHEN {fps} IS NULL OR {n} IS NULL THEN 'video_open_failed' WHEN {fps} <= 0 OR {n} < 1 THEN 'invalid_video_metadata'"""


def _bad_sampling(fps: str, n: str) -> str:
    return f"""WHEN {fps} < 8 THEN 'source_fps_too_low' WHEN ({n} - 1) / {fps} + 0.02::DOUBLE < last_time OR round_even(last_time * {fps}, 0) >= {n} THEN 'insufficient_duration'"""


_LIFECYCLE = f"""WITH {_PHYS_REF}, timelines(scene_id, fps, longest, shortest) AS (VALUES {_TIMELINES}),
  jobs AS (SELECT job_id, arg_max({{'case_id': case_id, 'done': coalesce(lower(status) = 'completed', false), 'path': video_path}}, {{'a': submitted_at, 'b': prediction_no}}) AS j FROM predictions WHERE job_id IS NOT NULL GROUP BY job_id),
  files AS (SELECT path, (5 + max(size_bytes) % 40)::DOUBLE AS fps, max(size_bytes) % 200 AS n FROM asset_lock GROUP BY path),
  videos AS (SELECT video_path AS path, (5 + max(prediction_no) % 30)::DOUBLE AS fps, max(prediction_no) % 150 AS n FROM predictions WHERE video_path IS NOT NULL GROUP BY video_path),
  rows_ AS (SELECT job_id, j.case_id AS case_id, r.scene_id, j.done AS done, j.path AS p_path, v.path IS NOT NULL AS p_known, v.fps AS p_fps, v.n AS p_n, t.fps AS t_fps, t.scene_id IS NOT NULL AS supported,
      CASE WHEN r.scene_id = 'pendulum' THEN pendulum_reason ELSE common_reason END AS r_reason, f.path IS NOT NULL AS r_known, f.fps AS r_fps, f.n AS r_n,
      CASE WHEN t.shortest IS NULL THEN t.longest WHEN least(t.longest, (f.n - 1) / nullif(f.fps, 0)) >= t.shortest AND floor(least(t.longest, (f.n - 1) / nullif(f.fps, 0)) * t.fps + 1e-9) >= 1
        AND f.n IS NOT NULL THEN floor(least(t.longest, (f.n - 1) / nullif(f.fps, 0)) * t.fps + 1e-9) / t.fps END AS last_time
    FROM jobs LEFT JOIN refs r ON r.case_id = j.case_id LEFT JOIN timelines t ON t.scene_id = r.scene_id
    LEFT JOIN files f ON f.path = CASE WHEN r.scene_id = 'pendulum' THEN CASE WHEN pendulum_reason IS NULL THEN video END WHEN own THEN video WHEN common_reason IS NULL THEN p_video END
    LEFT JOIN videos v ON v.path = j.path),
  said AS (SELECT *, CASE WHEN NOT supported THEN 'scene_evaluator_not_implemented' WHEN NOT done THEN 'prediction_incomplete' WHEN coalesce(p_path, '') = '' OR NOT p_known THEN 'prediction_video_missing'
      WHEN r_reason IS NOT NULL THEN r_reason WHEN NOT r_known THEN 'reference_video_missing' {_bad_media('r_fps', 'r_n')} WHEN last_time IS NULL THEN 'reference_too_short'
      {_bad_sampling('r_fps', 'r_n')} {_bad_media('p_fps', 'p_n')} {_bad_sampling('p_fps', 'p_n')} ELSE 'unhandled_case_evaluator_error' END AS reason_code FROM rows_)
  SELECT job_id, case_id, scene_id, CASE reason_code WHEN 'scene_evaluator_not_implemented' THEN 'unsupported' WHEN 'unhandled_case_evaluator_error' THEN 'error' ELSE 'unavailable' END AS status, reason_code FROM said"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The last prediction of each job is its record. Frame rates and counts of files are made of their sizes, as the tables hold
    none."""
    p = table(spark, d, "predictions")
    last = p.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by(F.struct("case_id", F.coalesce(F.lower("status") == "completed", F.lit(False)).alias("complete"), "video_path"), F.struct("submitted_at", "prediction_no")).alias("j"))
    jobs = materialize(last.select("job_id", "j.*"))
    cases = table(spark, d, "cases")
    size, no = F.max("size_bytes"), F.max("prediction_no")
    files = table(spark, d, "asset_lock").groupBy("path").agg((5 + size % 40).alias("fps"), (size % 200).alias("frame_count"))
    videos = p.where("video_path IS NOT NULL").groupBy(F.col("video_path").alias("path")).agg((5 + no % 30).alias("fps"), (no % 150).alias("frame_count"))
    scene = cases.groupBy("case_id").agg(F.max_by("scene_id", "received_at").alias("scene_id"))
    common, own = validation.resolve_reference(cases), evaluators.pendulum_reference(cases)
    pendulum = scene.where("scene_id = 'pendulum'").select("case_id")
    references = common.join(pendulum, "case_id", "left_anti").unionByName(own.join(pendulum, "case_id", "left_semi"))
    return evaluators.requests(jobs.select("job_id", "case_id"), scene, jobs, files.unionByName(videos), references)


@query(_LIFECYCLE)
def case_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """No scene is observed here: what passes all checks ends as unhandled."""
    return evaluators.evaluate(materialize(_requests(spark, d)), {}).drop("score")


def _one_scene(scene: str) -> tuple[str, object]:
    sql = f"WITH x AS ({_LIFECYCLE}) SELECT job_id, case_id, scene_id, CASE WHEN scene_id IS DISTINCT FROM '{scene}' THEN 'error' WHEN reason_code = 'unhandled_case_evaluator_error' THEN NULL ELSE status END AS status, CASE WHEN scene_id IS DISTINCT FROM '{scene}' THEN 'wrong_scene' WHEN reason_code <> 'unhandled_case_evaluator_error' THEN reason_code END AS reason_code FROM x"
    return sql, scene


def _checked(spark: SparkSession, d: str, scene: str) -> DataFrame:
    return evaluators.checked(_requests(spark, d), scene, evaluators.TIMELINES[scene]).select("job_id", "case_id", "scene_id", "status", "reason_code")


@query(_one_scene("pendulum")[0])
def pendulum_requests(spark: SparkSession, d: str) -> DataFrame:
    """All requests, as one evaluator sees them: those of other scenes are wrong."""
    return _checked(spark, d, "pendulum")


@query(_one_scene("free_fall")[0])
def free_fall_requests(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d, "free_fall")


@query(_one_scene("inclined_plane_slide")[0])
def incline_requests(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d, "inclined_plane_slide")


@query(_one_scene("uniform_circular_motion")[0])
def circular_requests(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d, "uniform_circular_motion")


@query(_one_scene("collision_1d")[0])
def collision_requests(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d, "collision_1d")


@query(f"""WITH {_PHYS_REF} SELECT case_id, CASE WHEN pendulum_reason IS NULL THEN CASE WHEN ood THEN 'parent_physics_reference' ELSE 'same_case_reference' END END AS mode, parent_id,
  CASE WHEN pendulum_reason IS NULL THEN video END AS path, pendulum_reason AS reason_code FROM refs""")
def pendulum_reference(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.pendulum_reference(table(spark, d, "cases"))


@query(f"""WITH {_FREE_FALL} SELECT job_id, CASE role WHEN 'r' THEN 'reference' ELSE 'prediction' END AS role, 0.5::DOUBLE + job_id % 4 / 4.0::DOUBLE AS metres,
  round(CASE WHEN span > 0 THEN acc * (0.5::DOUBLE + job_id % 4 / 4.0::DOUBLE) END, 4) AS acceleration FROM t""")
def free_fall_acceleration(spark: SparkSession, d: str) -> DataFrame:
    """Initial heights are made of the job's number."""
    traces = scoring.free_fall_traces(_points(spark, d))[1]
    heights = traces.select("job_id").distinct().withColumn("metres", 0.5 + F.col("job_id") % 4 / 4.0)
    return evaluators.fitted_acceleration(traces, heights).withColumn("acceleration", F.round("acceleration", 4))


@query("""SELECT case_id, received_at, round(greatest(0, 9.81::DOUBLE * (sin(radians(a)) - m * cos(radians(a)))), 6) AS theoretical FROM (
  SELECT case_id, received_at, physical_parameters['slope_angle'].value AS a, physical_parameters['friction_coefficient'].value AS m FROM cases WHERE scene_id = 'inclined_plane_slide') WHERE a IS NOT NULL AND m IS NOT NULL""")
def sliding_acceleration(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").where("scene_id = 'inclined_plane_slide'").select(
        "case_id", "received_at", F.col("physical_parameters")["slope_angle"]["value"].alias("a"), F.col("physical_parameters")["friction_coefficient"]["value"].alias("m")).where("a IS NOT NULL AND m IS NOT NULL")
    return c.select("case_id", "received_at", F.round(evaluators.sliding_acceleration(F.col("a"), F.col("m")), 6).alias("theoretical"))


@query("""SELECT DISTINCT case_id, obj::INTEGER AS obj, mass FROM (SELECT case_id, unnest(range(3)) AS obj, unnest([m1, m2, m3]) AS mass FROM (
  SELECT case_id, physical_parameters['ball_1_mass'].value AS m1, physical_parameters['ball_2_mass'].value AS m2, physical_parameters['ball_3_mass'].value AS m3 FROM cases)
  WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL)""")
def ball_masses(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.ball_masses(table(spark, d, "cases")).distinct()


@query("""SELECT case_id, received_at, coalesce(try_cast(appearance['object_count'] AS INTEGER), 1) AS objects FROM cases WHERE scene_id = 'uniform_circular_motion'""")
def expected_objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").where("scene_id = 'uniform_circular_motion'").select("case_id", "received_at", evaluators.expected_objects(F.col("appearance")).alias("objects"))


@query(f"""WITH {_FREE_FALL}, ok AS (SELECT series_id, frame, valid FROM s)
  SELECT a.job_id, a.frame, a.time_s, a.px AS reference_x, a.py AS reference_y, r.valid AS reference_valid, b.px AS prediction_x, b.py AS prediction_y, p.valid AS prediction_valid
  FROM both_ a JOIN both_ b ON a.job_id = b.job_id AND a.frame = b.frame AND a.role = 'r' AND b.role = 'p' JOIN ok r ON r.series_id = a.job_id AND r.frame = a.frame JOIN ok p ON p.series_id = a.job_id + 75 AND p.frame = a.frame""")
def per_frame_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.per_frame(_points(spark, d))


_BUCKET_SQL = "CASE WHEN scene_id IN ('pendulum', 'free_fall', 'uniform_circular_motion') THEN 'portrait' WHEN scene_id IN ('collision_1d', 'inclined_plane_slide') THEN 'landscape' END"


@query(f"""WITH b AS (SELECT case_id, received_at, {_BUCKET_SQL} AS bucket, nullif(assets['reference_video'], '') AS path, 1 + strlen(case_id) % 3 AS speed, (strlen(case_id) % 7)::DOUBLE AS duration FROM cases),
  f AS (SELECT *, least(floor(duration / speed * 24 + 1e-6)::INTEGER, 121) AS n FROM b)
  SELECT case_id, received_at, bucket, CASE bucket WHEN 'portrait' THEN 480 WHEN 'landscape' THEN 832 END AS width, CASE bucket WHEN 'portrait' THEN 832 WHEN 'landscape' THEN 480 END AS height,
    CASE WHEN n - ((n - 1) % 4 + 4) % 4 >= 5 THEN n - ((n - 1) % 4 + 4) % 4 END AS frames, CASE WHEN path LIKE '/%' THEN path ELSE '/data/videos/' || path END AS source, '/cache/' || case_id || '.mp4' AS derivative FROM f""")
def media_plan(spark: SparkSession, d: str) -> DataFrame:
    """How each case's recording is brought to an adapter's form; speeds and durations are made of the lengths of ids."""
    n = F.length("case_id")
    b = media.bucket(F.col("scene_id"), BUCKETS)
    path = F.nullif(F.col("assets")["reference_video"], F.lit(""))
    return table(spark, d, "cases").select(
        "case_id", "received_at", b["name"].alias("bucket"), b["width"].alias("width"), b["height"].alias("height"),
        media.frame_count((n % 7).cast("double"), 1 + n % 3, FPS, MOST_FRAMES, LEAST_FRAMES).alias("frames"),
        media.media_path(path, "/data/videos/").alias("source"), media.media_path(path, "/data/videos", cache="/cache", name=F.concat("case_id", F.lit(".mp4"))).alias("derivative"))


def _part(grammar: str, k: int) -> Column:
    return F.regexp_extract("case_id", text.CASE_IDS[grammar], k)


def _number(grammar: str, k: int) -> Column:
    return _part(grammar, k).try_cast("int")


@query("""SELECT DISTINCT case_id, nullif(coalesce(nullif(regexp_extract(case_id, '^pendulum_r\\d_ltot\\d{4}mm_lrope\\d{4}mm_r\\d{3}mm_a\\d{3}deg'), ''), nullif(regexp_extract(case_id, '^freefall_r\\d_(?:xl|l|m|s)_h\\d{3}cm'), ''),
  nullif(regexp_extract(case_id, '^collision_r\\d_(?:(?:large_steel|medium_steel|small_steel|glass_marble)_){3}v\\d{5}'), ''), nullif(regexp_extract(case_id, '^incline_r\\d_a\\d{2}deg_bg(?:white|oil|black|green)_img'), ''),
  nullif(regexp_extract(case_id, '^circular_r\\d_(?:silver\\d{2}cm_)?(?:wood\\d{2}cm_)?img'), '')), '') AS built FROM cases""")
def case_id_build(spark: SparkSession, d: str) -> DataFrame:
    """Ids made anew of what they say: the builders and the grammars are each other's inverse."""
    built = F.coalesce(
        F.when(_part("pendulum", 1) != "", text.pendulum_case_id(*(_number("pendulum", k) for k in range(1, 6)))),
        F.when(_part("free_fall", 1) != "", text.free_fall_case_id(_number("free_fall", 1), _part("free_fall", 2), text.free_fall_height(F.col("case_id")))),
        F.when(_part("collision", 1) != "", text.collision_case_id(_number("collision", 1), [_part("collision", k) for k in (2, 3, 4)], text.collision_speed(F.col("case_id")))),
        F.when(_part("incline", 1) != "", text.incline_case_id(_number("incline", 1), _number("incline", 2), _part("incline", 3))),
        F.when(_part("circular", 1) != "", text.circular_case_id(_number("circular", 1), _number("circular", 2), _number("circular", 3))))
    return table(spark, d, "cases").select("case_id", built.alias("built")).distinct()
