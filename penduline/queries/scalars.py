"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.functions import media, text
from penduline.queries.registry import query
from penduline.session import table


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE / 7 AS last FROM part), c AS (SELECT p_partkey, floor(least(last, 5.0) * 16 + 1e-9)::INTEGER + 1 AS n FROM p)
  SELECT p_partkey, i::INTEGER AS frame, i / 16.0::DOUBLE AS time_s FROM (SELECT p_partkey, n, unnest(range(n)) AS i FROM c WHERE n >= 2)""")
def timeline_generate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.posexplode(media.timeline(F.col("p_size") / 7.0, 16.0, 5.0)).alias("frame", "time_s"))


@query("SELECT event_id, round_even(value * 29.97::DOUBLE / 10, 0)::INTEGER AS frame FROM events")
def nearest_index_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", media.nearest_index(F.col("value"), F.lit(29.97) / 10).alias("frame"))


@query("""WITH b AS (SELECT p_partkey, p_size + 100 AS w, 50 + p_partkey % 900 AS h FROM part), s AS (SELECT *, least(480::DOUBLE / w, 832::DOUBLE / h) AS scale FROM b), r AS (SELECT *, greatest(1, round_even(w * scale, 0)::INTEGER) AS nw, greatest(1, round_even(h * scale, 0)::INTEGER) AS nh FROM s)
  SELECT p_partkey, round(scale, 6) AS scale, nw AS width, nh AS height, floor((480 - nw) / 2)::INTEGER AS left_, floor((832 - nh) / 2)::INTEGER AS top_ FROM r""")
def letterbox_transform(spark: SparkSession, d: str) -> DataFrame:
    b = media.letterbox(F.col("p_size") + 100, 50 + F.col("p_partkey") % 900, 480, 832)
    return table(spark, d, "part").select("p_partkey", b.alias("b")).select("p_partkey", F.round("b.scale", 6).alias("scale"), "b.width", "b.height", F.col("b.left").alias("left_"), F.col("b.top").alias("top_"))


@query("WITH r AS (SELECT p_partkey, least(floor(p_retailprice / 300 / (1 + p_size % 3) * 24 + 1e-6)::INTEGER, 121) AS n FROM part) SELECT p_partkey, CASE WHEN n - ((n - 1) % 4 + 4) % 4 >= 5 THEN n - ((n - 1) % 4 + 4) % 4 END AS frames FROM r")
def frame_count_4n1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", media.frame_count(F.col("p_retailprice") / 300, 1 + F.col("p_size") % 3, 24.0, 121, 5).alias("frames"))


@query("SELECT p_partkey, round(try_cast(split_part(f, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(f, '/', 2) AS DOUBLE), 0), 6) AS fps FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE (p_size * 1000)::VARCHAR || '/' || (p_partkey % 4 * 1001)::VARCHAR END AS f FROM part)")
def fraction_parse(spark: SparkSession, d: str) -> DataFrame:
    f = F.when(F.col("p_size") % 5 == 0, "N/A").otherwise(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/"), (F.col("p_partkey") % 4 * 1001).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.round(media.fraction(f), 6).alias("fps"))


@query("""SELECT event_id, CASE WHEN fps <= 0 OR n < 1 THEN 'invalid_video_metadata' WHEN fps < 8 THEN 'source_fps_too_low' WHEN (n - 1) / fps + 0.02 < 2 OR round_even(2 * fps, 0) >= n THEN 'insufficient_duration' END AS reason_code
  FROM (SELECT event_id, (user_id % 40)::DOUBLE AS fps, (event_id % 100)::INTEGER AS n FROM events)""")
def sampling_faults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", media.sampling_fault((F.col("user_id") % 40).cast("double"), (F.col("event_id") % 100).cast("int"), F.lit(2.0)).alias("reason_code"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^a-zA-Z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("""SELECT DISTINCT case_id, try_cast(regexp_extract(case_id, '^freefall_r(\\d+)_(xl|l|m|s)_h(\\d+)cm', 3) AS INTEGER) / 100::DOUBLE AS height_m, try_cast(regexp_extract(case_id, '^pendulum_r(\\d+)_ltot(\\d+)mm_lrope(\\d+)mm_r(\\d+)mm_a(\\d+)deg', 5) AS INTEGER) AS angle_deg,
  try_cast(regexp_extract(case_id, '^collision_r\\d+_(?:(?:large_steel|medium_steel|small_steel|glass_marble)_){3}v(\\d+)', 1) AS INTEGER) / 10000::DOUBLE AS speed FROM cases""")
def case_id_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("case_id")
    return table(spark, d, "cases").select("case_id", text.free_fall_height(c).alias("height_m"), text.pendulum_angle(c).alias("angle_deg"), text.collision_speed(c).alias("speed")).distinct()


@query("SELECT path, NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS inside, regexp_replace(path, '^(?:\\.\\./)+', '') AS relative FROM asset_lock")
def path_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_lock").select("path", text.stays_inside(F.col("path")).alias("inside"), text.dataset_relative(F.col("path")).alias("relative"))


@query("""WITH q AS (SELECT case_id, received_at, scene_id, unnest(map_entries(physical_parameters)) AS e FROM cases), u AS (SELECT case_id, received_at, string_agg(e.key || ' = ' || floor(e.value.value * 1000)::BIGINT || ' per mille ' || coalesce(e.value.unit, ''), ', ' ORDER BY e.key) AS clauses FROM q WHERE coalesce(e.value.annotated, true) AND e.value.value IS NOT NULL GROUP BY ALL)
  SELECT DISTINCT c.case_id, c.received_at, 'Scene ' || c.scene_id || CASE WHEN u.clauses IS NULL THEN '' ELSE ' with ' || u.clauses || '.' END AS prompt FROM cases c LEFT JOIN u ON u.case_id = c.case_id AND u.received_at = c.received_at""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    from penduline.operators.validation import usable_quantities

    usable = F.array_sort(F.map_entries(usable_quantities(F.col("physical_parameters"))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    clauses = F.transform(usable, lambda e: F.concat(e["key"], F.lit(" = "), F.floor(e["value"]["value"] * 1000).cast("string"), F.lit(" per mille "), F.coalesce(e["value"]["unit"], F.lit(""))))
    return table(spark, d, "cases").select("case_id", "received_at", text.render_prompt(F.concat(F.lit("Scene "), "scene_id"), clauses, " with ", ", ", ".").alias("prompt")).distinct()


@query("SELECT prediction_no, strftime(submitted_at, '%Y%m%dT%H%M%SZ') || '__' || job_id || '__' || baseline_id AS run_id FROM predictions")
def run_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_no", text.run_stamp(F.col("submitted_at"), F.col("job_id"), F.col("baseline_id")).alias("run_id"))


@query("SELECT prediction_no, CASE WHEN s BETWEEN 0 AND 1 THEN s END AS score FROM (SELECT prediction_no, manual_scores['physical'] AS s FROM predictions)")
def manual_score(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("manual_scores")["physical"]
    return table(spark, d, "predictions").select("prediction_no", F.when(s.between(0, 1), s).alias("score"))


@query("SELECT event_id, printf('%.1f', value) AS text FROM events")
def python_rounding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.fixed_digits("value", F.lit(1)).alias("text"))
