"""Clauses, prompts, adaptations and split rules over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from penduline.operators import etl, prompts
from penduline.queries.registry import query
from penduline.session import table

_LAST = """last AS (SELECT case_id, arg_max({'scene_id': scene_id, 'physics': physical_parameters, 'assets': assets}, {'a': received_at, 'b': scene_id}) AS c FROM cases GROUP BY case_id),
  clauses AS (SELECT scene_id, generate_subscripts(id_parameters, 1) - 1 AS pos, unnest(id_parameters) AS name FROM scenes)"""


def _last(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").groupBy("case_id").agg(F.max_by(F.struct("scene_id", F.col("physical_parameters").alias("physics"), "assets"), F.struct("received_at", "scene_id")).alias("c"))
    return c.select("case_id", "c.*")


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's id parameters as required clauses; lengths must be in metres."""
    rows = table(spark, d, "scenes").select("scene_id", F.posexplode("id_parameters").alias("pos", "name"))
    unit = F.when(F.col("name").rlike("radius|length|height"), "m")
    return rows.select("scene_id", "pos", "name", unit.alias("unit"), F.lit(True).alias("required"), F.lit(2).alias("precision"))


@query(f"""WITH {_LAST}, j AS (SELECT l.case_id, k.pos, k.name, l.c.physics[k.name] AS q FROM last l JOIN clauses k ON k.scene_id = l.c.scene_id),
  u AS (SELECT *, q IS NOT NULL AND coalesce(q.annotated, true) AND q.value IS NOT NULL AS usable FROM j)
  SELECT case_id, pos::INTEGER AS pos, name, CASE WHEN usable THEN q.value END AS value, CASE WHEN usable THEN q.unit END AS unit,
    CASE WHEN NOT usable THEN 'missing_required_parameter' WHEN regexp_matches(name, 'radius|length|height') AND q.unit IS DISTINCT FROM 'm' THEN 'unit_mismatch' END AS fault FROM u""")
def clause_expand(spark: SparkSession, d: str) -> DataFrame:
    return prompts.clause_values(_last(spark, d), _clauses(spark, d))


@query(f"""WITH {_LAST}, j AS (SELECT l.case_id, l.c.scene_id AS scene_id, k.pos, k.name, l.c.physics[k.name] AS q FROM last l LEFT JOIN clauses k ON k.scene_id = l.c.scene_id),
  u AS (SELECT *, q IS NOT NULL AND coalesce(q.annotated, true) AND q.value IS NOT NULL AS usable FROM j),
  t AS (SELECT *, concat_ws(' ', name, CASE WHEN usable THEN printf('%.2f', q.value) END, CASE WHEN usable THEN q.unit END) AS said,
    CASE WHEN name IS NULL THEN NULL WHEN NOT usable THEN 'missing_required_parameter' WHEN regexp_matches(name, 'radius|length|height') AND q.unit IS DISTINCT FROM 'm' THEN 'unit_mismatch' END AS fault FROM u),
  g AS (SELECT case_id, any_value(scene_id) AS scene_id, string_agg(said, ', ' ORDER BY pos) FILTER (name IS NOT NULL) AS parts, list_sort(list(name) FILTER (name IS NOT NULL)) AS used_parameters, min(fault) AS fault FROM t GROUP BY case_id),
  p AS (SELECT *, CASE WHEN fault IS NOT NULL THEN NULL WHEN parts IS NOT NULL THEN 'Scene ' || scene_id || ' with ' || parts || '.' ELSE 'Scene ' || scene_id END AS prompt FROM g)
  SELECT case_id, 'physics' AS profile_id, prompt, used_parameters, sha256(prompt) AS prompt_sha256, fault FROM p""")
def prompt_profile(spark: SparkSession, d: str) -> DataFrame:
    return prompts.rendered(_last(spark, d).withColumn("base_prompt", F.concat(F.lit("Scene "), "scene_id")), _clauses(spark, d), "physics")


@query(f"WITH {_LAST} SELECT case_id, coalesce(nullif(c.assets['first_frame'], ''), nullif(c.assets['physics_reference_video'], '') || ':frame0') AS source FROM last")
def first_frame_source(spark: SparkSession, d: str) -> DataFrame:
    return _last(spark, d).select("case_id", prompts.first_frame_source(F.col("assets")).alias("source"))


@query("""WITH h AS (SELECT case_id, sha256('spatial:' || scene_id) AS s, sha256('temporal:x1.000000') AS t, sha256('paradigm:eval') AS p, sha256('text:' || coalesce(prompt, '')) AS x, sha256('conditioning:generic') AS c
    FROM (SELECT case_id, max(scene_id) AS scene_id, max(text.prompt) AS prompt FROM cases GROUP BY case_id))
  SELECT case_id || '__eval__generic' AS adaptation_id, sha256(concat_ws('|', case_id, s, t, p)) AS materialization, sha256(concat_ws('|', case_id, s, t, p, x, c)) AS fingerprint FROM h""")
def adaptation_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").groupBy("case_id").agg(F.max("scene_id").alias("scene_id"), F.max("text.prompt").alias("prompt"))
    return prompts.adaptations(c, "eval", "generic", F.col("scene_id"), F.lit(1.0), F.col("prompt")).select("adaptation_id", "materialization", "fingerprint")


@query("WITH n AS (SELECT scene_id, count(*) AS n FROM (SELECT DISTINCT scene_id, case_id FROM cases WHERE view_a_split = 'train') GROUP BY scene_id) SELECT scene_id, n AS n_items, max(n) OVER () AS n_balanced, ceil(max(n) OVER () * count(*) OVER () * 4 / 8.0::DOUBLE)::BIGINT AS steps FROM n")
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    return prompts.sampling_plan(table(spark, d, "cases").where("view_a_split = 'train'").select("scene_id", "case_id").distinct(), "scene_id", 4, 8)


@query("""WITH i AS (SELECT DISTINCT case_id, regexp_extract(case_id, '_bg(white|oil|black|green)_', 1) AS bg, regexp_extract(case_id, '_a(\\d+)deg', 1)::INTEGER AS value FROM cases WHERE case_id LIKE 'incline_%'),
  k AS (SELECT DISTINCT value FROM i WHERE bg = 'white' AND value % 5 <> 0)
  SELECT case_id, CASE WHEN bg = 'white' AND i.value % 5 = 0 THEN 'test_id' WHEN bg = 'white' THEN 'train' WHEN k.value IS NOT NULL THEN 'test_ood1' END AS split, CASE WHEN bg <> 'white' AND k.value IS NULL THEN 'value_not_trained_on' END AS reason FROM i LEFT JOIN k USING (value)""")
def split_rules(spark: SparkSession, d: str) -> DataFrame:
    """Factor-pure splits of the incline cases: the white background trains, angles in fives are held out."""
    i = table(spark, d, "cases").where("case_id LIKE 'incline_%'").select("case_id").distinct()
    i = i.withColumn("bg", F.regexp_extract("case_id", "_bg(white|oil|black|green)_", 1)).withColumn("value", F.regexp_extract("case_id", r"_a(\d+)deg", 1).cast("int"))
    return etl.factor_pure(i, F.col("bg"), "white", F.col("value") % 5 == 0).select("case_id", "split", "reason")


@query("SELECT evaluation_partition, coalesce(prompt_profile_id, '') AS profile, lower(coalesce(status, '')) AS status, count(*) AS n FROM predictions GROUP BY ALL")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "predictions").groupBy("evaluation_partition", none("prompt_profile_id").alias("profile"), F.lower(none("status")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT p.case_id, any_value(c.scene_id) AS scene_id, count(*) AS n_jobs, count(*) FILTER (lower(p.status) = 'completed') AS n_completed FROM predictions p LEFT JOIN (SELECT case_id, max(scene_id) AS scene_id FROM cases GROUP BY case_id) c ON c.case_id = p.case_id
  WHERE p.evaluation_partition = 'train_seen' GROUP BY p.case_id""")
def train_seen_gallery(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, "cases").groupBy("case_id").agg(F.max("scene_id").alias("scene_id"))
    jobs = table(spark, d, "predictions").where("evaluation_partition = 'train_seen'").groupBy("case_id").agg(F.count("*").alias("n_jobs"), F.count_if(F.lower("status") == "completed").alias("n_completed"))
    return jobs.join(scenes, "case_id", "left").select("case_id", "scene_id", "n_jobs", "n_completed")


@query("SELECT user_id % 10 AS y, event_type AS x, floor(median(value))::BIGINT AS background FROM events GROUP BY ALL")
def median_background(spark: SparkSession, d: str) -> DataFrame:
    """The temporal median of each pixel (here: cell), cut to a whole number."""
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("y"), F.col("event_type").alias("x")).agg(F.floor(F.percentile("value", F.lit(0.5))).alias("background"))


