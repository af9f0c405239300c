"""Checks over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import splits, validation
from penduline.queries.planning import _A
from penduline.queries.registry import query
from penduline.session import broadcast_if_small, table

_PHYSICS = "list_sort(list_transform(map_entries(physical_parameters), lambda e: e.key || '=' || coalesce(e.value.value::VARCHAR, '~') || coalesce(e.value.unit, '~') || coalesce(e.value.annotated::VARCHAR, '~')))"
_OK = "(cardinality(physical_parameters) > 0 AND len(list_filter(map_values(physical_parameters), lambda q: q.value IS NULL OR isnan(q.value) OR isinf(q.value) OR q.unit IS NULL OR q.annotated IS NULL)) = 0)"


@query("SELECT job_id, count(*) AS n FROM predictions GROUP BY job_id HAVING count(*) > 1")
def unique_key_guard(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_keys(table(spark, d, "predictions"), "job_id")


@query(f"SELECT case_id, received_at, coalesce({_OK}, false) AS complete FROM cases")
def quantity_completeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_id", "received_at", validation.quantity_ok(F.col("physical_parameters")).alias("complete"))


@query("SELECT case_id, received_at, list_sort(list_transform(list_filter(map_entries(physical_parameters), lambda e: coalesce(e.value.annotated, true) AND e.value.value IS NOT NULL), lambda e: e.key)) AS usable FROM cases")
def annotated_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_id", "received_at", F.array_sort(F.map_keys(validation.usable_quantities(F.col("physical_parameters")))).alias("usable"))


@query("""WITH c AS (SELECT c.*, s.scene_id IS NOT NULL AS known, coalesce(s.ood1_factors, []) AS allowed, s.id_parameters AS needed, c.ood.factors AS factors, c.ood.level AS level,
    coalesce(c.has_real_reference_video, false) AS is_real, coalesce(c.provenance.source_kind, '') = 'synthetic_first_frame' AS made FROM cases c LEFT JOIN scenes s USING (scene_id)),
  i AS (SELECT case_id, received_at, unnest([
    CASE WHEN schema_version IS DISTINCT FROM '1.0' THEN 'schema_version' END,
    CASE WHEN case_id IS NULL THEN 'invalid_case_id' END,
    CASE WHEN coalesce(view_a_split NOT IN ('train', 'test_id', 'test_ood1'), true) THEN 'invalid_split' END,
    CASE WHEN view_a_split IN ('train', 'test_id') AND (level IS DISTINCT FROM 'id' OR coalesce(len(factors) <> 0, true)) THEN 'id_mismatch' END,
    CASE WHEN view_a_split = 'test_ood1' AND (level IS DISTINCT FROM 'ood1' OR coalesce(len(factors) = 0, true)) THEN 'ood1_mismatch' END,
    CASE WHEN is_real AND coalesce(assets['reference_video'], '') = '' THEN 'missing_real_reference' END,
    CASE WHEN made AND coalesce(provenance.parent_case_id, '') = '' THEN 'missing_parent' END,
    CASE WHEN made AND is_real THEN 'synthetic_marked_real' END,
    CASE WHEN made AND coalesce(assets['first_frame'], '') = '' THEN 'missing_first_frame' END,
    CASE WHEN coalesce(cardinality(input_views) = 0, true) THEN 'missing_input_views' END,
    CASE WHEN list_contains(map_keys(input_views), 'i2v') AND coalesce(input_views['i2v'].first_frame, '') = '' THEN 'invalid_i2v' END,
    CASE WHEN list_contains(map_keys(input_views), 'ti2v') AND coalesce(input_views['ti2v'].first_frame, '') = '' THEN 'invalid_ti2v' END,
    CASE WHEN NOT known THEN 'unknown_scene' END,
    CASE WHEN len(list_filter(needed, lambda p: NOT list_contains(coalesce(map_keys(physical_parameters), []), p))) > 0 THEN 'missing_physics' END,
    CASE WHEN len(list_filter(coalesce(factors, []), lambda f: NOT list_contains(allowed, f))) > 0 THEN 'disallowed_ood1_factor' END]) AS code FROM c)
  SELECT case_id, received_at, 'error' AS level, code FROM i WHERE code IS NOT NULL""")
def issue_collect(spark: SparkSession, d: str) -> DataFrame:
    return validation.case_issues(table(spark, d, "cases"), table(spark, d, "scenes"))


@query(f"""WITH last AS (SELECT case_id, arg_max({{'scene': scene_id, 'level': ood.level, 'physics': {_PHYSICS}}}, {{'a': received_at, 'b': scene_id, 'c': coalesce(ood.level, '')}}) AS p FROM cases GROUP BY case_id),
  k AS (SELECT c.case_id, c.scene_id, {_PHYSICS} AS physics, provenance.parent_case_id AS parent_id FROM cases c WHERE provenance.parent_case_id <> ''),
  i AS (SELECT k.case_id, k.parent_id, unnest([CASE WHEN l.case_id IS NULL THEN 'parent_not_found' END, CASE WHEN l.p.scene <> k.scene_id THEN 'parent_scene_mismatch' END, CASE WHEN l.p.level <> 'id' THEN 'parent_not_id' END,
    CASE WHEN l.case_id IS NOT NULL AND l.p.physics IS DISTINCT FROM k.physics THEN 'ood1_physics_changed' END]) AS code FROM k LEFT JOIN last l ON l.case_id = k.parent_id)
  SELECT DISTINCT case_id, parent_id, 'error' AS level, code FROM i WHERE code IS NOT NULL""")
def parent_self_join(spark: SparkSession, d: str) -> DataFrame:
    return validation.parent_issues(table(spark, d, "cases"))


@query(f"""WITH last AS (SELECT case_id, arg_max({{'physics': {_PHYSICS}, 'video': assets['physics_reference_video'], 'is_real': coalesce(has_real_reference_video, false), 'parent_id': nullif(provenance.parent_case_id, '')}}, received_at) AS c FROM cases GROUP BY case_id),
  r AS (SELECT l.case_id, l.c.parent_id AS pid, l.c.video AS video, p.c.video AS p_video, coalesce(l.c.video, '') <> '' AND l.c.is_real AS own,
    CASE WHEN coalesce(l.c.video, '') <> '' AND l.c.is_real THEN NULL WHEN l.c.parent_id IS NULL THEN 'no_trustworthy_physics_reference' WHEN p.case_id IS NULL THEN 'ood_parent_missing'
      WHEN p.c.physics IS DISTINCT FROM l.c.physics THEN 'ood_parent_physics_mismatch' WHEN coalesce(p.c.video, '') = '' THEN 'no_trustworthy_physics_reference' END AS reason_code
    FROM last l LEFT JOIN last p ON p.case_id = l.c.parent_id)
  SELECT case_id, CASE WHEN own THEN 'same_case_reference' WHEN reason_code IS NULL THEN 'parent_physics_reference' END AS mode, CASE WHEN NOT own THEN pid END AS parent_id, CASE WHEN own THEN video WHEN reason_code IS NULL THEN p_video END AS path, reason_code FROM r""")
def physics_reference(spark: SparkSession, d: str) -> DataFrame:
    return validation.resolve_reference(table(spark, d, "cases"))


@query("""SELECT DISTINCT path, level, code FROM (
  SELECT path, 'error' AS level, unnest([CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') THEN 'absolute_or_escaping_path' END, CASE WHEN size_bytes IS NULL OR size_bytes < 0 THEN 'invalid_size' END,
    CASE WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) THEN 'invalid_sha256' END]) AS code FROM asset_lock
  UNION ALL SELECT path, 'warning', 'locked_again' FROM asset_lock GROUP BY path HAVING count(*) > 1
  UNION ALL SELECT path, 'error', 'missing_asset' FROM (SELECT DISTINCT unnest(map_values(assets)) AS path FROM cases) WHERE path <> '' AND path NOT IN (SELECT path FROM asset_lock)) WHERE code IS NOT NULL""")
def asset_lock_check(spark: SparkSession, d: str) -> DataFrame:
    return validation.lock_issues(table(spark, d, "asset_lock"), table(spark, d, "cases"))


@query(f"""WITH {_A} SELECT view_id, case_id, 'listed_again' AS code FROM members GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT DISTINCT view_id, case_id, 'unknown_case' FROM members WHERE case_id NOT IN (SELECT case_id FROM cases)""")
def view_integrity(spark: SparkSession, d: str) -> DataFrame:
    return validation.view_issues(splits.view_members(table(spark, d, "view_a")), table(spark, d, "cases"))


@query("SELECT case_id, 'left_only' AS side FROM (SELECT DISTINCT case_id FROM cases) WHERE case_id NOT IN (SELECT case_id FROM predictions WHERE case_id IS NOT NULL) UNION ALL SELECT case_id, 'right_only' FROM (SELECT DISTINCT case_id FROM predictions) WHERE case_id NOT IN (SELECT case_id FROM cases)")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    return validation.set_difference(table(spark, d, "cases"), table(spark, d, "predictions"), "case_id")


@query("SELECT case_id, prediction_no FROM predictions WHERE case_id NOT IN (SELECT case_id FROM cases)")
def anti_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("case_id", "prediction_no").where("case_id IS NOT NULL").join(table(spark, d, "cases").select("case_id"), "case_id", "left_anti")


@query("SELECT DISTINCT case_id FROM cases WHERE case_id IN (SELECT case_id FROM predictions)")
def semi_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_id").distinct().join(table(spark, d, "predictions").select("case_id"), "case_id", "left_semi")


@query("SELECT case_id, received_at FROM cases WHERE ood.level = 'id' OR list_has_any(ood.factors, ['background', 'material'])")
def ood_factor_filter(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array(F.lit("background"), F.lit("material"))
    return table(spark, d, "cases").where((F.col("ood.level") == "id") | F.arrays_overlap("ood.factors", allowed)).select("case_id", "received_at")


@query("""WITH docs AS (SELECT record_id, CASE WHEN json_valid(body) THEN body END AS body FROM case_records),
  hits AS (SELECT d.record_id, '/' || replace(replace(replace(replace(substr(t.fullkey, 2), '.', '/'), '[', '/'), ']', ''), '"', '') AS path FROM docs d, json_tree(d.body) t WHERE t.key = 'prompt')
  SELECT d.record_id, coalesce(h.paths, []) AS paths FROM docs d LEFT JOIN (SELECT record_id, list_sort(list(ltrim(path, '/')).list_transform(lambda p: '/' || p)) AS paths FROM hits GROUP BY record_id) h USING (record_id)""")
def forbidden_key_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_records").select("record_id", validation.forbidden_key_paths("body", F.lit("prompt")).alias("paths"))


@query("SELECT baseline_id, s.scene_id, list_contains(supported_scenes, s.scene_id) OR list_contains(supported_scenes, 'all') AS supported FROM baselines, scenes s")
def scene_support(spark: SparkSession, d: str) -> DataFrame:
    """Both sides are fixed, small tables of settings."""
    b, s = table(spark, d, "baselines"), table(spark, d, "scenes").select("scene_id")
    ok = F.array_contains("supported_scenes", F.col("scene_id")) | F.array_contains("supported_scenes", "all")
    return b.crossJoin(broadcast_if_small(s)).select("baseline_id", "scene_id", ok.alias("supported"))


_KEYS = ", ".join(f"'{k}'" for k in validation.CASE_KEYS)


@query(f"""SELECT record_id, CASE WHEN body IS NOT NULL THEN list_sort(list_filter([{_KEYS}], lambda k: NOT list_contains(json_keys(body), k))) END AS missing
  FROM (SELECT record_id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS body FROM case_records)""")
def required_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_records").select("record_id", validation.missing_keys(F.col("body")).alias("missing"))


@query("""SELECT table_name, expected, n FROM (VALUES ('baselines', 140), ('scenes', 5), ('subject_areas', 10)) e(table_name, expected)
  JOIN (SELECT 'baselines' AS table_name, count(*) AS n FROM baselines UNION ALL SELECT 'scenes', count(*) FROM scenes UNION ALL SELECT 'subject_areas', count(*) FROM subject_areas) USING (table_name) WHERE n <> expected""")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    """Five scenes are expected, as the protocol has so many; the catalogue holds six."""
    counts = None
    for name in ("baselines", "scenes", "subject_areas"):
        n = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return validation.count_faults(counts, {"baselines": 140, "scenes": 5, "subject_areas": 10}, "table_name")
