"""Migration, import and training-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import etl
from penduline.queries.registry import query
from penduline.queries.series import _S, frames
from penduline.session import table


@query("SELECT '2.0' AS schema_version, case_id, scene_id, received_at_n, regexp_replace(assets['first_frame'], '^(?:\\.\\./)+', '') AS first_frame, nullif(provenance.parent_case_id, '') AS parent_case_id, cardinality(physical_parameters)::INTEGER AS n_physics FROM (SELECT *, 1 AS received_at_n FROM cases)")
def case_migration(spark: SparkSession, d: str) -> DataFrame:
    m = etl.migrate_cases(table(spark, d, "cases"))
    return m.select("schema_version", "case_id", "scene_id", F.lit(1).alias("received_at_n"), F.col("assets")["first_frame"].alias("first_frame"), F.col("provenance.parent_case_id").alias("parent_case_id"), F.size("physics").alias("n_physics"))


@query("SELECT c.case_id, c.scene_id, CASE WHEN t.case_id IS NOT NULL THEN 'train' WHEN ood.level = 'id' THEN 'test_id' ELSE 'test_ood1' END AS view_a_split, assets['first_frame'] AS i2v_first_frame FROM cases c LEFT JOIN (SELECT DISTINCT case_id FROM predictions WHERE evaluation_partition = 'train_seen') t ON t.case_id = c.case_id")
def legacy_projection(spark: SparkSession, d: str) -> DataFrame:
    return etl.legacy_cases(table(spark, d, "cases"), table(spark, d, "predictions").where("evaluation_partition = 'train_seen'"))


@query("""WITH used AS (SELECT unnest(map_keys(assets)) AS role, unnest(map_values(assets)) AS path, case_id FROM cases), f AS (SELECT path, max(size_bytes) AS size_bytes, max(sha256) AS sha256 FROM asset_lock GROUP BY path)
  SELECT u.path, any_value(f.size_bytes) AS size_bytes, any_value(f.sha256) AS sha256, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT case_id) AS n_cases FROM used u LEFT JOIN f USING (path) WHERE u.path <> '' GROUP BY u.path""")
def lock_build(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "asset_lock").groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.max("sha256").alias("sha256"))
    out = etl.build_lock(table(spark, d, "cases"), files)
    return out.select("path", "size_bytes", "sha256", F.array_join("roles", ",").alias("roles"), F.size("case_ids").cast("bigint").alias("n_cases"))


@query("SELECT coalesce(a.case_id, m.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'not_annotated' WHEN m.case_id IS NULL THEN 'no_media' ELSE 'accepted' END AS state FROM (SELECT DISTINCT case_id FROM cases) a FULL JOIN (SELECT DISTINCT unnest(case_ids) AS case_id FROM asset_lock) m ON a.case_id = m.case_id")
def annotation_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return etl.reconcile(table(spark, d, "cases"), table(spark, d, "asset_lock").select(F.explode("case_ids").alias("case_id")), "case_id")


@query(f"""WITH {_S} SELECT series_id AS run, frame + 1 AS step, x AS value, (frame // 41 + 1)::BIGINT AS epoch, round(avg(x) OVER (w ROWS 24 PRECEDING) + 1e-8, 5) AS mean25, round(avg(x) OVER (w ROWS 99 PRECEDING) + 1e-8, 5) AS mean100,
  round(median(x) OVER (w ROWS 24 PRECEDING) + 1e-8, 5) AS median25 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame)""")
def loss_export(spark: SparkSession, d: str) -> DataFrame:
    loss = frames(spark, d).select(F.col("series_id").alias("run"), (F.col("frame") + 1).alias("step"), F.col("x").alias("value"))
    return etl.loss_table(loss, 41).drop("ema").withColumns({c: F.round(F.col(c) + 1e-8, 5) for c in ("mean25", "mean100", "median25")})
