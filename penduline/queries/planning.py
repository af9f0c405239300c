"""Splits, plans, samples and fingerprints over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import lineage, splits
from penduline.queries.registry import query
from penduline.session import table

_MEMBERS = """sr AS (SELECT view_id, unnest(map_entries(scenes)) AS s FROM {view}),
  gr AS (SELECT view_id, s.key AS scene_id, unnest(map_entries(s.value)) AS g FROM sr),
  members AS (SELECT view_id, scene_id, g.key AS grp, generate_subscripts(g.value, 1) - 1 AS pos, unnest(g.value) AS case_id FROM gr)"""
_A, _B = _MEMBERS.format(view="view_a"), _MEMBERS.format(view="view_b")


@query("SELECT scene_id, split, case_id, count(*) OVER (PARTITION BY case_id) AS n_splits FROM (SELECT DISTINCT scene_id, view_a_split AS split, case_id FROM cases WHERE view_a_split IN ('train', 'test_id', 'test_ood1') AND scene_id IS NOT NULL)")
def view_a_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.view_a(table(spark, d, "cases"))


@query("SELECT scene_id, 'group_' || ((row_number() OVER (PARTITION BY scene_id ORDER BY sha256('42:' || case_id), case_id) - 1) % 5 + 1) AS grp, case_id FROM (SELECT DISTINCT scene_id, case_id FROM cases)")
def view_b_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.view_b_hashed(table(spark, d, "cases"), 5, 42)


@query()
def view_b_mt19937(spark: SparkSession, d: str) -> DataFrame:
    return splits.view_b_shuffled(table(spark, d, "cases"), 5, 42)


@query("SELECT scene_id, case_id FROM (SELECT scene_id, case_id, row_number() OVER (PARTITION BY scene_id ORDER BY sha256('7:' || case_id), case_id) AS k FROM (SELECT DISTINCT scene_id, case_id FROM cases)) WHERE k <= 20")
def seeded_case_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.seeded_sample(table(spark, d, "cases"), 20, 7)


@query(f"WITH {_A} SELECT view_id, scene_id, grp, pos::INTEGER AS pos, case_id FROM members")
def view_member_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.view_members(table(spark, d, "view_a"))


@query(f"""WITH {_A}, e AS (SELECT DISTINCT case_id, scene_id, grp AS evaluation_partition FROM members WHERE grp IN ('test_id', 'test_ood1'))
  SELECT concat_ws('__', 'finetune', case_id, 'generic', 'seed' || lpad(seed::VARCHAR, 6, '0')) AS job_id, case_id, scene_id, evaluation_partition, 'generic' AS conditioning, seed FROM e, (SELECT unnest([42, 7]::BIGINT[]) AS seed)""")
def plan_view_a(spark: SparkSession, d: str) -> DataFrame:
    return splits.plan_jobs(splits.view_members(table(spark, d, "view_a")), "finetune", "generic", [42, 7], ["test_id", "test_ood1"])


@query(f"""WITH {_B}, e AS (SELECT DISTINCT case_id, scene_id, grp AS evaluation_partition FROM members WHERE scene_id IN ('pendulum', 'free_fall'))
  SELECT concat_ws('__', 'direct', case_id, 'physics', 'seed000042') AS job_id, case_id, scene_id, evaluation_partition, 'physics' AS conditioning, 42::BIGINT AS seed FROM e""")
def plan_view_b(spark: SparkSession, d: str) -> DataFrame:
    return splits.plan_jobs(splits.view_members(table(spark, d, "view_b")), "direct", "physics", [42], scenes=["pendulum", "free_fall"])


@query(f"""WITH {_A}, e AS (SELECT DISTINCT case_id, scene_id, grp AS evaluation_partition FROM members)
  SELECT concat_ws('__', 'v1', case_id, 'prompt-' || p, 'seed000042') AS job_id, case_id, scene_id, CASE WHEN evaluation_partition = 'train' THEN 'train_seen' ELSE evaluation_partition END AS evaluation_partition, p AS conditioning FROM e, (SELECT unnest(['generic', 'physics_natural']) AS p)""")
def plan_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Jobs x prompt profiles, with previews on training cases kept apart as train_seen."""
    members = splits.view_members(table(spark, d, "view_a"))
    jobs = [splits.plan_jobs(members, "v1", f"prompt-{p}", [42]).withColumn("conditioning", F.lit(p)) for p in ("generic", "physics_natural")]
    part = F.when(F.col("evaluation_partition") == "train", "train_seen").otherwise(F.col("evaluation_partition"))
    return jobs[0].unionByName(jobs[1]).withColumn("evaluation_partition", part).drop("seed")


@query("SELECT prediction_no, ((row_number() OVER (ORDER BY prediction_no) - 1) % 8)::INTEGER AS shard FROM predictions")
def strided_shard(spark: SparkSession, d: str) -> DataFrame:
    return splits.strided(table(spark, d, "predictions").select("prediction_no"), "prediction_no", 8)


@query("""WITH c AS (SELECT DISTINCT scene_id, case_id FROM cases WHERE view_a_split = 'train'), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY case_id) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM c),
  s AS (SELECT unnest(range((SELECT max(n) FROM r))) AS slot) SELECT scene_id, case_id, slot FROM r, s WHERE slot % n = k""")
def cyclic_oversample(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "cases").where("view_a_split = 'train'").select("scene_id", "case_id").distinct()
    return splits.oversample(train, "scene_id", "case_id")


@query("SELECT scene_id, list_sort(list(DISTINCT v))[len(list_distinct(list(v))) // 2 + 1] AS held_out FROM (SELECT scene_id, physical_parameters['striker_speed'].value AS v FROM cases UNION ALL SELECT scene_id, physical_parameters['slope_angle'].value FROM cases) WHERE v IS NOT NULL GROUP BY scene_id")
def held_out_pick(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases")
    v = [c.select("scene_id", F.col("physical_parameters")[n]["value"].alias("v")) for n in ("striker_speed", "slope_angle")]
    return splits.held_out(v[0].unionByName(v[1]), "scene_id", "v")


@query("SELECT scene_id, case_id, received_at, rank::INTEGER AS rank FROM (SELECT scene_id, case_id, received_at, row_number() OVER (PARTITION BY scene_id ORDER BY received_at DESC, case_id) AS rank FROM cases) WHERE rank <= 5")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return splits.top_k(table(spark, d, "cases").select("scene_id", "case_id", "received_at"), "scene_id", 5, F.desc("received_at"), F.asc("case_id"))


@query(f"WITH {_A} SELECT DISTINCT case_id, grp FROM members")
def entry_dedup(spark: SparkSession, d: str) -> DataFrame:
    return splits.view_members(table(spark, d, "view_a")).select("case_id", "grp").distinct()


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment NOT IN ('BUILDING') UNION ALL SELECT c_custkey + 1000000, c_mktsegment, 0 FROM customer WHERE c_mktsegment = 'BUILDING'")
def partition_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_mktsegment", F.lit(0.0).alias("c_acctbal"))
    return splits.replace_partitions(old, new, "c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey")
def key_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return splits.replace_partitions(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey")


@query("SELECT path, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, string_agg(DISTINCT case_id, ',' ORDER BY case_id) AS case_ids FROM (SELECT case_id, unnest(map_keys(assets)) AS role, unnest(map_values(assets)) AS path FROM cases) WHERE path IS NOT NULL AND path <> '' GROUP BY path")
def asset_inversion(spark: SparkSession, d: str) -> DataFrame:
    return lineage.asset_inversion(table(spark, d, "cases"))


@query("SELECT dataset_id, count(*)::INTEGER AS n, sha256('[' || string_agg('\"' || case_id || '\"', ',' ORDER BY case_id) || ']') AS sha256 FROM (SELECT DISTINCT dataset_id, case_id FROM cases) GROUP BY dataset_id")
def set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lineage.set_fingerprint(table(spark, d, "cases"), "dataset_id", "case_id")


@query("SELECT o_orderpriority, count(*) AS n, sum(('0x' || substr(sha256(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR), 1, 15))::HUGEINT)::VARCHAR AS fingerprint FROM orders GROUP BY o_orderpriority")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lineage.row_fingerprint(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "o_custkey")


@query("SELECT scene_id, (('0x' || substr(sha256('42:' || scene_id), 1, 16))::UHUGEINT)::VARCHAR AS seed FROM scenes")
def scene_seed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenes").select("scene_id", splits.scene_seed(F.col("scene_id"), 42).cast("string").alias("seed"))


@query()
def canonical_json_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_records").select("record_id", lineage.canonical_sha256("body").alias("sha256"))


@query("SELECT part_key, list_distinct(list_transform(range(5), lambda i: round_even((i * (n - 1))::DOUBLE / 4, 0)::INTEGER)).list_sort() AS picks FROM (SELECT p_partkey AS part_key, p_size AS n FROM part)")
def uniform_frame_picks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), F.array_sort(splits.uniform_picks(F.col("p_size"), 5)).alias("picks"))
