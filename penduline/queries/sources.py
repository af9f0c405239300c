"""Sources and sinks, there and back over the given tables; names, units and texts; staging, operations and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.functions import media, text
from penduline.operators import audits, etl, splits
from penduline.plans import runs
from penduline.queries.registry import query
from penduline.session import fresh_path, table
from penduline.sources import documents, sinks


@query("SELECT prediction_no, job_id, case_id, status, seed FROM predictions")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as lines of JSON and read back: nothing is lost, nulls stay nulls."""
    rows = table(spark, d, "predictions").select("prediction_no", "job_id", "case_id", "status", "seed")
    path = fresh_path(spark)
    sinks.write_jsonl(rows, path)
    return documents.read_jsonl(spark, path, rows.schema)[0]


@query("SELECT baseline_id, input_mode, family FROM baselines")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark)
    sinks.write_csv(table(spark, d, "baselines").select("baseline_id", "input_mode", "family"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT job_id, prediction_no, prediction_no % 4 AS worker FROM predictions")
def shard_scan(spark: SparkSession, d: str) -> DataFrame:
    """Four workers write shards of their own; all shards together are the bag of their rows."""
    rows = table(spark, d, "predictions").select("job_id", "prediction_no", (F.col("prediction_no") % 4).alias("worker"))
    path = fresh_path(spark)
    for k in range(4):
        sinks.write_jsonl(rows.where(F.col("worker") == k), f"{path}/worker_{k}.jsonl")
    return documents.read_shards(spark, f"{path}/worker_*.jsonl", rows.schema)


@query("SELECT record_id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN 'row' ELSE 'fault' END AS kind FROM case_records WHERE trim(coalesce(body, '')) <> '' AND NOT contains(body, chr(10))")
def jsonl_faults(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of one line as lines of a file: each is a row or a fault, none is lost."""
    bodies = table(spark, d, "case_records").where("trim(coalesce(body, '')) <> '' AND NOT contains(body, '\\n')").select("record_id", "body")
    path = fresh_path(spark)
    bodies.select(F.col("body").alias("value")).write.text(path)
    faults = documents.read_jsonl(spark, path, "case_id string")[1].select(F.col("text").alias("body"), F.lit("fault").alias("kind")).distinct()
    return bodies.join(faults, "body", "left").select("record_id", F.coalesce("kind", F.lit("row")).alias("kind"))


@query("SELECT user_id AS step, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_scalars(spark: SparkSession, d: str) -> DataFrame:
    return documents.latest_scalars(table(spark, d, "events").select(F.col("user_id").alias("step"), "value", F.col("event_id").alias("file_order")))


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS value FROM nation")
def settings_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet, names in column A and values in column B, as settings."""
    cells = F.create_map(F.lit("A"), F.concat(F.lit(" "), "n_name"), F.lit("B"), F.col("n_regionkey").cast("string"))
    return etl.settings(table(spark, d, "nation").select(F.col("n_nationkey").alias("row"), cells.alias("cells"))).select(F.explode("settings").alias("name", "value"))


@query("""SELECT release_no, dataset_id, delivered_at, CASE view WHEN 'A' THEN 'view_a' WHEN 'B' THEN 'view_b' END AS view_id FROM (SELECT release_no, dataset_id, delivered_at, view FROM view_a UNION ALL SELECT release_no, dataset_id, delivered_at, view FROM view_b)""")
def view_migration(spark: SparkSession, d: str) -> DataFrame:
    columns = ["release_no", "dataset_id", "delivered_at", "view"]
    return etl.migrate_views(table(spark, d, "view_a").select(*columns).unionByName(table(spark, d, "view_b").select(*columns)))


@query("""SELECT p_partkey, 'IMG_' || lpad((p_size * 37)::VARCHAR, greatest(4, length((p_size * 37)::VARCHAR))::INTEGER, '0') AS stem, CASE WHEN p_partkey % 3 < 2 THEN p_size END::INTEGER AS cm,
  CASE WHEN p_partkey % 3 < 2 THEN p_size + 0.5::DOUBLE END AS deg_s FROM part""")
def unit_parse(spark: SparkSession, d: str) -> DataFrame:
    """Stems, lengths and speeds as they are written in sheets; other units give nothing."""
    size, turn = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    lengths = F.concat(F.when(turn == 0, F.lit(" ")).otherwise(F.lit("")), size, F.when(turn == 0, "cm").when(turn == 1, " cm ").otherwise("mm"))
    speeds = F.concat(size, F.lit(".5"), F.when(turn == 0, "deg/s").when(turn == 1, "度/秒").otherwise("rad/s"))
    names = F.concat(F.lit("img 0"), (F.col("p_size") * 37).cast("string"), F.lit(" copy 2.MOV"))
    return table(spark, d, "part").select("p_partkey", text.picture_stem(names).alias("stem"), text.centimetres(lengths).alias("cm"), text.degrees_per_second(speeds).alias("deg_s"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'Plain' || substr(p_type, 9) WHEN p_type LIKE 'Plain%' THEN p_type END AS upgraded, CASE WHEN p_size % 5 = 0 THEN '—' ELSE printf('%.4f', p_size / 8.0::DOUBLE) END AS score,
  CASE WHEN p_size % 7 = 0 THEN 1.0::DOUBLE WHEN p_size % 7 - 2 > 0 THEN (p_size % 7 - 2)::DOUBLE END AS speed FROM part""")
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """A prompt's prefix upgraded once, a score as text, and a speed factor."""
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", text.prefix_upgrade(F.col("p_type"), "STANDARD", "Plain").alias("upgraded"), text.score_text(F.when(size % 5 != 0, size / 8.0)).alias("score"),
        media.speed_factor(F.when(size % 7 != 0, (size % 7 - 2).cast("double"))).alias("speed"))


@query("""WITH c AS (SELECT DISTINCT case_id FROM cases WHERE view_a_split = 'train'), p AS (SELECT case_id, max(text.prompt) AS prompt FROM cases WHERE text.prompt IS NOT NULL GROUP BY case_id)
  SELECT case_id, CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'missing_prompt' ELSE 'staged' END AS state FROM c LEFT JOIN p USING (case_id)""")
def training_staging(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases")
    prompts = cases.where("text.prompt IS NOT NULL").groupBy("case_id").agg(F.max("text.prompt").alias("prompt")).withColumn("role", F.lit("train"))
    rows, faults = etl.staging(cases.where("view_a_split = 'train'").select("case_id").distinct(), prompts)
    return rows.select("case_id", F.lit("staged").alias("state")).unionByName(faults.select("case_id", F.col("code").alias("state")))


_ENTRIES = """e AS (SELECT view_id, unnest(map_entries(scenes)) AS s FROM view_b), g AS (SELECT view_id, s.key AS scene_id, unnest(map_entries(s.value)) AS g FROM e), i AS (SELECT DISTINCT scene_id, g.key AS grp, unnest(g.value) AS case_id FROM g),
  j AS (SELECT 'direct__' || case_id || '__generic__seed000007' AS job_id FROM i WHERE grp IN ('group_1', 'group_2') AND case_id IS NOT NULL)"""


@query(f"""WITH {_ENTRIES} SELECT 'train' AS operation_id, 'train' AS kind, [] AS depends_on UNION ALL SELECT 'infer:' || job_id, 'infer', ['train'] FROM j UNION ALL SELECT 'evaluate:' || job_id, 'evaluate', ['infer:' || job_id] FROM j""")
def plan_operations(spark: SparkSession, d: str) -> DataFrame:
    members = splits.view_members(table(spark, d, "view_b")).where("case_id IS NOT NULL")
    return runs.operations(splits.plan_jobs(members, "direct", "generic", [7], ["group_1", "group_2"]), True)


@query("""WITH r AS (SELECT event_id, (event_id % 50)::INTEGER AS start_frame, event_id % 11 <> 0 AS reviewed, 40 AS source_frames, 40 - event_id % 50 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS aligned_frames, user_id % 17 <> 0 AS same FROM events)
  SELECT event_id AS case_id, CASE WHEN NOT reviewed THEN 'unreviewed_alignment' WHEN start_frame >= source_frames THEN 'invalid_alignment_frame' WHEN aligned_frames <> source_frames - start_frame THEN 'alignment_not_materialized'
    WHEN NOT same THEN 'first_frame_differs' END AS code FROM r""")
def alignment_audit(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, d, "events").select(
        e.alias("case_id"), (e % 50).cast("int").alias("start_frame"), (e % 11 != 0).alias("reviewed"), F.lit(40).alias("source_frames"),
        (40 - e % 50 + F.when(e % 13 == 0, 1).otherwise(0)).alias("aligned_frames"), F.lit("h").alias("source_hash"), F.when(F.col("user_id") % 17 != 0, "h").otherwise("other").alias("first_hash"))
    return audits.alignment(rows).select("case_id", "code")
