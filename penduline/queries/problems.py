"""Queries of the general training-data problems, by the name under which they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import drift, orphans, shred, snapshots
from penduline.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.found(table(spark, d, "case_records"))


def _flat(spark: SparkSession, d: str, tag: str) -> DataFrame:
    return shred.tables(table(spark, d, "case_records"))[tag].drop("payload")


def p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "quantity")


def p2_readings(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "reading")


def p2_views(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "view")


def p2_crops(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "crop")


def p2_assets(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "asset")


def p2_renditions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "rendition").select("record_id", "item_path", "parent_path", "height", "path", F.col("audio.channels").alias("audio_channels"))


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    """The arguments of a step come as rows of their own here, as maps have no order."""
    steps = _flat(spark, d, "step")
    return steps.select("record_id", "item_path", "op", F.explode_outer("args").alias("arg", "arg_value"))


def p2_step_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "step_input").select("record_id", "item_path", "parent_path", "frame", F.col("mask.rle").alias("mask_rle"))


def p2_cases(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "case").select("record_id", "schema_version", "case_id", "scene_id", F.col("ood.level").alias("ood_level"), F.col("ood.factors").alias("ood_factors"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    return shred.table_sizes(table(spark, d, "case_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.found(table(spark, d, "view_a"))


def p3_digests(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.digest_check(table(spark, d, "view_a"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(*(table(spark, d, n) for n in ("cases", "view_b", "predictions", "case_deletions", "asset_lock")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "manifest_lines"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(table(spark, d, "manifest_lines"))


def p5_casts(spark: SparkSession, d: str) -> DataFrame:
    return drift.cast_report(p5_table(spark, d))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_tables, p2_cases, p2_quantities, p2_readings, p2_views, p2_crops, p2_assets, p2_renditions, p2_steps, p2_step_inputs, p3_found, p3_digests, p4_found, p4_report, p5_found, p5_table, p5_casts,
)}
