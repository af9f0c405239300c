"""Schemas of the manifests."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType, StructType

QUANTITY = "STRUCT<value: DOUBLE, unit: STRING, annotated: BOOLEAN>"
CASE = (
    f"schema_version STRING, case_id STRING, scene_id STRING, assets MAP<STRING, STRING>, physics MAP<STRING, {QUANTITY}>, appearance MAP<STRING, STRING>, "
    "provenance STRUCT<source_kind: STRING, parent_case_id: STRING>, ood STRUCT<level: STRING, factors: ARRAY<STRING>>, has_real_reference_video BOOLEAN")
VIEW = "schema_version STRING, view_id STRING, view STRING, coverage STRING, seed BIGINT, group_count INT, case_set_sha256 STRING, scenes MAP<STRING, MAP<STRING, ARRAY<STRING>>>"
PREDICTION = "job_id STRING, case_id STRING, status STRING, video_path STRING, manual_scores MAP<STRING, DOUBLE>"
SCENE = "scene_id STRING, id_parameters ARRAY<STRING>, ood1_factors ARRAY<STRING>"
LOCKED = "path STRING, size_bytes BIGINT, sha256 STRING, roles ARRAY<STRING>, case_ids ARRAY<STRING>"
POINT = "job_id STRING, role STRING, obj INT, frame INT, time_s DOUBLE, x DOUBLE, y DOUBLE, valid BOOLEAN"


def as_struct(spark: SparkSession, schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


def with_corrupt(spark: SparkSession, schema: str | StructType, name: str) -> StructType:
    """The schema and a text column for what doesn't fit it."""
    return StructType([*as_struct(spark, schema).fields]).add(name, StringType())
