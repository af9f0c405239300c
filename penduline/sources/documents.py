"""JSON documents, lines, catalogues and shards, read with a given schema; faults are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from penduline import schemas

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a file. Files that are no object have null columns and their text in _corrupt_record."""
    return spark.read.schema(schemas.with_corrupt(spark, schema, CORRUPT)).option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): faults has file, line (0-based offset is not known to Spark, so the text is given) of lines that are
    no object of the schema. Blank lines are skipped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    parsed = raw.select("file", "value", F.from_json("value", schemas.with_corrupt(spark, schema, CORRUPT), {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull() | ~F.ltrim("value").startswith("{")
    fields = [f.name for f in schemas.as_struct(spark, schema).fields]
    return parsed.where(~bad).select(*(F.col(f"r.{f}").alias(f) for f in fields)), parsed.where(bad).select("file", F.col("value").alias("text"))


def read_catalogue(spark: SparkSession, path: str, schema: str | StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of a folder of objects, each with a key of its own: missing_key, duplicate_key, not_an_object."""
    rows = read_json(spark, path, schema).withColumn("file", F.col("_metadata.file_name"))
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1").select("file", F.lit("duplicate_key").alias("code"))
    own = rows.where(F.col(key).isNull()).select("file", F.when(F.col(CORRUPT).isNotNull(), "not_an_object").otherwise("missing_key").alias("code"))
    return rows.where(F.col(key).isNotNull()).drop(CORRUPT), own.unionByName(twice)


def read_shards(spark: SparkSession, pattern: str, schema: str | StructType) -> DataFrame:
    """All shards of a pattern such as worker_*.jsonl as one bag of rows."""
    return spark.read.schema(schema).json(pattern)


def latest_scalars(events: DataFrame) -> DataFrame:
    """(step, value) from events(step, value, file_order): the last write of a step counts; only finite values."""
    return events.groupBy("step").agg(F.max_by("value", "file_order").alias("value")).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
