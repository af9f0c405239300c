"""Session helpers: reading tables, cutting lineage in the shared folder, guarded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after its size has been checked.
BROADCAST_ROWS = 20_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Prepare a session: give this package to the executors' Python workers, once an application (they needn't have it
    installed), and have unions promise no partitioning. In Spark 4.1 a union of sides partitioned by the same key passes
    for partitioned by it even where adaptive execution merged their partitions differently; what follows then misses rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="penduline-")) / "penduline.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(home.rglob("*.py")):
                z.write(source, source.relative_to(home.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the cluster names none, a folder of this machine is used if the master is
    local (tests); on any other master that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="penduline-")
        else:
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_WRITTEN: set[str] = set()


def fresh_path(spark: SparkSession) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the application ends."""
    home = f"{shared_dir(spark)}/penduline-{spark.sparkContext.applicationId}"
    if home not in _WRITTEN:
        _WRITTEN.add(home)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{home}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as parquet into the shared folder and read it back: the lineage is cut, and the loss of an executor
    costs nothing that was already computed."""
    ship(df.sparkSession)
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted, not guessed), else df unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df, a scan that Python is to work on, over all cores: a small input of fewer partitions than cores is dealt out, a
    large one left as it is."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
