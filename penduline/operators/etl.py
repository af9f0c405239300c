"""Migration and import of cases, locks of assets, and the loss curve of a training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penduline.functions.text import dataset_relative
from penduline.operators import series


def migrate_cases(cases: DataFrame) -> DataFrame:
    """First-version cases in the shape of the second: split, texts and prompts are dropped, parameters renamed, paths made
    relative to the dataset."""
    return cases.select(
        F.lit("2.0").alias("schema_version"), "case_id", "scene_id", F.transform_values("assets", lambda k, v: dataset_relative(v)).alias("assets"), F.col("physical_parameters").alias("physics"), "appearance",
        F.struct(F.col("provenance.source_kind").alias("source_kind"), F.nullif("provenance.parent_case_id", F.lit("")).alias("parent_case_id")).alias("provenance"), "ood", "has_real_reference_video")


def migrate_views(view: DataFrame) -> DataFrame:
    return view.withColumn("view_id", F.when(F.col("view") == "A", "view_a").when(F.col("view") == "B", "view_b")).drop("view")


def legacy_cases(cases: DataFrame, train: DataFrame) -> DataFrame:
    """(case_id, scene_id, view_a_split, i2v_first_frame): the split follows from the training ids and the level."""
    t = train.select("case_id").distinct().withColumn("_t", F.lit(True))
    split = F.when(F.col("_t"), "train").when(F.col("ood.level") == "id", "test_id").otherwise("test_ood1")
    return cases.join(t, "case_id", "left").select("case_id", "scene_id", split.alias("view_a_split"), F.col("assets")["first_frame"].alias("i2v_first_frame"))


def build_lock(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256, roles, case_ids) of every asset of a case; size and hash are null for files not there."""
    used = cases.select("case_id", F.explode("assets").alias("role", "path")).where("path <> ''").groupBy("path").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("case_id")).alias("case_ids"))
    return used.join(files.select("path", "size_bytes", "sha256"), "path", "left").select("path", "size_bytes", "sha256", "roles", "case_ids")


def reconcile(annotations: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """(key, state): accepted, no_media or not_annotated."""
    a = annotations.select(key).distinct().withColumn("_a", F.lit(1))
    m = media.select(key).distinct().withColumn("_m", F.lit(1))
    state = F.when(F.col("_a").isNull(), "not_annotated").when(F.col("_m").isNull(), "no_media").otherwise("accepted")
    return a.join(m, key, "full").select(key, state.alias("state"))


def settings(rows: DataFrame) -> DataFrame:
    """One row 'settings' from sheet rows whose column A names what column B holds; the last of equal names counts."""
    named = rows.where("cells['A'] IS NOT NULL").select(F.trim(F.col("cells")["A"]).alias("k"), "row", F.col("cells")["B"].alias("v"))
    return named.groupBy("k").agg(F.max_by("v", "row").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("settings"))


def factor_pure(cases: DataFrame, background: Column, base: str, held: Column) -> DataFrame:
    """cases with split and reason: the base background trains, its held-out values test as id, other backgrounds with
    values that were trained on test as ood1, all else is left out with a reason."""
    trained = cases.where((background == base) & ~held).select(F.col("value").alias("_v")).distinct().withColumn("_known", F.lit(True))
    joined = cases.join(trained, F.col("value") == F.col("_v"), "left")
    split = F.when((background == base) & held, "test_id").when(background == base, "train").when(F.col("_known"), "test_ood1")
    return joined.withColumn("split", split).withColumn("reason", F.when(F.col("split").isNull(), "value_not_trained_on")).drop("_v", "_known")


def loss_table(loss: DataFrame, steps_per_epoch: int) -> DataFrame:
    """loss(run, step, value) with epoch, trailing means of 25 and 100, median of 25 and exponential mean of each run."""
    w = Window.partitionBy("run").orderBy("step")
    smooth = series.ema(loss, "value", 0.05, "run", "step")
    return loss.select("run", "step", "value", series.epoch(F.col("step"), steps_per_epoch).alias("epoch"), series.rolling_mean("value", 25, w).alias("mean25"), series.rolling_mean("value", 100, w).alias("mean100"),
                       series.rolling_median("value", 25, w).alias("median25")).join(smooth, ["run", "step"], "left")


def staging(cases: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): training cases with their resolved prompt (role train); without one, or with a blank one, they fail."""
    p = prompts.where("role = 'train'").select("case_id", "prompt").dropDuplicates(["case_id"])
    both = cases.join(p, "case_id", "left")
    blank = F.trim(F.coalesce("prompt", F.lit(""))) == ""
    return both.where(~blank), both.where(blank).select("case_id", F.lit("missing_prompt").alias("code"))


def newest(checkpoints: DataFrame) -> DataFrame:
    """(path) of the checkpoint written last; of equals the last by name."""
    return checkpoints.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
