"""References to records that do not exist.

Every key is taken apart into a family and an integer (its serial number; 0 for a key without digits), so that a key and its
(family, integer) stand for each other. Within a family the parents' integers are compressed into contiguous runs, clipped to
blocks of BLOCK integers so that no block is large; each distinct target is matched as of the start of the preceding run, and
a target beyond that run's end, or before any run, never arrives: it is missing. Only what lies within a run is then looked
at in time: first arrival, and for targets ever deleted the last deletion and the last arrival before each reference.

Null and empty targets are no references; null keys and times are no events. Equal references count once. Empty tables give
no rows. Other columns of the tables are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penduline.session import materialize

#: Integers per block of the run index.
BLOCK = 4096

_SPACE = ["target_table", "family", "block"]
# the digits after the first _k, else the last digits; 18 at most, so that they fit a bigint
_SERIAL, _LAST = r"(?s)^(.*?_k)(\d{1,18})(?!\d)(.*)\z", r"(?s)^(.*?)(\d{1,18})(\D*)\z"


def numbered(key: Column) -> tuple[Column, Column]:
    """(family, n) of a key: a_k00000244_x -> 8|a_k?_x, 244. The family names the number of digits, so no two keys agree in
    both; a key without digits is a family of its own with the number 0."""
    def digits(pattern: str) -> Column:
        return F.regexp_extract(key, pattern, 2)

    def bare(pattern: str) -> Column:
        return F.regexp_replace(key, F.lit(pattern), F.lit("$1?$3"))

    of_serial = digits(_SERIAL) != ""
    text = F.when(of_serial, digits(_SERIAL)).otherwise(digits(_LAST))
    family = F.concat_ws("|", F.length(text).cast("string"), F.when(of_serial, F.lit("k")).otherwise(F.lit("")), F.when(of_serial, bare(_SERIAL)).otherwise(bare(_LAST)))
    return family, F.when(text != "", text.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _spaced(df: DataFrame) -> DataFrame:
    """df(target_table, target_key) with family, n and block."""
    family, n = numbered(F.col("target_key"))
    return df.withColumns({"family": family, "n": n}).withColumn("block", F.floor(F.col("n") / F.lit(BLOCK)))


def runs(parents: DataFrame) -> DataFrame:
    """(target_table, family, block, run_start, run_end) of the contiguous integers n in parents(target_table, family, n)."""
    at = Window.partitionBy(*_SPACE).orderBy("n")
    return (
        parents.where("n IS NOT NULL").select("target_table", "family", "n").distinct()
        .withColumn("block", F.floor(F.col("n") / F.lit(BLOCK)))
        .withColumn("island", F.col("n") - F.row_number().over(at))
        .groupBy(*_SPACE, "island").agg(F.min("n").alias("run_start"), F.max("n").alias("run_end"))
        .drop("island")
    )


def as_of_runs(targets: DataFrame, index: DataFrame) -> DataFrame:
    """targets(target_table, family, n, ...) with beyond: whether the integer lies in no run. Each row is matched to the
    preceding run start of its block. Rows with a null n stay out."""
    asked = targets.where("n IS NOT NULL").withColumn("block", F.floor(F.col("n") / F.lit(BLOCK))).withColumn("asked", F.lit(1))
    starts = index.select(*_SPACE, F.col("run_start").alias("n"), "run_end", F.lit(0).alias("asked"))
    at = Window.partitionBy(*_SPACE).orderBy("n", "asked")
    return (
        asked.unionByName(starts, allowMissingColumns=True).withColumn("reach", F.last("run_end", True).over(at))
        .where("asked = 1").withColumn("beyond", F.col("reach").isNull() | (F.col("n") > F.col("reach"))).select(*targets.columns, "beyond")
    )


def references(cases: DataFrame, view_b: DataFrame, predictions: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_key, target_key, target_table, at): equal references once, at their earliest time."""
    def of(df: DataFrame, name: str, field: str, key: str, target: Column, time: str, parent: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(key).alias("ref_key"), target.alias("target_key"),
                         F.lit(parent).alias("target_table"), F.col(time).alias("at"))

    listed = view_b.select("view_id", "delivered_at", F.explode("scenes").alias("scene", "groups")).select(
        "view_id", "delivered_at", F.explode("groups").alias("grp", "ids")).select("view_id", "delivered_at", F.explode("ids").alias("id"))
    every = (
        of(cases, "cases", "parent_case_id", "case_id", F.col("provenance.parent_case_id"), "received_at", "cases")
        .unionByName(of(cases, "cases", "physics_reference_video", "case_id", F.col("assets")["physics_reference_video"], "received_at", "asset_lock"))
        .unionByName(of(listed, "view_b", "scenes", "view_id", F.col("id"), "delivered_at", "cases"))
        .unionByName(of(predictions, "predictions", "case_id", "job_id", F.col("case_id"), "submitted_at", "cases"))
    )
    return every.where("target_key IS NOT NULL AND target_key <> ''").groupBy(
        "ref_table", "ref_field", "ref_key", "target_key", "target_table").agg(F.min("at").alias("at"))


def target_events(cases: DataFrame, deletions: DataFrame, assets: DataFrame) -> DataFrame:
    """(target_table, target_key, at, arrives): each arrival and deletion once. Null keys and times are no events."""
    def of(df: DataFrame, parent: str, key: str, time: str, arrives: bool) -> DataFrame:
        return df.select(F.lit(parent).alias("target_table"), F.col(key).alias("target_key"), F.col(time).alias("at"), F.lit(arrives).alias("arrives"))

    return (
        of(cases, "cases", "case_id", "received_at", True).unionByName(of(deletions, "cases", "case_id", "deleted_at", False))
        .unionByName(of(assets, "asset_lock", "path", "locked_at", True)).unionByName(of(assets, "asset_lock", "path", "withdrawn_at", False))
        .where("target_key IS NOT NULL AND at IS NOT NULL").distinct()
    )


def _last_before(refs: DataFrame, events: DataFrame) -> DataFrame:
    """refs with last_arrival and last_deletion at or before their time. A target's events are cut by day: the state at
    the end of the earlier days is carried by a row a day, so that no task gets all that belongs to one target.

    Both come from written tables. Spark takes the union of sides that are all partitioned by the key for partitioned by it,
    even where adaptive execution has merged their partitions differently, and then plans no exchange, nor keeps one that
    is asked for; a scan has no partitioning to be mistaken."""
    key = ["target_table", "target_key"]
    e = events.withColumn("day", F.to_date("at")).select(
        *key, "day", "at", F.when(F.col("arrives"), F.col("at")).alias("arrival"), F.when(~F.col("arrives"), F.col("at")).alias("deletion"))
    earlier = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    r = refs.withColumn("day", F.to_date("at"))
    by_day = e.groupBy(*key, "day").agg(F.max("arrival").alias("arrival"), F.max("deletion").alias("deletion"))
    days = (
        by_day.unionByName(r.select(*key, "day").distinct(), allowMissingColumns=True).repartition(*key)
        .groupBy(*key, "day").agg(F.max("arrival").alias("arrival"), F.max("deletion").alias("deletion"))
        .select(*key, "day", F.max("arrival").over(earlier).alias("arrival"), F.max("deletion").over(earlier).alias("deletion"))
        .where("arrival IS NOT NULL OR deletion IS NOT NULL")
        .withColumn("at", F.lit(None).cast("timestamp_ntz"))
    )
    within = Window.partitionBy(*key, "day").orderBy(F.asc_nulls_first("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.withColumn("asked", F.lit(True)).unionByName(e.unionByName(days), allowMissingColumns=True).repartition(*key, "day")
    return both.select("*", F.max("arrival").over(within).alias("last_arrival"), F.max("deletion").over(within).alias("last_deletion")).where("asked").drop(
        "arrival", "deletion", "asked", "day")


def orphans(refs: DataFrame, events: DataFrame) -> DataFrame:
    """refs with a reason: missing, late or deleted; all other references are left out. A reference without a time can
    only be missing; its period is null."""
    key = ["target_table", "target_key"]
    refs, events = materialize(refs), materialize(events)
    state = events.groupBy(*key).agg(F.min(F.when(F.col("arrives"), F.col("at"))).alias("first_arrival"), F.min(F.when(~F.col("arrives"), F.col("at"))).alias("first_deletion"))
    arrived = materialize(state.where("first_arrival IS NOT NULL"))
    asked = as_of_runs(materialize(_spaced(refs.select(*key).distinct())), runs(_spaced(arrived)))
    # what lies beyond its run is missing; what lies within is in the parents and looked up for its times only
    asked = materialize(asked.select(*key, "beyond"))
    known = asked.where("NOT beyond").select(*key).join(arrived, key)
    targets = materialize(known.unionByName(asked.where("beyond").select(*key), allowMissingColumns=True))
    seen = refs.join(targets, key)
    reason = F.when(F.col("first_arrival").isNull(), "missing").when(F.col("first_arrival") > F.col("at"), "late")
    perhaps = materialize(seen.where("first_arrival <= at AND first_deletion <= at").drop("first_arrival", "first_deletion"))
    suspects = targets.where("first_deletion IS NOT NULL").select(*key)
    deleted = _last_before(perhaps, materialize(events.join(suspects, key, "left_semi"))).where(
        "last_deletion IS NOT NULL AND (last_arrival IS NULL OR last_arrival <= last_deletion)").withColumn("reason", F.lit("deleted"))
    columns = ["ref_table", "ref_field", "ref_key", "target_key", F.date_format("at", "yyyy-MM").alias("period"), "reason"]
    return seen.withColumn("reason", reason).where("reason IS NOT NULL").select(*columns).unionByName(deleted.select(*columns))


def found(cases: DataFrame, view_b: DataFrame, predictions: DataFrame, deletions: DataFrame, assets: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_key, target_key, period, reason)"""
    return orphans(references(cases, view_b, predictions), target_events(cases, deletions, assets))


def report(found_rows: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return found_rows.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("target_key").alias("n_targets"))
