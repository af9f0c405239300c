"""Audits of what was imported, aligned or restored: rows with a code, null where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composite_parent(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """(case_id, parent_id, code): the one parent with exactly equal keys; parent_not_found or several_parents otherwise.
    Null keys equal nothing."""
    held = parents.groupBy(*keys).agg(F.countDistinct("case_id").alias("n"), F.min("case_id").alias("parent_id"))
    both = children.select("case_id", *keys).distinct().join(held, keys, "left")
    return both.select("case_id", F.when(F.col("n") == 1, F.col("parent_id")).alias("parent_id"), F.when(F.col("n").isNull(), "parent_not_found").when(F.col("n") > 1, "several_parents").alias("code"))


def restored_speed(original: Column, restored: Column, frames_before: Column, frames_after: Column, factor: Column, tolerance: float = 0.002) -> Column:
    """Code of a recording brought back to physical speed: its frames must be kept and its duration divided by factor."""
    return (
        F.when(F.coalesce(factor <= 0, F.lit(True)), "invalid_factor").when(~frames_before.eqNullSafe(frames_after), "frames_changed")
        .when(F.coalesce(F.abs(restored - original / F.when(factor > 0, factor)) > tolerance, F.lit(True)), "duration_mismatch"))


def alignment(rows: DataFrame) -> DataFrame:
    """rows (case_id, start_frame, reviewed, source_frames, aligned_frames, first_hash, source_hash) with code: what was cut must
    have been reviewed, lie within its source, keep the number of frames that follow, and start with the very picture."""
    code = (
        F.when(~F.coalesce("reviewed", F.lit(False)), "unreviewed_alignment").when(F.coalesce((F.col("start_frame") < 0) | (F.col("start_frame") >= F.col("source_frames")), F.lit(True)), "invalid_alignment_frame")
        .when(~F.col("aligned_frames").eqNullSafe(F.col("source_frames") - F.col("start_frame")), "alignment_not_materialized").when(~F.col("first_hash").eqNullSafe(F.col("source_hash")), "first_frame_differs"))
    return rows.withColumn("code", code)


def start_frames(scores: DataFrame, fps: Column, floor: float, window: int = 8, share: float = 0.75) -> DataFrame:
    """(series_id, onset, start, trend, moving): the first frame of sustained motion by the two scores a and b of each frame,
    both above median + max(floor, 7 x median deviation); the start is rewound by max(2, 5 % of a second)."""
    from penduline.operators import series

    bars = [series.mad_threshold(scores, c, floor).withColumnRenamed("threshold", f"bar_{c}") for c in ("a", "b")]
    s = scores.join(bars[0], "series_id").join(bars[1], "series_id")
    onset = series.sustained_onset(s, (F.col("a") > F.col("bar_a")) & (F.col("b") > F.col("bar_b")), window, share)
    after = s.join(onset, "series_id").groupBy("series_id").agg(F.first("onset").alias("onset"), F.regr_slope(F.when(F.col("frame") >= F.col("onset"), F.col("a")), F.col("frame").cast("double")).alias("trend"), F.max(fps).alias("fps"))
    rewind = F.greatest(F.lit(2), F.rint(0.05 * F.col("fps")).cast("int"))
    return after.select("series_id", "onset", F.when(F.col("onset").isNotNull(), F.greatest(F.lit(0), F.col("onset") - rewind)).cast("bigint").alias("start"), "trend", F.col("onset").isNotNull().alias("moving"))


def entry_frames(components: DataFrame, expected: Column, least_share: float = 0.6) -> DataFrame:
    """(series_id, usual_height, entry) from components(series_id, frame, height, x), of which a frame may have none or many: an
    object is there if the tallest component has enough of the expected height or, where that is null, of the usual one
    (80 % quantile); it enters where it stays and goes forwards."""
    from penduline.operators import series

    tall = components.groupBy("series_id", "frame").agg(F.max("height").alias("height"), F.max_by("x", F.struct("height", "x")).alias("x"), F.max(expected).alias("expected"))
    usual = tall.groupBy("series_id").agg(F.percentile(F.when(F.col("height") > 0, F.col("height")), F.lit(0.8)).alias("usual_height"))
    marked = tall.join(usual, "series_id").withColumn("present", F.coalesce(F.col("height") >= least_share * F.coalesce("expected", "usual_height"), F.lit(False)))
    return series.entry_run(marked, "present", "x").join(usual, "series_id").select("series_id", "usual_height", "entry")
