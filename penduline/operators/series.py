"""Ordered series: columns of a series id, a frame number and values. Order is always an explicit column.

All window operators work per series; a series is one recording and so of bounded length (some tens to hundreds of frames),
while the number of series is unbounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: str | list[str] = "series_id", order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def rolling_mean(value: str, width: int, w: WindowSpec) -> Column:
    """Trailing mean, over fewer values at the start."""
    return F.avg(value).over(w.rowsBetween(1 - width, 0))


def middle(values: Column) -> Column:
    """The median of an array of numbers; null of an empty one."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)


def rolling_median(value: str, width: int, w: WindowSpec) -> Column:
    """Trailing median; an ordered window has no median of its own, so the frame's values are gathered (width at most)."""
    return middle(F.collect_list(value).over(w.rowsBetween(1 - width, 0)))


def ema(series: DataFrame, value: str, alpha: float, key: str = "series_id", order: str = "frame") -> DataFrame:
    """(key, order, ema): e0 = x0, e = alpha x + (1 - alpha) e. Null values are passed over."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    step = F.aggregate(pairs, F.array().cast("array<double>"), lambda acc, p: F.array_append(
        acc, F.when(F.size(acc) == 0, p[value].cast("double")).otherwise(F.lit(alpha) * p[value] + F.lit(1 - alpha) * F.get(acc, F.size(acc) - 1))))
    rows = series.where(F.col(value).isNotNull()).groupBy(key).agg(pairs.alias("p"), step.alias("e"))
    return rows.select(key, F.explode(F.arrays_zip("p", "e")).alias("z")).select(key, F.col(f"z.p.{order}").alias(order), F.col("z.e").alias("ema"))


def epoch(step: Column, steps_per_epoch: int) -> Column:
    """1-based epoch of a 1-based step."""
    return (F.floor((step - 1) / steps_per_epoch) + 1).cast("bigint")


def epoch_stats(series: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n, mean, median, min, max, stdev (0 of a single value)."""
    v = F.col(value)
    return series.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"),
                                     F.max(v).alias("max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"))


def head_tail(series: DataFrame, value: str, count: int, key: str = "series_id", order: str = "frame") -> DataFrame:
    """(key, head, tail, ratio): means of the first and last values, and last by first."""
    w = Window.partitionBy(key)
    r = series.select(key, value, F.row_number().over(w.orderBy(order)).alias("i"), F.row_number().over(w.orderBy(F.desc(order))).alias("j"))
    out = r.groupBy(key).agg(F.avg(F.when(F.col("i") <= count, F.col(value))).alias("head"), F.avg(F.when(F.col("j") <= count, F.col(value))).alias("tail"))
    return out.withColumn("ratio", F.try_divide("tail", "head"))


def interpolated(value: str, valid: str, w: WindowSpec, order: str = "frame") -> Column:
    """The value where it is valid; between valid frames linear in the frame number; beyond them constant; null if none."""
    ok = F.when(F.col(valid), F.struct(F.col(order).alias("f"), F.col(value).alias("v")))
    back = F.last(ok, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(ok, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    part = F.try_divide((F.col(order) - back["f"]).cast("double"), ahead["f"] - back["f"])
    return F.when(F.col(valid), F.col(value)).otherwise(F.coalesce(back["v"] + (ahead["v"] - back["v"]) * part, back["v"], ahead["v"]))


def unwrapped(angle: str, w: WindowSpec) -> Column:
    """Phase without jumps: multiples of 2 pi are added so that steps lie in [-pi, pi]; a step of exactly pi stays pi.

    Two windows: call on a DataFrame that has unwrap_step() as column 'step' (see unwrap())."""
    return F.col(angle) + F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))


def unwrap(series: DataFrame, angle: str, key: str | list[str] = "series_id", order: str = "frame", period: float = 2 * math.pi) -> DataFrame:
    """series with 'unwrapped'."""
    w = over(key, order)
    delta = F.col(angle) - F.lag(angle).over(w)
    half = period / 2
    turned = F.pmod(delta + F.lit(half), F.lit(period)) - F.lit(half)
    turned = F.when((turned == -half) & (delta > 0), F.lit(half)).otherwise(turned)
    step = F.when(F.abs(delta) < half, 0.0).otherwise(F.coalesce(turned - delta, F.lit(0.0)))
    return series.withColumn("step", step).withColumn("unwrapped", unwrapped(angle, w)).drop("step")


def relative_to_first(value: str, w: WindowSpec) -> Column:
    return F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def first_reach(series: DataFrame, value: str, share: float, key: str | list[str] = "series_id", time: str = "time_s") -> DataFrame:
    """(key, reach): first time at which the value is at least share of its maximum, else the last time."""
    keys = [key] if isinstance(key, str) else key
    top = series.groupBy(*keys).agg(F.max(value).alias("_top"))
    return series.join(top, keys).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(value) >= share * F.col("_top"), F.col(time))), F.max(time)).alias("reach"))


def monotone_ratio(series: DataFrame, value: str, tolerance: float, key: str | list[str] = "series_id", order: str = "frame") -> DataFrame:
    """(key, monotone): share of steps that don't fall by more than tolerance x range."""
    keys = [key] if isinstance(key, str) else key
    steps = series.withColumn("_d", F.col(value) - F.lag(value).over(over(keys, order)))
    return steps.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_span"), F.collect_list("_d").alias("_steps")).select(
        *keys, F.try_divide(F.size(F.filter("_steps", lambda x: x >= F.lit(-tolerance) * F.col("_span"))), F.size("_steps")).alias("monotone"))


def autocorrelation(series: DataFrame, value: str, lags: tuple[int, int], key: str = "series_id", order: str = "frame") -> DataFrame:
    """(key, lag, r): sum of products of the centred values at a lag over that at lag 0, for each lag in lags (both
    inclusive) that is shorter than the series; none for constant series."""
    held = series.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value].cast("double")).alias("x"))
    kind = held.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lag, r = [], [], []
            starts, flat = batch["x"].offsets.to_numpy(), batch["x"].values.to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                x = flat[starts[k] : starts[k + 1]]
                c = x - x.mean() if len(x) else x
                energy = float(c @ c)
                if energy > 1e-12:  # neither constant nor with a null
                    reach = range(lags[0], min(lags[1], len(c) - 1) + 1)
                    at += [k] * len(reach)
                    lag += reach
                    r += [float(c[: len(c) - s] @ c[s:]) / energy for s in reach]
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(at, pa.int64())), pa.array(lag, pa.int32()), pa.array(r, pa.float64())], names=[key, "lag", "r"])

    return held.mapInArrow(run, f"`{key}` {kind.simpleString()}, lag int, r double")


def period_lag(correlations: DataFrame, key: str = "series_id", least: float = 0.1) -> DataFrame:
    """(key, lag): the first inner lag whose r is no less than that before, more than that after and at least `least`;
    else the lag of the largest r if that is at least `least`; else null."""
    w = over(key, "lag")
    r = F.col("r")
    peaks = correlations.withColumn("peak", (r >= F.lag("r").over(w)) & (r > F.lead("r").over(w)) & (r >= least))
    best = F.max_by("lag", F.struct("r", -F.col("lag")))
    return peaks.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("peak"), F.col("lag"))), F.when(F.max("r") >= least, best)).alias("lag"))


def event_frame(series: DataFrame, a: str, b: str, key: str | list[str] = "series_id", order: str = "frame") -> DataFrame:
    """(key, event): the first frame at which a and b are nearest."""
    keys = [key] if isinstance(key, str) else key
    return series.groupBy(*keys).agg(F.min_by(order, F.struct(F.abs(F.col(a) - F.col(b)), order)).alias("event"))


def windows_about(event: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """(pre_from, pre_to, post_from, post_to), ends exclusive, around an event in a series of n frames."""
    width = F.greatest(F.lit(3), F.rint(n * 0.2).cast("int"))
    pre_to = F.greatest(F.lit(3), event - 1)
    pre_from = F.greatest(F.lit(0), pre_to - width)
    short = pre_to - pre_from < 3
    post_from = F.least(n - 3, event + 2)
    post_to = F.least(n, post_from + width)
    few = post_to - post_from < 3
    return (F.when(short, 0).otherwise(pre_from), F.when(short, 3).otherwise(pre_to), F.when(few, n - 3).otherwise(post_from), F.when(few, n).otherwise(post_to))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope as an aggregate; null without spread in x."""
    return F.regr_slope(y, x)


def sustained_onset(series: DataFrame, condition: Column, window: int, share: float, key: str = "series_id", order: str = "frame") -> DataFrame:
    """(key, onset): first frame of whose next `window` frames (itself included, all there) at least share meet a condition."""
    w = over(key, order).rowsBetween(0, window - 1)
    marks = series.withColumn("_hits", F.count_if(condition).over(w)).withColumn("_seen", F.count("*").over(w))
    return marks.groupBy(key).agg(F.min(F.when((F.col("_seen") == window) & (F.col("_hits") >= math.ceil(share * window)), F.col(order))).alias("onset"))


def mad_threshold(series: DataFrame, value: str, floor: float, times: float = 7.0, key: str = "series_id") -> DataFrame:
    """(key, threshold): median + max(floor, times x median absolute deviation)."""
    mid = series.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    return series.join(mid, key).groupBy(key).agg(F.first("_m").alias("_m"), F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_d")).select(
        key, (F.col("_m") + F.greatest(F.lit(floor), times * F.col("_d"))).alias("threshold"))


def entry_run(series: DataFrame, present: str, centre: str, key: str = "series_id", order: str = "frame") -> DataFrame:
    """(key, entry): first frame with at least four of five frames present from it on, and at least three of the steps
    between them not falling."""
    w = over(key, order)
    ahead = w.rowsBetween(0, 4)
    rising = series.withColumn("_up", (F.col(centre) >= F.lag(centre).over(w)) & F.col(present) & F.lag(present).over(w))
    marks = rising.withColumn("_in", F.count_if(F.col(present)).over(ahead)).withColumn("_rise", F.count_if(F.coalesce("_up", F.lit(False))).over(w.rowsBetween(1, 4)))
    return marks.groupBy(key).agg(F.min(F.when(F.col(present) & (F.col("_in") >= 4) & (F.col("_rise") >= 3), F.col(order))).alias("entry"))


def valid_stats(series: DataFrame, valid: str, threshold: float, key: str = "series_id") -> DataFrame:
    """(key, valid_ratio, n_valid, reason_code)"""
    out = series.groupBy(key).agg(F.avg(F.col(valid).cast("double")).alias("valid_ratio"), F.count_if(F.col(valid)).alias("n_valid"))
    return out.withColumn("reason_code", F.when((F.col("valid_ratio") < threshold) | (F.col("n_valid") < 3), "insufficient_valid_masks"))


def pair_error(a: DataFrame, b: DataFrame, value: str, least_scale: float, key: str = "series_id", order: str = "frame") -> DataFrame:
    """(key, n, rmse, nrmse) over the frames both have; scaled by the range of a, least_scale at least."""
    both = a.select(key, order, F.col(value).alias("_a")).join(b.select(key, order, F.col(value).alias("_b")), [key, order])
    rmse = F.sqrt(F.avg(F.pow(F.col("_a") - F.col("_b"), 2)))
    return both.groupBy(key).agg(F.count("*").alias("n"), rmse.alias("rmse"), (rmse / F.greatest(F.max("_a") - F.min("_a"), F.lit(least_scale))).alias("nrmse"))
