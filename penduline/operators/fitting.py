"""Least-squares fits as aggregates: polynomials, principal axis, circle. Closed forms over centred sums, so a fit is one
grouped aggregation after the means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _centred(points: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """points with c_<column> for each column, minus its mean m_<column> in the group. Groups are recordings; rows without a key
    belong to none."""
    whole = Window.partitionBy(*keys)
    means = points.dropna(subset=keys).withColumns({f"m_{c}": F.avg(c).over(whole) for c in columns})
    return means.withColumns({f"c_{c}": F.col(c) - F.col(f"m_{c}") for c in columns})


def _sum(*factors: Column) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return F.sum(out)


def linear(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, slope, intercept, rmse); slope null without spread in x."""
    cx, cy = F.col(f"c_{x}"), F.col(f"c_{y}")
    s = _centred(points, list(keys), x, y).groupBy(*keys).agg(F.count("*").alias("n"), _sum(cx, cx).alias("xx"), _sum(cx, cy).alias("xy"), _sum(cy, cy).alias("yy"), F.first(f"m_{x}").alias("mx"), F.first(f"m_{y}").alias("my"))
    s = s.withColumn("slope", F.try_divide("xy", F.when(F.col("xx") > 0, F.col("xx"))))
    return s.select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - F.col("slope") * F.col("xy")) / F.col("n")).alias("rmse"))


def quadratic(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, a, b, c) of a x^2 + b x + c; null with fewer than three different x."""
    cx, cy = F.col(f"c_{x}"), F.col(y)
    s = _centred(points, list(keys), x).groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), _sum(cx, cx).alias("s2"), _sum(cx, cx, cx).alias("s3"), _sum(cx, cx, cx, cx).alias("s4"), F.sum(cy).alias("sy"), _sum(cx, cy).alias("sxy"), _sum(cx, cx, cy).alias("sxxy"), F.first(f"m_{x}").alias("m"))
    n, s2, s3, s4, sy, sxy, sxxy, m = (F.col(k) for k in ("n", "s2", "s3", "s4", "sy", "sxy", "sxxy", "m"))
    det = n * s2 * s4 - s2 * s2 * s2 - n * s3 * s3
    det = F.when(F.abs(det) > 1e-12 * F.greatest(n * s2 * s4, F.lit(1e-300)), det)
    a = (n * (s2 * sxxy - s3 * sxy) - s2 * s2 * sy) / det
    s = s.withColumn("a", a).withColumn("b0", F.try_divide(sxy - F.col("a") * s3, s2)).withColumn("c0", (sy - F.col("a") * s2) / n)
    return s.select(*keys, F.col("n").cast("bigint").alias("n"), "a", (F.col("b0") - 2 * F.col("a") * m).alias("b"), (F.col("c0") - F.col("b0") * m + F.col("a") * m * m).alias("c"))


def axis(points: DataFrame, x: str, y: str, order: str, *keys: str) -> DataFrame:
    """(keys, mx, my, dx, dy, explained): principal axis through the mean, pointing from the first to the last point;
    explained is its share of the spread, 0 without any."""
    cx, cy = F.col(f"c_{x}"), F.col(f"c_{y}")
    s = _centred(points, list(keys), x, y).groupBy(*keys).agg(
        _sum(cx, cx).alias("xx"), _sum(cx, cy).alias("xy"), _sum(cy, cy).alias("yy"), F.first(f"m_{x}").alias("mx"), F.first(f"m_{y}").alias("my"),
        (F.max_by(x, order) - F.min_by(x, order)).alias("wx"), (F.max_by(y, order) - F.min_by(y, order)).alias("wy"))
    theta = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    s = s.withColumn("theta", theta).withColumn("flip", F.when(F.cos("theta") * F.col("wx") + F.sin("theta") * F.col("wy") < 0, -1.0).otherwise(1.0))
    total = F.col("xx") + F.col("yy")
    top = (total + F.hypot(F.col("xx") - F.col("yy"), 2 * F.col("xy"))) / 2
    return s.select(*keys, "mx", "my", (F.col("flip") * F.cos("theta")).alias("dx"), (F.col("flip") * F.sin("theta")).alias("dy"), F.coalesce(F.try_divide(top, total), F.lit(0.0)).alias("explained"))


def project(points: DataFrame, axes: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """points with along and across their group's axis."""
    cx, cy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    return points.join(axes.select(*keys, "mx", "my", "dx", "dy"), list(keys)).withColumn("along", cx * F.col("dx") + cy * F.col("dy")).withColumn("cross", cy * F.col("dx") - cx * F.col("dy")).drop("mx", "my", "dx", "dy")


def circle(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, cx, cy, radius): algebraic least-squares circle; null for fewer than three points or points on a line."""
    ux, uy = F.col(f"c_{x}"), F.col(f"c_{y}")
    z = ux * ux + uy * uy
    s = _centred(points, list(keys), x, y).groupBy(*keys).agg(
        F.count("*").alias("n"), _sum(ux, ux).alias("xx"), _sum(ux, uy).alias("xy"), _sum(uy, uy).alias("yy"), _sum(ux, z).alias("xz"), _sum(uy, z).alias("yz"), F.avg(z).alias("mz"), F.first(f"m_{x}").alias("mx"), F.first(f"m_{y}").alias("my"))
    det = 2 * (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    det = F.when((F.col("n") >= 3) & (F.abs(det) > 1e-12 * F.pow(F.col("xx") + F.col("yy"), 2)), det)
    s = s.withColumn("px", (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).withColumn("py", (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    return s.select(*keys, "n", (F.col("px") + F.col("mx")).alias("cx"), (F.col("py") + F.col("my")).alias("cy"), F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("mz")).alias("radius"))


def radial_spread(points: DataFrame, circles: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, radial_cv, residual): relative spread of the distances from the centre, and their rms error."""
    far = F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy"))
    return points.join(circles, list(keys)).withColumn("_r", far).groupBy(*keys).agg(
        F.try_divide(F.stddev_pop("_r"), F.avg("_r")).alias("radial_cv"), F.sqrt(F.avg(F.pow(F.col("_r") - F.col("radius"), 2))).alias("residual"))
