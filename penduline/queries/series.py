"""Series operators over events: one series a user, frames by time."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penduline.functions import similarity
from penduline.operators import fitting, series
from penduline.queries.registry import query
from penduline.session import table

_S = """s AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 16.0::DOUBLE AS time_s,
  value AS x, json_extract_string(props, '$.k')::DOUBLE AS y, event_type <> 'error' AS valid FROM events)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, frame, time_s, x, y, valid)"""
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = (F.row_number().over(order) - 1).cast("bigint")
    return e.select(F.col("user_id").alias("series_id"), frame.alias("frame"), (frame / 16.0).alias("time_s"), F.col("value").alias("x"),
                    F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("event_type") != "error").alias("valid"))


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


_W = series.over


@query(f"WITH {_S} SELECT series_id, frame, round(avg(x) OVER (PARTITION BY series_id ORDER BY frame ROWS 24 PRECEDING), 6) AS mean25 FROM s")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames(spark, d).select("series_id", "frame", series.rolling_mean("x", 25, _W()).alias("mean25")), "mean25")


@query(f"WITH {_S} SELECT series_id, frame, round(median(x) OVER (PARTITION BY series_id ORDER BY frame ROWS 24 PRECEDING), 6) AS median25 FROM s")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames(spark, d).select("series_id", "frame", series.rolling_median("x", 25, _W()).alias("median25")), "median25")


@query(f"WITH RECURSIVE {_S}, e AS (SELECT series_id, frame, x AS ema FROM s WHERE frame = 0 UNION ALL SELECT s.series_id, s.frame, 0.05::DOUBLE * s.x + 0.95::DOUBLE * e.ema FROM e JOIN s ON s.series_id = e.series_id AND s.frame = e.frame + 1) SELECT series_id, frame, round(ema + 1e-7, 4) AS ema FROM e")
def ema(spark: SparkSession, d: str) -> DataFrame:
    return _r(series.ema(frames(spark, d), "x", 0.05).withColumn("ema", F.col("ema") + 1e-7), "ema", digits=4)


@query(f"WITH {_S} SELECT series_id, (frame // 20 + 1) AS epoch, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, min(x) AS min, max(x) AS max, round(coalesce(stddev_samp(x), 0), 6) AS stdev FROM s GROUP BY ALL")
def epoch_stats(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).withColumn("epoch", series.epoch(F.col("frame") + 1, 20))
    return _r(series.epoch_stats(s, "x", "series_id", "epoch"), "mean", "median", "stdev")


@query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY frame DESC) AS j FROM s), h AS (SELECT series_id, avg(x) FILTER (frame < 20) AS head, avg(x) FILTER (j <= 20) AS tail FROM r GROUP BY series_id) SELECT series_id, round(head, 6) AS head, round(tail, 6) AS tail, round(tail / head, 6) AS ratio FROM h")
def head_tail_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _r(series.head_tail(frames(spark, d), "x", 20), "head", "tail", "ratio")


_GAP = f"""{_S}, g AS (SELECT *, last_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER b AS f0, last_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER b AS x0,
  first_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER a AS f1, first_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER a AS x1 FROM s
  WINDOW b AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT series_id, frame, time_s, y, CASE WHEN valid THEN x ELSE coalesce(x0 + (x1 - x0) * (frame - f0) / nullif(f1 - f0, 0), x0, x1) END AS x FROM g)"""


@query(f"WITH {_GAP} SELECT series_id, frame, round(x, 6) AS filled FROM filled")
def gap_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames(spark, d).select("series_id", "frame", series.interpolated("x", "valid", _W()).alias("filled")), "filled")


@query(f"""WITH {_S}, a AS (SELECT series_id, frame, y / 10 AS angle, y / 10 - lag(y / 10) OVER (PARTITION BY series_id ORDER BY frame) AS dl FROM s),
  t AS (SELECT *, CASE WHEN dl IS NULL OR abs(dl) < pi() THEN 0 ELSE (dl + pi()) - 2 * pi() * floor((dl + pi()) / (2 * pi())) - pi() - dl END AS step FROM a)
  SELECT series_id, frame, round(angle + sum(step) OVER (PARTITION BY series_id ORDER BY frame), 6) AS unwrapped FROM t""")
def phase_unwrap(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).select("series_id", "frame", (F.col("y") / 10).alias("angle"))
    return _r(series.unwrap(s, "angle"), "unwrapped").drop("angle")


@query(f"WITH {_S} SELECT series_id, frame, round(x - first_value(x) OVER (PARTITION BY series_id ORDER BY frame), 6) AS moved FROM s")
def relative_to_first(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames(spark, d).select("series_id", "frame", series.relative_to_first("x", _W()).alias("moved")), "moved")


@query(f"WITH {_S}, m AS (SELECT *, max(x) OVER (PARTITION BY series_id) AS top FROM s) SELECT series_id, coalesce(min(time_s) FILTER (x >= 0.95::DOUBLE * top), max(time_s)) AS reach FROM m GROUP BY series_id")
def first_reach_time(spark: SparkSession, d: str) -> DataFrame:
    return series.first_reach(frames(spark, d), "x", 0.95)


@query(f"WITH {_S}, k AS (SELECT *, x - lag(x) OVER (PARTITION BY series_id ORDER BY frame) AS dl, max(x) OVER (PARTITION BY series_id) - min(x) OVER (PARTITION BY series_id) AS span FROM s) SELECT series_id, round(avg((dl >= -0.02::DOUBLE * span)::INTEGER), 6) AS monotone FROM k WHERE dl IS NOT NULL GROUP BY series_id")
def monotone_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _r(series.monotone_ratio(frames(spark, d), "x", 0.02), "monotone")


_AUTO = f"""{_S}, c AS (SELECT series_id, frame, x - avg(x) OVER (PARTITION BY series_id) AS c FROM s), e AS (SELECT series_id, sum(c * c) AS e FROM c GROUP BY series_id),
  r AS (SELECT a.series_id, b.frame - a.frame AS lag, sum(a.c * b.c) / any_value(e.e) AS r FROM c a JOIN c b ON a.series_id = b.series_id AND b.frame - a.frame BETWEEN 5 AND 40 JOIN e ON e.series_id = a.series_id GROUP BY ALL)"""


@query(f"WITH {_AUTO} SELECT series_id, lag::INTEGER AS lag, round(r, 6) AS r FROM r")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return _r(series.autocorrelation(frames(spark, d), "x", (5, 40)), "r")


@query(f"""WITH {_AUTO}, p AS (SELECT *, r >= lag(r) OVER w AND r > lead(r) OVER w AND r >= 0.1 AS peak FROM r WINDOW w AS (PARTITION BY series_id ORDER BY lag))
  SELECT series_id, coalesce(min(lag) FILTER (peak), CASE WHEN max(r) >= 0.1 THEN arg_max(lag, r) END)::INTEGER AS lag FROM p GROUP BY series_id""")
def period_estimate(spark: SparkSession, d: str) -> DataFrame:
    return series.period_lag(series.autocorrelation(frames(spark, d), "x", (5, 40)))


_EVENT = f"{_S}, ev AS (SELECT series_id, arg_min(frame, {{'a': abs(x - y), 'b': frame}}) AS event, count(*) AS n FROM s GROUP BY series_id)"


@query(f"WITH {_EVENT} SELECT series_id, event FROM ev")
def event_frame(spark: SparkSession, d: str) -> DataFrame:
    return series.event_frame(frames(spark, d), "x", "y")


@query(f"""WITH {_EVENT}, w AS (SELECT *, greatest(3, round_even(n * 0.2::DOUBLE, 0)) AS width, greatest(3, event - 1) AS pre_to, least(n - 3, event + 2) AS post_from FROM ev),
  w2 AS (SELECT *, greatest(0, pre_to - width) AS pre_from, least(n, post_from + width) AS post_to FROM w),
  w3 AS (SELECT series_id, CASE WHEN pre_to - pre_from < 3 THEN 0 ELSE pre_from END AS a, CASE WHEN pre_to - pre_from < 3 THEN 3 ELSE pre_to END AS b, CASE WHEN post_to - post_from < 3 THEN n - 3 ELSE post_from END AS c, CASE WHEN post_to - post_from < 3 THEN n ELSE post_to END AS e FROM w2)
  SELECT series_id, round(regr_slope(x, time_s) FILTER (frame >= a AND frame < b), 6) AS v_before, round(regr_slope(x, time_s) FILTER (frame >= c AND frame < e), 6) AS v_after FROM s JOIN w3 USING (series_id) GROUP BY series_id""")
def pre_post_velocity(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d)
    at = series.event_frame(s, "x", "y").join(s.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")
    a, b, c, e = series.windows_about(F.col("event"), F.col("n"))
    both = s.join(at.select("series_id", a.alias("a"), b.alias("b"), c.alias("c"), e.alias("e")), "series_id")
    inside = lambda lo, hi: F.when((F.col("frame") >= F.col(lo)) & (F.col("frame") < F.col(hi)), F.col("time_s"))
    return _r(both.groupBy("series_id").agg(series.slope(F.col("x"), inside("a", "b")).alias("v_before"), series.slope(F.col("x"), inside("c", "e")).alias("v_after")), "v_before", "v_after")


@query(f"WITH {_S}, m AS (SELECT *, count(*) FILTER (x > 20 AND y > 20) OVER w AS hits, count(*) OVER w AS seen FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT series_id, min(frame) FILTER (seen = 8 AND hits >= 6) AS onset FROM m GROUP BY series_id")
def sustained_onset(spark: SparkSession, d: str) -> DataFrame:
    return series.sustained_onset(frames(spark, d), (F.col("x") > 20) & (F.col("y") > 20), 8, 0.75)


@query(f"WITH {_S}, m AS (SELECT series_id, quantile_cont(x, 0.5) AS m FROM s GROUP BY series_id) SELECT series_id, round(any_value(m) + greatest(1.5::DOUBLE, 7 * quantile_cont(abs(x - m), 0.5)), 6) AS threshold FROM s JOIN m USING (series_id) GROUP BY series_id")
def mad_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _r(series.mad_threshold(frames(spark, d), "x", 1.5), "threshold")


@query(f"""WITH {_S}, u AS (SELECT *, coalesce(x >= lag(x) OVER w AND valid AND lag(valid) OVER w, false) AS up FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
  m AS (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS here, count(*) FILTER (up) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS rise FROM u)
  SELECT series_id, min(frame) FILTER (valid AND here >= 4 AND rise >= 3) AS entry FROM m GROUP BY series_id""")
def entry_run(spark: SparkSession, d: str) -> DataFrame:
    return series.entry_run(frames(spark, d), "valid", "x")


@query(f"WITH {_S}, v AS (SELECT series_id, avg(valid::INTEGER) AS valid_ratio, count(*) FILTER (valid) AS n_valid FROM s GROUP BY series_id) SELECT series_id, round(valid_ratio, 6) AS valid_ratio, n_valid, CASE WHEN valid_ratio < 0.8::DOUBLE OR n_valid < 3 THEN 'insufficient_valid_masks' END AS reason_code FROM v")
def valid_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _r(series.valid_stats(frames(spark, d), "valid", 0.8), "valid_ratio")


@query(f"WITH {_S} SELECT series_id, round(max(x) - min(x), 6) AS range, round(stddev_pop(x), 6) AS std, round(stddev_pop(x) / avg(x), 6) AS cv, round(quantile_cont(x, 0.95), 6) AS q95 FROM s GROUP BY series_id")
def spread_stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames(spark, d).groupBy("series_id").agg((F.max("x") - F.min("x")).alias("range"), F.stddev_pop("x").alias("std"), F.try_divide(F.stddev_pop("x"), F.avg("x")).alias("cv"), F.percentile("x", F.lit(0.95)).alias("q95")), "range", "std", "cv", "q95")


@query(f"WITH {_S} SELECT series_id, round(regr_slope(x, time_s), 6) AS slope, round(corr(x, time_s), 6) AS r, round(avg(x) FILTER (time_s >= 2.5) - avg(x) FILTER (time_s < 0.3), 6) AS edge FROM s GROUP BY series_id")
def trend_test(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("time_s")
    return _r(frames(spark, d).groupBy("series_id").agg(F.regr_slope("x", "time_s").alias("slope"), F.corr("x", "time_s").alias("r"), (F.avg(F.when(t >= 2.5, F.col("x"))) - F.avg(F.when(t < 0.3, F.col("x")))).alias("edge")), "slope", "r", "edge")


@query(f"WITH {_S} SELECT series_id, count(*) AS n, round(regr_slope(x, time_s), 6) AS slope, round(regr_intercept(x, time_s), 6) AS intercept, round(sqrt(greatest(0, regr_syy(x, time_s) - regr_slope(x, time_s) * regr_sxy(x, time_s)) / count(*)), 6) AS rmse FROM s GROUP BY series_id")
def poly_fit1(spark: SparkSession, d: str) -> DataFrame:
    return _r(fitting.linear(frames(spark, d), "time_s", "x", "series_id"), "slope", "intercept", "rmse")


@query(f"""WITH {_S}, c AS (SELECT *, time_s - avg(time_s) OVER (PARTITION BY series_id) AS u, avg(time_s) OVER (PARTITION BY series_id) AS m FROM s),
  q AS (SELECT series_id, count(*)::DOUBLE AS n, any_value(m) AS m, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(x) AS sy, sum(u * x) AS sxy, sum(u * u * x) AS sxxy FROM c GROUP BY series_id),
  a AS (SELECT *, (n * (s2 * sxxy - s3 * sxy) - s2 * s2 * sy) / (n * s2 * s4 - s2 * s2 * s2 - n * s3 * s3) AS a FROM q), b AS (SELECT *, (sxy - a * s3) / s2 AS b0, (sy - a * s2) / n AS c0 FROM a)
  SELECT series_id, n::BIGINT AS n, round(a, 5) AS a, round(b0 - 2 * a * m, 5) AS b, round(c0 - b0 * m + a * m * m, 5) AS c FROM b""")
def poly_fit2(spark: SparkSession, d: str) -> DataFrame:
    return _r(fitting.quadratic(frames(spark, d), "time_s", "x", "series_id"), "a", "b", "c", digits=5)


_AXIS = f"""{_S}, c AS (SELECT *, avg(x) OVER (PARTITION BY series_id) AS mx, avg(y) OVER (PARTITION BY series_id) AS my FROM s),
  q AS (SELECT series_id, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy, arg_max(x, frame) - arg_min(x, frame) AS wx, arg_max(y, frame) - arg_min(y, frame) AS wy FROM c GROUP BY series_id),
  t AS (SELECT *, 0.5 * atan2(2 * xy, xx - yy) AS th, (xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2 / (xx + yy) AS explained FROM q),
  ax AS (SELECT series_id, mx, my, CASE WHEN cos(th) * wx + sin(th) * wy < 0 THEN -1 ELSE 1 END * cos(th) AS dx, CASE WHEN cos(th) * wx + sin(th) * wy < 0 THEN -1 ELSE 1 END * sin(th) AS dy, explained FROM t)"""


@query(f"WITH {_AXIS} SELECT series_id, round(mx, 6) AS mx, round(my, 6) AS my, round(dx, 6) AS dx, round(dy, 6) AS dy, round(explained, 6) AS explained FROM ax")
def axis_fit(spark: SparkSession, d: str) -> DataFrame:
    return _r(fitting.axis(frames(spark, d), "x", "y", "frame", "series_id"), "mx", "my", "dx", "dy", "explained")


@query(f"WITH {_AXIS} SELECT series_id, frame, round((x - mx) * dx + (y - my) * dy, 5) AS along, round((y - my) * dx - (x - mx) * dy, 5) AS cross FROM s JOIN ax USING (series_id)")
def axis_project(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d)
    return _r(fitting.project(s, fitting.axis(s, "x", "y", "frame", "series_id"), "x", "y", "series_id").select("series_id", "frame", "along", "cross"), "along", "cross", digits=5)


_CIRCLE = f"""{_S}, c AS (SELECT series_id, x, y, x - avg(x) OVER (PARTITION BY series_id) AS u, y - avg(y) OVER (PARTITION BY series_id) AS v, avg(x) OVER (PARTITION BY series_id) AS mx, avg(y) OVER (PARTITION BY series_id) AS my FROM s),
  q AS (SELECT series_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS xx, sum(u * v) AS xy, sum(v * v) AS yy, sum(u * (u * u + v * v)) AS xz, sum(v * (u * u + v * v)) AS yz, avg(u * u + v * v) AS mz FROM c GROUP BY series_id),
  p AS (SELECT *, (xz * yy - yz * xy) / (2 * (xx * yy - xy * xy)) AS px, (yz * xx - xz * xy) / (2 * (xx * yy - xy * xy)) AS py FROM q), circ AS (SELECT series_id, n, px + mx AS cx, py + my AS cy, sqrt(px * px + py * py + mz) AS radius FROM p)"""


@query(f"WITH {_CIRCLE} SELECT series_id, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(radius, 5) AS radius FROM circ")
def circle_fit(spark: SparkSession, d: str) -> DataFrame:
    return _r(fitting.circle(frames(spark, d), "x", "y", "series_id"), "cx", "cy", "radius", digits=5)


@query(f"WITH {_CIRCLE}, f AS (SELECT series_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r, radius FROM s JOIN circ USING (series_id)) SELECT series_id, round(stddev_pop(r) / avg(r), 6) AS radial_cv, round(sqrt(avg((r - radius) * (r - radius))), 6) AS residual FROM f GROUP BY series_id")
def circle_residual(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d)
    return _r(fitting.radial_spread(s, fitting.circle(s, "x", "y", "series_id"), "x", "y", "series_id"), "radial_cv", "residual")


_PAIR = f"{_S}, pr AS (SELECT a.series_id, a.frame, a.time_s, a.x AS r, b.x AS p FROM s a JOIN s b ON b.series_id = a.series_id + 75 AND b.frame = a.frame)"


@query(f"WITH {_PAIR} SELECT series_id, count(*) AS n, round(sqrt(avg((r - p) * (r - p))), 6) AS rmse, round(sqrt(avg((r - p) * (r - p))) / greatest(max(r) - min(r), 1), 6) AS nrmse FROM pr GROUP BY series_id")
def normalized_rmse(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).select("series_id", "frame", "x")
    return _r(series.pair_error(s, s.withColumn("series_id", F.col("series_id") - 75), "x", 1.0), "rmse", "nrmse")


@query(f"""WITH {_PAIR} SELECT series_id, frame, round(abs(p - r) / 2, 6) AS scaled, round(abs(p - r) / greatest(abs(r), 1e-12), 6) AS relative, round(exp(-abs(p - r) / 2), 6) AS similar, round(1 - least(abs(p - r), 1), 6) AS ratio, round(exp(-greatest(p - r, 0) / 5), 6) AS decay FROM pr""")
def similarity_kernels(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d)
    both = s.select("series_id", "frame", F.col("x").alias("r")).join(s.select((F.col("series_id") - 75).alias("series_id"), "frame", F.col("x").alias("p")), ["series_id", "frame"])
    r, p = F.col("r"), F.col("p")
    return _r(both.select("series_id", "frame", similarity.scaled_delta(r, p, 2.0).alias("scaled"), similarity.relative_delta(r, p).alias("relative"), similarity.delta_similarity(r, p, 2.0).alias("similar"),
                          similarity.ratio_similarity(r, p).alias("ratio"), similarity.decay(p - r, 5.0).alias("decay")), "scaled", "relative", "similar", "ratio", "decay")


