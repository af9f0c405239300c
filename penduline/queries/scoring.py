"""Scene scores over events: user u is the reference of job u, user u + 75 its prediction, over the frames both have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import scoring
from penduline.queries.registry import query
from penduline.queries.series import _S, frames


#: Traces of free fall (t) and how they differ (e).
_FREE_FALL = f"""{_S}, pt AS (SELECT series_id AS job_id, 'r' AS role, frame, time_s, y AS px, x AS py FROM s UNION ALL SELECT series_id - 75, 'p', frame, time_s, y, x FROM s),
  both_ AS (SELECT pt.* FROM pt JOIN (SELECT job_id, frame FROM pt GROUP BY ALL HAVING count(*) = 2) USING (job_id, frame)),
  v AS (SELECT *, py - first_value(py) OVER (PARTITION BY job_id, role ORDER BY frame) AS v FROM both_),
  sp AS (SELECT *, max(abs(v)) OVER k AS span, max(v) OVER k AS top, v - lag(v) OVER (PARTITION BY job_id, role ORDER BY frame) AS step, time_s - avg(time_s) OVER k AS u FROM v WINDOW k AS (PARTITION BY job_id, role)),
  q AS (SELECT job_id, role, any_value(span) AS span, max(time_s) AS duration, (max(px) - min(px)) / any_value(span) AS drift, avg((step >= -0.02::DOUBLE * span)::INTEGER) AS down, coalesce(min(time_s) FILTER (v >= 0.95::DOUBLE * top), max(time_s)) AS impact,
    count(*)::DOUBLE AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(v) AS sy, sum(u * v) AS sxy, sum(u * u * v) AS sxxy FROM sp GROUP BY ALL),
  t AS (SELECT *, 2 * (n * (s2 * sxxy - s3 * sxy) - s2 * s2 * sy) / (n * s2 * s4 - s2 * s2 * s2 - n * s3 * s3) / span AS acc FROM q),
  e AS (SELECT a.job_id, sqrt(avg((a.v / a.span - b.v / b.span) ** 2)) / greatest(max(a.v / a.span) - min(a.v / a.span), 1) AS nrmse FROM sp a JOIN sp b ON a.job_id = b.job_id AND a.frame = b.frame AND a.role = 'r' AND b.role = 'p' GROUP BY a.job_id)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d)
    a = s.select(F.col("series_id").alias("job_id"), "frame", "time_s", F.col("y").alias("ax"), F.col("x").alias("ay"), F.col("valid").alias("av"))
    b = s.select((F.col("series_id") - 75).alias("job_id"), "frame", F.col("y").alias("bx"), F.col("x").alias("by"), F.col("valid").alias("bv"))
    row = lambda role, p: F.struct(F.lit(role).alias("role"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"), F.col(f"{p}v").alias("valid"))
    both = a.join(b, ["job_id", "frame"]).select("job_id", "frame", "time_s", F.explode(F.array(row("reference", "a"), row("prediction", "b"))).alias("p"))
    return both.select("job_id", "p.role", F.lit(0).alias("obj"), "frame", "time_s", "p.x", "p.y", "p.valid")


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) + 0.0 for c, kind in df.dtypes if kind == "double"})


@query(f"""WITH {_FREE_FALL},
  c AS (SELECT job_id, exp(-nrmse / 0.15) AS vertical_trajectory, exp(-abs(p.acc - r.acc) / greatest(abs(r.acc), 1e-9) / 0.35) AS normalized_acceleration, exp(-abs(p.impact - r.impact) / greatest(r.duration, 1e-9) / 0.15) AS impact_time,
    0.5 * (exp(-abs(p.drift - r.drift) / 0.08) + 1 - least(abs(p.down - r.down), 1)) AS motion_constraints FROM e JOIN t r USING (job_id) JOIN t p USING (job_id) WHERE r.role = 'r' AND p.role = 'p')
  SELECT job_id, round(vertical_trajectory, 5) AS vertical_trajectory, round(normalized_acceleration, 5) AS normalized_acceleration, round(impact_time, 5) AS impact_time, round(motion_constraints, 5) AS motion_constraints,
    NULL::VARCHAR AS reason_code, round(0.5 * vertical_trajectory + 0.25 * normalized_acceleration + 0.15 * impact_time + 0.1 * motion_constraints, 5) AS score, 'evaluated' AS status FROM c""")
def free_fall_score(spark: SparkSession, d: str) -> DataFrame:
    return _round(scoring.score_free_fall(_points(spark, d)))


def _weighted(**parts: float) -> str:
    """The weighted mean of the parts that aren't null."""
    return f"({' + '.join(f'coalesce({w} * {k}, 0)' for k, w in parts.items())}) / nullif({' + '.join(f'CASE WHEN {k} IS NULL THEN 0 ELSE {w} END' for k, w in parts.items())}, 0)"


def _rounded(*parts: str) -> str:
    return ", ".join(f"round({k}, 5) AS {k}" for k in parts)


_BOTH = _FREE_FALL[: _FREE_FALL.index("  v AS (")].rstrip().rstrip(",")

#: Ways along the principal axis (w), traces (t) and how they differ (e).
_INCLINE = f"""{_BOTH},
  ce AS (SELECT *, avg(px) OVER k AS mx, avg(py) OVER k AS my FROM both_ WINDOW k AS (PARTITION BY job_id, role)),
  ax AS (SELECT job_id, role, sum((px - mx) * (px - mx)) AS xx, sum((px - mx) * (py - my)) AS xy, sum((py - my) * (py - my)) AS yy, arg_max(px, frame) - arg_min(px, frame) AS wx, arg_max(py, frame) - arg_min(py, frame) AS wy FROM ce GROUP BY ALL),
  th AS (SELECT *, 0.5 * atan2(2 * xy, xx - yy) AS th FROM ax),
  ar AS (SELECT job_id, role, cos(th) * CASE WHEN cos(th) * wx + sin(th) * wy < 0 THEN -1 ELSE 1 END AS dx, sin(th) * CASE WHEN cos(th) * wx + sin(th) * wy < 0 THEN -1 ELSE 1 END AS dy FROM th),
  al AS (SELECT ce.*, (px - mx) * dx + (py - my) * dy AS along, (py - my) * dx - (px - mx) * dy AS across FROM ce JOIN ar USING (job_id, role)),
  sw AS (SELECT *, along - first_value(along) OVER (PARTITION BY job_id, role ORDER BY frame) AS s, row_number() OVER (PARTITION BY job_id, role ORDER BY frame) AS k FROM al),
  w AS (SELECT *, max(s) OVER g AS top, max(s) OVER g - min(s) OVER g AS span, s - lag(s) OVER (PARTITION BY job_id, role ORDER BY frame) AS step FROM sw WINDOW g AS (PARTITION BY job_id, role)),
  cut AS (SELECT job_id, role, greatest(5, min(k) FILTER (s >= 0.9::DOUBLE * top)) AS last FROM w GROUP BY ALL),
  early AS (SELECT w.*, time_s - avg(time_s) OVER (PARTITION BY job_id, role) AS u FROM w JOIN cut USING (job_id, role) WHERE k <= last),
  fq AS (SELECT job_id, role, count(*)::DOUBLE AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(s) AS sy, sum(u * s) AS sxy, sum(u * u * s) AS sxxy FROM early GROUP BY ALL),
  fa AS (SELECT job_id, role, CASE WHEN abs(n * s2 * s4 - s2 * s2 * s2 - n * s3 * s3) > 1e-12 * greatest(n * s2 * s4, 1e-300) THEN (n * (s2 * sxxy - s3 * sxy) - s2 * s2 * sy) / (n * s2 * s4 - s2 * s2 * s2 - n * s3 * s3) END AS a FROM fq),
  t AS (SELECT job_id, role, any_value(span) AS span, max(time_s) AS duration, avg((step >= -0.015::DOUBLE * span)::INTEGER) AS steady, coalesce(min(time_s) FILTER (s >= 0.95::DOUBLE * top), max(time_s)) AS descent,
    stddev_pop(across) / nullif(any_value(span), 0) AS across, 2 * any_value(a) / nullif(any_value(span), 0) AS acc FROM w JOIN fa USING (job_id, role) GROUP BY ALL),
  e AS (SELECT a.job_id, sqrt(avg((a.s / nullif(a.span, 0) - b.s / nullif(b.span, 0)) ** 2)) / greatest(max(a.s / nullif(a.span, 0)) - min(a.s / nullif(a.span, 0)), 1) AS nrmse FROM w a JOIN w b ON a.job_id = b.job_id AND a.frame = b.frame AND a.role = 'r' AND b.role = 'p' GROUP BY a.job_id)"""


@query(f"""WITH {_INCLINE}, c AS (SELECT job_id, coalesce(least(r.span, p.span) < 16, true) AS bad, exp(-nrmse / 0.18) AS along_plane_trajectory, exp(-abs(p.acc - r.acc) / greatest(abs(r.acc), 1e-9) / 0.4) AS normalized_acceleration,
    exp(-abs(p.descent - r.descent) / greatest(r.duration, 1e-9) / 0.18) AS descent_time, 0.45 * exp(-abs(p.across - r.across) / 0.05) + 0.35 * (1 - least(abs(p.steady - r.steady), 1)) + 0.2 AS contact_and_pose_constraints
    FROM e JOIN t r USING (job_id) JOIN t p USING (job_id) WHERE r.role = 'r' AND p.role = 'p'),
  g AS (SELECT job_id, bad, {", ".join(f"CASE WHEN NOT bad THEN {k} END AS {k}" for k in scoring.INCLINE["weights"])} FROM c)
  SELECT job_id, {_rounded(*scoring.INCLINE["weights"])}, CASE WHEN bad THEN 'insufficient_incline_motion' END AS reason_code, round({_weighted(**scoring.INCLINE["weights"])}, 5) AS score, CASE WHEN bad THEN 'error' ELSE 'evaluated' END AS status FROM g""")
def incline_score(spark: SparkSession, d: str) -> DataFrame:
    return _round(scoring.score_incline(_points(spark, d)))


#: Angles about the fitted circle (an) and traces (t).
_ORBIT = f"""{_BOTH},
  ce AS (SELECT *, avg(px) OVER k AS mx, avg(py) OVER k AS my FROM both_ WINDOW k AS (PARTITION BY job_id, role)),
  uv AS (SELECT *, px - mx AS u, py - my AS v FROM ce),
  cq AS (SELECT job_id, role, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS xx, sum(u * v) AS xy, sum(v * v) AS yy, sum(u * (u * u + v * v)) AS xz, sum(v * (u * u + v * v)) AS yz, avg(u * u + v * v) AS mz FROM uv GROUP BY ALL),
  cd AS (SELECT *, CASE WHEN n >= 3 AND abs(2 * (xx * yy - xy * xy)) > 1e-12 * (xx + yy) ** 2 THEN 2 * (xx * yy - xy * xy) END AS det FROM cq),
  cp AS (SELECT job_id, role, mx, my, mz, (xz * yy - yz * xy) / det AS qx, (yz * xx - xz * xy) / det AS qy FROM cd),
  cc AS (SELECT job_id, role, qx + mx AS cx, qy + my AS cy, sqrt(qx * qx + qy * qy + mz) AS radius FROM cp),
  ro AS (SELECT both_.*, radius, atan2(py - cy, px - cx) AS raw, sqrt((px - cx) ** 2 + (py - cy) ** 2) AS far FROM both_ JOIN cc USING (job_id, role)),
  dl AS (SELECT *, raw - lag(raw) OVER (PARTITION BY job_id, role ORDER BY frame) AS dl FROM ro),
  tu AS (SELECT *, (dl + pi()) - 2 * pi() * floor((dl + pi()) / (2 * pi())) - pi() AS turned FROM dl),
  st AS (SELECT *, CASE WHEN abs(dl) < pi() THEN 0 ELSE coalesce(CASE WHEN turned = -pi() AND dl > 0 THEN pi() ELSE turned END - dl, 0) END AS jump FROM tu),
  un AS (SELECT *, raw + sum(jump) OVER (PARTITION BY job_id, role ORDER BY frame) AS unwrapped FROM st),
  an AS (SELECT *, unwrapped - first_value(unwrapped) OVER (PARTITION BY job_id, role ORDER BY frame) AS angle FROM un),
  t AS (SELECT job_id, role, any_value(radius) AS radius, stddev_pop(far) / nullif(avg(far), 0) AS cv, regr_slope(angle, time_s) AS omega,
    sqrt(greatest(0, regr_syy(angle, time_s) - regr_slope(angle, time_s) * regr_sxy(angle, time_s)) / count(*)) AS fit FROM an GROUP BY ALL),
  e AS (SELECT a.job_id, sqrt(avg((a.angle - b.angle) ** 2)) AS rmse FROM an a JOIN an b ON a.job_id = b.job_id AND a.frame = b.frame AND a.role = 'r' AND b.role = 'p' GROUP BY a.job_id)"""


@query(f"""WITH {_ORBIT}, c AS (SELECT job_id, exp(-rmse / 0.35) AS angular_trajectory, exp(-abs(p.omega - r.omega) / greatest(abs(r.omega), 1e-9) / 0.25) AS angular_velocity,
    0.5 * (exp(-abs(p.cv - r.cv) / 0.08) + exp(-abs(r.radius / greatest(r.radius, 1e-9) - p.radius / greatest(p.radius, 1e-9)) / 0.12)) AS orbit_geometry, exp(-abs(p.fit - r.fit) / 0.2) AS uniform_motion
    FROM e JOIN t r USING (job_id) JOIN t p USING (job_id) WHERE r.role = 'r' AND p.role = 'p')
  SELECT job_id, {_rounded(*scoring.ORBIT["weights"])}, NULL::VARCHAR AS reason_code, round({_weighted(**scoring.ORBIT["weights"])}, 5) AS score, 'evaluated' AS status FROM c""")
def orbit_score(spark: SparkSession, d: str) -> DataFrame:
    return _round(scoring.score_orbits(_points(spark, d)))


#: Three balls on one axis (al), what happens about their meeting (sp) and traces (t).
_COLLISION = f"""{_BOTH},
  pts AS (SELECT job_id, role, obj, frame, time_s, px + 40 * obj * (1 + frame % 5) AS x, py AS y FROM both_, (SELECT unnest(range(3)) AS obj)),
  ce AS (SELECT *, avg(x) OVER k AS mx, avg(y) OVER k AS my FROM pts WINDOW k AS (PARTITION BY job_id, role)),
  ax AS (SELECT job_id, role, 0.5 * atan2(2 * sum((x - mx) * (y - my)), sum((x - mx) * (x - mx)) - sum((y - my) * (y - my))) AS th, arg_max(x, frame) FILTER (obj = 0 AND frame <= 3) - arg_min(x, frame) FILTER (obj = 0) AS wx,
    arg_max(y, frame) FILTER (obj = 0 AND frame <= 3) - arg_min(y, frame) FILTER (obj = 0) AS wy, max(time_s) FILTER (obj = 0) AS duration, (max(frame) - min(frame) + 1)::INTEGER AS frames FROM ce GROUP BY ALL),
  ar AS (SELECT *, CASE WHEN cos(th) * wx + sin(th) * wy < 0 THEN -1 ELSE 1 END AS flip FROM ax),
  pr AS (SELECT ce.*, duration, frames, flip * ((x - mx) * cos(th) + (y - my) * sin(th)) AS along, flip * ((y - my) * cos(th) - (x - mx) * sin(th)) AS across FROM ce JOIN ar USING (job_id, role)),
  sp0 AS (SELECT *, max(along) OVER k - min(along) OVER k AS span, along - first_value(along) OVER (PARTITION BY job_id, role, obj ORDER BY frame) AS way FROM pr WINDOW k AS (PARTITION BY job_id, role)),
  al AS (SELECT *, way / nullif(span, 0) AS n FROM sp0),
  bf AS (SELECT job_id, role, frame, time_s, max(along) FILTER (obj = 0) AS a, max(along) FILTER (obj = 1) AS b FROM al GROUP BY ALL),
  ev AS (SELECT job_id, role, arg_min({{'f': frame, 't': time_s}}, {{'gap': round(abs(a - b), 9), 'f': frame}}) AS e FROM bf GROUP BY ALL),
  w0 AS (SELECT job_id, role, duration, frames, e.f::INTEGER AS event, e.t AS event_s, greatest(3, round_even(frames * 0.2, 0)::INTEGER) AS width FROM ar JOIN ev USING (job_id, role)),
  w1 AS (SELECT *, greatest(3, event - 1) AS a2, least(frames - 3, event + 2) AS b1 FROM w0),
  w2 AS (SELECT *, greatest(0, a2 - width) AS a1, least(frames, b1 + width) AS b2 FROM w1),
  win AS (SELECT *, CASE WHEN a2 - a1 < 3 THEN 0 ELSE a1 END AS pre_from, CASE WHEN a2 - a1 < 3 THEN 3 ELSE a2 END AS pre_to, CASE WHEN b2 - b1 < 3 THEN frames - 3 ELSE b1 END AS post_from, CASE WHEN b2 - b1 < 3 THEN frames ELSE b2 END AS post_to FROM w2),
  sp AS (SELECT al.job_id, al.role, obj, regr_slope(n, CASE WHEN frame >= pre_from AND frame < pre_to THEN time_s END) AS before, regr_slope(n, CASE WHEN frame >= post_from AND frame < post_to THEN time_s END) AS after,
    stddev_pop(across) AS across, any_value(span) AS span, 0.05::DOUBLE + 0.01::DOUBLE * obj AS mass FROM al JOIN win USING (job_id, role) GROUP BY ALL),
  ph AS (SELECT job_id, role, abs(sum(mass * after) - sum(mass * before)) / greatest(sum(abs(mass * before)), 1e-9) AS residual, max(after) FILTER (obj = 2) - max(after) FILTER (obj = 0) AS apart,
    max(before) FILTER (obj = 0) - max(before) FILTER (obj = 2) AS closing, avg(across) / nullif(any_value(span), 0) AS across, any_value(span) AS span FROM sp GROUP BY ALL),
  t AS (SELECT ph.*, CASE WHEN abs(closing) > 1e-9 THEN apart / closing END AS bounce, event_s, duration FROM ph JOIN win USING (job_id, role)),
  wo AS (SELECT a.job_id, obj, sqrt(avg((a.n - b.n) ** 2)) / greatest(max(a.n) - min(a.n), 1) AS nrmse FROM al a JOIN al b USING (job_id, obj, frame) WHERE a.role = 'r' AND b.role = 'p' GROUP BY ALL),
  vo AS (SELECT job_id, sqrt(avg((r - p) ** 2)) / greatest(max(abs(r)), 1e-9) AS speed FROM (SELECT a.job_id, unnest([a.before, a.after]) AS r, unnest([b.before, b.after]) AS p FROM sp a JOIN sp b USING (job_id, obj) WHERE a.role = 'r' AND b.role = 'p') GROUP BY job_id)"""


@query(f"""WITH {_COLLISION}, c AS (SELECT job_id, coalesce(least(r.span, p.span) < 20, true) AS bad, exp(-way / 0.12) AS instance_trajectories, exp(-abs(p.event_s - r.event_s) / greatest(r.duration, 1e-9) / 0.1) AS contact_event_time,
    exp(-speed / 0.25) AS pre_post_velocities, exp(-abs(p.residual - r.residual) / 0.2) AS momentum, CASE WHEN p.bounce IS NULL THEN 0 ELSE exp(-abs(p.bounce - r.bounce) / greatest(abs(r.bounce), 0.1) / 0.25) END AS back, r.bounce AS r_bounce,
    exp(-abs(p.across - r.across) / 0.03) AS one_dimensional_constraint FROM (SELECT job_id, avg(nrmse) AS way FROM wo GROUP BY job_id) JOIN vo USING (job_id) JOIN t r USING (job_id) JOIN t p USING (job_id) WHERE r.role = 'r' AND p.role = 'p'),
  d AS (SELECT *, CASE WHEN r_bounce IS NULL THEN momentum ELSE 0.6 * momentum + 0.4 * back END AS collision_physics FROM c),
  g AS (SELECT job_id, bad, {", ".join(f"CASE WHEN NOT bad THEN {k} END AS {k}" for k in scoring.COLLISION["weights"])} FROM d)
  SELECT job_id, {_rounded(*scoring.COLLISION["weights"])}, CASE WHEN bad THEN 'insufficient_collision_motion' END AS reason_code, round({_weighted(**scoring.COLLISION["weights"])}, 5) AS score, CASE WHEN bad THEN 'error' ELSE 'evaluated' END AS status FROM g""")
def collision_score(spark: SparkSession, d: str) -> DataFrame:
    """Three objects a recording: the series itself and two that follow at fixed distances."""
    p = _points(spark, d)
    three = p.select("job_id", "role", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("obj"), "frame", "time_s", "x", "y").withColumn("x", F.col("x") + 40 * F.col("obj") * (1 + F.col("frame") % 5))
    masses = p.select("job_id").distinct().select("job_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("obj")).withColumn("mass", 0.05 + 0.01 * F.col("obj"))
    return _round(scoring.score_collision(three, masses))


#: Filled marks (fi), angles (an), autocorrelation (r) and traces (t).
_PENDULUM = f"""{_BOTH},
  mk AS (SELECT job_id, role, frame, time_s, px % 3 AS pv, py - 10 AS bx, 100 + px % 7 AS bh, frame % 12 <> 5 AS ok FROM both_),
  ga AS (SELECT *, last_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER b AS f0, first_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER a AS f1,
    last_value(CASE WHEN ok THEN pv END IGNORE NULLS) OVER b AS pv0, first_value(CASE WHEN ok THEN pv END IGNORE NULLS) OVER a AS pv1,
    last_value(CASE WHEN ok THEN bx END IGNORE NULLS) OVER b AS bx0, first_value(CASE WHEN ok THEN bx END IGNORE NULLS) OVER a AS bx1,
    last_value(CASE WHEN ok THEN bh END IGNORE NULLS) OVER b AS bh0, first_value(CASE WHEN ok THEN bh END IGNORE NULLS) OVER a AS bh1 FROM mk
    WINDOW b AS (PARTITION BY job_id, role ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY job_id, role ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  fi AS (SELECT job_id, role, frame, time_s, ok, CASE WHEN ok THEN pv ELSE coalesce(pv0 + (pv1 - pv0) * (frame - f0) / nullif(f1 - f0, 0), pv0, pv1) END AS pv,
    CASE WHEN ok THEN bx ELSE coalesce(bx0 + (bx1 - bx0) * (frame - f0) / nullif(f1 - f0, 0), bx0, bx1) END AS bx,
    CASE WHEN ok THEN bh ELSE coalesce(bh0 + (bh1 - bh0) * (frame - f0) / nullif(f1 - f0, 0), bh0, bh1) END AS bh FROM ga),
  mi AS (SELECT job_id, role, median(pv) FILTER (ok) AS mx FROM mk GROUP BY ALL),
  an AS (SELECT fi.*, sqrt((bx - mx) ** 2 + bh ** 2) AS len, atan2(bx - mx, bh) AS angle, abs(pv - mx) AS drift, time_s - lag(time_s) OVER (PARTITION BY job_id, role ORDER BY frame) AS gap, row_number() OVER (PARTITION BY job_id, role ORDER BY frame) AS k
    FROM fi JOIN mi USING (job_id, role)),
  md AS (SELECT job_id, role, median(angle) AS mid, median(len) FILTER (ok) AS ml, median(gap) AS step, count(*) AS n, avg(angle) AS mean FROM an GROUP BY ALL),
  t0 AS (SELECT job_id, role, avg(ok::INTEGER) AS valid_ratio, count(*) FILTER (ok) AS n_valid, any_value(ml) AS ml, stddev_pop(drift) FILTER (ok) / nullif(any_value(ml), 0) AS drift,
    stddev_pop(len) FILTER (ok) / greatest(avg(len) FILTER (ok), 1e-12) AS len, quantile_cont(abs(angle - mid), 0.95) AS amplitude FROM an JOIN md USING (job_id, role) GROUP BY ALL),
  c AS (SELECT job_id, role, k, angle - mean AS c, step, greatest(2, ceil(0.3 / step)) AS lo, least(n - 2, floor(2.5 / step)) AS hi, sum((angle - mean) * (angle - mean)) OVER (PARTITION BY job_id, role) AS e, n FROM an JOIN md USING (job_id, role)),
  r AS (SELECT a.job_id, a.role, b.k - a.k AS lag, sum(a.c * b.c) / any_value(a.e) AS r, any_value(a.step) AS step FROM c a JOIN c b ON a.job_id = b.job_id AND a.role = b.role AND b.k - a.k BETWEEN a.lo AND a.hi WHERE a.n >= 5 AND a.e > 1e-12 GROUP BY ALL),
  pk AS (SELECT *, r >= lag(r) OVER w AND r > lead(r) OVER w AND r >= 0.1 AS peak FROM r WINDOW w AS (PARTITION BY job_id, role ORDER BY lag)),
  pe AS (SELECT job_id, role, coalesce(min(lag) FILTER (peak), CASE WHEN max(r) >= 0.1 THEN arg_max(lag, {{'r': r, 'l': -lag}}) END) * any_value(step) AS period FROM pk GROUP BY ALL),
  t AS (SELECT * FROM t0 LEFT JOIN pe USING (job_id, role)),
  e AS (SELECT a.job_id, sqrt(avg((a.angle - b.angle) ** 2)) AS rmse FROM an a JOIN an b ON a.job_id = b.job_id AND a.frame = b.frame AND a.role = 'r' AND b.role = 'p' GROUP BY a.job_id)"""


@query(f"""WITH {_PENDULUM}, c1 AS (SELECT job_id, least(r.valid_ratio, p.valid_ratio) < 0.9 OR least(r.n_valid, p.n_valid) < 3 AS bad, least(r.ml, p.ml) <= 1 AS short, exp(-rmse / greatest(r.amplitude, radians(5))) AS angle_trajectory,
    CASE WHEN r.period IS NULL THEN NULL WHEN p.period IS NULL THEN 0 ELSE exp(-abs(p.period - r.period) / r.period) END AS period, exp(-abs(p.amplitude - r.amplitude) / greatest(r.amplitude, radians(1))) AS amplitude,
    0.5 * (exp(-abs(p.drift - r.drift) / 0.03) + exp(-abs(p.len - r.len) / 0.05)) AS structural_consistency FROM e JOIN t r USING (job_id) JOIN t p USING (job_id) WHERE r.role = 'r' AND p.role = 'p'),
  g AS (SELECT job_id, bad, short, coalesce(bad OR short, true) AS wrong, {", ".join(f"CASE WHEN NOT coalesce(bad OR short, true) THEN {k} END AS {k}" for k in scoring.PENDULUM["weights"])} FROM c1)
  SELECT job_id, {_rounded(*scoring.PENDULUM["weights"])}, CASE WHEN coalesce(NOT bad, false) AND short THEN 'invalid_pendulum_length' WHEN wrong THEN 'insufficient_valid_masks' END AS reason_code,
    round({_weighted(**scoring.PENDULUM["weights"])}, 5) AS score, CASE WHEN wrong THEN 'error' ELSE 'evaluated' END AS status FROM g""")
def pendulum_score(spark: SparkSession, d: str) -> DataFrame:
    m = _points(spark, d).select("job_id", "role", "frame", "time_s", (F.col("x") % 3).alias("pivot_x"), F.lit(0.0).alias("pivot_y"), (F.col("y") - 10).alias("bob_x"), (100 + F.col("x") % 7).alias("bob_y"), (F.col("frame") % 12 != 5).alias("valid"))
    return _round(scoring.score_pendulum(m))
