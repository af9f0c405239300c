"""Audits over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.functions.text import CASE_IDS
from penduline.operators import audits
from penduline.queries.registry import query
from penduline.queries.series import _S, frames
from penduline.session import table

_KEYS = "^pendulum_r(\\d+)_ltot(\\d+)mm_lrope(\\d+)mm_r(\\d+)mm_a(\\d+)deg"


@query(f"""WITH p AS (SELECT DISTINCT case_id, regexp_extract(case_id, '{_KEYS}', 2) AS total, regexp_extract(case_id, '{_KEYS}', 3) AS rope, regexp_extract(case_id, '{_KEYS}', 4) AS radius, regexp_extract(case_id, '{_KEYS}', 5) AS angle FROM cases WHERE case_id LIKE 'pendulum_%'),
  h AS (SELECT total, rope, radius, angle, count(*) AS n, min(case_id) AS parent_id FROM p WHERE case_id NOT LIKE '%_ood%' GROUP BY ALL)
  SELECT case_id, CASE WHEN n = 1 THEN parent_id END AS parent_id, CASE WHEN n IS NULL THEN 'parent_not_found' WHEN n > 1 THEN 'several_parents' END AS code FROM p LEFT JOIN h USING (total, rope, radius, angle) WHERE case_id LIKE '%_ood%'""")
def composite_parent_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "cases").where("case_id LIKE 'pendulum_%'").select("case_id").distinct()
    p = p.withColumns({n: F.regexp_extract("case_id", CASE_IDS["pendulum"], k) for k, n in ((2, "total"), (3, "rope"), (4, "radius"), (5, "angle"))})
    return audits.composite_parent(p.where("case_id LIKE '%_ood%'"), p.where("case_id NOT LIKE '%_ood%'"), ["total", "rope", "radius", "angle"])


@query("SELECT event_id, CASE WHEN f <= 0 THEN 'invalid_factor' WHEN event_id % 9 = 0 THEN 'frames_changed' WHEN abs(value / 8 + (event_id % 5) / 1000.0::DOUBLE - value / f) > 0.002 THEN 'duration_mismatch' END AS code FROM (SELECT event_id, value, CASE WHEN user_id % 7 = 0 THEN 0 ELSE 8 END AS f FROM events)")
def restore_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    factor, n = F.when(F.col("user_id") % 7 == 0, 0).otherwise(8), F.lit(81)
    return e.select("event_id", audits.restored_speed(F.col("value"), F.col("value") / 8 + (F.col("event_id") % 5) / 1000.0, n, n - F.when(F.col("event_id") % 9 == 0, 1).otherwise(0), factor).alias("code"))


@query(f"""WITH {_S},
  c AS (SELECT series_id, frame, x / 100 AS a, y / 100 AS b FROM s), mm AS (SELECT series_id, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM c GROUP BY series_id),
  bar AS (SELECT c.series_id, any_value(ma) + greatest(-0.5::DOUBLE, 7 * quantile_cont(abs(a - ma), 0.5)) AS ba, any_value(mb) + greatest(-0.5::DOUBLE, 7 * quantile_cont(abs(b - mb), 0.5)) AS bb FROM c JOIN mm USING (series_id) GROUP BY c.series_id),
  h AS (SELECT series_id, frame, count(*) FILTER (a > ba AND b > bb) OVER w AS hits, count(*) OVER w AS seen FROM c JOIN bar USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
  o AS (SELECT series_id, min(frame) FILTER (seen = 8 AND hits >= 6) AS onset FROM h GROUP BY series_id)
  SELECT series_id, onset, CASE WHEN onset IS NOT NULL THEN greatest(0, onset - 2) END AS start, onset IS NOT NULL AS moving FROM o""")
def start_frame(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).select("series_id", "frame", (F.col("x") / 100).alias("a"), (F.col("y") / 100).alias("b"), F.lit(16.0).alias("fps"))
    return audits.start_frames(s, F.col("fps"), -0.5).drop("trend")
