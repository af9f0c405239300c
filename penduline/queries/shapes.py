"""Masks made of the signs of embeddings (8 x 8 pixels), and tracks made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.operators import masks, tracking
from penduline.queries.registry import query
from penduline.queries.series import frames
from penduline.session import table

_M = "m AS (SELECT vec_id, label, list_transform(embedding, lambda e: e > 0.12::FLOAT) AS m FROM embeddings)"
_P = _M + ", p AS (SELECT a.vec_id // 2 AS pair, a.label, a.m AS a, b.m AS b FROM m a JOIN m b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
_COUNTS = "len(list_filter(range(1, len(a) + 1), lambda i: a[i] AND b[i])) AS inter, len(list_filter(range(1, len(a) + 1), lambda i: a[i] OR b[i])) AS uni"
_PIX = _M + ", i AS (SELECT vec_id, unnest(range(len(m))) AS i, unnest(m) AS on_ FROM m), pix AS (SELECT vec_id, i % 8 AS x, i // 8 AS y FROM i WHERE on_)"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    on = F.transform("embedding", lambda e: e > F.lit(0.12).cast("float"))
    return table(spark, d, "embeddings").select("vec_id", "label", masks.pack(on).alias("mask"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d)
    odd = m.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("mask").alias("b"))
    return m.where("vec_id % 2 = 0").withColumnRenamed("mask", "a").join(odd, "vec_id").select((F.col("vec_id") / 2).cast("bigint").alias("pair"), "label", "a", "b")


@query(f"WITH {_P}, c AS (SELECT pair, {_COUNTS} FROM p) SELECT pair, round(inter / nullif(uni, 0)::DOUBLE, 6) AS observed_iou, round(coalesce(inter / nullif(uni, 0)::DOUBLE, 0), 6) AS iou FROM c")
def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("pair", F.round(masks.iou(a, b), 6).alias("observed_iou"), F.round(masks.iou_or_zero(a, b), 6).alias("iou"))


@query(f"""WITH {_P}, c AS (SELECT label, {_COUNTS} FROM p), v AS (SELECT label, inter / nullif(uni, 0)::DOUBLE AS v FROM c)
  SELECT label, round(avg(v), 6) AS mean, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(count(v) / count(*)::DOUBLE, 6) AS observed_frame_ratio, CASE WHEN count(v) = 0 THEN 'no_observed_mask_iou' END AS reason_code FROM v GROUP BY label""")
def observed_iou_summary(spark: SparkSession, d: str) -> DataFrame:
    out = masks.iou_summary(_pairs(spark, d).withColumn("iou", masks.iou(F.col("a"), F.col("b"))), "iou", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "lowest", "highest", "observed_frame_ratio")})


@query(f"WITH {_P}, c AS (SELECT pair, {_COUNTS} FROM p) SELECT pair, uni::BIGINT AS union_area FROM c")
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("pair", masks.area(masks.union(F.col("a"), F.col("b"))).alias("union_area"))


@query(f"WITH {_PIX} SELECT vec_id, count(x) AS area, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM m LEFT JOIN pix USING (vec_id) GROUP BY vec_id")
def mask_centroid(spark: SparkSession, d: str) -> DataFrame:
    return masks.centroids(_masks(spark, d), "mask", 8, "vec_id").withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query(f"""WITH {_PIX}, cut AS (SELECT vec_id, quantile_cont(y::DOUBLE, 0.06) AS t, quantile_cont(y::DOUBLE, 0.76) AS l FROM pix GROUP BY vec_id)
  SELECT vec_id, median(x) FILTER (y <= t) AS pivot_x, min(y) FILTER (y <= t)::INTEGER AS pivot_y, round(avg(x) FILTER (y >= l), 6) AS bob_x, round(avg(y) FILTER (y >= l), 6) AS bob_y, count(*) FILTER (y <= t) >= 2 AND count(*) FILTER (y >= l) >= 3 AS valid FROM pix JOIN cut USING (vec_id) GROUP BY vec_id""")
def pivot_and_bob(spark: SparkSession, d: str) -> DataFrame:
    return masks.pivot_and_bob(masks.pixels(_masks(spark, d), "mask", 8, "vec_id"), "vec_id").withColumns({c: F.round(c, 6) for c in ("bob_x", "bob_y")})


@query(f"WITH {_PIX} SELECT vec_id, count(*) AS area FROM pix GROUP BY vec_id HAVING count(*) BETWEEN 3 AND 13")
def area_gate(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d).select("vec_id", masks.area(F.col("mask")).alias("area"))
    return m.where(masks.area_gate(F.col("area"), 3, 64, 0.2))


@query(f"""WITH RECURSIVE {_PIX}, spots AS (SELECT vec_id, y * 8 + x AS i, x, y FROM pix),
  reach AS (SELECT vec_id, i AS root, i, x, y FROM spots UNION SELECT r.vec_id, r.root, p.i, p.x, p.y FROM reach r JOIN spots p ON p.vec_id = r.vec_id AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
  part AS (SELECT vec_id, i, any_value(x) AS x, any_value(y) AS y, min(root) AS label FROM reach GROUP BY vec_id, i),
  sums AS (SELECT vec_id, label, count(*) AS area, avg(x) AS x, avg(y) AS y FROM part GROUP BY vec_id, label)
  SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, label) - 1)::INTEGER AS component, area, round(x, 6) AS x, round(y, 6) AS y FROM sums""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return masks.components(_masks(spark, d), "mask", 8, 8, "vec_id").withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("""WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS id, s_acctbal / 100 AS x, s_suppkey % 7 AS y, 10 + s_suppkey % 3 AS area FROM supplier),
  p AS (SELECT a.nation, a.id AS left_id, b.id AS right_id, b.x - a.x - 0.5::DOUBLE * (a.area + b.area) AS cost FROM s a JOIN s b ON a.nation = b.nation AND b.x - a.x BETWEEN 1 AND 60 AND abs(a.y - b.y) <= 4)
  SELECT nation, arg_min(left_id, {'c': cost, 'l': left_id, 'r': right_id}) AS left_id, arg_min(right_id, {'c': cost, 'l': left_id, 'r': right_id}) AS right_id, round(min(cost), 6) AS cost FROM p GROUP BY nation""")
def viable_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 7).alias("y"), (10 + F.col("s_suppkey") % 3).alias("area"))
    return tracking.best_pair(s, "nation", "id", 1.0, 60.0, 4.0, 0.5).withColumn("cost", F.round("cost", 6))


@query()
def instance_tracking(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d)
    three = [s.select("series_id", F.floor(F.col("frame") / 3).alias("frame"), "x", "y", F.lit(1.0).alias("area"))]
    return tracking.track(three[0], 3)


@query(f"""WITH {_PIX} SELECT vec_id, greatest(0, (min(x) + max(x)) / 2 - greatest(3, (max(x) - min(x) + 1) * 1.25::DOUBLE) / 2) AS x0, greatest(0, (min(y) + max(y)) / 2 - greatest(3, (max(y) - min(y) + 1) * 1.25::DOUBLE) / 2) AS y0,
  least(7, (min(x) + max(x)) / 2 + greatest(3, (max(x) - min(x) + 1) * 1.25::DOUBLE) / 2) AS x1, least(7, (min(y) + max(y)) / 2 + greatest(3, (max(y) - min(y) + 1) * 1.25::DOUBLE) / 2) AS y1 FROM pix GROUP BY vec_id""")
def prompt_boxes(spark: SparkSession, d: str) -> DataFrame:
    return masks.prompt_boxes(masks.pixels(_masks(spark, d), "mask", 8, "vec_id"), 8, 8, 1.25, 3, "vec_id")


@query(f"WITH {_PIX} SELECT vec_id, count(*) AS area, min(y) AS top FROM pix WHERE y >= 3 GROUP BY vec_id")
def top_clip(spark: SparkSession, d: str) -> DataFrame:
    clipped = masks.clipped(masks.pixels(_masks(spark, d), "mask", 8, "vec_id"), F.lit(3))
    return clipped.groupBy("vec_id").agg(F.count("*").alias("area"), F.min("y").cast("bigint").alias("top"))
