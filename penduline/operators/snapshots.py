"""What changed between full snapshots, by invertible Bloom lookup tables.

Each snapshot is a set of (key, place) elements, hashed and spread over buckets. Per bucket a lookup table
holds, for each cell, the number of its elements and the xor of their hashes; an element goes into three cells, one in
each third of the table. The
tables of two consecutive snapshots are subtracted: what both hold cancels out, and the rest is recovered by peeling
cells that hold a single element. A bucket that can't be peeled to nothing, or whose digest differs, is tried again with
twice the cells; the buckets that still fail after the last round are compared element by element.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penduline.session import broadcast_if_small, materialize

#: Elements of a dataset's largest snapshot per bucket, and cells in each third of a bucket's table by round.
BUCKET_ELEMENTS, THIRDS = 2048, (127, 257, 521, 1031, 2053)

_MASK = (1 << 64) - 1
_BUCKET = ["dataset_id", "release_no", "bucket"]
_SCHEMA = "dataset_id string, release_no int, bucket bigint, h bigint, sign int"


def view_elements(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(releases, elements) of View A rows.

    releases: dataset_id, release_no, prev_no, next_no. elements: dataset_id, release_no, case_id, place; the place is
    the sorted set of the (scene, group) pairs that list the case. Of several deliveries of a release the last counts
    (all of them if at the same instant). Null ids and rows without dataset_id or release_no are left out; a release
    whose lists are null or empty is a release without cases.
    """
    named = view.where("dataset_id IS NOT NULL AND release_no IS NOT NULL")
    last = named.groupBy("dataset_id", "release_no").agg(F.max("delivered_at").alias("last_at"))
    order = Window.partitionBy("dataset_id").orderBy("release_no")
    releases = last.select("dataset_id", "release_no", F.lag("release_no").over(order).alias("prev_no"), F.lead("release_no").over(order).alias("next_no"))
    rows = named.join(last, ["dataset_id", "release_no"]).where(F.col("delivered_at").eqNullSafe(F.col("last_at")))
    elements = (
        rows.select("dataset_id", "release_no", F.explode("scenes").alias("scene", "groups"))
        .select("dataset_id", "release_no", "scene", F.explode("groups").alias("grp", "ids"))
        .select("dataset_id", "release_no", F.to_json(F.array("scene", "grp")).alias("spot"), F.explode("ids").alias("case_id"))
        .where("case_id IS NOT NULL")
        .groupBy("dataset_id", "release_no", "case_id").agg(F.array_join(F.array_sort(F.collect_set("spot")), ",").alias("place"))
    )
    return releases, elements


def _cells_of(h: Column, third: int) -> Column:
    """One cell in each third of the table, from three parts of the hash."""
    return F.array(*(F.lit(k * third) + (F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(0x1FFFFF)) % F.lit(third)).cast("int") for k in range(3)))


def subtract(hashed: DataFrame, third: int) -> DataFrame:
    """(dataset_id, release_no, bucket, cell, n, xh, xc, xg): the table of each release minus that of the one before.
    Cell -1 is the digest of the whole bucket. Cells that cancel out don't appear."""
    xors = tuple(F.bit_xor(c).alias(c) for c in ("xh", "xc", "xg"))
    own = (
        hashed.select("dataset_id", "release_no", "prev_no", "next_no", "bucket", F.explode(F.concat(F.array(F.lit(-1)), _cells_of(F.col("h"), third))).alias("cell"),
                      F.col("h").alias("xh"), F.xxhash64("h").alias("xc"), F.col("g").alias("xg"))
        .groupBy("dataset_id", "release_no", "prev_no", "next_no", "bucket", "cell").agg(F.count("*").alias("n"), *xors)
    )
    sides = own.select("dataset_id", "bucket", "cell", "xh", "xc", "xg", F.explode(F.array(
        F.struct(F.when(F.col("prev_no").isNotNull(), F.col("release_no")).alias("release_no"), F.col("n").alias("n")),
        F.struct(F.col("next_no").alias("release_no"), (-F.col("n")).alias("n")),
    )).alias("side")).select("dataset_id", "side.release_no", "bucket", "cell", "side.n", "xh", "xc", "xg").where("release_no IS NOT NULL")
    return sides.groupBy(*_BUCKET, "cell").agg(F.sum("n").alias("n"), *xors).where("n <> 0 OR xh <> 0 OR xc <> 0 OR xg <> 0")


def check_of(h: int) -> int:
    """Spark's xxhash64 of a bigint, unsigned."""
    return xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)


def peel(pdf: pd.DataFrame, third: int) -> list[tuple[int, int]]:
    """Decode the difference of one bucket: (hash, sign) pairs, or [(0, 0)] if peeling doesn't end in an empty table
    whose digest is empty too."""
    size = 3 * third + 1
    n, xh, xc, xg = [0] * size, [0] * size, [0] * size, [0] * size
    for k, a, b, c, d in zip(pdf["cell"], pdf["n"], pdf["xh"], pdf["xc"], pdf["xg"], strict=True):
        n[k + 1], xh[k + 1], xc[k + 1], xg[k + 1] = int(a), int(b) & _MASK, int(c) & _MASK, int(d) & _MASK
    out, todo = [], [k for k in range(1, size) if n[k] in (1, -1)]
    while todo:
        k = todo.pop()
        h, sign = xh[k], n[k]
        if sign not in (1, -1) or check_of(h) != xc[k]:
            continue
        c, g = xc[k], xg[k]
        out.append((h, sign))
        if len(out) > size:
            return [(0, 0)]
        for j in (0, *(1 + i * third + (h >> 21 * i & 0x1FFFFF) % third for i in range(3))):
            n[j] -= sign
            xh[j] ^= h
            xc[j] ^= c
            xg[j] ^= g
            if j and n[j] in (1, -1):
                todo.append(j)
    return [(0, 0)] if any(n) or any(xh) or any(xc) or any(xg) else out


def _decoder(third: int):  # noqa: ANN202
    def decode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = peel(pdf, third)
        return pd.DataFrame({"dataset_id": key[0], "release_no": np.int32(key[1]), "bucket": np.int64(key[2]),
                             "h": np.array([h for h, _ in found], np.uint64).view(np.int64), "sign": np.array([s for _, s in found], np.int32)},
                            index=range(len(found)))

    return decode


def differences(releases: DataFrame, elements: DataFrame, thirds: tuple[int, ...] = THIRDS, bucket_elements: int = BUCKET_ELEMENTS) -> DataFrame:
    """(dataset_id, release_no, case_id, place, sign): elements only in a release (1) or only in the one before (-1)."""
    spark = elements.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    elements = materialize(elements)
    largest = elements.groupBy("dataset_id", "release_no").count().groupBy("dataset_id").agg(
        F.greatest(F.lit(1), F.ceil(F.max("count") / F.lit(bucket_elements))).cast("bigint").alias("buckets"))
    hashed = materialize(
        elements.join(broadcast_if_small(releases), ["dataset_id", "release_no"]).join(broadcast_if_small(largest), "dataset_id")
        .withColumn("h", F.xxhash64("case_id", "place")).withColumn("g", F.xxhash64("place", F.lit("second"), "case_id"))
        .withColumn("bucket", F.pmod("g", "buckets")).drop("buckets")
    )
    left, recovered = hashed, []
    for third in thirds:
        # tables are small, but peeling takes Python: the partitions are told, or adaptive execution would merge them
        decoded = materialize(subtract(left, third).repartition(tasks, *_BUCKET).groupBy(*_BUCKET).applyInPandas(_decoder(third), _SCHEMA))
        recovered.append(decoded.where("sign <> 0"))
        failed = decoded.where("sign = 0").select(*_BUCKET)
        if failed.isEmpty():
            failed = None
            break
        failed = materialize(failed)
        # only the two releases that face each other in a failed bucket are looked at again
        later = left.drop("next_no").join(failed, _BUCKET).withColumn("next_no", F.lit(None).cast("int"))
        earlier = left.drop("prev_no").join(failed.withColumnRenamed("release_no", "next_no"), ["dataset_id", "next_no", "bucket"]).withColumn("prev_no", F.lit(None).cast("int"))
        left = materialize(later.unionByName(earlier))
    hashes = recovered[0]
    for more in recovered[1:]:
        hashes = hashes.unionByName(more)
    changed = hashes.select("dataset_id", "release_no", "h", "sign")
    later = hashed.where("prev_no IS NOT NULL").select("dataset_id", "release_no", "h", "case_id", "place", F.lit(1).alias("sign"))
    earlier = hashed.where("next_no IS NOT NULL").select("dataset_id", F.col("next_no").alias("release_no"), "h", "case_id", "place", F.lit(-1).alias("sign"))
    out = later.unionByName(earlier).join(broadcast_if_small(changed), ["dataset_id", "release_no", "h", "sign"]).drop("h")
    if failed is not None:
        pairs = left.where("prev_no IS NOT NULL").select("dataset_id", "release_no", "case_id", "place", F.lit(1).alias("sign")).unionByName(
            left.where("next_no IS NOT NULL").select("dataset_id", F.col("next_no").alias("release_no"), "case_id", "place", F.lit(-1).alias("sign")))
        out = out.unionByName(pairs.groupBy("dataset_id", "release_no", "case_id", "place").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
    return out


def found(view: DataFrame) -> DataFrame:
    """(dataset_id, release_no, case_id, change) of every release but a dataset's first, against the next lower one."""
    releases, elements = view_elements(view)
    sides = differences(releases, elements)
    return sides.groupBy("dataset_id", "release_no", "case_id").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo")).select(
        "dataset_id", "release_no", "case_id",
        F.when(F.col("hi") == F.col("lo"), F.when(F.col("hi") == 1, "added").otherwise("removed")).otherwise("changed").alias("change"))


def digest_check(view: DataFrame) -> DataFrame:
    """(view_id, dataset_id, release_no, delivered_at, n_ids, own_sha256, stated_sha256, verdict): the SHA-256 of the
    JSON array of each delivery's sorted distinct ids against the stated one: match, mismatch or not_stated.

    The ids of one delivery come in one row and are hashed in one task, as SHA-256 needs them in order."""
    listed = F.filter(F.array_distinct(F.flatten(F.flatten(F.transform(F.map_values("scenes"), F.map_values)))), lambda x: x.isNotNull())
    ids = F.array_sort(F.coalesce(listed, F.array().cast("array<string>")))
    own = F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]")), 256)
    return view.select("view_id", "dataset_id", "release_no", "delivered_at", F.size(ids).alias("n_ids"), own.alias("own_sha256"), F.col("case_set_sha256").alias("stated_sha256")).withColumn(
        "verdict", F.when(F.col("stated_sha256").isNull(), "not_stated").when(F.col("stated_sha256") == F.col("own_sha256"), "match").otherwise("mismatch"))
