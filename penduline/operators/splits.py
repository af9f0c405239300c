"""Splits, plans and samples of cases: training/test views, evaluation groups, jobs, shards, oversampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penduline.session import materialize

# The groups of a training view and the number of digits of a seed in a job id.
VIEW_A_GROUPS = ("train", "test_id", "test_ood1")
SEED_DIGITS = 6


def view_a(cases: DataFrame) -> DataFrame:
    """(scene_id, split, case_id, n_splits): distinct members. n_splits > 1 is leakage: the case has several splits.
    Cases without a scene or with an unknown split are no members."""
    rows = cases.where(F.col("view_a_split").isin(*VIEW_A_GROUPS) & F.col("scene_id").isNotNull()).select("scene_id", F.col("view_a_split").alias("split"), "case_id").distinct()
    return rows.withColumn("n_splits", F.count("*").over(Window.partitionBy("case_id")))


def hash_rank(key: Column, seed: int) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def view_b_hashed(cases: DataFrame, groups: int, seed: int) -> DataFrame:
    """(scene_id, grp, case_id): per scene the cases, in the order of their seeded hash, dealt to groups in turn, so sizes
    differ by 1 at most."""
    if groups < 1:
        raise ValueError("groups must be at least 1")
    order = Window.partitionBy("scene_id").orderBy(hash_rank(F.col("case_id"), seed), "case_id")
    return cases.select("scene_id", "case_id").distinct().select(
        "scene_id", F.concat(F.lit("group_"), (F.row_number().over(order) - 1) % groups + 1).alias("grp"), "case_id")


def scene_seed(scene: Column, seed: int) -> Column:
    """The first 64 bits of SHA-256 of 'seed:scene', unsigned, as a decimal."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), scene), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def _scene_random(scene: str, seed: int) -> random.Random:
    import hashlib

    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{scene}".encode()).digest()[:8], "big"))


def view_b_shuffled(cases: DataFrame, groups: int, seed: int) -> DataFrame:
    """Like view_b_hashed, by a Mersenne Twister shuffle of the sorted ids of a scene, for views that were made so. The
    shuffle is sequential: a scene's ids are held by one task. For scenes too large for that take view_b_hashed."""
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["case_id"])
        scene = pdf["scene_id"].iloc[0]
        _scene_random(scene, seed).shuffle(ids)
        return pd.DataFrame({"scene_id": scene, "grp": [f"group_{k % groups + 1}" for k in range(len(ids))], "case_id": ids})

    if groups < 1:
        raise ValueError("groups must be at least 1")
    rows = cases.where("scene_id IS NOT NULL AND case_id IS NOT NULL").select("scene_id", "case_id").distinct()
    return rows.groupBy("scene_id").applyInPandas(deal, "scene_id string, grp string, case_id string")


def seeded_sample(cases: DataFrame, count: int, seed: int) -> DataFrame:
    """(scene_id, case_id): at most count cases a scene, by seeded hash; exactly count where a scene has as many."""
    order = Window.partitionBy("scene_id").orderBy(hash_rank(F.col("case_id"), seed), "case_id")
    return cases.select("scene_id", "case_id").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= count).drop("k")


def view_members(view: DataFrame) -> DataFrame:
    """(view_id, scene_id, grp, pos, case_id) of nested views; null lists have no members."""
    return (
        view.select("view_id", F.explode("scenes").alias("scene_id", "groups"))
        .select("view_id", "scene_id", F.explode("groups").alias("grp", "ids"))
        .select("view_id", "scene_id", "grp", F.posexplode("ids").alias("pos", "case_id"))
    )


def plan_jobs(members: DataFrame, task_id: str, conditioning: str, seeds: Sequence[int], partitions: Sequence[str] | None = None, scenes: Sequence[str] | None = None) -> DataFrame:
    """(job_id, case_id, scene_id, evaluation_partition, conditioning, seed): distinct members x seeds, narrowed first."""
    rows = members
    if scenes is not None:
        rows = rows.where(F.col("scene_id").isin(*scenes))
    if partitions is not None:
        rows = rows.where(F.col("grp").isin(*partitions))
    entries = rows.select("case_id", "scene_id", F.col("grp").alias("evaluation_partition")).distinct()
    jobs = entries.withColumn("conditioning", F.lit(conditioning)).withColumn("seed", F.explode(F.array(*(F.lit(int(s)).cast("bigint") for s in dict.fromkeys(seeds)))))
    job_id = F.concat_ws("__", F.lit(task_id), "case_id", "conditioning", F.concat(F.lit("seed"), F.lpad(F.col("seed").cast("string"), SEED_DIGITS, "0")))
    return jobs.select(job_id.alias("job_id"), "case_id", "scene_id", "evaluation_partition", "conditioning", "seed")


def strided(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows with shard: place in the order of key, modulo shards. Ranks come from a range-partitioned sort and the counts
    of the partitions before, so no task sees all rows."""
    spark = rows.sparkSession
    # written once: the bounds of the ranges are sampled, and must be the same for the counts and for the ranks
    ordered = materialize(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ordered.groupBy("_part").count().collect()}  # one row a partition
    before, start = 0, []
    for part in sorted(counts):
        start.append((part, before))
        before += counts[part]
    offsets = spark.createDataFrame(start or [(0, 0)], "_part int, _start bigint")
    within = Window.partitionBy("_part").orderBy(key)
    return ordered.join(F.broadcast(offsets), "_part").withColumn("shard", ((F.col("_start") + F.row_number().over(within) - 1) % shards).cast("int")).drop("_part", "_start")


def oversample(items: DataFrame, group: str, order: str) -> DataFrame:
    """items repeated in turn until each group is as large as the largest: adds slot, 0 .. largest - 1."""
    n = Window.partitionBy(group)
    ranked = items.withColumn("_rank", F.row_number().over(n.orderBy(order)) - 1).withColumn("_n", F.count("*").over(n))
    largest = items.groupBy(group).count().agg(F.max("count").alias("_largest"))
    return ranked.crossJoin(F.broadcast(largest)).withColumn("slot", F.explode(F.expr("filter(sequence(_rank, _largest - 1 + _n, _n), s -> s < _largest)"))).drop("_rank", "_n", "_largest")


def held_out(items: DataFrame, group: str, value: str) -> DataFrame:
    """(group, held_out): the distinct value at index n // 2 of each group's sorted values."""
    w = Window.partitionBy(group)
    ranked = items.where(F.col(value).isNotNull()).select(group, value).distinct().select(group, value, F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.where("k = n div 2 + 1").select(group, F.col(value).alias("held_out"))


def top_k(items: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in an order; ties fall as the order says."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def replace_partitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows whose key comes in new, plus new. Rows without a key are kept."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def uniform_picks(n: Column, k: int) -> Column:
    """k indices spread evenly over 0 .. n-1, halves to even, each once."""
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(max(k - 1, 1))).cast("int"))))
