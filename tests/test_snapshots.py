import random
from datetime import datetime

from penduline.operators import snapshots
from pyspark.sql import functions as F

VIEW = "dataset_id string, release_no int, delivered_at timestamp_ntz, scenes map<string, map<string, array<string>>>, view_id string, case_set_sha256 string"


def _view(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], VIEW)


def _brute(rows):
    last = {}
    for d, n, at, scenes in rows:
        if d is not None and n is not None and (last.get((d, n)) is None or at >= last[d, n][0]):
            last[d, n] = (at, scenes)
    place = {}
    for (d, n), (_, scenes) in last.items():
        held = place.setdefault((d, n), {})
        for s, groups in (scenes or {}).items():
            for g, ids in (groups or {}).items():
                for i in ids or []:
                    if i is not None:
                        held.setdefault(i, set()).add((s, g))
    out = set()
    for d, n in place:
        before = [m for e, m in place if e == d and m < n]
        if before:
            a, b = place[d, max(before)], place[d, n]
            out |= {(d, n, i, "added") for i in b if i not in a} | {(d, n, i, "removed") for i in a if i not in b} | {(d, n, i, "changed") for i in a if i in b and a[i] != b[i]}
    return out


def _random_rows(rng, size, share):
    ids = [f"k{k}" for k in range(size)]
    rows = []
    for d in ("p", "q"):
        place = {i: rng.choice(["train", "test_id"]) for i in ids if rng.random() < 0.8}
        for n in (1, 2, 4, 7):
            for i in ids:
                if rng.random() < share:
                    place.pop(i, None) if rng.random() < 0.5 else place.update({i: rng.choice(["train", "test_id", "test_ood1"])})
            scenes = {}
            for i, g in place.items():
                scenes.setdefault("s" if i < "k5" else "t", {}).setdefault(g, []).append(i)
            rows.append((d, n, datetime(2024, 1, n), scenes))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = _random_rows(rng, 300, 0.05)
    rows += [("p", 4, datetime(2023, 1, 1), {"s": {"train": ["old"]}}), ("q", 9, datetime(2024, 2, 1), None), ("q", 10, datetime(2024, 2, 2), {"s": {"train": ["k1", "k1", None], "x": ["k1"]}, "e": None}), (None, 1, None, {"s": {"train": ["z"]}})]
    assert {tuple(r) for r in snapshots.found(_view(spark, rows)).collect()} == _brute(rows)


def test_failed_buckets_are_enlarged_and_at_last_compared(spark):
    rows = _random_rows(random.Random(2), 120, 0.5)
    releases, elements = snapshots.view_elements(_view(spark, rows))
    for thirds in ((5, 17, 127), (3, 5)):  # the first decode only later, the second ones never
        got = snapshots.differences(releases, elements, thirds, bucket_elements=64)
        sides = got.groupBy("dataset_id", "release_no", "case_id").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo")).collect()
        name = {(1, 1): "added", (-1, -1): "removed", (1, -1): "changed"}
        assert {(r.dataset_id, r.release_no, r.case_id, name[r.hi, r.lo]) for r in sides} == _brute(rows)


def test_check_hash_is_that_of_spark(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    got = spark.createDataFrame([(v,) for v in values], "h bigint").select("h", F.xxhash64("h").alias("c")).collect()
    assert all(snapshots.check_of(r.h & snapshots._MASK) == r.c & snapshots._MASK for r in got)


def test_empty(spark):
    assert snapshots.found(_view(spark, [])).count() == 0
