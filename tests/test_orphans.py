import random
from datetime import datetime, timedelta

import pytest
from penduline import session
from penduline.operators import orphans
from pyspark.sql import functions as F

REFS = "ref_table string, ref_field string, ref_key string, target_key string, target_table string, at timestamp_ntz"
EVENTS = "target_table string, target_key string, at timestamp_ntz, arrives boolean"


def _brute(refs, events):
    out = set()
    for table, field, key, target, parent, at in refs:
        ins = [t for p, k, t, a in events if (p, k) == (parent, target) and a]
        outs = [t for p, k, t, a in events if (p, k) == (parent, target) and not a]
        if not ins:
            reason = "missing"
        elif at is None:
            continue
        elif min(ins) > at:
            reason = "late"
        else:
            gone = [t for t in outs if t <= at]
            if not gone or any(max(gone) < t <= at for t in ins):
                continue
            reason = "deleted"
        out.add((table, field, key, target, at.strftime("%Y-%m") if at else None, reason))
    return out


def _tables(spark, rng):
    start = datetime(2024, 1, 1)
    when = lambda: start + timedelta(hours=rng.randrange(24 * 90), minutes=rng.randrange(60))
    keys = [f"a_k{k:08d}{s}" for k in [*range(20), *range(40, 60), 4095, 4096, 4097, 10**9] for s in ("", "_x")] + ["plain", "other", "long" * 3000, "a_k99999999999999999999", "b_k1", "b_k01", "x\n7\n"]
    events = {("cases", k, when(), rng.random() < 0.7) for k in keys if rng.random() < 0.7 for _ in range(rng.randint(1, 6))}
    events |= {("cases", "a_k00000001", when(), rng.random() < 0.5) for _ in range(200)}
    refs = {}
    for n in range(1500):
        target = rng.choice([*keys, "a_k00000030", "a_k00005000", "a_k00000001", "A_k00000001"])
        refs["t", "f", f"r{n % 700}", target, "cases"] = when() if n % 97 else None
    return [(*k, v) for k, v in refs.items()], list(events)


def test_against_brute_force(spark):
    rows, events = _tables(spark, random.Random(5))
    got = orphans.orphans(spark.createDataFrame(rows, REFS), spark.createDataFrame(events, EVENTS))
    assert {tuple(r) for r in got.collect()} == _brute(rows, events)


@pytest.mark.parametrize("promise", ["false", "true"])
def test_without_broadcasts(spark, monkeypatch, promise):
    """Sort-merge joins and partitions merged at run time: no reference may miss its events."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k"}
    prepare = session.ship

    def ship(s):
        prepare(s)
        s.conf.set("spark.sql.unionOutputPartitioning", promise)

    monkeypatch.setattr(session, "ship", ship)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows, events = _tables(spark, random.Random(6))
        got = orphans.orphans(spark.createDataFrame(rows, REFS), spark.createDataFrame(events, EVENTS))
        assert {tuple(r) for r in got.collect()} == _brute(rows, events)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_key_and_its_number_stand_for_each_other(spark):
    keys = ["a_k00000244_x", "a_k0244_x", "a_k244", "p/a_k00000001/reference.mp4", "plain", "", "v1.2", "a_k99999999999999999999", "9" * 40, "x_k7\n", "?", "a_k?"]
    family, n = orphans.numbered(F.col("key"))
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", family.alias("family"), n.alias("n")).collect()
    assert len({(r.family, r.n) for r in rows}) == len(keys)
    by_key = {r.key: r.n for r in rows}
    assert (by_key["a_k00000244_x"], by_key["p/a_k00000001/reference.mp4"], by_key["plain"], by_key["v1.2"]) == (244, 1, 0, 2)


def test_runs(spark):
    parents = spark.createDataFrame([("t", "f", n) for n in (1, 2, 3, 3, 7, 4095, 4096)] + [("t", "f", None), ("u", "f", 2), ("t", "g", 4)], "target_table string, family string, n bigint")
    runs = orphans.runs(parents)
    assert sorted((r.target_table, r.family, r.run_start, r.run_end) for r in runs.collect()) == [("t", "f", 1, 3), ("t", "f", 7, 7), ("t", "f", 4095, 4095), ("t", "f", 4096, 4096), ("t", "g", 4, 4), ("u", "f", 2, 2)]
    asked = spark.createDataFrame([("t", "f", n) for n in (0, 1, 3, 4, 7, 8, 4096, 4097, 9000)] + [("u", "f", 3), ("t", "h", 1)], "target_table string, family string, n bigint")
    beyond = orphans.as_of_runs(asked, runs).where("beyond")
    assert sorted((r.target_table, r.family, r.n) for r in beyond.collect()) == [("t", "f", 0), ("t", "f", 4), ("t", "f", 8), ("t", "f", 4097), ("t", "f", 9000), ("t", "h", 1), ("u", "f", 3)]


def test_empty(spark):
    assert orphans.orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], EVENTS)).count() == 0
