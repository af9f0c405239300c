from penduline.operators import audits
from pyspark.sql import functions as F


def test_codes(spark):
    rows = [("ok", 3, True, 10, 7, "h", "h"), ("un", 3, None, 10, 7, "h", "h"), ("out", 10, True, 10, 0, "h", "h"), ("len", 3, True, 10, 8, "h", "h"), ("pic", 3, True, 10, 7, "h", None)]
    df = spark.createDataFrame(rows, "case_id string, start_frame int, reviewed boolean, source_frames int, aligned_frames int, first_hash string, source_hash string")
    assert {r.case_id: r.code for r in audits.alignment(df).collect()} == {"ok": None, "un": "unreviewed_alignment", "out": "invalid_alignment_frame", "len": "alignment_not_materialized", "pic": "first_frame_differs"}
    got = spark.range(1).select(*(audits.restored_speed(F.lit(8.0), F.lit(d), F.lit(81), F.lit(n), F.lit(f)).alias(a) for a, d, n, f in (("ok", 1.001, 81, 8), ("late", 1.1, 81, 8), ("cut", 1.0, 80, 8), ("zero", 1.0, 81, 0)))).first()
    assert tuple(got) == (None, "duration_mismatch", "frames_changed", "invalid_factor")


def test_composite_parent(spark):
    kids = spark.createDataFrame([("k1", 1.0, 2.0), ("k2", 1.0, 3.0), ("k3", 4.0, 4.0), ("k4", None, 2.0)], "case_id string, a double, b double")
    parents = spark.createDataFrame([("p1", 1.0, 2.0), ("p1", 1.0, 2.0), ("p2", 1.0, 3.0), ("p3", 1.0, 3.0), ("p4", None, 2.0)], kids.schema)
    assert {r.case_id: (r.parent_id, r.code) for r in audits.composite_parent(kids, parents, ["a", "b"]).collect()} == {
        "k1": ("p1", None), "k2": (None, "several_parents"), "k3": (None, "parent_not_found"), "k4": (None, "parent_not_found")}


def test_start_frame(spark):
    rows = [("s", k, 0.1 * (k % 2) + (5 if k >= 30 else 0), 0.1 * (k % 3) + (4 if k >= 30 else 0), 60.0) for k in range(80)] + [("still", k, 0.1, 0.1, 60.0) for k in range(20)]
    rows += [("s", k, 0.1, 0.1, 60.0) for k in range(80, 400)]
    got = {r.series_id: r for r in audits.start_frames(spark.createDataFrame(rows, "series_id string, frame int, a double, b double, fps double"), F.col("fps"), 1.0).collect()}
    assert (got["s"].onset, got["s"].start, got["s"].moving) == (28, 25, True) and (got["still"].onset, got["still"].start, got["still"].moving) == (None, None, False)


def test_entry_frames(spark):
    rows = [("s", k, 20.0 if k >= 6 else 3.0, float(5 * k)) for k in range(20)] + [("s", k, 2.0, 90.0) for k in range(20)] + [("none", k, 0.0, 0.0) for k in range(9)]
    df = spark.createDataFrame(rows, "series_id string, frame int, height double, x double")
    got = {r.series_id: (r.usual_height, r.entry) for r in audits.entry_frames(df, F.lit(None).cast("double")).collect()}
    assert got == {"s": (20.0, 6), "none": (None, None)}
    assert {r.series_id: r.entry for r in audits.entry_frames(df, F.lit(4.0)).collect()}["s"] == 0
