import numpy as np
import pytest
from penduline.operators import fitting, masks, series, tracking
from pyspark.sql import functions as F


def _frames(spark, values, valid=None):
    return spark.createDataFrame([(1, k, k / 10, float(v), True if valid is None else bool(valid[k])) for k, v in enumerate(values)], "series_id int, frame int, time_s double, x double, valid boolean")


def test_gaps_and_phases(spark):
    v, ok = np.arange(12.0) ** 2, np.array([0, 0, 1, 0, 1, 1, 0, 0, 1, 1, 0, 0], bool)
    got = _frames(spark, v, ok).select("frame", series.interpolated("x", "valid", series.over()).alias("f")).orderBy("frame").collect()
    assert [r.f for r in got] == pytest.approx(list(np.interp(np.arange(12), np.arange(12)[ok], v[ok])))
    angles = np.array([0, 2, 3.1, -3.0, -1, 1, 3, np.pi, 0, -np.pi, 2.9, -2.9])
    got = series.unwrap(_frames(spark, angles), "x").orderBy("frame").collect()
    assert [r.unwrapped for r in got] == pytest.approx(list(np.unwrap(angles)))


def test_fits_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(5, 3, 50), rng.normal(-2, 1, 50)
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "series_id int, frame int, x double, y double")
    q = fitting.quadratic(df, "x", "y", "series_id").first()
    assert [q.a, q.b, q.c] == pytest.approx(list(np.polyfit(x, y, 2)), abs=1e-9)
    one = fitting.linear(df, "x", "y", "series_id").first()
    p = np.polyfit(x, y, 1)
    assert [one.slope, one.intercept, one.rmse] == pytest.approx([*p, np.sqrt(np.mean((y - np.polyval(p, x)) ** 2))], abs=1e-9)
    a = fitting.axis(df, "x", "y", "frame", "series_id").first()
    c = np.stack([x - x.mean(), y - y.mean()], 1)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert abs(abs(a.dx * vt[0, 0] + a.dy * vt[0, 1]) - 1) < 1e-9 and a.explained == pytest.approx(s[0] ** 2 / (s**2).sum())
    t = np.linspace(0, 4, 30)
    ring = spark.createDataFrame([(1, 4 + 3 * float(np.cos(k)), -2 + 3 * float(np.sin(k))) for k in t], "series_id int, x double, y double")
    r = fitting.circle(ring, "x", "y", "series_id").first()
    assert (r.cx, r.cy, r.radius) == pytest.approx((4, -2, 3))
    line = spark.createDataFrame([(1, float(k), float(k)) for k in range(5)], "series_id int, x double, y double")
    assert fitting.circle(line, "x", "y", "series_id").first().radius is None
    assert fitting.quadratic(line.limit(1), "x", "y", "series_id").first().a is None


def test_masks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((2, 10, 13)) < 0.3
    df = spark.createDataFrame([(1, a.ravel().tolist(), b.ravel().tolist()), (2, [False] * 130, [False] * 130)], "k int, a array<boolean>, b array<boolean>")
    df = df.select("k", masks.pack(F.col("a")).alias("a"), masks.pack(F.col("b")).alias("b"))
    one, none = df.select(masks.iou(F.col("a"), F.col("b")).alias("i"), masks.iou_or_zero(F.col("a"), F.col("b")).alias("z"), masks.area(masks.union(F.col("a"), F.col("b"))).alias("u"), "a").collect()
    assert one.i == pytest.approx((a & b).sum() / (a | b).sum()) and one.u == (a | b).sum() and (none.i, none.z, none.u) == (None, 0.0, 0)
    assert (masks.unpack(np.array(one.a), 10, 13) == a).all()
    seen = masks.iou_summary(df.withColumn("iou", masks.iou(F.col("a"), F.col("b"))), "iou").first()
    assert seen.observed_frame_ratio == 0.5 and seen.mean == pytest.approx(one.i)
    c = {r.k: r for r in masks.centroids(df, "a", 13, "k").collect()}
    ys, xs = np.nonzero(a)
    assert (c[1].area, c[1].x, c[1].y) == (len(xs), pytest.approx(xs.mean()), pytest.approx(ys.mean())) and (c[2].area, c[2].x) == (0, None)


def test_components_match_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(20):
        picture = rng.random((9, 11)) < 0.35
        labels, n = masks.label_components(picture)
        left, count = set(zip(*np.nonzero(picture), strict=True)), 0
        while left:
            todo, group = [left.pop()], []
            count += 1
            while todo:
                y, x = todo.pop()
                group.append((y, x))
                for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            assert len({labels[p] for p in group}) == 1
        assert count == n == labels.max()


def test_motion():
    stack = np.full((9, 60, 80), 30, np.uint8)
    for k in range(9):
        stack[k, 20:32, 5 + 7 * k : 17 + 7 * k] = 200
    moved = masks.motion_masks(stack, 15.0)
    assert moved.any(axis=(1, 2)).all() and masks.best_proposal(moved) is not None and masks.best_proposal(np.zeros((2, 5, 5), bool)) is None
    with pytest.raises(ValueError, match="empty_timeline"):
        masks.median_background(stack[:0])


def test_tracking(spark):
    rows = []
    for k in range(12):
        spots = [(10 + k, 5.0), (40 - 2 * k, 25.0)]
        rows += [(1, k, float(x), float(y), 9.0) for x, y in (spots if k % 2 else spots[::-1])][: 1 if k == 6 else 2]
    got = tracking.track(spark.createDataFrame(rows, "series_id int, frame int, x double, y double, area double"), 2).orderBy("frame", "obj").collect()
    assert {r.frame for r in got} == set(range(12)) - {6}
    assert all(r.y == (5.0 if r.obj == 0 else 25.0) for r in got)
    assert tracking.assign_nearest(np.array([[0.0, 0], [5, 0]]), np.array([[5.0, 1], [9, 9], [0, 1]])) == (2, 0)
    with pytest.raises(ValueError, match="as many candidates"):
        tracking.assign_nearest(np.zeros((3, 2)), np.zeros((2, 2)))


def test_least_assignment_against_all():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(0, 5))
        cost = rng.integers(0, 12, (n, n + int(rng.integers(0, 4)))).astype(float)
        got = tracking.least_assignment(cost)
        assert len(set(got)) == n
        assert sum(cost[i, j] for i, j in enumerate(got)) == min((sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(cost.shape[1]), n)), default=0)
    known = np.column_stack([np.arange(12.0) * 10, np.zeros(12)])
    assert tracking.assign_nearest(known, np.concatenate([np.full((20, 2), 500.0), known[::-1] + 0.25])) == tuple(range(31, 19, -1))


def test_many_candidates_are_all_looked_at(spark):
    rows = [(1, 0, 10.0, 5.0, 50.0), (1, 0, 30.0, 5.0, 50.0)]
    rows += [(1, 1, 200.0 + k, 90.0, 99.0) for k in range(20)] + [(1, 1, 11.0, 5.0, 1.0), (1, 1, 31.0, 5.0, 1.0)]
    got = tracking.track(spark.createDataFrame(rows, "series_id int, frame int, x double, y double, area double"), 2).where("frame = 1").orderBy("obj").collect()
    assert [r.x for r in got] == [11.0, 31.0]


def test_autocorrelation_of_odd_series(spark):
    rows = [(1, k, float(k % 4)) for k in range(30)] + [(2, k, 3.0) for k in range(9)] + [(3, k, None if k == 4 else float(k)) for k in range(9)] + [(4, 0, 1.0)]
    got = {}
    for r in series.autocorrelation(spark.createDataFrame(rows, "series_id int, frame int, v double"), "v", (4, 40)).collect():
        got.setdefault(r.series_id, {})[r.lag] = r.r
    x = np.arange(30) % 4 - np.mean(np.arange(30) % 4)
    assert set(got) == {1} and set(got[1]) == set(range(4, 30)) and got[1][5] == pytest.approx(x[:-5] @ x[5:] / (x @ x))
