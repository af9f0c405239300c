import json
import math

import numpy as np
import pytest
from penduline.operators import scoring
from penduline.queries import scoring as queries
from pyspark.sql import functions as F

POINTS = "job_id string, role string, obj int, frame int, time_s double, x double, y double"
MARKS = "job_id string, role string, frame int, time_s double, pivot_x double, pivot_y double, bob_x double, bob_y double, valid boolean"


def _points(spark, job, role, xy, fps):
    """xy: objects x frames x 2"""
    return [(job, role, o, k, k / fps, float(x), float(y)) for o, track in enumerate(xy) for k, (x, y) in enumerate(track)]


def _score(rows, job):
    return next(r for r in rows if r.job_id == job)


def test_free_fall(spark):
    t = np.arange(33) / 32
    fall = lambda a, drift=0.0: [np.stack([50 + drift * t, 10 + a * t**2], 1)]
    rows = []
    for job, track in {"same": fall(200), "slower": fall(150, 3), "up": fall(-200), "still": fall(1)}.items():
        rows += _points(spark, job, "reference", fall(200), 32) + _points(spark, job, "prediction", track, 32)
    got = scoring.score_free_fall(spark.createDataFrame(rows, POINTS)).collect()
    assert _score(got, "same").score == 1.0
    assert 0.3 < _score(got, "slower").score < 1
    assert _score(got, "up").score < 0.35
    still = _score(got, "still")
    assert (still.score, still.status, still.reason_code) == (None, "error", "insufficient_vertical_motion")
    _, traces = scoring.free_fall_traces(spark.createDataFrame(rows, POINTS))
    r = next(x for x in traces.collect() if x.job_id == "same" and x.role == "prediction")
    assert r.span == pytest.approx(200) and r.acceleration == pytest.approx(2.0) and r.down == 1.0 and r.impact == pytest.approx(t[np.flatnonzero(200 * t**2 >= 190)[0]])


def test_incline(spark):
    t = np.arange(41) / 16
    slide = lambda a, bend=0.0: [np.stack([20 + a * t**2, 30 + 0.5 * a * t**2 + bend * np.sin(9 * t)], 1)]
    rows = []
    for job, track in {"same": slide(25, 1.0), "bent": slide(18, 6.0)}.items():
        rows += _points(spark, job, "reference", slide(25, 1.0), 16) + _points(spark, job, "prediction", track, 16)
    got = scoring.score_incline(spark.createDataFrame(rows, POINTS)).collect()
    assert _score(got, "same").score == 1.0 and 0.2 < _score(got, "bent").score < 1
    turning = spark.createDataFrame([(*r, 5.0 + r[3] % 2 if r[0] == "same" else 179.0 if r[3] % 2 else 1.0) for r in rows], POINTS + ", angle_deg double")
    spread = {(r.job_id, r.role): r.orientation for r in scoring.orientation_spread(turning).collect()}
    assert spread["same", "reference"] == pytest.approx(0.5, abs=0.01) and spread["bent", "reference"] == pytest.approx(1.0, abs=0.01)


def test_orbits(spark):
    t = np.arange(41) / 8
    orbit = lambda r, w, p=0.0: np.stack([100 + r * np.cos(w * t + p), 90 + r * np.sin(w * t + p)], 1)
    rows = []
    for job, tracks in {"same": [orbit(60, 0.95, 1), orbit(35, 0.95)], "other": [orbit(35, 0.6), orbit(60, 0.95, 1)], "fewer": [orbit(35, 0.95)]}.items():
        rows += _points(spark, job, "reference", [orbit(35, 0.95), orbit(60, 0.95, 1)], 8) + _points(spark, job, "prediction", tracks, 8)
    points = spark.createDataFrame(rows, POINTS)
    got = scoring.score_orbits(points).collect()
    assert _score(got, "same").score == pytest.approx(1.0, abs=1e-12)  # objects are matched by radius, whatever their number
    assert 0.2 < _score(got, "other").score < 1
    assert _score(got, "fewer").status == "error" and _score(got, "fewer").score is None
    frames, traces = scoring.orbit_traces(points)
    r = next(x for x in traces.collect() if x.job_id == "fewer" and x.role == "prediction")
    assert r.omega == pytest.approx(0.95, abs=1e-3) and r.radius == pytest.approx(35) and r.fit < 1e-9
    assert frames.where("frame = 0").select("angle").distinct().collect()[0][0] == 0.0


def test_collision(spark):
    n, hit = 41, 20
    t = np.arange(n) / 16
    striker = np.where(np.arange(n) <= hit, 10 + 4.0 * np.arange(n), 10 + 4.0 * hit)
    last = 150 + np.where(np.arange(n) <= hit, 0, 4.0 * (np.arange(n) - hit))
    tracks = lambda wobble=0.0, speed=1.0: [np.stack([striker, 50 + wobble * np.sin(t * 20)], 1), np.stack([np.full(n, 95.0), np.full(n, 50.0)], 1), np.stack([150 + speed * (last - 150), np.full(n, 50.0)], 1)]
    rows = []
    for job, track in {"same": tracks(), "slow": tracks(3.0, 0.5)}.items():
        rows += _points(spark, job, "reference", tracks(), 16) + _points(spark, job, "prediction", track, 16)
    masses = spark.createDataFrame([(j, o, 1.0) for j in ("same", "slow") for o in range(3)], "job_id string, obj int, mass double")
    points = spark.createDataFrame(rows, POINTS)
    got = scoring.score_collision(points, masses).collect()
    assert _score(got, "same").score == 1.0 and 0.2 < _score(got, "slow").score < 1
    _, traces, _ = scoring.collision_traces(points, masses)
    r = next(x for x in traces.collect() if x.job_id == "same" and x.role == "reference")
    assert r.restitution == pytest.approx(1.0, abs=1e-6) and r.residual == pytest.approx(0.0, abs=1e-6) and r.event == hit


def test_pendulum(spark):
    t = np.arange(81) / 16
    rows = []

    def swing(job, role, amplitude, period, bad=()):
        for k, s in enumerate(t):
            a = amplitude * math.cos(2 * math.pi * s / period)
            x, y = 100 + 80 * math.sin(a), 20 + 80 * math.cos(a)
            rows.append((job, role, k, float(s), 100.0, 20.0, x if k not in bad else None, y if k not in bad else None, k not in bad))

    for job, (a, p, bad) in {"same": (0.35, 1.0, (4, 5)), "slow": (0.3, 1.25, ()), "blind": (0.35, 1.0, tuple(range(0, 81, 4)))}.items():
        swing(job, "reference", 0.35, 1.0, (4, 5))
        swing(job, "prediction", a, p, bad)
    marks = spark.createDataFrame(rows, MARKS)
    got = scoring.score_pendulum(marks).collect()
    assert _score(got, "same").score == 1.0
    assert 0.1 < _score(got, "slow").score < 0.9
    assert (_score(got, "blind").score, _score(got, "blind").reason_code) == (None, "insufficient_valid_masks")
    _, traces = scoring.pendulum_traces(marks)
    r = next(x for x in traces.collect() if x.job_id == "slow" and x.role == "prediction")
    assert r.period == pytest.approx(1.25) and r.amplitude == pytest.approx(0.3, abs=0.01) and r.length == pytest.approx(0, abs=1e-9)


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of 234 users, of whom user 160 is missing: some are a reference, some a prediction, most both."""
    users, d = [u for u in range(234) if u != 160], str(tmp_path_factory.mktemp("tables"))
    rows = [(u * 100 + k, u, f"2024-01-01T00:00:{k:02d}", "error" if (u + k) % 9 == 0 else "view", float((u * 7 + k * k * 3) % 40), f'{{"k": {(u * 5 + k * 11) % 30}}}') for u in users for k in range(9 + u % 2)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d, users, rows


def test_every_user_is_paired_with_the_one_75_on(spark, many_users):
    d, users, rows = many_users
    want = set()
    for u in users:
        if u + 75 in users:
            for role, of in (("reference", u), ("prediction", u + 75)):
                want |= {(u, role, k, json.loads(p)["k"], x, kind != "error") for e, v, _, kind, x, p in rows for k in [e % 100] if v == of and k < 9 + min(u % 2, (u + 75) % 2)}
    got = [(r.job_id, r.role, r.frame, r.x, r.y, r.valid) for r in queries._points(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["free_fall_score", "incline_score", "orbit_score", "collision_score", "pendulum_score"])
def test_scores_of_more_than_150_users(spark, many_users, name):
    d, users, _ = many_users
    assert sorted(r.job_id for r in getattr(queries, name)(spark, d).collect()) == [u for u in users if u + 75 in users]
