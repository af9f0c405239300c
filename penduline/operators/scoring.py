"""State traces of recordings and their similarity to a reference, scene by scene.

points: job_id, role ('reference' or 'prediction'), obj, frame, time_s, x, y, without gaps (series.interpolated fills them).
Traces are window and group aggregates per (job_id, role[, obj]); a reference and its prediction are compared by the same
expressions, so equal traces score exactly 1. Each scorer gives one row a job: its components, score, status and
reason_code; a trace without enough motion makes an error with a reason and a null score.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penduline.functions.similarity import decay, delta_similarity, ratio_similarity, weighted
from penduline.operators import fitting, series
from penduline.session import materialize

# Scales, limits and weights of the protocol.
FREE_FALL: dict[str, Any] = {
    "least_span": 8.0, "trajectory": 0.15, "acceleration": 0.35, "impact": 0.15, "drift": 0.08,
    "weights": {"vertical_trajectory": 0.5, "normalized_acceleration": 0.25, "impact_time": 0.15, "motion_constraints": 0.1}}
INCLINE: dict[str, Any] = {
    "least_span": 16.0, "trajectory": 0.18, "acceleration": 0.4, "descent": 0.18, "cross": 0.05, "orientation": 12.0,
    "weights": {"along_plane_trajectory": 0.5, "normalized_acceleration": 0.25, "descent_time": 0.15, "contact_and_pose_constraints": 0.1}}
ORBIT: dict[str, Any] = {
    "angle": 0.35, "omega": 0.25, "radial_cv": 0.08, "radii": 0.12, "fit": 0.2,
    "weights": {"angular_trajectory": 0.5, "angular_velocity": 0.25, "orbit_geometry": 0.15, "uniform_motion": 0.1}}
COLLISION: dict[str, Any] = {
    "least_span": 20.0, "trajectory": 0.12, "event": 0.1, "velocity": 0.25, "momentum": 0.2, "restitution": 0.25, "cross": 0.03,
    "weights": {"instance_trajectories": 0.45, "contact_event_time": 0.15, "pre_post_velocities": 0.2, "collision_physics": 0.15, "one_dimensional_constraint": 0.05}}
PENDULUM: dict[str, Any] = {
    "least_angle_deg": 5.0, "drift": 0.03, "length": 0.05, "least_s": 0.3, "most_s": 2.5, "valid_ratio": 0.9,
    "weights": {"angle_trajectory": 0.6, "period": 0.2, "amplitude": 0.1, "structural_consistency": 0.1}}

KEYS = ["job_id", "role"]


def _windows(keys: list[str]) -> tuple:
    w = Window.partitionBy(*keys).orderBy("frame")
    return w, Window.partitionBy(*keys)


def paired(traces: DataFrame, *keys: str) -> DataFrame:
    """One row a key with r_<column> of the reference and p_<column> of the prediction."""
    names = [c for c in traces.columns if c not in ("role", *keys)]
    r = traces.where("role = 'reference'").select(*keys, *(F.col(c).alias(f"r_{c}") for c in names))
    p = traces.where("role = 'prediction'").select(*keys, *(F.col(c).alias(f"p_{c}") for c in names))
    return r.join(p, list(keys))


def _relative(name: str, least: float) -> Column:
    r, p = F.col(f"r_{name}"), F.col(f"p_{name}")
    return F.abs(p - r) / F.greatest(F.abs(r), F.lit(least))


def _finish(pairs: DataFrame, parts: dict[str, Column], config: dict[str, Any], bad: Column | None = None, code: str = "") -> DataFrame:
    wrong = F.coalesce(bad, F.lit(True)) if bad is not None else F.lit(False)
    cells = {k: F.when(~wrong, v) for k, v in parts.items()}
    out = pairs.select("job_id", *(v.alias(k) for k, v in cells.items()), F.when(wrong, code).alias("reason_code"))
    return out.withColumn("score", weighted({k: F.col(k) for k in parts}, config["weights"])).withColumn("status", F.when(F.col("reason_code").isNull(), "evaluated").otherwise("error"))


def _rmse(series_points: DataFrame, value: str, *keys: str, least: float = 1.0) -> DataFrame:
    """(keys, nrmse, rmse) of reference and prediction over the frames both have."""
    both = paired(series_points.select(*keys, "role", "frame", value), *keys, "frame")
    rmse = F.sqrt(F.avg(F.pow(F.col(f"r_{value}") - F.col(f"p_{value}"), 2)))
    return both.groupBy(*keys).agg(rmse.alias("rmse"), (rmse / F.greatest(F.max(f"r_{value}") - F.min(f"r_{value}"), F.lit(least))).alias("nrmse"))


def free_fall_traces(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with v and n, traces): drop v below the first frame, its span, acceleration over span, impact, drift, steadiness."""
    w, whole = _windows(KEYS)
    s = points.withColumn("v", F.col("y") - F.first("y").over(w)).withColumn("span", F.max(F.abs("v")).over(whole)).withColumn("top", F.max("v").over(whole)).withColumn(
        "step", F.col("v") - F.lag("v").over(w)).withColumn("n", F.try_divide("v", "span"))
    s = materialize(s)
    traces = s.groupBy(*KEYS).agg(
        F.first("span").alias("span"), F.max("time_s").alias("duration"), F.try_divide(F.max("x") - F.min("x"), F.first("span")).alias("drift"),
        F.avg((F.col("step") >= -0.02 * F.col("span")).cast("double")).alias("down"),
        F.coalesce(F.min(F.when(F.col("v") >= 0.95 * F.col("top"), F.col("time_s"))), F.max("time_s")).alias("impact"))
    fit = fitting.quadratic(s, "time_s", "v", *KEYS).select(*KEYS, "a")
    return s, traces.join(fit, KEYS).withColumn("acceleration", F.try_divide(2 * F.col("a"), "span")).drop("a")


def score_free_fall(points: DataFrame, config: dict[str, Any] = FREE_FALL) -> DataFrame:
    frames, traces = free_fall_traces(materialize(points))
    traces = materialize(traces)
    pairs = paired(traces, "job_id").join(_rmse(frames, "n", "job_id"), "job_id")
    duration = F.greatest(F.col("r_duration"), F.lit(1e-9))
    parts = {
        "vertical_trajectory": decay(F.col("nrmse"), config["trajectory"]),
        "normalized_acceleration": decay(_relative("acceleration", 1e-9), config["acceleration"]),
        "impact_time": decay(F.abs(F.col("p_impact") - F.col("r_impact")) / duration, config["impact"]),
        "motion_constraints": 0.5 * (delta_similarity(F.col("r_drift"), F.col("p_drift"), config["drift"]) + ratio_similarity(F.col("r_down"), F.col("p_down"))),
    }
    return _finish(pairs, parts, config, F.least("r_span", "p_span") < config["least_span"], "insufficient_vertical_motion")


def orientation_spread(points: DataFrame) -> DataFrame:
    """(job_id, role, orientation): spread in degrees of box angles (angle_deg, null where unseen), which repeat every 180
    degrees; 180 with fewer than two."""
    seen = points.where("angle_deg IS NOT NULL").withColumn("twice", F.radians(2 * F.col("angle_deg")))
    turned = series.unwrap(seen, "twice", KEYS).withColumn("u", F.degrees(F.col("unwrapped") / 2))
    spread = turned.groupBy(*KEYS).agg(F.when(F.count("u") >= 2, F.stddev_pop("u")).alias("s"))
    return points.select(*KEYS).distinct().join(spread, KEYS, "left").select(*KEYS, F.coalesce("s", F.lit(180.0)).alias("orientation"))


def incline_traces(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with s and n, traces): way s along the principal axis, its span, acceleration up to nine tenths of the way, ..."""
    w, whole = _windows(KEYS)
    lines = fitting.axis(points, "x", "y", "frame", *KEYS)
    s = fitting.project(points, lines, "x", "y", *KEYS).withColumn("s", F.col("along") - F.first("along").over(w))
    s = s.withColumn("top", F.max("s").over(whole)).withColumn("span", F.max("s").over(whole) - F.min("s").over(whole)).withColumn("step", F.col("s") - F.lag("s").over(w)).withColumn(
        "n", F.try_divide("s", "span")).withColumn("k", F.row_number().over(w)).withColumn("last", F.greatest(F.lit(5), F.min(F.when(F.col("s") >= 0.9 * F.col("top"), F.col("k"))).over(whole)))
    s = materialize(s)
    traces = s.groupBy(*KEYS).agg(
        F.first("span").alias("span"), F.max("time_s").alias("duration"), F.avg((F.col("step") >= -0.015 * F.col("span")).cast("double")).alias("steady"),
        F.coalesce(F.min(F.when(F.col("s") >= 0.95 * F.col("top"), F.col("time_s"))), F.max("time_s")).alias("descent"), F.try_divide(F.stddev_pop("cross"), F.first("span")).alias("cross"))
    fit = fitting.quadratic(s.where("k <= last"), "time_s", "s", *KEYS).select(*KEYS, "a")
    turned = orientation_spread(points) if "angle_deg" in points.columns else traces.select(*KEYS, F.lit(180.0).alias("orientation"))
    return s, traces.join(fit, KEYS).join(turned, KEYS).withColumn("acceleration", F.try_divide(2 * F.col("a"), "span")).drop("a")


def score_incline(points: DataFrame, config: dict[str, Any] = INCLINE) -> DataFrame:
    frames, traces = incline_traces(materialize(points))
    traces = materialize(traces)
    pairs = paired(traces, "job_id").join(_rmse(frames, "n", "job_id"), "job_id")
    contact = delta_similarity(F.col("r_cross"), F.col("p_cross"), config["cross"])
    pose = delta_similarity(F.col("r_orientation"), F.col("p_orientation"), config["orientation"])
    parts = {
        "along_plane_trajectory": decay(F.col("nrmse"), config["trajectory"]),
        "normalized_acceleration": decay(_relative("acceleration", 1e-9), config["acceleration"]),
        "descent_time": decay(F.abs(F.col("p_descent") - F.col("r_descent")) / F.greatest(F.col("r_duration"), F.lit(1e-9)), config["descent"]),
        "contact_and_pose_constraints": 0.45 * contact + 0.35 * ratio_similarity(F.col("r_steady"), F.col("p_steady")) + 0.2 * pose,
    }
    return _finish(pairs, parts, config, F.least("r_span", "p_span") < config["least_span"], "insufficient_incline_motion")


def orbit_traces(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with rank and angle, traces): circle, unwrapped angle from its first value, angular velocity; the objects of
    a recording are ranked by radius."""
    keys = [*KEYS, "obj"]
    w, _ = _windows(keys)
    circles = fitting.circle(points, "x", "y", *keys).select(*keys, "cx", "cy", "radius")
    around = points.join(circles, keys).withColumn("raw", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).withColumn("far", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    turned = materialize(series.unwrap(around, "raw", keys).withColumn("angle", F.col("unwrapped") - F.first("unwrapped").over(w)))
    fit = fitting.linear(turned, "time_s", "angle", *keys).select(*keys, F.col("slope").alias("omega"), F.col("rmse").alias("fit"))
    traces = turned.groupBy(*keys).agg(F.first("radius").alias("radius"), F.try_divide(F.stddev_pop("far"), F.avg("far")).alias("radial_cv")).join(fit, keys)
    ranked = traces.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy("radius", "obj"))).withColumn("largest", F.max("radius").over(Window.partitionBy(*KEYS)))
    ranked = materialize(ranked)
    return turned.join(ranked.select(*keys, "rank"), keys), ranked


def score_orbits(points: DataFrame, config: dict[str, Any] = ORBIT) -> DataFrame:
    """Jobs whose recordings show different numbers of objects end as errors."""
    frames, traces = orbit_traces(materialize(points))
    objects = paired(traces.drop("obj"), "job_id", "rank").join(_rmse(frames.drop("obj"), "angle", "job_id", "rank"), ["job_id", "rank"])
    share = F.try_divide("r_radius", F.greatest(F.col("r_largest"), F.lit(1e-9))) - F.try_divide("p_radius", F.greatest(F.col("p_largest"), F.lit(1e-9)))
    means = objects.groupBy("job_id").agg(
        F.count("*").alias("matched"), F.avg(decay(F.col("rmse"), config["angle"])).alias("a"), F.avg(decay(_relative("omega", 1e-9), config["omega"])).alias("o"),
        F.avg(delta_similarity(F.col("r_radial_cv"), F.col("p_radial_cv"), config["radial_cv"])).alias("c"), decay(F.sqrt(F.avg(share * share)), config["radii"]).alias("g"),
        F.avg(delta_similarity(F.col("r_fit"), F.col("p_fit"), config["fit"])).alias("u"))
    sizes = traces.groupBy("job_id").agg(F.count_if(F.col("role") == "reference").alias("nr"), F.count_if(F.col("role") == "prediction").alias("np"))
    parts = {"angular_trajectory": F.col("a"), "angular_velocity": F.col("o"), "orbit_geometry": 0.5 * (F.col("c") + F.col("g")), "uniform_motion": F.col("u")}
    return _finish(sizes.join(means, "job_id", "left"), parts, config, F.col("nr") != F.col("np"), "unhandled_case_evaluator_error")


def collision_traces(points: DataFrame, masses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames with n, traces, velocities by object). Objects are 0 (striker), 1 (target), 2; masses: job_id, obj, mass.
    All objects of a recording share one axis, along which the striker starts forwards. Balls meet in the frame in which the
    first two are nearest; of gaps that are equal to nine decimals the first counts."""
    early = points.where("obj = 0").groupBy(*KEYS).agg(
        (F.max_by("x", F.when(F.col("frame") <= 3, F.col("frame"))) - F.min_by("x", "frame")).alias("wx"), (F.max_by("y", F.when(F.col("frame") <= 3, F.col("frame"))) - F.min_by("y", "frame")).alias("wy"),
        F.max("time_s").alias("duration"), (F.max("frame") - F.min("frame") + 1).cast("int").alias("frames"))
    lines = fitting.axis(points, "x", "y", "frame", *KEYS).join(early, KEYS)
    flip = F.when(F.col("dx") * F.col("wx") + F.col("dy") * F.col("wy") < 0, -1.0).otherwise(1.0)
    lines = lines.withColumn("flip", flip).withColumn("dx", F.col("dx") * F.col("flip")).withColumn("dy", F.col("dy") * F.col("flip"))
    s = fitting.project(points, lines, "x", "y", *KEYS)
    w, _ = _windows([*KEYS, "obj"])
    s = s.withColumn("span", F.max("along").over(Window.partitionBy(*KEYS)) - F.min("along").over(Window.partitionBy(*KEYS))).withColumn("n", F.try_divide(F.col("along") - F.first("along").over(w), "span"))
    s = materialize(s)
    by_frame = s.groupBy(*KEYS, "frame", "time_s").agg(F.max(F.when(F.col("obj") == 0, F.col("along"))).alias("a"), F.max(F.when(F.col("obj") == 1, F.col("along"))).alias("b"))
    event = by_frame.groupBy(*KEYS).agg(F.min(F.struct(F.round(F.abs(F.col("a") - F.col("b")), 9).alias("gap"), F.col("frame").cast("int").alias("frame"), "time_s")).alias("e"))
    scalars = lines.select(*KEYS, "duration", "frames").join(event.select(*KEYS, F.col("e.frame").alias("event"), F.col("e.time_s").alias("event_s")), KEYS)
    a, b, c, d = series.windows_about(F.col("event"), F.col("frames"))
    cut = scalars.withColumns({"pre_from": a, "pre_to": b, "post_from": c, "post_to": d})
    inside = lambda lo, hi: F.when((F.col("frame") >= F.col(lo)) & (F.col("frame") < F.col(hi)), F.col("time_s"))
    speeds = s.join(cut.select(*KEYS, "pre_from", "pre_to", "post_from", "post_to"), KEYS).groupBy(*KEYS, "obj").agg(
        F.regr_slope(F.col("n"), inside("pre_from", "pre_to")).alias("before"), F.regr_slope(F.col("n"), inside("post_from", "post_to")).alias("after"), F.stddev_pop("cross").alias("cross"), F.first("span").alias("span")).join(masses, ["job_id", "obj"])
    m = F.col("mass")
    physics = speeds.groupBy(*KEYS).agg(
        (F.abs(F.sum(m * F.col("after")) - F.sum(m * F.col("before"))) / F.greatest(F.sum(F.abs(m * F.col("before"))), F.lit(1e-9))).alias("residual"),
        (F.max_by("after", "obj") - F.min_by("after", "obj")).alias("apart"), (F.min_by("before", "obj") - F.max_by("before", "obj")).alias("closing"),
        F.try_divide(F.avg("cross"), F.first("span")).alias("cross"), F.first("span").alias("span"))
    physics = physics.withColumn("restitution", F.when(F.abs("closing") > 1e-9, F.col("apart") / F.col("closing"))).drop("apart", "closing")
    return s, scalars.join(physics, KEYS), speeds.select(*KEYS, "obj", "before", "after")


def score_collision(points: DataFrame, masses: DataFrame, config: dict[str, Any] = COLLISION) -> DataFrame:
    frames, traces, speeds = collision_traces(materialize(points), masses)
    traces, speeds = materialize(traces), materialize(speeds)
    way = _rmse(frames, "n", "job_id", "obj").groupBy("job_id").agg(F.avg("nrmse").alias("way"))
    v = paired(speeds, "job_id", "obj").select("job_id", F.explode(F.array(F.struct(F.col("r_before").alias("r"), F.col("p_before").alias("p")), F.struct(F.col("r_after").alias("r"), F.col("p_after").alias("p")))).alias("v"))
    v = v.groupBy("job_id").agg((F.sqrt(F.avg(F.pow(F.col("v.r") - F.col("v.p"), 2))) / F.greatest(F.max(F.abs("v.r")), F.lit(1e-9))).alias("speed"))
    pairs = paired(traces, "job_id").join(way, "job_id").join(v, "job_id")
    momentum = delta_similarity(F.col("r_residual"), F.col("p_residual"), config["momentum"])
    bounce = F.when(F.col("p_restitution").isNull(), 0.0).otherwise(decay(_relative("restitution", 0.1), config["restitution"]))
    parts = {
        "instance_trajectories": decay(F.col("way"), config["trajectory"]),
        "contact_event_time": decay(F.abs(F.col("p_event_s") - F.col("r_event_s")) / F.greatest(F.col("r_duration"), F.lit(1e-9)), config["event"]),
        "pre_post_velocities": decay(F.col("speed"), config["velocity"]),
        "collision_physics": F.when(F.col("r_restitution").isNull(), momentum).otherwise(0.6 * momentum + 0.4 * bounce),
        "one_dimensional_constraint": delta_similarity(F.col("r_cross"), F.col("p_cross"), config["cross"]),
    }
    return _finish(pairs, parts, config, F.least("r_span", "p_span") < config["least_span"], "insufficient_collision_motion")


def pendulum_traces(marks: DataFrame, config: dict[str, Any] = PENDULUM) -> tuple[DataFrame, DataFrame]:
    """(frames with angle, traces) from marks(job_id, role, frame, time_s, pivot_x, pivot_y, bob_x, bob_y, valid)."""
    w, whole = _windows(KEYS)
    ok = F.col("valid")
    s = marks.withColumns({c: series.interpolated(c, "valid", w) for c in ("pivot_x", "pivot_y", "bob_x", "bob_y")})
    middle = marks.where("valid").groupBy(*KEYS).agg(F.percentile("pivot_x", F.lit(0.5)).alias("mx"), F.percentile("pivot_y", F.lit(0.5)).alias("my"))
    s = s.join(middle, KEYS).withColumn("dx", F.col("bob_x") - F.col("mx")).withColumn("dy", F.col("bob_y") - F.col("my"))
    s = s.withColumn("length", F.hypot("dx", "dy")).withColumn("angle", F.atan2("dx", "dy")).withColumn("drift", F.hypot(F.col("pivot_x") - F.col("mx"), F.col("pivot_y") - F.col("my"))).withColumn(
        "gap", F.col("time_s") - F.lag("time_s").over(w))
    s = materialize(s)
    mids = s.groupBy(*KEYS).agg(F.percentile("angle", F.lit(0.5)).alias("mid"), F.percentile(F.when(ok, F.col("length")), F.lit(0.5)).alias("median_length"), F.percentile("gap", F.lit(0.5)).alias("step"), F.count("*").alias("n"))
    s = materialize(s.join(mids, KEYS))
    traces = s.groupBy(*KEYS).agg(
        F.avg(ok.cast("double")).alias("valid_ratio"), F.count_if(ok).alias("n_valid"), F.first("median_length").alias("median_length"), F.first("step").alias("step"), F.first("n").alias("n"),
        F.try_divide(F.stddev_pop(F.when(ok, F.col("drift"))), F.first("median_length")).alias("drift"), F.try_divide(F.stddev_pop(F.when(ok, F.col("length"))), F.greatest(F.avg(F.when(ok, F.col("length"))), F.lit(1e-12))).alias("length"),
        F.percentile(F.abs(F.col("angle") - F.col("mid")), F.lit(0.95)).alias("amplitude"))
    lags = traces.select(*KEYS, F.greatest(F.lit(2), F.ceil(config["least_s"] / F.col("step")).cast("int")).alias("lo"), F.least(F.col("n").cast("int") - 2, F.floor(config["most_s"] / F.col("step")).cast("int")).alias("hi"), "step", "n")
    held = s.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "angle"))), lambda p: p["angle"]).alias("a")).join(lags, KEYS).where("n >= 5 AND lo <= hi")
    mean = F.aggregate("a", F.lit(0.0), lambda p, q: p + q) / F.size("a")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda t, u: t + u)
    held = held.withColumn("m", mean).withColumn("c", F.transform("a", lambda u: u - F.col("m"))).withColumn("e", dot(F.col("c"), F.col("c"))).where("e > 1e-12")
    held = held.withColumn("lag", F.explode(F.sequence("lo", "hi")))
    held = held.select(*KEYS, "step", "lag", (dot(F.slice("c", F.lit(1), F.size("c") - F.col("lag")), F.slice("c", F.col("lag") + 1, F.size("c") - F.col("lag"))) / F.col("e")).alias("r"))
    # inner lags only: the first and the last have no neighbour within the range
    lw = Window.partitionBy(*KEYS).orderBy("lag")
    peak = (F.col("r") >= F.lag("r").over(lw)) & (F.col("r") > F.lead("r").over(lw)) & (F.col("r") >= 0.1)
    best = F.max_by("lag", F.struct("r", -F.col("lag")))
    period = held.withColumn("peak", peak).groupBy(*KEYS).agg((F.coalesce(F.min(F.when(F.col("peak"), F.col("lag"))), F.when(F.max("r") >= 0.1, best)) * F.first("step")).alias("period"))
    return s, traces.join(period, KEYS, "left")


def score_pendulum(marks: DataFrame, config: dict[str, Any] = PENDULUM) -> DataFrame:
    frames, traces = pendulum_traces(materialize(marks), config)
    traces = materialize(traces)
    pairs = paired(traces, "job_id").join(_rmse(frames, "angle", "job_id").select("job_id", "rmse"), "job_id")
    rate = F.when(F.col("r_period").isNull(), None).when(F.col("p_period").isNull(), 0.0).otherwise(F.exp(-F.abs(F.col("p_period") - F.col("r_period")) / F.col("r_period")))
    parts = {
        "angle_trajectory": F.exp(-F.col("rmse") / F.greatest(F.col("r_amplitude"), F.lit(math.radians(config["least_angle_deg"])))),
        "period": rate,
        "amplitude": F.exp(-F.abs(F.col("p_amplitude") - F.col("r_amplitude")) / F.greatest(F.col("r_amplitude"), F.lit(math.radians(1.0)))),
        "structural_consistency": 0.5 * (delta_similarity(F.col("r_drift"), F.col("p_drift"), config["drift"]) + delta_similarity(F.col("r_length"), F.col("p_length"), config["length"])),
    }
    bad = (F.least("r_valid_ratio", "p_valid_ratio") < config["valid_ratio"]) | (F.least("r_n_valid", "p_n_valid") < 3)
    scored = _finish(pairs, parts, config, bad | (F.least("r_median_length", "p_median_length") <= 1.0), "insufficient_valid_masks")
    short = pairs.select("job_id", (F.coalesce(~bad, F.lit(False)) & (F.least("r_median_length", "p_median_length") <= 1.0)).alias("short"))
    return scored.join(short, "job_id").withColumn("reason_code", F.when(F.col("short"), "invalid_pendulum_length").otherwise(F.col("reason_code"))).drop("short")
