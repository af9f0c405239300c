"""Scene evaluators: from a request over media and reference to a score or the reason why there is none.

A request is a row: a planned job with its case, its prediction, its reference and what is known of both recordings. Whatever
stops it is found by a ladder of columns, first rung first; only what passes is observed and scored. Observations (points of the
objects, by role 'reference' or 'prediction') come from a source outside this engine, as do the media's frame counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penduline.functions import media
from penduline.operators import masks, scoring, validation
from penduline.operators.evaluation import ERROR, EVALUATED, INCOMPLETE, NO_RECORD, NOT_IMPLEMENTED, UNAVAILABLE, UNHANDLED, UNSUPPORTED

WRONG_SCENE, NO_VIDEO = "wrong_scene", "prediction_video_missing"
OPEN_FAILED, TOO_SHORT, NO_REFERENCE_FILE = "video_open_failed", "reference_too_short", "reference_video_missing"


@dataclass(frozen=True)
class Timeline:
    """Sampling of a scene: times a second, its longest and shortest duration, and what a recording must offer. Without a
    shortest one the timeline is fixed; else it ends with the reference."""

    fps: float
    longest: float
    shortest: float | None = None
    least_fps: float = 8.0
    tolerance: float = 0.02

    def last(self, reference_end: Column) -> Column:
        """The last time that is sampled, null where the reference is too short."""
        if self.shortest is None:
            return F.lit(self.longest)
        length = F.least(F.lit(self.longest), reference_end)
        steps = F.floor(length * self.fps + 1e-9)
        return F.when((length >= self.shortest) & (steps >= 1), steps / F.lit(self.fps))


# Timelines of the protocol.
TIMELINES = {
    "pendulum": Timeline(16.0, 5.0),
    "collision_1d": Timeline(16.0, 5.0, 1.5),
    "free_fall": Timeline(32.0, 1.0, 0.2),
    "inclined_plane_slide": Timeline(16.0, 5.0, 1.0),
    "uniform_circular_motion": Timeline(8.0, 5.0, 3.0),
}


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def requests(jobs: DataFrame, cases: DataFrame, predictions: DataFrame, recordings: DataFrame, references: DataFrame) -> DataFrame:
    """jobs with scene_id, what their prediction says, and what is known of both recordings.

    jobs: job_id, case_id. cases: case_id, scene_id, one row each. predictions: job_id, complete, video_path, one row each.
    recordings: path, fps, frame_count (nulls: it can't be opened). references: case_id, path, reason_code, of
    validation.resolve_reference. Columns found: r_path, r_reason, r_known, r_fps, r_frames, p_path, p_known, p_fps, p_frames.
    """
    said = predictions.select("job_id", F.lit(True).alias("predicted"), F.coalesce("complete", F.lit(False)).alias("complete"), F.col("video_path").alias("p_path"))
    refs = references.select("case_id", F.col("path").alias("r_path"), F.col("reason_code").alias("r_reason"))

    def known(mark: str) -> DataFrame:
        return recordings.select(F.col("path").alias(f"{mark}_path"), F.lit(True).alias(f"{mark}_known"), F.col("fps").cast("double").alias(f"{mark}_fps"), F.col("frame_count").alias(f"{mark}_frames"))

    return (
        jobs.select("job_id", "case_id").join(cases.select("case_id", "scene_id"), "case_id", "left").join(said, "job_id", "left")
        .join(refs, "case_id", "left").join(known("r"), "r_path", "left").join(known("p"), "p_path", "left"))


def checked(rows: DataFrame, scene: str, timeline: Timeline) -> DataFrame:
    """requests with last_time, status and reason_code: both null where the request can be observed and scored by the evaluator
    of a scene. Of several faults the first in the order of the work counts."""
    end = F.try_divide(F.col("r_frames") - 1, F.col("r_fps"))
    rows = rows.withColumn("last_time", timeline.last(end))

    def opened(mark: str) -> list[tuple[str, str, Column]]:
        return [(UNAVAILABLE, OPEN_FAILED, F.col(f"{mark}_fps").isNull() | F.col(f"{mark}_frames").isNull()),
                (UNAVAILABLE, "invalid_video_metadata", (F.col(f"{mark}_fps") <= 0) | (F.col(f"{mark}_frames") < 1))]

    def sampled(mark: str) -> Column:
        return media.sampling_fault(F.col(f"{mark}_fps"), F.col(f"{mark}_frames"), F.col("last_time"), timeline.least_fps, timeline.tolerance)

    rungs = [
        (ERROR, WRONG_SCENE, ~F.col("scene_id").eqNullSafe(F.lit(scene))),
        (UNAVAILABLE, NO_RECORD, F.col("predicted").isNull()),
        (UNAVAILABLE, INCOMPLETE, ~F.col("complete")),
        (UNAVAILABLE, NO_VIDEO, _none(F.col("p_path")) | F.col("p_known").isNull()),
        *((UNAVAILABLE, code, F.col("r_reason") == code) for code in REFERENCE_FAULTS),
        (UNAVAILABLE, NO_REFERENCE_FILE, _none(F.col("r_path")) | F.col("r_known").isNull()),
        *opened("r"),
        (UNAVAILABLE, TOO_SHORT, F.col("last_time").isNull()),
        *((UNAVAILABLE, code, sampled("r") == code) for code in SAMPLING_FAULTS),
        *opened("p"),
        *((UNAVAILABLE, code, sampled("p") == code) for code in SAMPLING_FAULTS),
    ]
    status = reason = F.lit(None).cast("string")
    for state, code, holds in reversed(rungs):
        holds = F.coalesce(holds, F.lit(False))
        status, reason = F.when(holds, state).otherwise(status), F.when(holds, code).otherwise(reason)
    return rows.withColumn("status", status).withColumn("reason_code", reason)


# Why a case has no reference, and why a recording can't be sampled.
REFERENCE_FAULTS = ("reference_path_escape", "no_trustworthy_physics_reference", "ood_parent_missing", "ood_parent_physics_mismatch", "ood_parent_reference_mismatch")
SAMPLING_FAULTS = ("source_fps_too_low", "insufficient_duration")


@dataclass(frozen=True)
class Evaluator:
    """What evaluates a scene. score takes the points of the requests that passed (and the side table given with them) and gives
    job_id, score, status, reason_code and the components of the score."""

    scene: str
    timeline: Timeline
    score: Callable[..., DataFrame]
    reference: Callable[[DataFrame], DataFrame] = validation.resolve_reference


EVALUATORS = {
    e.scene: e
    for e in (
        Evaluator("pendulum", TIMELINES["pendulum"], scoring.score_pendulum, lambda cases: pendulum_reference(cases)),
        Evaluator("free_fall", TIMELINES["free_fall"], scoring.score_free_fall),
        Evaluator("inclined_plane_slide", TIMELINES["inclined_plane_slide"], scoring.score_incline),
        Evaluator("uniform_circular_motion", TIMELINES["uniform_circular_motion"], scoring.score_orbits),
        Evaluator("collision_1d", TIMELINES["collision_1d"], scoring.score_collision),
    )
}


def evaluate_scene(rows: DataFrame, points: DataFrame, evaluator: Evaluator, *side: DataFrame) -> DataFrame:
    """(job_id, case_id, scene_id, status, reason_code, score) of every request of a scene's evaluator, in whatever state.

    points: job_id, role, ... of recordings, as the scorer takes them; those of requests that didn't pass aren't scored. A request
    that passed but has no score, as it has no points or the scorer fails on it, ends as an error."""
    seen = checked(rows, evaluator.scene, evaluator.timeline)
    passed = seen.where("status IS NULL").select("job_id")
    scores = evaluator.score(points.join(passed, "job_id", "left_semi"), *side).select(
        "job_id", F.col("score").alias("s_score"), F.col("status").alias("s_status"), F.col("reason_code").alias("s_reason"))
    both = seen.join(scores, "job_id", "left")
    status = F.coalesce("status", "s_status", F.lit(ERROR))
    reason = F.when(F.col("status").isNotNull(), F.col("reason_code")).otherwise(F.coalesce("s_reason", F.when(F.col("s_status").isNull() | F.col("s_score").isNull(), UNHANDLED)))
    return both.select("job_id", "case_id", "scene_id", F.when(reason.isNotNull() & (status == EVALUATED), ERROR).otherwise(status).alias("status"), reason.alias("reason_code"),
                       F.when(reason.isNull(), F.col("s_score")).alias("score"))


def unsupported(rows: DataFrame, evaluators: dict[str, Evaluator] = EVALUATORS) -> DataFrame:
    """Requests of scenes that have no evaluator, in the shape of evaluate_scene()."""
    none = rows.where(~F.coalesce(F.col("scene_id").isin(*evaluators), F.lit(False)))
    return none.select("job_id", "case_id", "scene_id", F.lit(UNSUPPORTED).alias("status"), F.lit(NOT_IMPLEMENTED).alias("reason_code"), F.lit(None).cast("double").alias("score"))


def evaluate(rows: DataFrame, points: dict[str, tuple[DataFrame, ...]], evaluators: dict[str, Evaluator] = EVALUATORS) -> DataFrame:
    """Every request by the evaluator of its scene. points: scene -> what its scorer takes; a scene without is not observed, its
    requests end as errors if they pass. evaluators may be replaced, by doubles in tests or by others."""
    out = unsupported(rows, evaluators)
    for scene, e in sorted(evaluators.items()):
        own = rows.where(F.col("scene_id") == scene)
        if scene in points:
            out = out.unionByName(evaluate_scene(own, points[scene][0], e, *points[scene][1:]))
        else:
            seen = checked(own, scene, e.timeline)
            out = out.unionByName(seen.select("job_id", "case_id", "scene_id", F.coalesce("status", F.lit(ERROR)).alias("status"), F.coalesce("reason_code", F.lit(UNHANDLED)).alias("reason_code"), F.lit(None).cast("double").alias("score")))
    return out


def pendulum_reference(cases: DataFrame) -> DataFrame:
    """(case_id, mode, parent_id, path, reason_code) by the rule of the pendulum: a case needs a reference of its own; that of an
    ood1 case must be its parent's, whose parameters must be the same. Of several rows of a case the last received counts."""
    last = cases.groupBy("case_id").agg(F.max_by(F.struct(
        validation.physics_key(F.col("physical_parameters")).alias("physics"), F.nullif(F.col("assets")["physics_reference_video"], F.lit("")).alias("video"), F.col("ood.level").alias("level"),
        F.nullif("provenance.parent_case_id", F.lit("")).alias("parent_id")), F.struct("received_at", validation.physics_key(F.col("physical_parameters")))).alias("c")).select("case_id", "c.*")
    parent = last.select(F.col("case_id").alias("parent_id"), F.col("physics").alias("p_physics"), F.col("video").alias("p_video"), F.lit(True).alias("found"))
    ood = F.coalesce(F.col("level") == "ood1", F.lit(False))
    reason = (
        F.when(F.col("video").isNull(), "no_trustworthy_physics_reference").when(~ood, None).when(F.col("found").isNull(), "ood_parent_missing")
        .when(~F.col("p_physics").eqNullSafe(F.col("physics")), "ood_parent_physics_mismatch").when(~F.col("p_video").eqNullSafe(F.col("video")), "ood_parent_reference_mismatch"))
    rows = last.join(parent, "parent_id", "left").withColumn("reason_code", reason).withColumn("mode", F.when(ood, "parent_physics_reference").otherwise("same_case_reference"))
    fine = F.col("reason_code").isNull()
    return rows.select("case_id", F.when(fine, F.col("mode")).alias("mode"), "parent_id", F.when(fine, F.col("video")).alias("path"), "reason_code")


# diagnostics


def fitted_acceleration(traces: DataFrame, lengths: DataFrame) -> DataFrame:
    """(job_id, role, metres, acceleration): acceleration in m/s2, where the whole way of a trace is so many metres long; null
    without a length or way. traces: job_id, role, span, acceleration in spans. lengths: job_id, metres."""
    a = F.when((F.col("metres") != 0) & (F.col("span") > 0), F.col("acceleration") * F.col("metres"))
    return traces.join(lengths.select("job_id", "metres"), "job_id", "left").select("job_id", "role", "metres", a.alias("acceleration"))


def sliding_acceleration(angle_deg: Column, friction: Column, gravity: float = 9.81) -> Column:
    """What a block slides with on a plane, not less than 0."""
    return F.greatest(F.lit(0.0), F.lit(gravity) * (F.sin(F.radians(angle_deg)) - friction * F.cos(F.radians(angle_deg))))


def expected_objects(appearance: Column) -> Column:
    """How many objects a recording shows: one if it isn't said or isn't a number."""
    return F.coalesce(appearance["object_count"].try_cast("int"), F.lit(1))


def ball_masses(cases: DataFrame) -> DataFrame:
    """(case_id, obj, mass) of the three balls, numbered from 0; cases that lack one give no row, as they can't be scored."""
    held = [F.col("physical_parameters")[f"ball_{k}_mass"]["value"] for k in (1, 2, 3)]
    whole = cases.where(F.forall(F.array(*held), lambda m: m.isNotNull()))
    return whole.select("case_id", F.posexplode(F.array(*held)).alias("obj", "mass"))


def per_frame(points: DataFrame, ious: DataFrame | None = None) -> DataFrame:
    """One row a job and frame: time, x and y of reference and prediction, whether each was seen, and the overlap of their
    masks (ious: job_id, frame, iou). Frames only one of both has are kept."""
    def side(role: str, mark: str) -> DataFrame:
        return points.where(F.col("role") == role).select("job_id", "frame", F.col("time_s").alias(f"{mark}_time"), *(F.col(c).alias(f"{role}_{c}") for c in ("x", "y", "valid")))

    rows = side("reference", "r").join(side("prediction", "p"), ["job_id", "frame"], "full").withColumn("time_s", F.coalesce("r_time", "p_time")).drop("r_time", "p_time")
    return rows.join(ious.select("job_id", "frame", "iou"), ["job_id", "frame"], "left") if ious is not None else rows


def instance_ious(frames: DataFrame) -> DataFrame:
    """(job_id, obj, mean, lowest, highest, observed_frame_ratio, reason_code) from frames(job_id, obj, frame, reference,
    prediction), both masks; obj -1 is the union of all objects of a frame."""
    zero = F.array().cast("array<bigint>")
    single = frames.select("job_id", "obj", "frame", F.coalesce("reference", zero).alias("reference"), F.coalesce("prediction", zero).alias("prediction"))
    words = {c: single.select("job_id", "frame", F.posexplode(c).alias("word", "bits")).groupBy("job_id", "frame", "word").agg(F.bit_or("bits").alias(c)) for c in ("reference", "prediction")}
    both = words["reference"].join(words["prediction"], ["job_id", "frame", "word"], "full")
    bits = lambda c: F.bit_count(F.coalesce(c, F.lit(0).cast("bigint")))
    zero_bits = F.lit(0).cast("bigint")
    a, b = F.coalesce("reference", zero_bits), F.coalesce("prediction", zero_bits)
    of_union = both.groupBy("job_id", "frame").agg(F.try_divide(F.sum(bits(a.bitwiseAND(b))).cast("double"), F.sum(bits(a.bitwiseOR(b)))).alias("iou"))
    every = single.select("job_id", "frame").distinct().join(of_union, ["job_id", "frame"], "left").select("job_id", F.lit(-1).alias("obj"), "iou")
    return masks.iou_summary(single.select("job_id", "obj", masks.iou(F.col("reference"), F.col("prediction")).alias("iou")).unionByName(every), "iou", "job_id", "obj")


def describe(evaluator: Evaluator) -> dict[str, Any]:
    """The evaluator as it enters a fingerprint."""
    t = evaluator.timeline
    return {"scene_id": evaluator.scene, "scorer": evaluator.score.__name__, "timeline": {"fps": t.fps, "longest": t.longest, "shortest": t.shortest, "least_fps": t.least_fps, "tolerance": t.tolerance}}
