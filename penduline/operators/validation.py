"""Checks on manifests. Each gives rows that say what is wrong; none stops at the first fault."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from penduline.session import broadcast_if_small

ERROR, WARNING = "error", "warning"


def issues(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """keys, level, code: a row for each rule (level, code, condition) that holds; a null condition doesn't hold."""
    marks = F.array(*(F.when(c, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, c in rules))
    return rows.select(*keys, F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("i")).select(*keys, "i.level", "i.code")


def quantity_ok(physics: Column) -> Column:
    """Whether there are parameters, each with unit, flag and a finite value."""
    good = F.forall(F.map_values(physics), lambda q: F.coalesce(
        q["value"].isNotNull() & ~F.isnan(q["value"]) & (F.abs(q["value"]) < float("inf")) & q["unit"].isNotNull() & q["annotated"].isNotNull(), F.lit(False)))
    return F.coalesce((F.size(physics) > 0) & good, F.lit(False))


def usable_quantities(physics: Column) -> Column:
    """The parameters that are annotated (which is so by default) and have a value."""
    return F.map_filter(physics, lambda k, q: F.coalesce(q["annotated"], F.lit(True)) & q["value"].isNotNull())


def case_issues(cases: DataFrame, scenes: DataFrame, version: str = "1.0") -> DataFrame:
    """(case_id, received_at, level, code) of each row of cases by itself: every rule it breaks. scenes: scene_id, id_parameters,
    ood1_factors. Rules on time scales (temporal.encoded_to_physical_speed) and on alignments (alignment.source_start_frame,
    alignment.review_status) apply where cases has those columns."""
    known = cases.join(broadcast_if_small(scenes.select("scene_id", F.col("ood1_factors").alias("allowed"), F.col("id_parameters").alias("needed"), F.lit(True).alias("known"))), "scene_id", "left")
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    level, split, views, assets = F.col("ood.level"), F.col("view_a_split"), F.col("input_views"), F.col("assets")
    empty = F.array().cast("array<string>")
    factors = F.col("ood.factors")
    at_id = split.isin("train", "test_id")
    real = F.coalesce("has_real_reference_video", F.lit(False))
    synthetic = F.col("provenance.source_kind") == "synthetic_first_frame"
    rules = [
        (ERROR, "schema_version", ~F.col("schema_version").eqNullSafe(F.lit(version))),
        (ERROR, "invalid_case_id", F.col("case_id").isNull()),
        (ERROR, "invalid_split", F.coalesce(~split.isin("train", "test_id", "test_ood1"), F.lit(True))),
        (ERROR, "id_mismatch", at_id & (~level.eqNullSafe(F.lit("id")) | F.coalesce(F.size(factors) != 0, F.lit(True)))),
        (ERROR, "ood1_mismatch", (split == "test_ood1") & (~level.eqNullSafe(F.lit("ood1")) | F.coalesce(F.size(factors) == 0, F.lit(True)))),
        (ERROR, "missing_real_reference", real & none(assets["reference_video"])),
        (ERROR, "missing_parent", synthetic & none(F.col("provenance.parent_case_id"))),
        (ERROR, "synthetic_marked_real", synthetic & real),
        (ERROR, "missing_first_frame", synthetic & none(assets["first_frame"])),
        (ERROR, "missing_input_views", F.coalesce(F.size(views) == 0, F.lit(True))),
        *((ERROR, f"invalid_{v}", F.map_contains_key(views, v) & none(views[v]["first_frame"])) for v in ("i2v", "ti2v")),
        (ERROR, "unknown_scene", F.col("known").isNull()),
        (ERROR, "missing_physics", F.size(F.array_except("needed", F.coalesce(F.map_keys("physical_parameters"), empty))) > 0),
        (ERROR, "disallowed_ood1_factor", F.size(F.array_except(F.coalesce(factors, empty), F.coalesce("allowed", empty))) > 0),
    ]
    if "temporal" in cases.columns:
        speed = F.col("temporal.encoded_to_physical_speed")
        rules.append((ERROR, "invalid_time_scale", F.isnan(speed) | (speed <= 0)))
    if "alignment" in cases.columns:
        aligned = F.col("alignment").isNotNull()
        rules += [
            (ERROR, "invalid_alignment_frame", aligned & F.coalesce(F.col("alignment.source_start_frame") < 0, F.lit(True))),
            (ERROR, "unreviewed_alignment", aligned & ~F.col("alignment.review_status").eqNullSafe(F.lit("visually_verified"))),
            (ERROR, "missing_alignment_source", aligned & none(assets["source_video"])),
            (ERROR, "alignment_not_materialized", aligned & assets["reference_video"].eqNullSafe(assets["source_video"])),
        ]
    return issues(known, ["case_id", "received_at"], rules)


# The keys that a case document must have.
CASE_KEYS = ("schema_version", "case_id", "scene_id", "view_a_split", "physical_parameters", "appearance", "text", "assets", "has_real_reference_video", "ood", "provenance", "input_views")


def missing_keys(document: Column, required: tuple[str, ...] = CASE_KEYS) -> Column:
    """The required keys that a JSON object lacks at its top, sorted; null for a text that is no JSON object."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(document)))


def count_faults(counts: DataFrame, expected: dict[str, int], key: str) -> DataFrame:
    """(key, expected, n) wherever counts(key, n) differs from what is expected; a key that isn't there counts as 0, and one that
    isn't expected has a null."""
    want = counts.sparkSession.createDataFrame(sorted(expected.items()), f"`{key}` string, expected bigint")
    both = counts.select(F.col(key), "n").join(want, key, "full").select(key, "expected", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    return both.where(~F.col("expected").eqNullSafe(F.col("n")))


def physics_key(physics: Column) -> Column:
    """Equal for equal parameters, in whatever order. Maps themselves can't be compared."""
    return F.to_json(F.array_sort(F.map_entries(physics)))


def parent_issues(cases: DataFrame) -> DataFrame:
    """(case_id, level, code) of references to parents: parent_not_found, parent_scene_mismatch, parent_not_id,
    ood1_physics_changed. Of several rows of a parent the last received counts."""
    last = cases.groupBy("case_id").agg(F.max_by(F.struct("scene_id", F.col("ood.level").alias("level"), physics_key(F.col("physical_parameters")).alias("physics")), F.struct(
        "received_at", F.col("scene_id"), F.coalesce("ood.level", F.lit("")))).alias("parent"))
    children = cases.where("provenance.parent_case_id <> ''").select("case_id", "scene_id", physics_key(F.col("physical_parameters")).alias("physics"), F.col("provenance.parent_case_id").alias("parent_id"))
    both = children.join(last.select(F.col("case_id").alias("parent_id"), "parent"), "parent_id", "left")
    return issues(both, ["case_id", "parent_id"], [
        (ERROR, "parent_not_found", F.col("parent").isNull()), (ERROR, "parent_scene_mismatch", F.col("parent.scene_id") != F.col("scene_id")),
        (ERROR, "parent_not_id", F.col("parent.level") != "id"), (ERROR, "ood1_physics_changed", ~F.col("parent.physics").eqNullSafe(F.col("physics")) & F.col("parent").isNotNull())]).distinct()


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only, each once; both sets are equal if there is no row."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


@F.pandas_udf(ArrayType(StringType()))
def forbidden_key_paths(raw: pd.Series, forbidden: pd.Series) -> pd.Series:
    """The paths, at any depth, of object keys of a forbidden name; [] for texts that are no JSON."""
    def one(text: str | None, name: str) -> list[str]:
        try:
            todo = [("", json.loads(text))] if text else []
        except (ValueError, RecursionError):
            return []
        out = []
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                for k, v in x.items():
                    if k == name:
                        out.append(f"{path}/{k}")
                    todo.append((f"{path}/{k}", v))
            elif isinstance(x, list):
                todo += [(f"{path}/{i}", v) for i, v in enumerate(x)]
        return sorted(out)

    return pd.Series([one(t, n) for t, n in zip(raw, forbidden, strict=True)])


def lock_issues(lock: DataFrame, cases: DataFrame) -> DataFrame:
    """(path, level, code): faults of locked files, files locked more than once, and assets of cases that aren't locked."""
    own = issues(lock, ["path"], [
        (ERROR, "absolute_or_escaping_path", F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")),
        (ERROR, "invalid_size", F.col("size_bytes").isNull() | (F.col("size_bytes") < 0)),
        (ERROR, "invalid_sha256", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)))]).distinct()
    twice = duplicate_keys(lock, "path").select("path", F.lit(WARNING).alias("level"), F.lit("locked_again").alias("code"))
    used = cases.select(F.explode(F.map_values("assets")).alias("path")).where("path <> ''").distinct()
    unlocked = used.join(lock.select("path"), "path", "left_anti").select("path", F.lit(ERROR).alias("level"), F.lit("missing_asset").alias("code"))
    return own.unionByName(twice).unionByName(unlocked)


def view_issues(members: DataFrame, cases: DataFrame) -> DataFrame:
    """(view_id, case_id, code): members in several places of one view, and members that are no case."""
    repeated = members.groupBy("view_id", "case_id").agg(F.count("*").alias("n")).where("n > 1").select("view_id", "case_id", F.lit("listed_again").alias("code"))
    unknown = members.select("view_id", "case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti").select("view_id", "case_id", F.lit("unknown_case").alias("code"))
    return repeated.unionByName(unknown)


def resolve_reference(cases: DataFrame) -> DataFrame:
    """(case_id, mode, parent_id, path, reason_code): the reference of each case by its last row: its own if that is real,
    else that of the parent with the same parameters."""
    last = cases.groupBy("case_id").agg(F.max_by(F.struct(
        physics_key(F.col("physical_parameters")).alias("physics"), F.col("assets")["physics_reference_video"].alias("video"), F.coalesce("has_real_reference_video", F.lit(False)).alias("real"),
        F.nullif("provenance.parent_case_id", F.lit("")).alias("parent_id")), F.struct("received_at", physics_key(F.col("physical_parameters")))).alias("c")).select("case_id", "c.*")
    parent = last.select(F.col("case_id").alias("parent_id"), F.col("physics").alias("p_physics"), F.col("video").alias("p_video"), F.lit(True).alias("found"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    own = has(F.col("video")) & F.col("real")
    reason = (
        F.when(own, None).when(F.col("parent_id").isNull(), "no_trustworthy_physics_reference").when(F.col("found").isNull(), "ood_parent_missing")
        .when(~F.col("p_physics").eqNullSafe(F.col("physics")), "ood_parent_physics_mismatch").when(~has(F.col("p_video")), "no_trustworthy_physics_reference"))
    return last.join(parent, "parent_id", "left").withColumn("reason_code", reason).select(
        "case_id", F.when(own, "same_case_reference").when(F.col("reason_code").isNull(), "parent_physics_reference").alias("mode"),
        F.when(~own, F.col("parent_id")).alias("parent_id"), F.when(own, F.col("video")).when(F.col("reason_code").isNull(), F.col("p_video")).alias("path"), "reason_code")
