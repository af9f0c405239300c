"""Prompts made of a scene's base text and clauses on parameters; the adaptation of cases to a conditioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penduline.functions.text import fixed_digits

#: Stages of an adaptation; of these the pictures depend on the first three only.
STAGES = ("spatial", "temporal", "paradigm", "text", "conditioning")
PICTURE_STAGES = STAGES[:3]


def clause_values(cases: DataFrame, clauses: DataFrame) -> DataFrame:
    """(case_id, pos, name, value, unit, fault) of each clause of a case's scene: missing_required_parameter or unit_mismatch,
    null if it can be said. Optional clauses without a usable parameter give no row.

    cases: case_id, scene_id, physics. clauses: scene_id, pos, name, unit (null: any), required. A parameter is usable if it
    is annotated (which is so by default) and has a value."""
    return _said(cases, clauses).select("case_id", "pos", "name", "value", "unit", "fault")


def _said(cases: DataFrame, clauses: DataFrame) -> DataFrame:
    """clause_values() with whatever else clauses says."""
    q = F.col("physics")[F.col("name")]
    usable = q.isNotNull() & F.coalesce(q["annotated"], F.lit(True)) & q["value"].isNotNull()
    rows = cases.select("case_id", "scene_id", "physics").join(clauses.withColumnRenamed("unit", "wanted"), "scene_id").withColumn("usable", F.coalesce(usable, F.lit(False)))
    fault = F.when(~F.col("usable"), "missing_required_parameter").when(F.col("wanted").isNotNull() & ~F.col("wanted").eqNullSafe(q["unit"]), "unit_mismatch")
    more = [c for c in clauses.columns if c not in ("scene_id", "pos", "name", "unit", "required")]
    return rows.where("usable OR required").select("case_id", "pos", "name", F.when(F.col("usable"), q["value"]).alias("value"), F.when(F.col("usable"), q["unit"]).alias("unit"), fault.alias("fault"), *more)


def rendered(cases: DataFrame, clauses: DataFrame, profile_id: str, intro: str = " with ", separator: str = ", ", outro: str = ".") -> DataFrame:
    """(case_id, profile_id, prompt, used_parameters, prompt_sha256, fault): base_prompt of the case and its clauses. A case with
    any fault has no prompt. Rendered once a case, however many jobs use it."""
    said = _said(cases, clauses)
    text = F.concat_ws(" ", "name", fixed_digits("value", F.coalesce("precision", F.lit(3))), "unit")
    parts = said.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda p: p["t"]).alias("parts"),
        F.array_sort(F.collect_set("name")).alias("used_parameters"), F.min("fault").alias("fault"))
    whole = cases.select("case_id", "base_prompt").join(parts, "case_id", "left")
    prompt = F.when(F.col("fault").isNotNull(), None).when(F.size("parts") > 0, F.concat("base_prompt", F.lit(intro), F.array_join("parts", separator), F.lit(outro))).otherwise(F.col("base_prompt"))
    return whole.select("case_id", F.lit(profile_id).alias("profile_id"), prompt.alias("prompt"), "used_parameters", F.sha2(prompt, 256).alias("prompt_sha256"), "fault")


def adaptations(cases: DataFrame, role: str, conditioning: str, bucket: Column, speed: Column, prompt: Column) -> DataFrame:
    """(adaptation_id, case_id, role, conditioning, stages, materialization, fingerprint): what is done to each case. Two
    adaptations of equal materialization share their pictures, whatever is said about them."""
    stages = {"spatial": bucket, "temporal": F.format_string("x%.6f", speed), "paradigm": F.lit(role), "text": F.coalesce(prompt, F.lit("")), "conditioning": F.lit(conditioning)}
    hashed = F.create_map(*(x for k in STAGES for x in (F.lit(k), F.sha2(F.concat(F.lit(f"{k}:"), stages[k]), 256))))
    rows = cases.select("case_id", F.concat_ws("__", "case_id", F.lit(role), F.lit(conditioning)).alias("adaptation_id"), F.lit(role).alias("role"), F.lit(conditioning).alias("conditioning"), hashed.alias("stages"))
    join = lambda names: F.sha2(F.concat_ws("|", F.col("case_id"), *(F.col("stages")[n] for n in names)), 256)
    return rows.withColumn("materialization", join(PICTURE_STAGES)).withColumn("fingerprint", join(STAGES))


def first_frame_source(assets: Column) -> Column:
    """The first frame's own file, else frame 0 of the reference; null without either."""
    own, video = F.nullif(assets["first_frame"], F.lit("")), F.nullif(assets["physics_reference_video"], F.lit(""))
    return F.coalesce(own, F.concat(video, F.lit(":frame0")))


def sampling_plan(items: DataFrame, group: str, repeat: int, world: int) -> DataFrame:
    """(group, n_items, n_balanced, steps): items, what they are repeated to (the largest group), and steps in all."""
    n = items.groupBy(group).agg(F.count("*").alias("n_items"))
    total = n.agg(F.max("n_items").alias("n_balanced"), F.count("*").alias("_g"))
    return n.crossJoin(F.broadcast(total)).select(group, "n_items", "n_balanced", F.ceil(F.col("n_balanced") * F.col("_g") * repeat / F.lit(world)).alias("steps"))
