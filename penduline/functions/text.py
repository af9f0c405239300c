"""Names, paths, units and prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Grammars of case ids by scene.
CASE_IDS = {
    "collision": r"^collision_r(\d+)_(large_steel|medium_steel|small_steel|glass_marble)_(large_steel|medium_steel|small_steel|glass_marble)_(large_steel|medium_steel|small_steel|glass_marble)_v(\d+)",
    "free_fall": r"^freefall_r(\d+)_(xl|l|m|s)_h(\d+)cm",
    "pendulum": r"^pendulum_r(\d+)_ltot(\d+)mm_lrope(\d+)mm_r(\d+)mm_a(\d+)deg",
    "incline": r"^incline_r(\d+)_a(\d+)deg_bg(white|oil|black|green)_img",
    "circular": r"^circular_r(\d+)_(?:silver(\d+)cm_)?(?:wood(\d+)cm_)?img",
}


def slug(text: Column) -> Column:
    """Runs of other characters than letters, digits, _ . - become one dash; no dashes at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_.-]+", "-"), "^-+|-+$", "")


def picture_stem(text: Column) -> Column:
    """'img 17.MOV' -> 'IMG_0017' by the first digits; null without any."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("IMG_"), F.lpad(F.regexp_replace(digits, "^0+(?=.)", ""), 4, "0")))


def centimetres(text: Column) -> Column:
    """'12cm' -> 12; null for anything else."""
    return F.regexp_extract(F.trim(text), r"^(\d+)\s*cm$", 1).try_cast("int")


def degrees_per_second(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)?)\s*(?:deg/s|度/秒)$", 1).try_cast("double")


def free_fall_height(case_id: Column) -> Column:
    """Metres, from the id of a free-fall case."""
    return F.regexp_extract(case_id, CASE_IDS["free_fall"], 3).try_cast("int") / 100


def pendulum_angle(case_id: Column) -> Column:
    return F.regexp_extract(case_id, CASE_IDS["pendulum"], 5).try_cast("int")


def collision_speed(case_id: Column) -> Column:
    return F.regexp_extract(case_id, CASE_IDS["collision"], 5).try_cast("int") / 10000


def pendulum_case_id(run: Column, total_mm: Column, rope_mm: Column, radius_mm: Column, angle_deg: Column) -> Column:
    """The id of a pendulum case; the grammars above read what these make."""
    return F.format_string("pendulum_r%d_ltot%04dmm_lrope%04dmm_r%03dmm_a%03ddeg", run, total_mm, rope_mm, radius_mm, angle_deg)


def free_fall_case_id(run: Column, size: Column, height_m: Column) -> Column:
    return F.format_string("freefall_r%d_%s_h%03dcm", run, size, F.rint(height_m * 100).cast("int"))


def collision_case_id(run: Column, balls: list[Column], speed: Column) -> Column:
    return F.format_string("collision_r%d_%s_%s_%s_v%05d", run, *balls, F.rint(speed * 10000).cast("int"))


def incline_case_id(run: Column, angle_deg: Column, background: Column) -> Column:
    return F.format_string("incline_r%d_a%02ddeg_bg%s_img", run, angle_deg, background)


def circular_case_id(run: Column, silver_cm: Column, wood_cm: Column) -> Column:
    """Only the objects that are there are named."""
    part = lambda name, v: F.when(v.isNotNull(), F.format_string(f"{name}%02dcm_", v)).otherwise("")
    return F.concat(F.format_string("circular_r%d_", run), part("silver", silver_cm), part("wood", wood_cm), F.lit("img"))


def dataset_relative(path: Column) -> Column:
    """Without leading ../ parts."""
    return F.regexp_replace(path, r"^(?:\.\./)+", "")


def stays_inside(path: Column) -> Column:
    """Whether a relative path, its parts taken one by one, never leaves its root."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, p: F.struct(
        (s["d"] + F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)).alias("d"),
        (s["ok"] & (s["d"] + F.when(p == "..", -1).otherwise(0) >= 0)).alias("ok")))
    return ~path.startswith("/") & depth["ok"]


def prefix_upgrade(text: Column, old: str, new: str) -> Column:
    """The old prefix replaced by the new one, once; null where neither is there."""
    return F.when(text.startswith(new), text).when(text.startswith(old), F.concat(F.lit(new), F.substring(text, len(old) + 1, 1 << 30)))


def run_stamp(at: Column, task: Column, baseline: Column) -> Column:
    """UTC time, task and baseline as the name of a run."""
    return slug(F.concat_ws("__", F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), task, baseline))


@F.pandas_udf(StringType())
def fixed_digits(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Python's fixed-point text: the exact binary value is rounded, halves to even (2.675 -> 2.67)."""
    return pd.Series([None if v is None or v != v else f"{v:.{int(d)}f}" for v, d in zip(value, digits, strict=True)])


def render_prompt(base: Column, clauses: Column, intro: str = "", separator: str = ", ", outro: str = "") -> Column:
    """base, then intro, the clauses and outro if there is any clause. Null clauses are left out."""
    held = F.filter(clauses, lambda c: c.isNotNull())
    return F.when(F.size(held) > 0, F.concat(base, F.lit(intro), F.array_join(held, separator), F.lit(outro))).otherwise(base)


def score_text(score: Column) -> Column:
    """Four decimals, or a dash for none."""
    return F.coalesce(fixed_digits(score, F.lit(4)), F.lit("—"))
