"""Fingerprints: SHA-256 of canonical JSON, of sets, of rows and of a task's parts."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical(value: object) -> str:
    """Sorted keys, no spaces, unescaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_sha256(raw: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null where there is no JSON."""
    def one(text: str | None) -> str | None:
        try:
            return digest(json.loads(text)) if text is not None else None
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def seal(document: dict, field: str = "instance_digest") -> dict:
    """The document with the digest of all its other fields."""
    rest = {k: v for k, v in document.items() if k != field}
    return {**rest, field: digest(rest)}


def verify(document: dict, field: str = "instance_digest") -> None:
    if document.get(field) != seal(document, field)[field]:
        raise ValueError(f"{field} does not match the document")


def quoted_list(values: Column) -> Column:
    """The JSON array of an array of texts that need no escapes."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))


def set_fingerprint(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, sha256): digest of the JSON array of each group's sorted distinct values. For groups of unbounded size
    take row_fingerprint, which needs no order."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("v")).select(
        group, F.size("v").alias("n"), F.sha2(quoted_list(F.col("v")), 256).alias("sha256"))


def row_fingerprint(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, n, fingerprint): order-free digest of a group's rows: sum of 60-bit parts of their SHA-256. Groups of any
    size, as it is aggregated before the shuffle."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def asset_inversion(cases: DataFrame) -> DataFrame:
    """(path, roles, case_ids): assets of cases by path, sorted, each once. Null and empty paths are no assets."""
    return cases.select("case_id", F.explode("assets").alias("role", "path")).where("path IS NOT NULL AND path <> ''").groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.array_join(F.array_sort(F.collect_set("case_id")), ",").alias("case_ids"))
