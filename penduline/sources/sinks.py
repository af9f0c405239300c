"""Artifacts of a run. Tables go through Spark's commit protocol; one-row documents are written beside and renamed."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(path: str | Path, value: object) -> None:
    """Canonical JSON, indented, atomically."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line with its keys sorted; null fields are kept."""
    ordered = rows.select(*sorted(rows.columns))
    ordered.select(F.to_json(F.struct(*ordered.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; without any row it is an error, as the columns of nothing mean nothing."""
    if rows.isEmpty():
        raise ValueError("no rows to write")
    rows.write.option("header", True).csv(path)


def report(title: str, facts: dict[str, str], cells: DataFrame, most: int = 1000) -> str:
    """Markdown of a summary table; null scores are dashes. cells: scene_id, evaluation_partition and the summary."""
    def four(x: float | None) -> str:
        return "—" if x is None else f"{x:.4f}"

    rows = cells.orderBy("scene_id", "evaluation_partition").limit(most).collect()  # a page to be read
    left_out = cells.count() - len(rows) if len(rows) == most else 0
    head = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items()), "", "| scene | partition | expected | evaluated | coverage | score | observed |", "|---|---|---:|---:|---:|---:|---:|"]
    return "\n".join([*head, *(f"| {r.scene_id} | {r.evaluation_partition} | {r.expected_jobs} | {r.evaluated_jobs} | {four(r.coverage)} | {four(r.score)} | {four(r.observed_mean_score)} |" for r in rows), *([f"| … | {left_out} more cells are in the table of the run | | | | | |"] if left_out else []), ""])


def file_sha256(path: str | Path) -> str:
    held = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            held.update(block)
    return held.hexdigest()


def copy_once(source: str, target: str) -> tuple[int | None, str | None, str]:
    """(size_bytes, sha256, state): source copied to target byte by byte, if target isn't there. States: copied, there_already,
    target_differs (which is left as it is) and source_missing. What was written is read again and must have the same hash."""
    if not os.path.isfile(source):
        return None, None, "source_missing"
    own = file_sha256(source)
    state = "there_already"
    if not os.path.exists(target):
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        fd, beside = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
        os.close(fd)
        shutil.copyfile(source, beside)
        os.replace(beside, target)
        state = "copied"
    if file_sha256(target) != own:
        state = "target_differs"
    return os.path.getsize(source), own, state


def copy_files(pairs: DataFrame) -> DataFrame:
    """(source, target, size_bytes, sha256, state) of pairs(source, target) of files that all executors see: the audit of copying
    them. Null paths are missing sources."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, t, *(copy_once(s, t) if s and t else (None, None, "source_missing"))) for s, t in zip(batch["source"], batch["target"], strict=True)]
            yield pd.DataFrame(rows, columns=["source", "target", "size_bytes", "sha256", "state"]).astype({"size_bytes": "Int64"})

    return pairs.select("source", "target").mapInPandas(run, "source string, target string, size_bytes bigint, sha256 string, state string")


def write_candidates(rows: DataFrame, path: str) -> None:
    """What a detector proposes, for review: as CSV and as JSON lines, both in one order by all columns."""
    ordered = rows.orderBy(*rows.columns)
    write_csv(ordered, f"{path}/csv")
    write_jsonl(ordered, f"{path}/json")
