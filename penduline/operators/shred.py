"""Deeply nested records into related flat tables.

One pass over the raw text: a depth-first visitor emits, for each object on its way, a row of table tag, key, parent key
and payload. The rows are written partitioned by tag; reading a tag applies that table's schema. Keys are paths inside
the record, so (record_id, parent_path) of a child always names a row of its parent table.

Null, blank, broken, truncated or too deeply nested bodies and bodies without a case give no row. Null entries give no
row but keep their position. Repeated records are records of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penduline.session import fresh_path, spread

#: Table -> the table of its parents.
PARENT_OF = {
    "case": None, "quantity": "case", "reading": "quantity", "view": "case", "crop": "view", "asset": "case",
    "rendition": "asset", "step": "case", "step_input": "step",
}

#: Typed columns of each table, read from the payload.
SCHEMAS = {
    "case": "schema_version STRING, case_id STRING, scene_id STRING, ood STRUCT<level: STRING, factors: ARRAY<STRING>>",
    "quantity": "value STRING, unit STRING, annotated BOOLEAN",
    "reading": "value DOUBLE, by STRING",
    "view": "prompt STRING, first_frame STRING",
    "crop": "box ARRAY<INT>, frame INT",
    "asset": "path STRING",
    "rendition": "height INT, path STRING, audio STRUCT<channels: INT>",
    "step": "op STRING, args MAP<STRING, DOUBLE>",
    "step_input": "frame INT, mask STRUCT<rle: ARRAY<INT>>",
}

_TAGGED = "record_id BIGINT, item_path STRING, parent_tag STRING, parent_path STRING, payload STRING, tag STRING"

#: part of the case -> (table, field that names a listed entry, list inside an entry, its table, field of a bare value)
PARTS = {
    "physical_parameters": ("quantity", "name", "readings", "reading", "value"),
    "input_views": ("view", "view", "crops", "crop", "prompt"),
    "assets": ("asset", "role", "renditions", "rendition", "path"),
}


def parse(text: str | None) -> object:
    """The complete JSON value of a text, None if there is none. NaN and Infinity are no JSON."""
    def no(name: str) -> None:
        raise ValueError(name)

    if not text:
        return None
    try:
        return json.loads(text.lstrip("﻿"), parse_constant=no)
    except (ValueError, RecursionError):
        return None


def find_cases(value: object) -> Iterator[dict]:
    """The cases in a value, however wrapped: in lists, in other objects or in strings that are JSON themselves."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            x = parse(x) if x.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"') else None
            if x is not None:
                todo.append(x)
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            if "case_id" in x:
                yield x
            else:
                todo.extend(reversed(list(x.values())))


def entries(part: object, name_field: str) -> Iterator[tuple[str, object]]:
    """(name, entry) of a part delivered as an object or as a list of entries that carry their name. A listed entry
    without any name goes by its position."""
    if isinstance(part, dict):
        yield from part.items()
    elif isinstance(part, list):
        for k, entry in enumerate(part):
            named = entry if isinstance(entry, dict) else {}
            name = next((named[f] for f in (name_field, "name", "view", "role") if isinstance(named.get(f), str)), str(k))
            yield name, entry


def visit(case: dict) -> Iterator[tuple[str, str, str | None, object]]:
    """(table, path, parent path, payload) depth first. The payload is what no row below it holds: the lists of children are
    left out, but parts of an unforeseen shape stay."""
    generator = case.get("provenance").get("generator") if isinstance(case.get("provenance"), dict) else None
    steps = generator.get("steps") if isinstance(generator, dict) else None
    own = {k: v for k, v in case.items() if k not in PARTS or not isinstance(v, dict | list)}
    if isinstance(steps, list):
        own["provenance"] = case["provenance"] | {"generator": {k: v for k, v in generator.items() if k != "steps"}}
    yield "case", "", None, own
    for part, (table, name_field, inner, inner_table, bare) in PARTS.items():
        for name, entry in entries(case.get(part), name_field):
            if entry is None:
                continue
            held = entry.get(inner) if isinstance(entry, dict) else None
            yield table, name, "", _without(entry, inner, bare)
            for k, item in enumerate(held if isinstance(held, list) else []):
                if item is not None:
                    yield inner_table, f"{name}/{k}", name, item if isinstance(item, dict) else {"value": item}
    for k, step in enumerate(steps if isinstance(steps, list) else []):
        if step is None:
            continue
        yield "step", str(k), "", _without(step, "inputs", "op")
        inputs = step.get("inputs") if isinstance(step, dict) else None
        for j, item in enumerate(inputs if isinstance(inputs, list) else []):
            if item is not None:
                yield "step_input", f"{k}/{j}", str(k), item if isinstance(item, dict) else {"frame": item}


def _without(entry: object, inner: str, bare: str) -> dict:
    """An entry without its list of children; a bare value under the name of its field."""
    if not isinstance(entry, dict):
        return {bare: entry}
    return {k: v for k, v in entry.items() if k != inner} if isinstance(entry.get(inner), list) else entry


def shred(records: DataFrame) -> DataFrame:
    """(record_id, tag, item_path, parent_tag, parent_path, payload): one row per object found. A record that holds
    several cases gives the rows of each of them."""
    schema = pa.schema([("record_id", pa.int64()), ("tag", pa.string()), ("item_path", pa.string()),
                        ("parent_tag", pa.string()), ("parent_path", pa.string()), ("payload", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = json.JSONEncoder(ensure_ascii=False).encode
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for record_id, body in zip(part["record_id"].to_pylist(), part["body"].to_pylist(), strict=True):
                    for case in find_cases(parse(body)):
                        out += [(record_id, tag, path, PARENT_OF[tag], parent, written(held)) for tag, path, parent, held in visit(case)]
                columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(records.select("record_id", "body")).mapInArrow(
        emit, "record_id bigint, tag string, item_path string, parent_tag string, parent_path string, payload string")


def write_tables(records: DataFrame, path: str) -> None:
    """Shred in a single pass into one folder per table."""
    shred(records).write.partitionBy("tag").mode("errorifexists").parquet(path)


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """All tables of some records, written in one pass into the shared folder and read back under their schemas."""
    path = fresh_path(records.sparkSession)
    write_tables(records, path)
    return {tag: read_table(records.sparkSession, path, tag) for tag in SCHEMAS}


def typed(tagged: DataFrame, tag: str) -> DataFrame:
    """One table: keys plus the columns of its schema; `payload` stays, so a value of an unforeseen shape isn't lost."""
    return (
        tagged.where(F.col("tag") == tag)
        .select("record_id", "item_path", "parent_tag", "parent_path",
                F.from_json("payload", SCHEMAS[tag], {"mode": "PERMISSIVE"}).alias("v"), "payload")
        .select("record_id", "item_path", "parent_tag", "parent_path", "v.*", "payload")
    )


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A table written by write_tables; only its own partition is read."""
    return typed(spark.read.schema(_TAGGED).parquet(path), tag)


def found(records: DataFrame) -> DataFrame:
    """(record_id, child_table, item_path) of every child row of the written tables."""
    every = None
    for tag, rows in tables(records).items():
        if PARENT_OF[tag] is not None:
            rows = rows.select("record_id", F.lit(tag).alias("child_table"), "item_path")
            every = rows if every is None else every.unionByName(rows)
    return every


def table_sizes(records: DataFrame) -> DataFrame:
    """Rows and records of each table."""
    path = fresh_path(records.sparkSession)
    write_tables(records, path)
    return records.sparkSession.read.schema(_TAGGED).parquet(path).groupBy("tag").agg(
        F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"))
