"""Schemas that drift between the files of a stream.

Each line is loaded as a map from path to (raw type, value); path and type statistics are aggregated by file; each file is
compared with the one before it in its stream. The consistent table then has a typed column for every field, renamings
followed, and every value that doesn't fit its column is reported beside it.

Bodies that aren't a complete JSON object count for nothing, but their file exists. Paths lead through objects only:
arrays are values. A field that holds only nulls in a file has no type there.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penduline.session import materialize, spread

_LINE = ["stream_id", "file_no"]
_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", type(None): "null"}
_KINDS = ("array", "boolean", "number", "string")

#: Fields for which consistent() makes columns; it fails, rather than leave some out, where there are more.
MOST_FIELDS = 10_000


def _leaves(value: dict) -> Iterator[tuple[str, object]]:
    todo = [("", value)]
    while todo:
        path, held = todo.pop()
        for name, x in held.items():
            at = f"{path}.{name}" if path else name
            if isinstance(x, dict):
                todo.append((at, x))
            else:
                yield at, x


def _raw(value: object) -> str | None:
    """The value as text; equal values have equal texts."""
    if value is None:
        return None
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def path_values(lines: DataFrame) -> DataFrame:
    """(row_no, stream_id, kind, file_no, line_no, site, fields): fields maps each path to its raw type and text.
    site is null where it isn't a text. Lines whose body is no complete JSON object give no row."""
    def no(name: str) -> None:
        raise ValueError(name)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.struct([("type", pa.string()), ("raw", pa.string())])
        for batch in batches:
            keep, sites, fields = [], [], []
            for k, body in enumerate(batch["body"].to_pylist()):
                try:
                    value = json.loads(body.lstrip("﻿"), parse_constant=no) if body else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    site = value.pop("site", None)
                    keep.append(k)
                    sites.append(site if isinstance(site, str) else None)
                    fields.append(list({p: {"type": _TYPES[type(x)], "raw": _raw(x)} for p, x in _leaves(value)}.items()))
            kept = batch.select(["row_no", "stream_id", "kind", "file_no", "line_no"]).take(pa.array(keep, pa.int64()))
            arrays = [*kept.columns, pa.array(sites, pa.string()), pa.array(fields, pa.map_(pa.string(), held))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.schema.names, "site", "fields"])

    return spread(lines.select("row_no", "stream_id", "kind", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), "body")).mapInArrow(
        parse, "row_no bigint, stream_id string, kind string, file_no int, line_no int, site string, fields map<string, struct<type: string, raw: string>>")


def path_stats(values: DataFrame) -> DataFrame:
    """(stream_id, file_no, path, types, n_lines, n_null): the types of the values that aren't null, sorted and joined."""
    return values.groupBy(*_LINE, "path").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type")))), "|").alias("types"),
        F.count("*").alias("n_lines"), F.count_if(F.col("type") == "null").alias("n_null"))


def file_order(lines: DataFrame) -> DataFrame:
    """(stream_id, file_no, prev_no, next_no) of every file that has a line, whatever is in it."""
    at = Window.partitionBy("stream_id").orderBy("file_no")
    files = lines.where("stream_id IS NOT NULL AND file_no IS NOT NULL").select("stream_id", F.col("file_no").cast("int").alias("file_no")).distinct()
    return files.select(*_LINE, F.lag("file_no").over(at).alias("prev_no"), F.lead("file_no").over(at).alias("next_no"))


def changes(lines: DataFrame) -> DataFrame:
    """(stream_id, file_no, change, old_path, new_path): renamed, added, removed, type_changed, each file against the next
    lower one of its stream. A path may take part in several renamings if the values allow them all."""
    leaves = materialize(
        path_values(lines).select(*_LINE, "site", F.explode("fields").alias("path", "v"))
        .select(*_LINE, "site", "path", "v.type", F.when(F.col("v.type") != "null", F.struct(F.xxhash64("v.raw", "v.type"), F.xxhash64("v.type", F.lit("2"), "v.raw"))).alias("value")))
    files = materialize(file_order(lines))
    stats = materialize(path_stats(leaves).join(files, _LINE))

    def facing(df: DataFrame, *columns: str) -> DataFrame:
        """Each row of a file twice: as the later one of a pair of files, and as the earlier one of the next pair."""
        return df.select("*", F.explode(F.array(
            F.struct(F.when(F.col("prev_no").isNotNull(), F.col("file_no")).alias("pair_no"), F.lit(True).alias("is_new")),
            F.struct(F.col("next_no").alias("pair_no"), F.lit(False).alias("is_new")))).alias("side")).select(
            "stream_id", "side.pair_no", "side.is_new", *columns).where("pair_no IS NOT NULL")

    pair = ["stream_id", "pair_no"]
    paths = materialize(facing(stats, "path", "types").groupBy(*pair, "path").agg(
        F.max(F.when(F.col("is_new"), F.col("types"))).alias("new_types"), F.max(F.when(~F.col("is_new"), F.col("types"))).alias("old_types")))
    gone = paths.where("new_types IS NULL").select(*pair, "path", F.lit(False).alias("is_new"))
    come = paths.where("old_types IS NULL").select(*pair, "path", F.lit(True).alias("is_new"))
    moved = gone.unionByName(come)
    # what a site says under a path, repeats and contradictions of one site included, as one signature
    said = (
        leaves.where("value IS NOT NULL AND site IS NOT NULL").select(*_LINE, "site", "path", "value").distinct()
        .groupBy(*_LINE, "site", "path").agg(F.struct(F.count("*"), F.bit_xor("value.col1"), F.bit_xor("value.col2")).alias("says"))
        .join(files, _LINE)
    )
    said = materialize(facing(said, "site", "path", "says").join(moved, [*pair, "path", "is_new"]))
    # paths that say the same at the same sites are one class, so that k fields that vanish and m that come, all of one value,
    # are a pair of classes and not k x m pairs at every site
    classes = materialize(said.groupBy(*pair, "is_new", "path").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("site", "says")).alias("a"), F.bit_xor(F.xxhash64("says", F.lit("2"), "site")).alias("b")).select(
        *pair, "is_new", "path", F.xxhash64("n", "a").alias("class_a"), F.col("b").alias("class_b")))
    first = classes.groupBy(*pair, "is_new", "class_a", "class_b").agg(F.min("path").alias("path"))
    spoken = materialize(said.join(first, [*pair, "is_new", "path"]))
    names = ["class_a", "class_b"]
    old = spoken.where("NOT is_new").select(*pair, "site", F.struct(*names).alias("old"), F.col("says").alias("old_says"))
    new = spoken.where("is_new").select(*pair, "site", F.struct(*names).alias("new"), F.col("says").alias("new_says"))
    candidates = old.join(new.withColumnRenamed("new_says", "old_says"), [*pair, "site", "old_says"]).select(*pair, "old", "new").distinct()
    alike = candidates.join(old, [*pair, "old"]).join(new, [*pair, "site", "new"]).groupBy(*pair, "old", "new").agg(
        F.bool_and(F.col("old_says") == F.col("new_says")).alias("equal")).where("equal").drop("equal")
    of = {m: classes.where(w).select(*pair, F.struct(*names).alias(m), F.col("path").alias(f"{m}_path")) for m, w in (("old", "NOT is_new"), ("new", "is_new"))}
    renamed = materialize(alike.join(of["old"], [*pair, "old"]).join(of["new"], [*pair, "new"]).select(*pair, "old_path", "new_path"))
    none = F.lit("")
    out = [
        renamed.select(*pair, F.lit("renamed").alias("change"), "old_path", "new_path"),
        come.join(renamed.select(*pair, F.col("new_path").alias("path")), [*pair, "path"], "left_anti").select(*pair, F.lit("added").alias("change"), none.alias("old_path"), F.col("path").alias("new_path")),
        gone.join(renamed.select(*pair, F.col("old_path").alias("path")), [*pair, "path"], "left_anti").select(*pair, F.lit("removed").alias("change"), F.col("path").alias("old_path"), none.alias("new_path")),
        paths.where("new_types <> '' AND old_types <> '' AND new_types <> old_types").select(*pair, F.lit("type_changed").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path")),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.withColumnRenamed("pair_no", "file_no")


def project(values: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One consistent table from path_values(): for each name, the value at a path, cast to a type. bad_casts lists the
    paths and raw texts of values that don't fit their column (which is null then); rest keeps all other paths."""
    cells = {name: F.col("fields")[path] for name, (path, _) in columns.items()}
    cast = {}
    for name, (_, kind) in columns.items():
        raw = cells[name]["raw"]
        cast[name] = F.from_json(raw, kind) if kind.startswith("array") else raw.try_cast(kind)
    bad = F.filter(F.array(*(F.when(cells[n]["raw"].isNotNull() & cast[n].isNull(), F.struct(F.lit(columns[n][0]).alias("path"), cells[n]["raw"].alias("raw"))) for n in columns)), lambda x: x.isNotNull())
    known = F.array(*(F.lit(p) for p, _ in columns.values()))
    rest = F.map_filter("fields", lambda k, v: ~F.array_contains(known, k))
    return values.select("row_no", "stream_id", "kind", "file_no", "line_no", "site", *(cast[n].alias(n) for n in columns), bad.alias("bad_casts"),
                         F.transform_values(rest, lambda k, v: v["raw"]).alias("rest"))


def column_map(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(stream_id, file_no, columns): columns maps each path of a file to the name its field had first in the stream.
    Renamings are those of changes(), each path in one of them at most, likest names first. No two paths of a file share a
    column: where a new path has the name of a field that goes on under another one, it is numbered."""
    def follow(held: pa.Table) -> pa.Table:
        paths, renamed, out = {}, {}, []
        for r in held.to_pylist():
            if r["new_path"] is None:
                paths.setdefault(r["file_no"], set()).add(r["path"])
            else:
                renamed.setdefault(r["file_no"], []).append((r["path"], r["new_path"]))
        before, known = {}, {}
        for f in sorted(paths):
            now = {p: before[p] for p in paths[f] if p in before}
            spent = set()
            for old, new in sorted(renamed.get(f, ()), key=lambda x: (-difflib.SequenceMatcher(None, *x).ratio(), *x)):
                if old in before and old not in spent and new not in now:
                    spent.add(old)
                    now[new] = before[old]
            taken = set(now.values())
            for p in sorted(paths[f] - set(now)):
                column, n = known.get(p, p), 1
                while column in taken:
                    n += 1
                    column = f"{p} {n}"
                now[p] = column
                taken.add(column)
            known |= now
            before = now
            out.append({"stream_id": held["stream_id"][0].as_py(), "file_no": f, "columns": list(now.items())})
        return pa.Table.from_pylist(out, pa.schema([("stream_id", pa.string()), ("file_no", pa.int32()), ("columns", pa.map_(pa.string(), pa.string()))]))

    renamed = changes(lines).where("change = 'renamed'").select(*_LINE, F.col("old_path").alias("path"), "new_path")
    paths = leaves.where("stream_id IS NOT NULL AND file_no IS NOT NULL").select(*_LINE, "path", F.lit(None).cast("string").alias("new_path")).distinct()
    return paths.unionByName(renamed).groupBy("stream_id").applyInArrow(follow, "stream_id string, file_no int, columns map<string, string>")


def consistent(lines: DataFrame) -> DataFrame:
    """One table of all lines with a typed column for every field: its type is the commonest of its values that aren't null
    (of equally common ones the first by name). A value of another type leaves its column null and is listed in bad_casts;
    nulls lists the paths that are null. Arrays are held as array<string>, elements that aren't strings as JSON."""
    values = materialize(path_values(lines))
    leaves = values.select(*_LINE, F.explode("fields").alias("path", "v")).select(*_LINE, "path")
    cells = F.transform_keys(F.transform_values("fields", lambda k, v: F.struct(k.alias("path"), v["type"].alias("type"), v["raw"].alias("raw"))), lambda k, v: F.coalesce(F.col("columns")[k], k))
    placed = materialize(values.join(column_map(lines, leaves), _LINE, "left").withColumn("cells", cells).drop("fields", "columns"))
    whole = F.coalesce(F.bool_and(F.when(F.col("v.type") == "number", F.col("v.raw").rlike("^-?[0-9]+$") & F.col("v.raw").try_cast("bigint").isNotNull())), F.lit(False))
    counted = placed.select(F.explode("cells").alias("field", "v")).groupBy("field").agg(whole.alias("whole"), *(F.count_if(F.col("v.type") == t).alias(t) for t in _KINDS)).limit(MOST_FIELDS + 1).collect()
    if len(counted) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields: no table can have a column for each")
    fixed = ["row_no", "stream_id", "kind", "file_no", "line_no", "site"]
    used, columns, kinds = {*fixed, "bad_casts", "nulls"}, [], []
    for r in sorted(counted, key=lambda r: r.field):
        kind = min(_KINDS, key=lambda t: (-r[t], t)) if any(r[t] for t in _KINDS) else "string"
        stem = name = re.sub(r"\W+", "_", r.field).lower() or "_"  # Spark takes names that differ in case for one
        n = 1
        while name in used:
            n += 1
            name = f"{stem}_{n}"
        used.add(name)
        cell = F.col("cells")[r.field]
        raw = F.when(cell["type"] == kind, cell["raw"])
        to = {"string": raw, "boolean": raw.try_cast("boolean"), "array": F.from_json(raw, "array<string>"), "number": raw.try_cast("bigint" if r.whole else "double")}[kind]
        columns.append(to.alias(name, metadata={"field": r.field}))
        kinds.append((r.field, kind))
    of = F.from_json(F.lit(json.dumps(dict(kinds))), "map<string, string>")
    said = F.transform(F.map_entries("cells"), lambda e: F.struct(e["value"]["path"].alias("path"), e["value"]["raw"].alias("raw"), e["value"]["type"].alias("type"), of[e["key"]].alias("column_type")))
    bad = F.filter(said, lambda x: (x["type"] != "null") & (x["type"] != x["column_type"]))
    nulls = F.array_sort(F.transform(F.filter(said, lambda x: x["type"] == "null"), lambda x: x["path"]))
    return placed.select(*fixed, *columns, F.array_sort(bad).alias("bad_casts"), nulls.alias("nulls"))


def cast_report(table: DataFrame) -> DataFrame:
    """Failed casts by stream, file and path."""
    return table.select(*_LINE, F.explode("bad_casts").alias("bad")).groupBy(*_LINE, F.col("bad.path").alias("path")).agg(F.count("*").alias("n_failed"))
