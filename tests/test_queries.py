"""Every query with an SQL twin, side by side over the smallest tables, where those are there."""

import datetime
import decimal
import glob
import importlib.util
import json
import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from penduline.operators import lineage, scoring
from penduline.queries import load, problems, problems_sql

TABLES = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
QUERIES = {**problems.QUERIES, **load()[0]}
SQL = {**problems_sql.SQL, **load()[1]}

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute("SET memory_limit = '4GB'")
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


#: Plans of large tables on small ones: no broadcasts, partitions merged and split at run time.
LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
         "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k"}


@pytest.fixture(params=["small", "large"])
def plans(request, spark):
    before = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items() if request.param == "large" else ():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, plans, name):
    df = QUERIES[name](spark, TABLES)
    names = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(SQL[name])
    theirs_names = [c[0] for c in cursor.description]
    assert sorted(theirs_names) == names
    theirs = sorted((tuple(_plain(dict(zip(theirs_names, r, strict=True))[c]) for c in names) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


# queries without a twin: what must hold of their rows, over whole tables


def _table(spark, name, tables=TABLES):
    return spark.read.parquet(f"{tables}/{name}.parquet")


def _hashes(spark, rows):
    def digest(body):
        try:
            return lineage.digest(json.loads(body))
        except ValueError:
            return None

    assert {r.record_id: r.sha256 for r in rows} == {r.record_id: digest(r.body) for r in _table(spark, "case_records").collect()}


def _groups(spark, rows):
    cases = {(r.scene_id, r.case_id) for r in _table(spark, "cases").select("scene_id", "case_id").distinct().collect()}
    assert sorted((r.scene_id, r.case_id) for r in rows) == sorted(cases)
    for scene in {r.scene_id for r in rows}:
        sizes = Counter(r.grp for r in rows if r.scene_id == scene)
        assert max(sizes.values()) - min(sizes.values()) <= 1


def _tracks(spark, rows):
    assert rows and {r.obj for r in rows} == {0, 1, 2}
    by_frame = Counter((r.series_id, r.frame) for r in rows)
    assert set(by_frame.values()) == {3}
    assert len({(r.series_id, r.frame, r.x, r.y) for r in rows}) == len(rows)


def _lines(spark, rows):
    def is_object(body):
        try:
            return isinstance(json.loads(body), dict) if body else False
        except ValueError:
            return False

    kept = {r.row_no for r in _table(spark, "manifest_lines").collect() if is_object(r.body)}
    assert sorted(r.row_no for r in rows) == sorted(kept)
    names = {c: f.metadata.get("field") for c, f in ((f.name, f) for f in QUERIES["p5_table"](spark, TABLES).schema.fields)}
    assert sum(v is not None for v in names.values()) > 20


def _casts(spark, rows):
    bad = Counter((r.stream_id, r.file_no, b.path) for r in QUERIES["p5_table"](spark, TABLES).collect() for b in r.bad_casts)
    assert rows and {(r.stream_id, r.file_no, r.path): r.n_failed for r in rows} == dict(bad)


CHECKS = {"canonical_json_hash": _hashes, "view_b_mt19937": _groups, "instance_tracking": _tracks, "p5_table": _lines, "p5_casts": _casts}
SCORES = ("free_fall_score", "incline_score", "orbit_score", "collision_score", "pendulum_score")


def test_every_query_is_checked():
    assert set(QUERIES) - set(SQL) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_rows(spark, name):
    CHECKS[name](spark, QUERIES[name](spark, TABLES).collect())


@pytest.mark.parametrize("name", SCORES)
def test_scores(spark, name):
    """One row for each pair of users, scored within 0..1 or with a reason; the total is the weighted sum of its parts."""
    tables = TABLES.replace("sf0.001", "sf0.01")
    users = {r.user_id for r in _table(spark, "events", tables).select("user_id").distinct().collect()}
    rows = QUERIES[name](spark, tables).collect()
    assert sorted(r.job_id for r in rows) == sorted(u for u in users if u + 75 in users)
    weights = getattr(scoring, name.removesuffix("_score").upper())["weights"]
    for r in rows:
        assert (r.status == "evaluated") == (r.reason_code is None)
        parts = {k: r[k] for k in weights if r[k] is not None}
        if r.status == "evaluated" and parts:
            assert all(0 <= v <= 1 for v in parts.values()) and 0 <= r.score <= 1
            assert r.score == pytest.approx(sum(weights[k] * v for k, v in parts.items()) / sum(weights[k] for k in parts), abs=1e-4)


def test_the_rest_works_without_the_texts_subpackage(tmp_path):
    home = Path(importlib.util.find_spec("penduline").origin).parent
    for path in home.rglob("*.py"):
        if "llm" not in path.relative_to(home).parts:
            assert "penduline.llm" not in path.read_text(encoding="utf-8")
    shutil.copytree(home, tmp_path / "penduline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home.parent / "__spark_entry__.py", tmp_path)
    code = ("import importlib, pathlib, __spark_entry__ as e\n"
            "for p in pathlib.Path('penduline').rglob('*.py'): importlib.import_module('.'.join(p.with_suffix('').parts).removesuffix('.__init__'))\n"
            "q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
