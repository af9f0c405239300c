"""Queries on texts over whole tables: side by side with their SQL, or by what must hold of their rows."""

import glob
import os
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from penduline.llm import queries, tokenizer

TABLES = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = queries.QUERIES[name](spark, TABLES)
        names = sorted(df.columns)
        ours = sorted(tuple(r[c] for c in names) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    cursor = duck.execute(queries.SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == names
    assert ours == sorted(tuple(dict(zip(order, r, strict=True))[c] for c in names) for r in cursor.fetchall())


def _table(spark, name, tables=TABLES):
    return spark.read.parquet(f"{tables}/{name}.parquet").collect()


@pytest.mark.skipif(not Path(tokenizer.VOCABULARY).exists(), reason="no vocabulary here")
def test_ids(spark):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_vocabulary(), special_tokens={})
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, TABLES).collect()}
    assert got == {r.doc_id: plain.encode_ordinary(r.text or "") for r in _table(spark, "documents")}


@pytest.mark.skipif(not Path(tokenizer.VOCABULARY).exists(), reason="no vocabulary here")
def test_mixes(spark):
    rows = queries.p7_mix(spark, TABLES).collect()
    shares = {(r.mix_id, r.source): r for r in queries.p7_shares(spark, TABLES).collect()}
    assert rows and {r.mix_id for r in _table(spark, "mix_targets")} == {m for m, _ in shares}
    copies, tokens = Counter((r.mix_id, r.source, r.doc_id) for r in rows), defaultdict(int)
    for r in rows:
        tokens[r.mix_id, r.source] += r.n_tokens
    assert all(shares[m, s].max_repeats is None or n <= shares[m, s].max_repeats for (m, s, _), n in copies.items())
    assert {k: r.out_tokens for k, r in shares.items() if r.out_tokens} == dict(tokens)
    for mix in {m for m, _ in shares}:
        assert sum(r.target_share for (m, _), r in shares.items() if m == mix) == pytest.approx(1, abs=1e-6)


def test_subjects(spark):
    tables = TABLES.replace("sf0.001", "sf0.01")
    got, said = defaultdict(set), defaultdict(set)
    for r in queries.p8_found(spark, tables).collect():
        assert r.subject not in got[r.doc_id]
        got[r.doc_id].add(r.subject)
    assert set().union(*got.values()) <= {r.subject for r in _table(spark, "subject_areas", tables)}
    for r in _table(spark, "subject_labels", tables):
        said[r.doc_id].add(r.subject)
    right = sum(got.get(d, set()) == {s for s in v if s} for d, v in said.items())
    assert right >= 0.93 * len(said)
    assert len(queries.p8_topics(spark, tables).collect()) == 10
