from collections import Counter, defaultdict

import pytest
from penduline.llm import mixing, tokenizer

TARGETS = "mix_id string, source string, target_weight double, max_repeats int, rate string"


def _docs(spark, counts):
    rows, n = [], 0
    for source, k in counts.items():
        for i in range(k):
            rows.append((n, "word " * (5 + i % 7), source, 1))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")


def _targets(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], TARGETS)


def test_shares_and_caps(spark):
    docs = _docs(spark, {"big": 1500, " Big ": 300, "BIG": 50, "small_one": 60, "small-one": 20, "rest": 500, None: 40, "  ": 5})
    targets = _targets(spark, [("m", "big", 2.0, None), ("m", "small one", 1.0, 4), ("m", "rest", 1.0, 3), ("m", "nowhere", 5.0, 2), ("m", "big", 0.0, None), ("z", "rest", 0.0, 1), ("y", "small_one", 0.3, 2)])
    out = mixing.shares(docs, targets).collect()
    m = {r.source: r for r in out if r.mix_id == "m"}
    assert m["nowhere"].target_share == 0 and m["nowhere"].out_docs == 0
    assert abs(sum(r.target_share for r in m.values()) - 1) < 1e-9
    for r in m.values():
        assert abs(r.actual_share - r.target_share) < 0.04
        assert r.max_repeats is None or r.most_copies <= r.max_repeats
    assert m["small_one"].rate == pytest.approx(4) and m["small_one"].out_docs == 320
    assert [r.out_docs for r in out if r.mix_id == "z"] == [0]
    assert [r.rate for r in out if r.mix_id == "y"] == [pytest.approx(1.0)]
    rows = mixing.mix(docs, targets).collect()
    copies = Counter((r.mix_id, r.doc_id) for r in rows)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.mix_id, r.source] += r.n_tokens
    assert {k: v for k, v in tokens.items()} == {(r.mix_id, r.source): r.out_tokens for r in out if r.out_docs}
    for r in out:
        per_doc = [n for (mix, d), n in copies.items() if mix == r.mix_id]
        assert not per_doc or max(per_doc) <= 4
    assert sorted((r.mix_id, r.doc_id, r.copy_no) for r in mixing.mix(docs, targets).collect()) == sorted((r.mix_id, r.doc_id, r.copy_no) for r in rows)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", 0), (2, "", "a", 0), (3, "x", "b", 0)], "doc_id bigint, text string, source string, n_tokens int")
    targets = _targets(spark, [("m", "a", 1.0, 2), ("m", "b", None, 2), ("m", None, 1.0, 1), ("n", "b", 1.0, 0), ("o", "b", -1.0, 1)])
    assert mixing.mix(docs, targets).count() == 0
    assert mixing.mix(docs.where("false"), targets).count() == 0
    assert mixing.mix(docs, targets.where("false")).count() == 0
    assert mixing.shares(docs, targets).count() == 5


def test_a_given_size_and_what_a_cap_withholds(spark):
    docs = _docs(spark, {"big": 300, "tiny": 10})
    targets = _targets(spark, [("m", "big", 1.0, None), ("m", "tiny", 1.0, 2)])
    held = {r.source: r.source_tokens for r in mixing.shares(docs, targets).collect()}
    size = 2 * held["big"]
    got = {r.source: r for r in mixing.shares(docs, targets, tokens=size).collect()}
    assert got["big"].rate == pytest.approx(1.0) and got["big"].shortfall == 0 and got["big"].out_docs == 300
    assert got["tiny"].rate == 2.0 and got["tiny"].out_docs == 20 and got["tiny"].shortfall == held["big"] - 2 * held["tiny"]
    assert got["big"].actual_share > 0.9 and {r.shortfall for r in mixing.shares(docs, targets).collect()} == {0}
    assert mixing.mix(docs, targets, tokens=size).count() == 320


def test_vocabulary_is_a_parameter():
    assert "vocabulary" in mixing.mix.__annotations__ and tokenizer.VOCABULARY.endswith(".tiktoken")
