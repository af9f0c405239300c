import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from penduline.llm import tokenizer

pytestmark = pytest.mark.skipif(not Path(tokenizer.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    return tokenizer.read_vocabulary()


@pytest.fixture(scope="module")
def encoder(ranks):
    return tokenizer.PrefixEncoder(ranks)


@pytest.fixture(scope="module")
def plain(ranks):
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["a", " ", "\n\n  x", "<|endoftext|>", "don't we'll", "漢字とかな", "👩‍🔬 naïve café ½ ²", "a" * 30_000, "=" * 20_000, "ab" * 9_999, "é" * 5_000, "\x00‮﻿", "1234567890" * 300])
def test_same_ids_as_merging(encoder, plain, text):
    assert encoder.encode(text) == plain.encode_ordinary(text)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab ", max_size=60), st.text("aeinorst .,'\n", max_size=80)))
def test_any_text(encoder, plain, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert plain.decode(ids) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25), st.text("abc", max_size=40))
def test_any_merge_order(pairs, text):
    """Small vocabularies, each token a merge of two before it, kept if merging makes it. (A token that merging never makes is
    no token of ours; the other library takes it where it is a whole piece.)"""
    import tiktoken

    ranks = {bytes([k]): k for k in range(256)}
    made = [b"a", b"b", b"c"]
    for i, j in pairs:
        token = made[i % len(made)] + made[j % len(made)]
        if token not in ranks and tokenizer.split_of(token, {**ranks, token: len(ranks)}) is not None:
            ranks[token] = len(ranks)
            made.append(token)
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert tokenizer.PrefixEncoder(ranks).encode_piece(text) == (own.encode_ordinary(text) if text else [])


def test_merging_makes_every_token(ranks):
    assert all(tokenizer.split_of(t, ranks) is not None for t in ranks if len(t) > 1)


def test_null_empty_and_extra_columns(spark, plain):
    rows = [(1, None, "x"), (2, "", "x"), (3, "two words", "x"), (3, "two words", None), (4, "long " * 20_000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokenizer.encode(docs).collect())
    assert got == [(1, []), (2, []), (3, plain.encode_ordinary("two words")), (3, plain.encode_ordinary("two words")), (4, plain.encode_ordinary("long " * 20_000))]
    assert tokenizer.encode(docs).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert tokenizer.encode(docs.where("false")).count() == 0
    sizes = {(r.doc_id, r.n_tokens) for r in tokenizer.count_tokens(docs, ["doc_id"]).collect()}
    assert sizes == {(i, len(x)) for i, x in got}


def test_other_public_library_agrees(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    path = Path(tokenizer.VOCABULARY).with_suffix(".json")
    if not path.exists():
        pytest.skip("no such file")
    other = tokenizers.Tokenizer.from_file(str(path))
    other.encode_special_tokens = True
    for text in ("Half of it\ttakes  mention.", json.dumps({"a": [1, "ü"]}), "没有方差就很难判断样本量。"):
        assert encoder.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_vocabularies_that_look_alike_are_told_apart(spark, tmp_path):
    import base64

    texts = spark.createDataFrame([(1, "ab ba abab"), (2, None), (3, "")], "doc_id bigint, text string")
    for name, pair in (("one", b"ab"), ("two", b"ba")):
        tokens = [bytes([k]) for k in range(256)] + [pair]
        path = tmp_path / name
        path.write_bytes(b"".join(base64.b64encode(t) + f" {k}\n".encode() for k, t in enumerate(tokens)))
        plain = tokenizer.PrefixEncoder(tokenizer.read_vocabulary(str(path)))
        got = {r.doc_id: r.ids for r in tokenizer.encode(texts, vocabulary=str(path)).collect()}
        assert got == {1: plain.encode("ab ba abab"), 2: [], 3: []} and 256 in got[1]
