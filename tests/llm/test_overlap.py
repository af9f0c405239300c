import random
import re
from collections import Counter

from penduline.llm import overlap
from pyspark.sql import functions as F

CASE = "case_id string, text struct<description string, prompt string>, provenance struct<source_kind string, parent_case_id string>, received_at timestamp_ntz, text_extra string"
VIEW = "dataset_id string, release_no int, delivered_at timestamp_ntz, scenes map<string, map<string, array<string>>>, case_id string"


def _cases(spark, rows):
    return spark.createDataFrame([(i, (t, None), ("real_capture", p), None, None) for i, t, p in rows], CASE)


def _view(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], VIEW)


def _brute(train, evaluation, rows):
    bags = [(i, Counter(re.findall(r"[^\W_]+", t.lower()))) for i, t, _ in rows if t]
    out = {(i, i) for i in train & evaluation}
    for i, a in bags:
        for j, b in bags:
            if i in train and j in evaluation and i != j and a and b and 5 * sum((a & b).values()) >= 4 * max(sum(a.values()), sum(b.values())):
                out.add((min(i, j), max(i, j)))
    out |= {(min(p, i), max(p, i)) for i, _, p in rows if p in train and i in evaluation}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["a", "b", "c"] * 10
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((f"c{k}", " ".join(words), None))
        if k % 3 == 0:  # a near copy: shuffled, some words changed, other case and punctuation
            again = words[:]
            rng.shuffle(again)
            for _ in range(rng.randint(0, len(again) // 4)):
                again[rng.randrange(len(again))] = rng.choice(vocabulary)
            rows.append((f"n{k}", ", ".join(again).upper() + "!", f"c{k}" if k % 2 else "c1"))
    rows += [("null", None, None), ("blank", " .,;", None), ("long", "x " * 5000, None), ("long2", "x " * 4999, "nowhere"), ("c0", rows[0][1], None)]
    ids = sorted({r[0] for r in rows})
    train = {i for i in ids if rng.random() < 0.55}
    evaluation = {i for i in ids if i not in train or rng.random() < 0.1}
    train.add("long")
    evaluation.add("long2")
    view = _view(spark, [("d", 1, None, {"s": {"train": ids}}), ("d", 2, None, {"s": {"train": [*sorted(train), None], "test_id": sorted(evaluation)[:20], "test_ood1": sorted(evaluation)[20:]}, "e": None}), (None, 9, None, {"s": {"train": ids}})])
    got = {tuple(r) for r in overlap.found(view, _cases(spark, rows)).collect()}
    assert got == _brute(train, evaluation, rows)


def test_last_delivery_counts_and_reasons(spark):
    from datetime import datetime

    t = [datetime(2024, 1, d) for d in (1, 2)]
    view = _view(spark, [("d", 2, t[0], {"s": {"train": ["x"], "test_id": ["x"]}}), ("d", 2, t[1], {"s": {"train": ["a"], "test_id": ["b", "b"]}}), ("e", 1, t[0], {"s": {"train": ["b"]}})])
    cases = _cases(spark, [("a", "One two, three", None), ("b", "three TWO one", "a")])
    rows = {(r.train_id, r.eval_id, r.why) for r in overlap.cross_split_pairs(view, cases).collect()}
    assert rows == {("b", "b", "same_id"), ("a", "b", "similar_text"), ("a", "b", "parent")}
    counts = overlap.counts(view, cases).collect()
    assert [(r.split, r.source_kind, r.pairs, r.same_id, r.similar_text, r.parent) for r in counts] == [("test_id", "real_capture", 2, 1, 1, 1)]


def test_empty_tables(spark):
    assert overlap.found(_view(spark, []), _cases(spark, [])).count() == 0


def test_a_word_that_all_records_share(spark, monkeypatch):
    """Every word is frequent, one is in all records: no pair is lost, and all records don't meet by that word."""
    monkeypatch.setattr(overlap, "OFTEN", 2)
    monkeypatch.setattr(overlap, "LONG", 30)
    rng = random.Random(4)
    rows = []
    for k in range(150):
        n = rng.choice((1, 2, 3, 5, 9, 20, 24, 25, 29, 30, 31, 36, 38))
        rows.append((f"c{k}", " ".join(["all", *(rng.choice("abcdefgh") * rng.choice((1, 2)) for _ in range(n))]), None))
    ids = [r[0] for r in rows]
    train, evaluation = set(ids[::2]), set(ids[1::2])
    view = _view(spark, [("d", 1, None, {"s": {"train": ids[::2], "test_id": ids[1::2]}})])
    assert {tuple(r) for r in overlap.found(view, _cases(spark, rows)).collect()} == _brute(train, evaluation, rows)
    bags = overlap.words(F.col("text"))
    classes = spark.createDataFrame([(r[0], r[1]) for r in rows], "class_id string, text string").select(
        F.col("class_id").cast("binary").alias("class_id"), F.lit(True).alias("of_train"), F.lit(True).alias("of_eval"), bags.alias("bag"))
    short = overlap.marked(classes).where("5 * n <= 4 * 30")
    assert short.select(F.explode("t_keys").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] < short.count() / 2


def test_classes_hold_copies_once(spark):
    ids = spark.createDataFrame([(f"c{k}",) for k in range(6)], "case_id string")
    texts = ids.select("case_id", F.lit("The same, words. Five!").alias("text"))
    membership, classes = overlap.text_classes(ids.where("case_id < 'c3'"), ids.where("case_id >= 'c3'"), texts)
    assert (membership.count(), classes.count(), overlap.class_pairs(classes).count()) == (6, 1, 1)
    assert overlap.near_pairs(ids.where("case_id < 'c3'"), ids.where("case_id >= 'c3'"), texts).count() == 9
