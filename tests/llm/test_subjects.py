import random

import pytest
from penduline.llm import subjects
from penduline.llm.sentences import sentences, words
from pyspark.sql import functions as F

TERMS = {
    "tea": ["kettle", "leaf", "infusion", "teapot", "saucer", "brewing", "blend", "camellia"],
    "boats": ["rudder", "mast", "keel", "harbour", "anchor", "sail", "rigging", "hull"],
    "chess": ["rook", "bishop", "gambit", "endgame", "castling", "pawn", "checkmate", "knight"],
}


@pytest.mark.parametrize(("text", "expected"), [
    (None, []), ("  \n ", []), ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("# Title\n\n- first item\n* second item\n1. third", ["first item", "second item", "third"]),
    ("Hard line\nbreaks here. Next\none.", ["Hard line breaks here.", "Next one."]), ("[10:00:01] WARN It broke.\n[10:00:02] INFO It went on.", ["It broke.", "It went on."]),
    ("> quoted line.\r\nown line.\r\n> again.", ["quoted line.", "own line.", "again."]), ("<p>First.</p>\n<p>Second.</p>", ["First.", "Second."]),
    ('{"note": ["A one.", "B two."], "rev": 5}', ["A one.", "B two."]), ("没有这个。还有那个？对！", ["没有这个。", "还有那个?", "对!"]), ("=====\n-----", []), ("ab\t1\ncd\t2\nthe end\nof it.", ["ab\t1", "cd\t2", "the end of it."]), ("[not json", ["[not json"]),
])
def test_sentences(text, expected):
    assert sentences(text) == expected


def test_words():
    assert words("The Rook-and_pawn, run 12 0x9fA3 xxxxxxxxx 车马炮 Übung") == ["the", "rook", "and_pawn", "run", "车马", "马炮", "übung"]


def _corpus(rng, n):
    frames = ["The {} was near the {} again.", "Nobody saw the {} before the {}.", "Between {} and {} there is a gap.", "See the {} and the {}."]
    plain = ["The list ends here.", "More on this next week.", "Thanks to everybody."]
    docs, truth = [], {}
    for d in range(n):
        chosen = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(frames).format(rng.choice(TERMS[s]), rng.choice(TERMS[s])) for s in chosen for _ in range(rng.randint(4, 6))]
        lines += [rng.choice(plain) for _ in range(rng.randint(1, 3))]
        rng.shuffle(lines)
        docs.append((d, " ".join(lines) if d % 2 else "\n".join(f"- {x}" for x in lines), "x"))
        truth[d] = set(chosen)
    return docs, truth


def test_subjects_are_found(spark):
    docs, truth = _corpus(random.Random(4), 400)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "1 2 3", "x"), (1003, docs[0][1], "x"), (1004, "The rook met the pawn. " * 5000, "x")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(d, s) for d in range(80) for s in (truth[d] or {None})] * 2 + [(81, "unknown"), (None, "tea"), (99999, "tea")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, "x") for s in TERMS] + [("empty", "x")], "subject string, scope string")
    got = {}
    for r in subjects.found(documents, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [d for d in truth if d >= 80]
    assert sum(got.get(d, set()) == truth[d] for d in held_out) >= 0.97 * len(held_out)
    assert not {1000, 1001, 1002} & set(got) and got.get(1003, set()) == got.get(0, set()) and got[1004] == {"chess"}
    topics = {r.topic: r.subject for r in subjects.topics(documents, areas, labels).collect()}
    assert set(TERMS) <= set(topics.values())
    makeup = {r.subject: r.n_docs for r in subjects.makeup(documents, areas, labels).collect()}
    assert makeup["empty"] == 0 and sum(makeup.values()) == sum(len(s) for s in got.values())


def test_without_labels_or_documents(spark):
    documents = spark.createDataFrame([(1, "The rook. The pawn.")] * 4, "doc_id bigint, text string")
    areas = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.found(documents, areas, labels).count() == 0
    assert subjects.found(documents.where("false"), areas, labels).count() == 0
    assert subjects.found(documents, areas.where(F.lit(False)), labels).count() == 0
