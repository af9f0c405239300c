"""Same or near-same records across splits.

Records are canonicalised (case, punctuation, white space and word order are normalised away), hashed, and the
evaluation hashes are joined with the training hashes. Exact copies share one class, so they meet once, not once per
copy. Near copies meet through hashes of their rarest words: when at least four fifths of the longer record's words are
shared, the two lists of words, ordered from rare to frequent, share a word within their first n - ceil(0.8 n) + 1, and their
two first shared words lie within one more. A rare word is a key by itself; of frequent words it takes two, so that a word
that all records share doesn't bring all of them together. Two classes that differ share two words at least, so both
keys are there. Texts of more than LONG words, which would have too many pairs, use single words throughout. Under frequent
words only those records meet whose lengths allow a match: of a record of n words that shares none of its first k, the
partner has 5/4 (n - k) words at most.
The candidates are then verified on whole lists of 64-bit word hashes, so no pair is lost, and none is wrong but by a
collision of hashes within one pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penduline.session import materialize

#: A word is frequent if more than OFTEN records and more than one of FREQUENT_ONE_IN have it. As the words of all records
#: number at most records x mean length, at most FREQUENT_ONE_IN x mean length are frequent: the broadcast list is bounded.
OFTEN, FREQUENT_ONE_IN = 500, 10_000
#: Words up to which frequent words are paired; at most 42 words are then in question, so 861 pairs.
LONG = 200


def words(text: Column) -> Column:
    """Sorted words (runs of letters and digits, lower case) with repeats; null for a null text, [] for a blank one."""
    return F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def last_release_members(view: DataFrame) -> DataFrame:
    """(case_id, split) of the last delivery of the highest release of each dataset, each once.

    Rows without dataset_id or release_no are no releases. Deliveries of one release at the same instant all count.
    """
    named = view.where("dataset_id IS NOT NULL AND release_no IS NOT NULL")
    last = named.groupBy("dataset_id").agg(F.max(F.struct("release_no", "delivered_at")).alias("last")).select(
        "dataset_id", "last.release_no", F.col("last.delivered_at").alias("at"))
    rows = named.join(last, ["dataset_id", "release_no"]).where(F.col("delivered_at").eqNullSafe(F.col("at")))
    return (
        rows.select(F.explode("scenes").alias("scene", "groups"))
        .select(F.explode("groups").alias("split", "ids"))
        .select("split", F.explode("ids").alias("case_id"))
        .where("case_id IS NOT NULL")
        .distinct()
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(starts: np.ndarray, total: int) -> np.ndarray:
    """Place of each of `total` elements in its group, the groups beginning at starts."""
    begins = np.zeros(total, np.int64)
    begins[starts] = starts
    return np.arange(total) - np.maximum.accumulate(begins)


def _marks(bags: pa.ListArray, frequent: dict[str, int]) -> tuple:
    """For the sorted bags of a batch: lengths, token hashes, sketches (rows of four integers), (rare words that are keys, whose)
    and (keys of frequent words, whose, own and longest length class in question).

    Repeats are tokens of their own (a, a -> a first, a second), so that the overlap of bags is that of sets."""
    import xxhash

    flat, lengths = bags.flatten(), np.diff(bags.offsets.to_numpy())
    coded = flat.dictionary_encode()
    held = coded.dictionary.to_pylist()
    total, code = len(flat), coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.ones(total, bool)
    first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    repeat = _within(np.nonzero(first)[0], total)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in held], np.uint64)
    count = np.array([frequent.get(w, 0) for w in held], np.int64)[code] if total else np.zeros(0, np.int64)
    token = _mixed(hashed[code] + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if total else np.zeros(0, np.uint64)

    bits = np.bincount(doc * 256 + (token & np.uint64(255)).astype(np.int64), minlength=256 * len(lengths)) & 1
    sketch = np.packbits(bits.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64)

    order = np.lexsort((token, count, doc))
    place = _within(np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0], total)
    n = lengths[doc]
    needed = n - (4 * n + 4) // 5 + 1
    ranked, hot = token[order], count[order] > 0
    rare = (place < needed) & ~hot
    singles, single_of = ranked[rare], doc[rare]

    # keys of frequent words, whose they are and the place of their first word
    lone = (place < needed) & hot & (5 * n > 4 * LONG)
    paired = (place <= needed) & hot & (n <= LONG)
    keys, owner, at = [ranked[lone]], [doc[lone]], [place[lone]]
    per_doc = np.bincount(doc[paired], minlength=len(lengths))
    begin = np.concatenate([[0], np.cumsum(per_doc)])
    kept, kept_at = ranked[paired], place[paired]
    for m in np.unique(per_doc[per_doc > 1]):
        of = np.nonzero(per_doc == m)[0]
        cells = begin[of][:, None] + np.arange(m)
        i, j = np.triu_indices(m, 1)
        keys.append(_mixed(kept[cells[:, i]] * np.uint64(3) + kept[cells[:, j]]).ravel())
        owner.append(np.repeat(of, len(i)))
        at.append(kept_at[cells[:, i]].ravel())
    key, own, place_of = np.concatenate(keys), np.concatenate(owner), np.concatenate(at)
    # n words, of which `place_of` are not shared, match at most 5/4 of the rest: a record looks for longer ones up to there
    low, high = _length_class(lengths[own]), _length_class(5 * (lengths[own] - place_of) // 4)
    return lengths, token.view(np.int64), sketch, (singles, single_of), (key, own, low, high)


def _length_class(n: np.ndarray) -> np.ndarray:
    """Classes of lengths, each an eighth longer than the one before."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.12) + 1e-9).astype(np.int64)


def _side_keys(singles: tuple, framed: tuple, wanted: np.ndarray, of_train: bool) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of keys, keys) of the records wanted. Rare words are keys as they are. With frequent ones, a training record
    shows its length class to shorter evaluation records and looks for those of its class or longer; and the other way."""
    key, own, low, high = (x[wanted[framed[1]]] for x in framed)
    first = low if of_train else low + 1
    each = np.maximum(high - first + 1, 0)
    sought = np.repeat(first, each) + _within((np.cumsum(each) - each)[each > 0], int(each.sum()))
    step, look, show = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 if of_train else 2), np.uint64(2 if of_train else 1)
    kept = wanted[singles[1]]
    every = np.concatenate([singles[0][kept], _mixed(key + low.astype(np.uint64) * step + show), _mixed(np.repeat(key, each) + sought.astype(np.uint64) * step + look)])
    of = np.concatenate([singles[1][kept], own, np.repeat(own, each)])
    return np.bincount(of, minlength=len(wanted)), every[np.argsort(of, kind="stable")].view(np.int64)


def marked(classes: DataFrame) -> DataFrame:
    """(class_id, of_train, of_eval, n, tokens, t_keys, e_keys, b0..b3) of classes(class_id, of_train, of_eval, bag): n words,
    their hashes, the keys under which the class may meet others as one of training and as one of evaluation, and a sketch:
    each word flips one of 256 bits."""
    total = classes.count()
    frequent = (
        classes.select(F.explode(F.array_distinct("bag")).alias("word"))
        .groupBy("word").count().where(F.col("count") > max(OFTEN, total // FREQUENT_ONE_IN))
    )
    counts = classes.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in frequent.toLocalIterator()})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                bags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(part["bag"].offsets.to_numpy()))]), pa.int32()), part["bag"].flatten())
                lengths, tokens, sketch, singles, framed = _marks(bags, heavy)
                sides = [_side_keys(singles, framed, part[f].to_numpy(zero_copy_only=False).astype(bool), f == "of_train") for f in ("of_train", "of_eval")]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(v)) for k, v in ((lengths, tokens), *sides)]
                yield pa.RecordBatch.from_arrays(
                    [part["class_id"], part["of_train"], part["of_eval"], pa.array(lengths, pa.int32()), *lists, *(pa.array(sketch[:, k]) for k in range(4))],
                    names=["class_id", "of_train", "of_eval", "n", "tokens", "t_keys", "e_keys", "b0", "b1", "b2", "b3"])

    return classes.where(F.size("bag") > 0).select("class_id", "of_train", "of_eval", "bag").mapInArrow(
        emit, "class_id binary, of_train boolean, of_eval boolean, n int, tokens array<bigint>, t_keys array<bigint>, e_keys array<bigint>, b0 bigint, b1 bigint, b2 bigint, b3 bigint")


def text_classes(train: DataFrame, evaluation: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, classes). membership: class_id, case_id, is_train of every id with a text of words, copies included.
    classes: class_id, bag, of_train, of_eval of every distinct list of words."""
    sides = train.select("case_id", F.lit(True).alias("is_train")).unionByName(
        evaluation.select("case_id", F.lit(False).alias("is_train")))
    bags = texts.where("text IS NOT NULL").select("case_id", words(F.col("text")).alias("bag")).where(F.size("bag") > 0)
    members = materialize(
        bags.join(sides, "case_id")
        .select("case_id", "is_train", "bag", F.substring(F.unhex(F.sha2(F.array_join("bag", " "), 256)), 1, 16).alias("class_id"))
    )
    classes = members.groupBy("class_id").agg(
        F.first("bag").alias("bag"), F.max("is_train").alias("of_train"), F.max(~F.col("is_train")).alias("of_eval"))
    return members.select("class_id", "case_id", "is_train").distinct(), materialize(classes)


def class_pairs(classes: DataFrame) -> DataFrame:
    """(t_class, e_class): classes of training and of evaluation texts that share at least four fifths of the longer one's
    words; a class that has texts of both splits is paired with itself. With the membership this is the whole result,
    without the pairs of copies."""
    marks = materialize(marked(classes))

    def side(mark: str) -> DataFrame:
        names = {"class_id": "class", "n": "n", "b0": "b0", "b1": "b1", "b2": "b2", "b3": "b3"}
        return marks.select(F.explode(f"{mark}_keys").alias("key"), *(F.col(c).alias(f"{mark}_{a}") for c, a in names.items()))

    longer = F.greatest("t_n", "e_n")
    apart = sum((F.bit_count(F.col(f"t_b{k}").bitwiseXOR(F.col(f"e_b{k}"))) for k in range(4)), F.lit(0))
    # words of one text only flip bits, so the sketches differ in no more bits than the texts in words
    candidates = side("t").join(side("e"), "key").where(
        (5 * F.least("t_n", "e_n") >= 4 * longer) & (5 * (F.col("t_n") + F.col("e_n") - apart) >= 8 * longer) & (F.col("t_class") != F.col("e_class"))
    ).select("t_class", "e_class").distinct()
    tokens = {m: marks.select(F.col("class_id").alias(f"{m}_class"), F.col("tokens").alias(f"{m}_tokens")) for m in "te"}
    near = candidates.join(tokens["t"], "t_class").join(tokens["e"], "e_class").where(
        5 * F.size(F.array_intersect("t_tokens", "e_tokens")) >= 4 * F.greatest(F.size("t_tokens"), F.size("e_tokens")))
    same = classes.where("of_train AND of_eval").select(F.col("class_id").alias("t_class"), F.col("class_id").alias("e_class"))
    return near.select("t_class", "e_class").unionByName(same)


def near_pairs(train: DataFrame, evaluation: DataFrame, texts: DataFrame) -> DataFrame:
    """(train_id, eval_id) of different ids whose texts share at least four fifths of the longer one's words.

    train, evaluation: case_id. texts: case_id, text; an id may have several texts, any pair of which may match.
    Null texts and texts without any word match nothing.
    """
    belongs, classes = text_classes(train, evaluation, texts)
    of_train = belongs.where("is_train").select(F.col("class_id").alias("t_class"), F.col("case_id").alias("train_id"))
    of_eval = belongs.where("NOT is_train").select(F.col("class_id").alias("e_class"), F.col("case_id").alias("eval_id"))
    return (
        class_pairs(classes).join(of_train, "t_class").join(of_eval, "e_class")
        .where("train_id <> eval_id").select("train_id", "eval_id").distinct()
    )


def cross_split_pairs(view: DataFrame, cases: DataFrame, eval_splits: tuple[str, ...] = ("test_id", "test_ood1")) -> DataFrame:
    """(train_id, eval_id, why): every pair with each reason that holds for it: same_id, similar_text, parent.

    Empty tables give no rows. Ids listed but never delivered still pair by id. Null ids, parents and texts match nothing.
    """
    members = materialize(last_release_members(view))
    train = members.where("split = 'train'").select("case_id").distinct()
    evaluation = members.where(F.col("split").isin(*eval_splits)).select("case_id").distinct()
    same = train.join(evaluation, "case_id").select(F.col("case_id").alias("train_id"), F.col("case_id").alias("eval_id"), F.lit("same_id").alias("why"))
    parents = (
        cases.select("case_id", F.col("provenance.parent_case_id").alias("parent")).where("parent IS NOT NULL").distinct()
        .join(evaluation, "case_id", "left_semi")
        .join(train.select(F.col("case_id").alias("parent")), "parent", "left_semi")
        .select(F.col("parent").alias("train_id"), F.col("case_id").alias("eval_id"), F.lit("parent").alias("why"))
    )
    texts = cases.select("case_id", F.col("text.description").alias("text")).distinct()
    near = near_pairs(train, evaluation, texts).withColumn("why", F.lit("similar_text"))
    return same.unionByName(near).unionByName(parents)


def found(view: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_a, case_b), smaller first, each pair once."""
    return cross_split_pairs(view, cases).select(
        F.least("train_id", "eval_id").alias("case_a"), F.greatest("train_id", "eval_id").alias("case_b")).distinct()


def counts(view: DataFrame, cases: DataFrame) -> DataFrame:
    """Overlaps per evaluation split and provenance.source_kind of the evaluation case's last row ('' if none):
    pairs, evaluation cases concerned, and pairs by reason. A pair counts once in each split that lists its case."""
    members = last_release_members(view).where("split <> 'train'").select("split", F.col("case_id").alias("eval_id"))
    kinds = cases.select("case_id", "received_at", F.col("provenance.source_kind").alias("kind")).groupBy("case_id").agg(
        F.max_by("kind", F.struct("received_at", "kind")).alias("source_kind"))
    pairs = cross_split_pairs(view, cases).groupBy("train_id", "eval_id").agg(
        *(F.max(F.when(F.col("why") == w, 1).otherwise(0)).alias(w) for w in ("same_id", "similar_text", "parent")))
    return (
        pairs.join(members, "eval_id").join(kinds.withColumnRenamed("case_id", "eval_id"), "eval_id", "left")
        .groupBy("split", F.coalesce("source_kind", F.lit("")).alias("source_kind"))
        .agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_cases"),
             *(F.sum(w).cast("bigint").alias(w) for w in ("same_id", "similar_text", "parent")))
    )
