"""Subject areas of documents, by latent Dirichlet topics.

1. Each document is cut into sentences and words, whatever its language and form; words are hashed into BUCKETS numbers.
2. A latent Dirichlet model is fitted to all documents by distributed variational Bayes. A document draws topic proportions;
   each of its sentences draws one topic of them, or none; each word of a sentence with a topic comes from that topic with
   the probability OWN, else, as all words of a sentence with none, from the words that are due to no topic. The partitions infer the proportions of their documents
   and add up expected word counts; the driver gets the sums (topics x buckets at most) only. The hand labels give the
   starting point and a weak prior: each topic begins with words that are typical of the documents with one label.
3. The topics are mapped to subjects by their top terms: those terms' typicality for each subject decides, so a topic may
   drift to another subject than it began with, or to none.
4. The proportions of every document are inferred under the fitted topics, in sentences: the sum over its sentences of the
   probability of a topic. A document has the subjects whose topics hold at least a quarter of it.

Everything is counted over all documents, with the same rules at every size; two words that share a bucket count as one.
Null, empty and wordless documents have no subject. Without any label no topic can be mapped and there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penduline.llm.sentences import sentence_words, sentences
from penduline.session import broadcast_if_small, materialize, spread

#: Numbers for words. The driver holds some matrices of topics x BUCKETS, whatever the size of the corpus.
BUCKETS = 1 << 18
#: Rounds of the fit over all documents, and of inference within a document.
ROUNDS, INNER = 3, 4
#: Dirichlet priors of a topic and of none in a document, the labels' weight, and by how many words in the whole corpus a
#: word's rate in a topic is drawn towards its rate outside.
ALPHA, ALPHA_NONE, PRIOR, SHRINK = 0.1, 0.5, 0.3, 5.0
#: Probability that a word of a sentence with a topic comes from that topic.
OWN = 0.15
#: A word is typical of a subject, and a topic is mapped to one, if the share of its labelled rate lies so far above even
#: shares, on the way from those to 1.
TYPICAL, MAPPED = 0.28, 0.22
#: Top terms by which a topic is mapped.
TOP_TERMS = 30
#: The least proportion of a document, and by how many sentences it may be missed, as probabilities don't reach 1.
SHARE, SLACK = 0.25, 0.15
#: Words handled at once in a worker.
CHUNK = 60_000


def split_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>, ends array<int>): the numbers of all words in order, and where each sentence ends."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers().__getitem__
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                every, ends = [], []
                for text in part["text"].to_pylist():
                    flat: list[int] = []
                    stops = []
                    for found in sentence_words(sentences(text)):
                        flat += map(number, found)
                        stops.append(len(flat))
                    every.append(flat)
                    ends.append(stops)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(every, schema.field(1).type), pa.array(ends, schema.field(2).type)], schema=schema)

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>, ends array<int>")


def bucket(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % BUCKETS


class _Numbers(dict):
    """Words to their numbers; a million of them are remembered."""

    def __missing__(self, word: str) -> int:
        k = bucket(word)
        if len(self) < 1_000_000:
            self[word] = k
        return k


def _digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: six steps of the recurrence, then the asymptotic series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):
        shift -= 1 / y
        y += 1
    f = 1 / (y * y)
    return shift + np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f / 252))


def _sums(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of groups of consecutive rows; of an empty group 0."""
    out = np.zeros((len(starts), rows.shape[1]), rows.dtype)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(rows, starts[full], 0)
    return out


def infer(said: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probabilities of the topics, the last column being none, of each sentence, by variational inference in its document.
    said: log likelihood ratios (sentences x topics) against none; first, count: the sentences of each document."""
    n = said.shape[1]
    alpha = np.array([ALPHA] * n + [ALPHA_NONE])
    logit = np.concatenate([said, np.zeros((len(said), 1))], 1)
    doc = np.repeat(np.arange(len(count)), count)
    likely = np.exp(logit - logit.max(1, keepdims=True))
    p = likely / likely.sum(1, keepdims=True)
    for _ in range(INNER):
        gamma = alpha + _sums(p, first, count)
        p = np.exp(_digamma(gamma))[doc] * likely
        p /= p.sum(1, keepdims=True)
    return p


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about CHUNK words, a longer document being a run of its own: (documents, ids, and starts and
    lengths of their sentences in words, first sentences and numbers of sentences of the documents)."""
    ids, lengths = batch["ids"].flatten().to_numpy(zero_copy_only=False), np.diff(batch["ids"].offsets.to_numpy())
    ends, per_doc = batch["ends"].flatten().to_numpy(zero_copy_only=False), np.diff(batch["ends"].offsets.to_numpy())
    starts, stops = np.cumsum(lengths) - lengths, np.cumsum(lengths)
    sentence_stop = np.repeat(starts, per_doc) + ends
    sentence_start = np.concatenate([[0], sentence_stop[:-1]]) if len(sentence_stop) else sentence_stop
    sentences_before = np.concatenate([[0], np.cumsum(per_doc)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + CHUNK, "right")))
        a, b = sentences_before[at], sentences_before[to]
        yield (slice(at, to), ids[starts[at] : stops[to - 1]], sentence_start[a:b] - starts[at], (sentence_stop - sentence_start)[a:b],
               sentences_before[at:to] - a, per_doc[at:to])
        at = to


class TopicModel:
    """Topics of a corpus. counts: expected words (topics x buckets); occurs: words of the corpus in each bucket."""

    def __init__(self, counts: np.ndarray, occurs: np.ndarray) -> None:
        self.counts, self.occurs = counts, occurs
        rest = np.maximum(occurs - counts.sum(0), 0)
        share, share_of_rest = (counts.sum(1, keepdims=True) + 1) / (occurs.sum() + 1), (rest.sum() + 1) / (occurs.sum() + 1)
        rate = (counts / share + SHRINK) / (rest / share_of_rest + SHRINK)
        #: how many times likelier a word is in a sentence with the topic than in one with none: its log, buckets x topics
        self.odds = np.ascontiguousarray(np.log(1 - OWN + OWN * rate).T.astype(np.float32))
        #: the part of a word's occurrences under a topic that is due to the topic
        self.due = OWN * rate / (1 - OWN + OWN * rate)

    def mapped(self, typical: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(top terms, affinity topics x subjects, subject of each topic or -1)."""
        relevance = self.counts * np.maximum(self.odds.T, 0)
        top = np.argsort(-relevance, axis=1, kind="stable")[:, :TOP_TERMS]
        affinity = np.zeros((len(self.counts), len(typical)))
        for k, terms in enumerate(top):
            affinity[k] = (typical[:, terms] * relevance[k, terms]).sum(1) / max(relevance[k, terms].sum(), 1e-12)
        return top, affinity, [int(a.argmax()) if a.max() >= _above_even(MAPPED, len(typical)) else -1 for a in affinity]


def _above_even(part: float, n: int) -> float:
    return 1 / n + part * (1 - 1 / n) if n > 1 else 0.5


def expected(batches: Iterator[pa.RecordBatch], odds: np.ndarray) -> np.ndarray:
    """Expected words under each topic (buckets x topics) in some documents."""
    total = np.zeros(odds.shape)
    for batch in batches:
        for _, ids, starts, lengths, first, count in _chunks(batch):
            if len(ids):
                p = infer(_sums(odds[ids], starts, lengths), first, count)[:, :-1].astype(np.float32)
                p[p < 1e-3] = 0
                order = np.argsort(ids, kind="stable")
                held = ids[order]
                begin = np.nonzero(np.concatenate([[True], held[1:] != held[:-1]]))[0]
                total[held[begin]] += np.add.reduceat(np.repeat(p, lengths, 0)[order], begin, 0)
    return total


def proportions(batch: pa.RecordBatch, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x topics, sentences): inferred topic proportions, in sentences, and how many sentences there are."""
    out = np.zeros((batch.num_rows, odds.shape[1]))
    number = np.zeros(batch.num_rows, np.int64)
    for docs, ids, starts, lengths, first, count in _chunks(batch):
        p = infer(_sums(odds[ids], starts, lengths), first, count)[:, :-1]
        out[docs], number[docs] = _sums(p, first, count), count
    return out, number


def seeds(typical: np.ndarray, evidence: np.ndarray, occurs: np.ndarray) -> np.ndarray:
    """Words to begin with: each bucket's occurrences, to the subject it is typical of; the rest belongs to none."""
    n = len(typical)
    if not n:
        return np.zeros((0, len(occurs)))
    is_typical = (evidence >= 1) & (typical.max(0) > _above_even(TYPICAL, n))
    return np.where(is_typical, occurs * typical**2 / np.maximum((typical**2).sum(0), 1e-12), 0)


def typicality(seen: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """Rates of words in the documents of each subject (subjects x buckets), as shares of the rates of all subjects."""
    smooth = (seen + 0.02) / (labelled + 1)
    return smooth / smooth.sum(0) if len(seen) else smooth


def _cells(corpus: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:  # noqa: ANN001
    """Sum over all partitions of what run(batches) gives, a matrix of buckets x columns; only its cells that aren't 0 travel."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = run(batches).ravel()
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at].astype(np.float64))], names=["cell", "n"])

    sums = corpus.select("ids", "ends").mapInArrow(cells, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(shape)


def fit(corpus: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[TopicModel, list[str], np.ndarray]:
    """(model, subjects, typicality) of split_documents()."""
    spark = corpus.sparkSession
    # subjects without any label can't be told from others: they have no topic
    subjects = sorted(r[0] for r in areas.join(labels.select("subject"), "subject", "left_semi").select("subject").distinct().collect())
    n = len(subjects)

    def occurring(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS)
        for batch in batches:
            total += np.bincount(batch["ids"].flatten().to_numpy(zero_copy_only=False), minlength=BUCKETS)
        return total

    occurs = _cells(corpus, occurring, (BUCKETS, 1))[:, 0]
    # what the labels say of each word: in how many documents of each subject it is; a document of several counts in parts
    said = labels.where("subject IS NOT NULL").select("doc_id", "subject").distinct()
    said = said.join(said.groupBy("doc_id").agg((1 / F.count("*")).alias("part")), "doc_id")
    by_word = corpus.join(broadcast_if_small(said), "doc_id").select("subject", "part", F.explode(F.array_append(F.array_distinct("ids"), F.lit(-1))).alias("word"))
    rate = np.zeros((n, BUCKETS + 1))
    at = {s: k for k, s in enumerate(subjects)}
    held = by_word.where(F.col("subject").isin(subjects)).groupBy("subject", "word").agg(F.sum("part").alias("part")).toPandas()
    rate[held["subject"].map(at).to_numpy(int), held["word"].to_numpy(int)] = held["part"].to_numpy(float)
    typical = typicality(rate[:, :-1], rate[:, -1:])
    evidence = rate[:, :-1].sum(0)
    seed = seeds(typical, evidence, occurs)
    model = TopicModel(seed, occurs)
    for _ in range(ROUNDS if n and occurs.any() else 0):
        shared = spark.sparkContext.broadcast(model.odds)
        counted = _cells(corpus, lambda batches, shared=shared: expected(batches, shared.value), (BUCKETS, n)).T
        shared.unpersist()
        model = TopicModel(model.due * counted + PRIOR * seed, occurs)
    return model, subjects, np.where(evidence >= 1, typical, 0)


def subject_shares(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, n_about, n_sentences): the proportion, in sentences, of every subject that holds some of a document."""
    corpus = materialize(split_documents(documents))
    model, subjects, typical = fit(corpus, areas, labels)
    n = len(subjects)
    shared = corpus.sparkSession.sparkContext.broadcast((model.odds, np.array(model.mapped(typical)[2], int), subjects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, subject_of, names = shared.value
        for batch in batches:
            of_topic, number = proportions(batch, odds)
            about = np.zeros((len(of_topic), n))
            for k, s in enumerate(subject_of):
                if s >= 0:
                    about[:, s] += of_topic[:, k]
            d, s = np.nonzero(about > 1e-3)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(d)), pa.array([names[k] for k in s], pa.string()),
                                              pa.array(about[d, s]), pa.array(number[d].astype(np.int32))],
                                             names=["doc_id", "subject", "n_about", "n_sentences"])

    return corpus.mapInArrow(run, "doc_id bigint, subject string, n_about double, n_sentences int")


def found(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): subjects that hold at least a quarter of the document's sentences."""
    return subject_shares(documents, areas, labels).where(F.col("n_about") + SLACK >= SHARE * F.col("n_sentences")).select("doc_id", "subject")


def topics(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(topic, subject, affinity, top_terms): the topics, as they are inspected for the mapping. A term is the commonest word
    of its bucket."""
    corpus = materialize(split_documents(documents))
    model, subjects, typical = fit(corpus, areas, labels)
    top, affinity, subject_of = model.mapped(typical)
    wanted = sorted({int(w) for terms in top for w in terms})
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(frozenset(wanted))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            count: dict[str, int] = {}
            for text in batch["text"].to_pylist():
                for found_words in sentence_words(sentences(text)):
                    for w in found_words:
                        count[w] = count.get(w, 0) + 1
            for w in count.keys() - known.keys():
                known[w] = bucket(w)
            held = [(known[w], w, c) for w, c in count.items() if known[w] in shared.value]
            if len(known) > 1_000_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["word", "term", "n"])

    names = spread(documents.select("text")).mapInArrow(named, "word int, term string, n bigint").groupBy("word", "term").agg(F.sum("n").alias("n")).groupBy("word").agg(
        F.max_by("term", F.struct("n", "term")).alias("term"))
    term = {r.word: r.term for r in names.collect()}
    rows = [(k, subjects[s] if s >= 0 else None, float(affinity[k].max()), [term[int(w)] for w in top[k] if int(w) in term]) for k, s in enumerate(subject_of)]
    return spark.createDataFrame(rows, "topic int, subject string, affinity double, top_terms array<string>")


def makeup(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, n_docs, doc_share): the make-up of the corpus, subjects without documents included."""
    total = documents.count()
    counts = found(documents, areas, labels).groupBy("subject").agg(F.count("*").alias("n_docs"))
    return areas.select("subject").distinct().join(counts, "subject", "left").na.fill(0, ["n_docs"]).withColumn("doc_share", F.col("n_docs") / F.lit(float(max(total, 1))))
