"""Encoding of a corpus under a public byte-level BPE vocabulary.

Within a piece of text (the public pattern cuts a text into pieces), every prefix has exactly one encoding, and so one last
token. An automaton over all tokens finds, in one scan, the tokens that end at each place; of those, exactly one follows
the last token of the prefix before it compatibly: the pair, merged by the rules on its own, stays that pair. So the last
tokens of all prefixes are found from left to right, and back-pointers from the end give the ids. The time is linear in
the length of a piece, however long, and no merging takes place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penduline.session import spread

#: Where the vocabulary lies on the driver; executors get it by broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded pieces that a worker remembers, and the longest piece it does so for.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token -> rank. The rank is both the id and the order of merging."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_of(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes this one; None for single bytes and for tokens that merging never makes."""
    parts = [token[k : k + 1] for k in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best = min(((ranks.get(parts[k] + parts[k + 1], own), k) for k in range(len(parts) - 1)))
        if best[0] >= own:
            return None
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class PrefixEncoder:
    """Encodes by the last token of every prefix. Built from Token -> rank; every single byte must be a token. Tokens that
    merging never makes (byte_bpe_50k has none) are never used."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self._pieces = regex.compile(PATTERN).findall
        self._byte = [ranks[bytes([k])] for k in range(256)]
        self._left, self._right, self._first, self._last = {}, {}, {}, {}
        self._merged: dict[tuple[int, int], int] = {}
        self._automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._first[rank], self._last[rank] = ranks[token[:1]], ranks[token[-1:]]
            if len(token) > 1:
                halves = split_of(token, ranks)
                if halves is None:
                    continue
                self._left[rank], self._right[rank] = halves
                self._merged[halves] = rank
            self._automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self._automaton.make_automaton()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}

    def _spine(self, token: int, inner: dict[int, int]) -> list[int]:
        """From the byte at the seam up to the token itself."""
        out = [token]
        while (token := inner.get(token)) is not None:
            out.append(token)
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the seam comes before those that make a and b. Of equal merges the left one is first."""
        key = (a, b)
        if (known := self._compatible.get(key)) is None:
            x, y = self._spine(a, self._right), self._spine(b, self._left)
            i = j = 0
            known = True
            never = 1 << 60
            while True:
                above_x = x[i + 1] if i + 1 < len(x) else never
                above_y = y[j + 1] if j + 1 < len(y) else never
                across = self._merged.get((x[i], y[j]), never)
                if across < above_x and across <= above_y and across < never:
                    known = False
                    break
                if above_x == never and above_y == never:
                    break
                if above_x <= above_y:
                    i += 1
                else:
                    j += 1
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece."""
        text = piece.encode("utf-8")
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        done = 0
        compatible = self.compatible
        # of the tokens that end at a place the longest come first
        for end, (length, token) in self._automaton.iter(text.decode("latin-1")):
            end += 1
            if end == done:
                continue
            start = end - length
            if start == 0 or compatible(last[start], token):
                last[end], size[end], done = token, length, end
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of an empty or null one none."""
        out: list[int] = []
        if not text:
            return out
        known = self._known
        for piece in self._pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(shared: Broadcast, digest: str) -> PrefixEncoder:
    """One encoder per worker and vocabulary, known by the digest of its file."""
    if digest not in _ENCODERS:
        _ENCODERS[digest] = PrefixEncoder(shared.value)
    return _ENCODERS[digest]


def _with(documents: DataFrame, text: str, column: str, kind: str, vocabulary: str, keep: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    digest = hashlib.sha256(Path(vocabulary).read_bytes()).hexdigest()
    counted = kind == "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, digest)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(at, 1024)
                texts = pc.cast(part[part.num_columns - 1], pa.string()).to_pylist()
                made = [len(encoder.encode(t)) for t in texts] if counted else [encoder.encode(t) for t in texts]
                new = pa.array(made, pa.int32() if counted else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], names=[*keep, column])

    wanted = documents.select(*keep, F.col(text).alias(f"{column}__text"))
    schema = wanted.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])
    return spread(wanted).mapInArrow(run, f"{fields}, `{column}` {kind}")


def encode(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the whole text's ids, without special tokens: their strings are ordinary text. Empty and null texts
    give an empty list, as does an empty table no row. Other columns are not carried along."""
    return _with(documents, text, "ids", "array<int>", vocabulary, ["doc_id"])


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns to keep, and n_tokens."""
    return _with(documents, text, "n_tokens", "int", vocabulary, keep)
