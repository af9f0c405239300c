"""Sentences and words of a document, whatever its language and outer form."""

from __future__ import annotations

import html
import json
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_LOG = re.compile(r"^\s*(?:\[[^\]\n]{1,40}\]|\d{4}-\d\d-\d\d[T ][\d:.,]+\S*|\d\d:\d\d:\d\d\S*)\s*(?:[A-Z]{3,8}\b:?)?\s*")
_MARK = re.compile(r"^\s*(?:>\s*)+|^\s*(?:[-*+•‣–]|\(?\d{1,3}[.)])\s+")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_END = re.compile(r"[.!?。！？…]['\"”’»)\]]*\s*$")
_CUT = re.compile(r"(?<=[.!?…])['\"”’»)\]]*\s+|(?<=[。！？])|(?<=[!?])(?=[㐀-鿿])|(?<=[㐀-鿿][!?])(?=\S)")
_ASCII_CUT = re.compile(r"[.!?]['\")\]]*\s+")
_CODE = re.compile(r"(?<![^\W_㐀-鿿])(?=[a-z]*\d)(?=\d*[a-z])[a-z\d]+(?![^\W_㐀-鿿])|([a-z])\1{5,}")
_CODED = re.compile(r"[a-z]\d|\d[a-z]|([a-z])\1{5}")
_WORD = re.compile(r"[^\W\d_㐀-鿿]+(?:_[^\W㐀-鿿]+)*|[㐀-鿿]+")
_ASCII_WORD = re.compile(r"[a-z]+(?:_[a-z0-9_]+)*")
# characters that only steer the layout
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in (*range(0x20000), *range(0xE0000, 0xE1000)) if unicodedata.category(chr(c)) == "Cf") + "]")


def _strings(value: object) -> list[str]:
    """The texts within a JSON value, in order."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            todo.extend(reversed(list(x.values())))
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; list items, log lines, quoted lines and rows of tables are sentences of their own. Hard line breaks
    within a sentence are undone. Markup, markers, headings and lines without a letter or digit give none."""
    if not text or not text.strip():
        return []
    t = text.strip()
    blocks = [t]
    if t[:1] in "{[":
        try:
            blocks = _strings(json.loads(t))
        except (ValueError, RecursionError):
            pass
    out: list[str] = []
    for block in blocks:
        b = block if block.isascii() else _FORMAT.sub("", unicodedata.normalize("NFKC", block))
        if "<" in b:
            b = _TAG.sub("\n", b)
        if "&" in b:
            b = html.unescape(b)
        items: list[str] = []
        fresh = True
        for line in b.splitlines():
            if not line.strip():
                fresh = True
                continue
            if _HEADING.match(line):
                fresh = True
                continue
            bare = _MARK.sub("", line)
            bare = _LOG.sub("", bare) if bare[:1] == "[" or bare[:1].isdigit() else bare
            row = "\t" in bare.strip()
            if fresh or row or bare != line or _END.search(items[-1]):
                items.append(bare.strip())
            else:
                glue = "" if items[-1][-1:] > "⺀" or bare.strip()[:1] > "⺀" else " "
                items[-1] += glue + bare.strip()
            fresh = row
        for item in items:
            out += [s for s in (_cut(item) if item.isascii() else _CUT.split(item)) if s and any(c.isalnum() for c in s)]
    return out


def _cut(item: str) -> list[str]:
    """_CUT for text of ASCII characters only, where it is the same."""
    out, at = [], 0
    for m in _ASCII_CUT.finditer(item):
        out.append(item[at : m.start() + 1])
        at = m.end()
    out.append(item[at:])
    return out


def sentence_words(sentences: list[str]) -> list[list[str]]:
    """The lower-case words of each sentence; codes of letters and digits and long runs of a letter are none; names joined by
    underscores stay whole; of Chinese, the pairs of characters."""
    text = "\n".join([s.replace("\n", " ") if "\n" in s else s for s in sentences]).casefold()
    if _CODED.search(text):
        text = _CODE.sub(" ", text)
    if text.isascii():
        return [[w for w in _ASCII_WORD.findall(s) if len(w) > 1] for s in text.split("\n")] if sentences else []
    out = []
    for s in text.split("\n") if sentences else ():
        now: list[str] = []
        for w in _WORD.findall(s):
            if len(w) > 1:
                if "㐀" <= w[0] <= "鿿":
                    now += [w[k : k + 2] for k in range(len(w) - 1)]
                else:
                    now.append(w)
        out.append(now)
    return out


def words(sentence: str) -> list[str]:
    """The words of one sentence."""
    return sentence_words([sentence])[0]
