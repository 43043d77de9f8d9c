"""Passages of evaluation items inside documents.

The items are the query set: small, and checked to be (``max_bytes``); larger sets are used
in blocks of that size, each against all documents. A document is read once per block and
never leaves its task.

1. Normal form: NFKC, lower case, markup, escapes and punctuation gone, words joined by one
   space. Words keep their letters and digits; hyphens and apostrophes inside them go.
2. Filter (q-gram lemma): a passage of ``words`` words within the edit budget keeps all its
   character q-grams but those that an altered word (its length + q - 1 of them) or an added
   one (q - 1) destroys. A copy spans at most ``words`` + ``altered`` + ``added`` words of the
   document, whatever their lengths, so it lies within two neighbouring blocks of as many
   words. Pairs of blocks with fewer shared q-grams than the item's bound can't hold a match.
3. Verification: banded alignment of the words in and next to those blocks, then
   the exact rule: ``words`` consecutive words of the item of which at most ``altered`` aren't matched
   in order, with at most ``added`` other words in between.

Null, empty and short texts contain nothing; repeated documents and items are rows of their
own. Very long texts are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.sources.scratch import cut

Q = 6
# a tag of any length if its attributes have values, else a short one: a comparison is none
_TAG = re.compile(r"""</?[a-zA-Z](?:[^<>]{0,200}|[\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))*\s*/?)>""")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt\"'/\\])")
_INNER = re.compile(r"(?<=\w)['’‘ʼ`´\-‐‑­](?=\w)|(?<=\w)[-‐­]\s*\n\s*(?=\w)|[​‌‍⁠­﻿]")
_WORD = re.compile(r"[^\W_]+")


class Rule(NamedTuple):
    words: int = 15
    altered: int = 2
    added: int = 6


def normal_words(text: str | None) -> list[str]:
    """The words of a text in normal form."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\n", "t": "\t"}.get(m[2], m[2]), text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    text = unicodedata.normalize("NFKC", text)
    if "*" in text:
        text = text.replace("*", "")
    text = _INNER.sub("", text)
    return _WORD.findall(text.lower())


def _codes(text: str) -> np.ndarray:
    """A number for each q-gram of ``text``, by place."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(points) < Q:
        return np.empty(0, np.uint64)
    n = len(points) - Q + 1
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(Q):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n] + np.uint64(1)
            code ^= code >> np.uint64(29)
    return code


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule) -> None:
        self.rule = rule
        self.ids, self.words, texts = [], [], []
        for item_id, passage in items:
            words = normal_words(passage)
            if len(words) >= rule.words:
                self.ids.append(item_id)
                self.words.append(words)
                texts.append(" ".join(words))
        self.sets = [frozenset(w) for w in self.words]
        # different words of the text that an acceptable copy of any window has at least
        self.fewest = [min(len(set(w[i : i + rule.words])) for i in range(len(w) - rule.words + 1)) - rule.altered for w in self.words]
        self.bounds = np.array([self._bound(w) for w in self.words], dtype=np.int64)
        codes = [_codes(t) for t in texts]
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.grams, self.start = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(every)))
        # most q-grams of a text are none of the items': a bit for each low part of a code says so
        bits = min(26, max(16, len(self.grams).bit_length() + 6))
        self.low = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self.grams & self.low] = True

    def _bound(self, words: list[str]) -> int:
        """Shared q-grams that any acceptable copy of any of the item's windows keeps."""
        rule, least = self.rule, 1 << 30
        for i in range(len(words) - rule.words + 1):
            sizes = sorted(map(len, words[i : i + rule.words]), reverse=True)
            grams = sum(sizes) + rule.words - 1 - Q + 1
            lost = sum(s + Q - 1 for s in sizes[: rule.altered]) + rule.added * (Q - 1)
            least = min(least, grams - lost)
        return max(1, least)

    def _enough_words(self, n: int, vocabulary: set[str]) -> bool:
        """Whether any window of the item has enough words that the text has anywhere."""
        if len(self.sets[n] & vocabulary) < self.fewest[n]:
            return False
        size, need = self.rule.words, self.rule.words - self.rule.altered
        hits = [w in vocabulary for w in self.words[n]]
        have = sum(hits[:size])
        for i in range(size, len(hits)):
            if have >= need:
                return True
            have += hits[i] - hits[i - size]
        return have >= need

    def found(self, words: list[str], piece: int = 30_000) -> list[int]:
        """Ids of the items that a document of these words contains. Long documents are
        searched in pieces that overlap by more than a match can be long."""
        if len(words) > piece:
            lap = 4 * (self.rule.words + self.rule.added)
            parts = (self.found(words[i : i + piece], piece + lap) for i in range(0, len(words), piece - lap))
            return sorted({n for part in parts for n in part})
        rule = self.rule
        if len(words) < rule.words - rule.altered or not self.ids:
            return []
        text = " ".join(words)
        codes = _codes(text)
        hit = np.flatnonzero(self.seen[codes & self.low])
        gram = np.minimum(np.searchsorted(self.grams, codes[hit]), len(self.grams) - 1)
        same = self.grams[gram] == codes[hit]
        hit, gram = hit[same], gram[same]
        if not len(hit):
            return []
        times = self.count[gram]
        spots = np.repeat(hit, times)
        ends = np.cumsum(times)
        entry = np.repeat(self.start[gram] - ends + times, times) + np.arange(len(spots))
        item = self.owner[entry]
        # no band holds more than the whole text
        enough = (np.bincount(item, minlength=len(self.ids)) >= self.bounds)[item]
        if not enough.any():
            return []
        item, spots = item[enough], spots[enough]
        span = rule.words + rule.altered + rule.added
        offsets = np.cumsum([len(w) + 1 for w in words])
        stride = len(words) // span + 3
        word = np.zeros(len(text) + 1, np.int64)
        word[offsets[:-1]] = 1
        block = np.cumsum(word)[spots] // span
        # a copy lies within two neighbouring blocks; the first that has hits stands for both
        keys, counts = np.unique(item * stride + block, return_counts=True)
        sums = counts.copy()
        sums[:-1] += np.where(np.diff(keys) == 1, counts[1:], 0)
        items_of, blocks_of = np.divmod(keys, stride)
        good = np.flatnonzero(sums >= self.bounds[items_of])
        out: set[int] = set()
        vocabulary, hopeless = set(words), set()
        for n, b in zip(items_of[good].tolist(), blocks_of[good].tolist()):
            if n in out or n in hopeless:
                continue
            if not self._enough_words(n, vocabulary):
                hopeless.add(n)
            elif matches(self.words[n], words[max(0, b - 1) * span : (b + 2) * span], rule):
                out.add(n)
        return [self.ids[n] for n in sorted(out)]


def matches(item: list[str], region: list[str], rule: Rule) -> bool:
    """Whether ``region`` holds a window of ``item`` within the rule.

    For each word of the item, the places of the same word in the region are known. Windows
    are tried by their first matched word: from it, the cheapest chain of matches is followed
    through the window within the band that ``added`` and ``altered`` allow.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(region):
        places.setdefault(w, []).append(j)
    at = [places.get(w, ()) for w in item]
    size = rule.words
    hits = [1 if p else 0 for p in at]
    have = sum(hits[:size])
    for i in range(len(item) - size + 1):
        if i:
            have += hits[i + size - 1] - hits[i - 1]
        if have >= size - rule.altered and _aligned(at, i, size, rule):
            return True
    return False


def _aligned(at: list, i: int, size: int, rule: Rule) -> bool:
    # states: place of the last match -> (altered, added, index of the last match) so far. The
    # overlap must span the window: it starts with a match and goes on to one at or beyond the
    # window's end, so a shorter overlap isn't stretched by words counted as altered
    best: dict[int, list[tuple[int, int, int]]] = {}
    for k in range(min(size + rule.altered, len(at) - i)):
        for j in at[i + k]:
            options = [(0, 0, 0)] if k == 0 else []
            for p in range(j - 1, max(-1, j - 2 - rule.added - rule.altered), -1):
                for altered, added, kp in best.get(p, ()):
                    if kp >= k:
                        continue
                    skipped = k - kp - 1  # words of the item between the two matches
                    extra = max(0, (j - p - 1) - skipped)  # words of the text beyond those
                    if altered + skipped <= rule.altered and added + extra <= rule.added:
                        options.append((altered + skipped, added + extra, k))
            if not options:
                continue
            if k >= size - 1:
                return True
            kept = best.setdefault(j, [])
            for o in set(options):
                if not any(a <= o[0] and b <= o[1] and c == o[2] for a, b, c in kept):
                    kept.append(o)
    return False


_index: dict[tuple, Items] = {}


def _search(shared, rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (len(shared.value), hash(tuple(shared.value)), rule)
        if key not in _index:
            _index.clear()
            _index[key] = Items(shared.value, rule)
        index = _index[key]
        for pdf in batches:
            rows = [(d, i) for d, t in zip(pdf["doc_id"], pdf["text"]) for i in index.found(normal_words(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    return run


def find(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, rule: Rule = Rule(), max_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) of each document that contains a passage of an item. The driver holds
    one block of items at a time, of about ``max_bytes``."""
    spark = docs.sparkSession
    known = items.select(items[item_id].cast("long").alias("i"), items[passage].alias("t")).where("t is not null")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).where("text is not null and text <> ''")
    known = cut(known, "items")
    size = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // max_bytes + 1
    out = []
    for b in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(sorted((r.i, r.t) for r in block.collect()))
        found = rows.mapInPandas(_search(shared, rule), "doc_id long, item_id long")
        if blocks > 1:
            found = cut(found, "leaks")
            shared.unpersist()
        out.append(found)
    return reduce(DataFrame.unionByName, out)
