"""Mapping of freely typed values to the entries of a reference list.

Each distinct value is resolved once:

1. Normal form: wrong decodings taken back, words split at case changes and at everything
   that is no letter or digit, lower case.
2. A multi-pattern automaton over the names and aliases finds the mentions embedded in the
   value; the longest non-overlapping ones win. A value with just one mention beside words
   that look like no word of the list means that entry.
3. Other values go to token-set similarity: words of the value are matched to words of the
   list as equal, as a beginning (at least START letters), as the word without its vowels, or
   within an edit distance that grows with the length. An entry is as similar
   as its words are matched, in any order; words of the value that no entry word explains
   count against it. Values that run words together are compared as a whole the same way.
4. The most similar entry is taken if it reaches ``least`` and all its words are matched;
   of equals the one with the closest length, then the smallest id.

The list goes to the executors in blocks of checked size (``max_entries``); the driver holds
one block at a time. What a block can tell about a value (mentions, words known or alike,
entries whose words are all matched) is put together for all blocks before anything is
decided, so the answer doesn't depend on the blocks. Null, blank and ``nan`` values get no
row; an empty list maps everything to 0.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.garbled import steps
from tessellum.session import tasks
from tessellum.sources.scratch import cut
from tessellum.sources.tables import has_value

_CASE = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_VOWELS = str.maketrans("", "", "aeiouäöüáéíóúàèìòùâêîôûãõå")
START = 4  # letters of a beginning that stands for a word
FILLERS = {"of", "the", "de", "in"}


def mended(value: str) -> str:
    """``value`` with UTF-8 readings taken back, word by word."""
    if value.isascii():
        return value
    out = []
    for word in value.split(" "):
        for _ in range(3):
            fixed = next((f for how, f in steps(word) if how.startswith("utf-8")), None) if not word.isascii() else None
            if fixed is None:
                break
            word = fixed
        out.append(word)
    return " ".join(out)


def words_of(value: str) -> list[str]:
    text = unicodedata.normalize("NFC", _CASE.sub(" ", value)).lower()
    return _WORD.findall(text)


def consonants(text: str) -> str:
    return text.translate(_VOWELS)


def bones(word: str) -> str:
    """A word as it is abbreviated by leaving out vowels: its first letter stays."""
    return word[:1] + consonants(word[1:])


def histogram(text: str) -> np.ndarray:
    """How often each letter occurs, other characters sharing counters."""
    out = np.zeros(32, dtype=np.int16)
    for c in text:
        out[ord(c) % 32] += 1
    return out


class ByLength:
    """Texts by length, to find those that may lie within an edit distance: an edit changes
    the letter counts by at most two in sum."""

    def __init__(self, texts: list[tuple[str, int]]) -> None:
        groups: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for text, n in texts:
            groups[len(text)].append((text, n))
        self.groups = {k: (np.stack([histogram(t) for t, _ in g]), g) for k, g in groups.items()}

    def near(self, text: str, most: int) -> Iterator[tuple[str, int]]:
        own = histogram(text)
        for size in range(len(text) - most, len(text) + most + 1):
            group = self.groups.get(size)
            if group is not None:
                for i in np.flatnonzero(np.abs(group[0] - own).sum(axis=1) <= 2 * most):
                    yield group[1][i]


def positions(text: str) -> dict[str, int]:
    """For each letter of ``text`` the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(a: str, b: str, most: int, places: dict[str, int] | None = None) -> int:
    """Edit distance with transpositions of neighbours, or ``most + 1`` if it is larger than
    ``most``: the columns of the distance table as bit vectors of their differences."""
    size = len(a)
    if abs(size - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if not size or not b:
        return max(size, len(b))
    places = positions(a) if places is None else places
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, diagonal, before, score = full, 0, 0, 0, size
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        at = places.get(c, 0)
        swapped = ((~diagonal & at) << 1) & before
        diagonal = ((((at & up) + up) ^ up) | at | down | swapped) & full
        right, back = (down | ~(diagonal | up)) & full, up & diagonal
        if right & top:
            score += 1
        elif back & top:
            score -= 1
        if score - left > most:
            return most + 1
        right, back = right << 1 | 1, back << 1
        up, down, before = (back | ~(diagonal | right)) & full, diagonal & right, at
    return min(score, most + 1)


def allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Facts(NamedTuple):
    """What a block of the list tells about the words of a value."""

    spans: list[tuple[int, int, int]]  # mentions: start, end and entry
    close: list[bool]  # for each plain word: some word of the block is like it
    matched: list[tuple[int, tuple[str, ...], float, tuple[int, ...]]]  # entry, words, quality, places used
    together: tuple[int | None, int | None, tuple[int, int] | None] | None  # see Canon.together


def least_of(options: Iterable):
    return min((o for o in options if o is not None), default=None)


class Canon:
    """A block of the reference list: (id, name) with aliases as further rows."""

    def __init__(self, entries: list[tuple[int, str]], least: float = 0.6) -> None:
        self.least = least
        self.names: list[tuple[int, tuple[str, ...]]] = []
        self.automaton = ahocorasick.Automaton()
        self.vocabulary: Counter[str] = Counter()  # word -> its names
        self.joined: dict[str, int] = {}  # these three: text -> smallest entry
        self.bones: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        for entry, name in sorted(entries):
            words = tuple(words_of(name))
            if not words:
                continue
            self.vocabulary.update(set(words))
            self.names.append((entry, words))
            self.whole.setdefault(" ".join(words), entry)
            self.joined.setdefault("".join(words), entry)
            self.bones.setdefault("".join(map(bones, words)), entry)
            self.bones.setdefault(consonants("".join(words)), entry)
        for text, entry in self.whole.items():
            self.automaton.add_word(f" {text} ", (len(text), entry))
        if self.whole:
            self.automaton.make_automaton()
        # all words of a matched name are matched, so its rarest word alone leads to it
        self.by_rarest: dict[str, list[int]] = defaultdict(list)
        self.real = [frozenset(words) - FILLERS for _, words in self.names]
        for n, (_, words) in enumerate(self.names):
            for w in {min(self.real[n], key=lambda w: (self.vocabulary[w], w))} if self.real[n] else set(words):
                self.by_rarest[w].append(n)
        self.by_bones: dict[str, list[str]] = defaultdict(list)
        self.by_start: dict[str, list[str]] = defaultdict(list)
        for w in self.vocabulary:
            for b in {bones(w), consonants(w)}:
                self.by_bones[b].append(w)
            if len(w) > START:
                self.by_start[w[:START]].append(w)
        self.words_near = ByLength([(w, 0) for w in self.vocabulary])
        self.names_near = ByLength(list(self.joined.items()))
        self.memo: dict[str, dict[str, float]] = {}

    def similar_words(self, word: str, known: bool) -> dict[str, float]:
        """Words of the block that ``word`` may stand for, with a similarity; only itself if it
        is ``known`` to be a word of the whole list."""
        if known:
            return {word: 1.0} if word in self.vocabulary else {}
        kept = self.memo.get(word)
        if kept is not None:
            return kept
        out: dict[str, float] = {}
        if not word.isdigit():
            if len(word) >= START:
                for w in self.by_start.get(word[:START], ()):
                    if w.startswith(word):
                        out[w] = 0.8
            if len(word) > 1:
                for w in self.by_bones.get(word, ()):
                    out[w] = max(out.get(w, 0.0), 0.85)
            most = allowed(len(word))
            if most:
                places = positions(word)
                for w, _ in self.words_near.near(word, most):
                    room = min(most, allowed(len(w)))
                    if room and (d := distance(word, w, room, places)) <= room:
                        out[w] = max(out.get(w, 0.0), 1 - 0.12 * d)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def facts(self, words: list[str], plain: list[str], known: list[bool]) -> Facts:
        """All but ``together``."""
        text = f" {' '.join(words)} "
        spans = [(end - size, end, entry) for end, (size, entry) in self.automaton.iter(text)] if self.whole else []
        close = [self.similar_words(w, k) for w, k in zip(plain, known)]
        alike: dict[str, tuple[float, int]] = {}  # word of the list -> similarity and place
        for i, c in enumerate(close):
            for w, s in c.items():
                if w not in alike or s > alike[w][0]:
                    alike[w] = (s, i)
        matched = []
        found, real = set(alike), self.real
        for n in {n for w in alike for n in self.by_rarest.get(w, ()) if real[n] <= found}:
            entry, names = self.names[n]
            need = set(names)
            used = {alike[w][1] for w in need if w in alike}
            if len(used) < len(real[n]):
                continue  # one word of the value can't stand for two
            letters = sum(map(len, need)) or 1
            quality = sum(len(w) * alike[w][0] if w in alike else 0.5 * len(w) for w in need) / letters
            matched.append((entry, names, quality, tuple(sorted(used))))
        return Facts(spans, [bool(c) for c in close], matched, None)

    def together(self, plain: list[str]) -> tuple[int | None, int | None, tuple[int, int] | None]:
        """The value as one run of letters against names written the same way: the entry that
        equals it, the one that does without vowels, and the closest as (distance, entry). A
        run of under six letters allows no edits."""
        text = "".join(plain)
        best: tuple[int, int] | None = None
        if len(text) >= 6:
            most = 1 if len(text) < 8 else 2 if len(text) < 12 else 3
            places = positions(text)
            for name, entry in self.names_near.near(text, most):
                d = distance(text, name, most, places)
                if d <= most and (best is None or (d, entry) < best):
                    best = (d, entry)
        return self.joined.get(text), self.bones.get(text) if len(text) >= 3 else None, best

    def resolve(self, value: str) -> tuple[int, float]:
        """(entry, similarity) of a value, this block being the whole list; (0, 0.0) where it
        means none."""
        words, plain = parts_of(value)
        entry = self.whole.get(" ".join(words)) if words else None
        if entry is not None:
            return entry, 1.0
        if not plain or not self.names:
            return 0, 0.0
        facts = self.facts(words, plain, [w in self.vocabulary for w in plain])
        return decide(words, plain, [facts], lambda: [self.together(plain)], self.least)


def parts_of(value: str) -> tuple[list[str], list[str]]:
    """The words of a value, and those that are no numbers."""
    words = words_of(mended(value))
    return words, [w for w in words if not w.isdigit()]


def decide(words: list[str], plain: list[str], parts: list[Facts], together: Callable, least: float) -> tuple[int, float]:
    """The answer for a value that is no name as a whole, from the facts of all blocks;
    ``together`` gives their runs of letters, if these are needed."""
    close = [any(p.close[i] for p in parts) for i in range(len(plain))]
    mentions: dict[tuple[int, int], int] = {}
    for p in parts:
        for start, end, entry in p.spans:
            mentions[start, end] = min(entry, mentions.get((start, end), entry))
    text = f" {' '.join(words)} "
    taken: list[tuple[int, int]] = []
    for start, end in sorted(mentions, key=lambda s: (s[0] - s[1], s[0])):  # longest first
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
    if taken:
        inside = text[taken[0][0] : taken[0][1] + 1].split()
        # a longer name, or one word with nothing beside it that looks like a word of the list:
        # the rest is decoration
        alone = len(taken) == 1 and all(w in inside or not c for w, c in zip(plain, close))
        if len(inside) > 1 or alone:
            return mentions[taken[0]], 1.0
    best: tuple = (0.0, 0, 0, (), 0)
    explained = [c or w in FILLERS for w, c in zip(plain, close)]
    letters = sum(map(len, plain))
    for p in parts:
        for entry, names, quality, used in p.matched:
            # words of the value that stand for something, but not for this entry
            beside = sum(1 for i, e in enumerate(explained) if e and i not in used and plain[i] not in FILLERS)
            similarity = quality - 0.15 * beside
            # words that neither the entry nor any other explains leave the answer open
            unknown = sum(1 for i, e in enumerate(explained) if i not in used and (e or len(plain[i]) >= 8))
            key = (round(similarity + 0.02 * len(set(names)), 6), -abs(sum(map(len, names)) - letters), -entry, names, unknown)
            if key > best:
                best = key
    # words that run together, or are taken for other words, may fit better as a whole
    if best[0] < least or best[4] > 0:
        runs = together()
        equal, bare, near = (least_of(r[k] for r in runs) for k in range(3))
        if equal is not None:
            run = (equal, 0.99)
        elif bare is not None:
            run = (bare, 0.85)
        else:
            run = (near[1], 1 - 0.08 * near[0]) if near else None
        if run and run[1] > best[0]:
            return run
    return (-best[2], best[0]) if best[0] >= least else (0, 0.0)


_memo: dict[tuple, Canon] = {}


def _canon(entries: list[tuple[int, str]], least: float) -> Canon:
    key = (len(entries), hash(tuple(entries)), least)
    if key not in _memo:
        _memo.clear()
        _memo[key] = Canon(entries, least)
    return _memo[key]


def _resolve(shared, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = _canon(shared.value, least)
        for pdf in batches:
            answers = [canon.resolve(v) for v in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "entry": [a[0] for a in answers], "similarity": [a[1] for a in answers]})

    return run


def _known_words(shared, least: float):
    """(value, entry, known): the entry named by the whole value, and the places of its plain
    words that are words of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = _canon(shared.value, least)
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                words, plain = parts_of(value)
                rows.append((value, canon.whole.get(" ".join(words)), [i for i, w in enumerate(plain) if w in canon.vocabulary]))
            out = pd.DataFrame(rows, columns=["value", "entry", "known"])
            yield out.assign(entry=out["entry"].astype("Int64"))

    return run


def _facts(shared, least: float):
    """(value, facts) of a block, without those that tell nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = _canon(shared.value, least)
        for pdf in batches:
            rows = []
            for value, at in zip(pdf["value"], pdf["known"]):
                words, plain = parts_of(value)
                if not plain:
                    continue
                known = [i in set(at) for i in range(len(plain))]
                f = canon.facts(words, plain, known)._replace(together=canon.together(plain))
                if f.spans or f.matched or any(f.close) or any(t is not None for t in f.together):
                    rows.append((value, pickle.dumps(tuple(f))))
            yield pd.DataFrame(rows, columns=["value", "facts"])

    return run


def _decide(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value, packed in zip(pdf["value"], pdf["facts"]):
                words, plain = parts_of(value)
                parts = [Facts(*pickle.loads(p)) for p in packed]  # written by _facts of this job
                rows.append((value, *decide(words, plain, parts, lambda parts=parts: [p.together for p in parts], least)))
            yield pd.DataFrame(rows, columns=["value", "entry", "similarity"])

    return run


_ANSWER = "value string, entry long, similarity double"


def _by_blocks(rows: DataFrame, pairs: DataFrame, blocks: int, make, schema: str, least: float) -> DataFrame:
    """The union of what ``make`` gives for each block of the list, one block after another."""
    spark, out = rows.sparkSession, []
    for b in range(blocks):
        entries = [(r.e, r.name) for r in pairs.where(F.col("block") == b).collect()]
        shared = spark.sparkContext.broadcast(sorted(entries))
        out.append(cut(rows.mapInPandas(make(shared, least), schema), "block"))
        shared.unpersist()
    return reduce(DataFrame.unionByName, out)


def resolve(values: DataFrame, reference: DataFrame, entry: str, names: list[str], least: float = 0.6, max_entries: int = 100_000) -> DataFrame:
    """(value, entry, similarity) of each distinct value of the column ``value``; ``names``
    are the columns of ``reference`` that name its entry."""
    spark = values.sparkSession
    pairs = reference.select(F.col(entry).cast("long").alias("e"), F.explode(F.array(*names)).alias("name"))
    pairs = cut(pairs.where(has_value("name")).distinct(), "entries")
    sums = pairs.agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("letters")).first()
    blocks = max(-(-sums.n // max_entries), -(-(sums.letters or 0) // (64 * max_entries)), 1)
    distinct = values.select("value").where(has_value("value")).distinct().repartition(tasks(spark), "value")
    if blocks == 1:
        shared = spark.sparkContext.broadcast(sorted((r.e, r.name) for r in pairs.collect()))
        return distinct.mapInPandas(_resolve(shared, least), _ANSWER)
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("e", "name"), F.lit(blocks)))
    spread = cut(distinct, "values")
    seen = _by_blocks(spread, pairs, blocks, _known_words, "value string, entry long, known array<int>", least)
    seen = cut(seen.groupBy("value").agg(F.min("entry").alias("entry"), F.flatten(F.collect_list("known")).alias("known")), "seen")
    rest = cut(seen.where("entry is null").select("value", "known"), "rest")
    facts = _by_blocks(rest, pairs, blocks, _facts, "value string, facts binary", least)
    facts = facts.groupBy("value").agg(F.collect_list("facts").alias("facts"))
    decided = facts.mapInPandas(_decide(least), _ANSWER)
    answers = seen.join(decided.withColumnRenamed("entry", "found"), "value", "left")
    return answers.select(
        "value",
        F.coalesce("entry", "found", F.lit(0)).cast("long").alias("entry"),
        F.when(F.col("entry").isNotNull(), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
    )
