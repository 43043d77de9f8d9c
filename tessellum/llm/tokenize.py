"""Encoding texts with a byte-level BPE vocabulary.

BPE encodings have a property that makes them computable letter by letter: cutting the last
token off the encoding of a string leaves the encoding of a shorter prefix. So one number for
each prefix, its last token, holds the encodings of all prefixes. The last token of a prefix
is the one vocabulary entry at its end that could stand after the encoding before it, that is,
where merging would not have crossed the border.

``WordTrie`` lays the distinct words of a batch into a trie and walks it depth first with one
last token for each node; words that begin alike share that work. Words are what the public
pre-tokenization pattern makes of a text; texts are split, looked up and joined within their
task, so nothing is shuffled, whatever the size of the corpus. Known words stay in memory up
to ``keep`` of them; beyond it the memory starts anew, with the same results.

Null and empty texts have the empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_DIR = "/opt/tokenizers"
MOST_BYTES = 64_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a tokenizer file, and which tokens may follow which."""

    def __init__(self, tokens: dict[bytes, int], parts: dict[int, tuple[int, int]], order: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.tokens, self.parts, self.order = tokens, parts, order
        self.size = {i: len(b) for b, i in tokens.items()}
        # merge number of each token; single bytes come before all merges
        self.born = {token: n for n, token in order.values()}
        self.follows: dict[tuple[int, int], bool] = {}
        # tokens by their last byte and length, for the search of the tokens at a prefix's end
        self.longest = max(map(len, tokens))

    @classmethod
    def load(cls, content: bytes) -> Vocabulary:
        """Of the content of a tokenizer file."""
        model = json.loads(content)["model"]
        letters = _byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(merges):
            token = ids[a + b]
            order[ids[a], ids[b]] = (n, token)
            parts.setdefault(token, (ids[a], ids[b]))
        made = set(parts) | {ids[c] for c in letters if c in ids}
        tokens = {spell(s): i for s, i in ids.items() if i in made}
        return cls(tokens, parts, order)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging a text of the two tokens leaves exactly these two.

        Both tokens are taken apart from the last merge back. As long as a part that touches
        the border exists, a merge across it with its neighbour must not come before the
        merge that swallowed the part.
        """
        known = self.follows.get((left, right))
        if known is None:
            known = self.follows[left, right] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        born, parts, order = self.born, self.parts, self.order
        a, b = left, right
        end = len(order)  # merges that happen before this number are still open
        equal_ok = True  # at the same number, the leftmost pair is merged first
        while True:
            across = order.get((a, b))
            if across is not None and (across[0] < end or (across[0] == end and not equal_ok)):
                return False
            na, nb = born.get(a, -1), born.get(b, -1)
            if na < 0 and nb < 0:
                return True
            if na > nb:
                # the left token's last merge is the later one: before it, its right part stood
                # at the border; a merge across must not come before that merge, and at an equal
                # number the left one is done first
                end, equal_ok = na, True
                a = parts[a][1]
            else:
                # the right token's left part stood at the border; at an equal number the merge
                # across lies further left and would be done first. Of two tokens of the same
                # merge the right one is made last, so it is taken apart first
                end, equal_ok = nb, False
                b = parts[b][0]


class WordTrie:
    """Encodings of words, sharing the work on common beginnings."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 400_000) -> None:
        self.vocabulary, self.keep = vocabulary, keep
        self.known: dict[str, list[int]] = {}
        self.computed = 0  # prefixes whose last token was searched for

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = set(words)
        # the sorted spellings are the trie's words in depth-first order: the states of the path
        # down to the node where two neighbours part are kept, those below are dropped
        v = self.vocabulary
        tokens, size, longest, may_follow = v.tokens, v.size, v.longest, v.may_follow
        last: list[int] = [-1]  # last[n]: last token of the prefix of n bytes
        before = b""
        for spelling, word in sorted((w.encode(), w) for w in new):
            shared = 0
            for x, y in zip(before, spelling):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            self.computed += len(spelling) - shared
            for end in range(shared + 1, len(spelling) + 1):
                for start in range(max(0, end - longest), end):
                    token = tokens.get(spelling[start:end])
                    if token is not None and (start == 0 or may_follow(last[start], token)):
                        last.append(token)
                        break
            ids, n = [], len(spelling)
            while n:
                ids.append(last[n])
                n -= size[last[n]]
            ids.reverse()
            self.known[word] = ids
            before = spelling

    def encode(self, words: list[str]) -> list[int]:
        known = self.known
        return [i for w in words for i in known[w]]


_tries: dict[tuple, WordTrie] = {}


def _trie(content: bytes, keep: int) -> WordTrie:
    key = (zlib.crc32(content), len(content), keep)
    if key not in _tries:
        _tries.clear()
        _tries[key] = WordTrie(Vocabulary.load(content), keep)
    return _tries[key]


def encode(df: DataFrame, text: str, path: str = f"{DEFAULT_DIR}/byte_bpe_50k.json", keep: int = 400_000, out: str = "ids") -> DataFrame:
    """``df`` with the integer array ``out``, the encoding of the column ``text``. A column
    of ``df`` that is called ``out`` is replaced. The driver reads the vocabulary file and sends
    it with the job; files beyond ``MOST_BYTES`` are refused."""
    content = Path(path).read_bytes()
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} has {len(content)} bytes; a vocabulary of at most {MOST_BYTES} is sent to the executors")
    shared = df.sparkSession.sparkContext.broadcast(content)
    pattern = regex.compile(PATTERN)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = _trie(shared.value, keep)
        for batch in batches:
            split = [pattern.findall(t) if t else [] for t in batch]
            trie.learn({w for ws in split for w in ws})
            yield pd.Series([trie.encode(ws) for ws in split], dtype=object)

    return df.withColumn(out, ids(F.col(text)))
