"""Statistics of a text that tell natural prose from lists, tables, records and junk.

Each text is read once and whole. Besides counts, ratios and repetition statistics there is
``prose_share``, which knows no language's words. A word is part of running prose if the words
around it are mostly clean words and one of these holds:

- Glue: as many of the words around it are short ones as sentences need (of, de, und, в, i,
  ve, ...); lists, tables, logs, word salad and noise have hardly any. A short word that is
  nearly alone on its line is none, nor are words of scripts that write syllables.
- Sentence: it lies in a sentence: it begins like one, ends like one, has neither too few nor too
  many words, mostly small initials where the script has them, and few commas.
- Scripts without spaces: the token is a sentence or more.

Words weigh by their letters, so a few sentences beside a long table stay few.

``is_junk`` combines the rules: less than half of the text is running prose, or most of it
repeats itself (equal sentences, lines or paragraphs, or one phrase that covers much of the
text), or nearly all lines are short list items. Null, empty and blank texts have zero words,
null shares, and are no junk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLEAN = regex.compile(r"[(\"'“”«»‘’„¿¡*_>\[]*\p{L}[\p{L}\p{M}]*(?:[’'‑-]\p{L}[\p{L}\p{M}]*)*[.,;:!?…)\"'“”«»’*_\]।،؛؟۔。！？、]*")
_STRIP = "(\"'“”«»‘’„¿¡*_>[.,;:!?…)]।،؛؟۔"
_SENTENCE = re.compile(r"(?<=[.!?。！？।؟۔])\s+|\n+")
_BULLET = re.compile(r"^\s*(?:[-*+•·▪–—]|\d+[.)])\s")
#: Scripts that write no spaces, and those whose words are written in a few syllables.
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SYLLABLES = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Hangul}\p{Ethiopic}]")
_ENDS = tuple(".!?…:;\"”’»)。！？।؟۔")
_TERMINATOR = re.compile(r"[.!?…。！？।؟۔][)\"'“”«»’*_\]]*$")
_COMMA = re.compile(r"[,;،、؛][)\"'“”«»’*_\]]*$")
_WORDS_AND_SPACES, _DIGITS = re.compile(r"[\w\s]+"), re.compile(r"\d+")
WINDOW = 12
GLUE_LETTERS = 3
GLUE_SHARE = 0.085
CLEAN_SHARE = 0.6
PROSE_SHARE = 0.5
REPEATED_SHARE = 0.5
PHRASE_SHARE = 0.45
LIST_SHARE = 0.9
LIST_WORDS = 4
#: A sentence: words, words between commas, clean words, words with small initials, words of a line.
SENTENCE_WORDS, CLAUSE_WORDS, SENTENCE_CLEAN, SENTENCE_SMALL, LINE_WORDS = (5, 80), 3.5, 0.75, 0.35, 5
KEEP = 200_000

COLUMNS = {
    "n_chars": "long",
    "n_words": "long",
    "n_lines": "long",
    "mean_word_length": "double",
    "symbol_ratio": "double",
    "digit_ratio": "double",
    "punctuated_lines": "double",
    "bullet_lines": "double",
    "words_per_line": "double",
    "common_words": "double",
    "duplicate_lines": "double",
    "duplicate_paragraphs": "double",
    "duplicate_sentences": "double",
    "phrase_share": "double",
    "prose_share": "double",
}

def _token(token: str) -> tuple[str, tuple]:
    """The bare word of a token and what it tells by itself: letters, clean, glue, glue in
    capitals, spaceless, large initial, small initial, terminator, comma."""
    bare = token.strip(_STRIP)
    clean = _CLEAN.fullmatch(token) is not None
    short = clean and len(bare) <= GLUE_LETTERS and not _SYLLABLES.search(bare)
    lower = bare.lower()
    first = bare[:1]
    return lower, (
        len(token),
        clean,
        short and bare == lower,
        short and bare != lower and bare == bare.upper(),
        len(token) > 8 and len(_SPACELESS.findall(token)) > 0.6 * len(token),
        clean and first != first.lower(),
        clean and first == first.lower() and first != first.upper(),
        _TERMINATOR.search(token) is not None,
        _COMMA.search(token) is not None,
    )


class _Tokens:
    """Answers of ``_token`` as rows of a table. Tokens recur, so answers are kept; the memory
    starts anew when it is full, with the same answers."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = []
        self.facts = np.zeros((1 << 12, 9))

    def look_up(self, tokens: list[str]) -> list[int]:
        if len(self.ids) > KEEP:
            self.__init__()
        found = list(map(self.ids.get, tokens))
        if None in found:
            for k, n in enumerate(found):
                if n is None:
                    found[k] = self._add(tokens[k])
        return found

    def _add(self, token: str) -> int:
        n = self.ids.get(token)
        if n is None:
            n = self.ids[token] = len(self.words)
            word, facts = _token(token)
            self.words.append(word)
            if n == len(self.facts):
                self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.facts[n] = facts
        return n


_tokens = _Tokens()


def _moving(values: np.ndarray, width: int) -> np.ndarray:
    """Mean of the values within ``width`` places."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(values))
    low, high = np.maximum(at - width, 0), np.minimum(at + width + 1, len(values))
    return (sums[high] - sums[low]) / (high - low)


def _in_sentence(clean, large, small, ends, commas, line_ends, breaks) -> np.ndarray:
    """Which tokens lie in a sentence. ``line_ends`` and ``breaks`` mark the last token of a
    line and of a paragraph; a sentence runs over line ends but not over paragraphs."""
    n = len(clean)
    stop = (ends > 0) | (breaks > 0)
    starts = np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])
    size = np.diff(np.append(starts, n))
    last = starts + size - 1
    total = lambda x: np.add.reduceat(x, starts)
    smalls, larges = total(small), total(large)
    cased = smalls + larges > 0
    capitals = (smalls == 0) & (larges > 1)  # a sentence in capitals
    begins = (small[starts] == 0) & (clean[starts] > 0)
    good = (
        (size >= SENTENCE_WORDS[0])
        & (size <= SENTENCE_WORDS[1])
        & (ends[last] > 0)
        & begins
        & (total(clean) >= SENTENCE_CLEAN * size)
        & (size >= CLAUSE_WORDS * (total(commas) + 1))
        & (~cased | capitals | (smalls >= SENTENCE_SMALL * size))
        & (size >= LINE_WORDS * (total(line_ends) - line_ends[last] + 1))
    )
    return np.repeat(good, size)


def prose_share(facts: np.ndarray, sizes: np.ndarray, breaks: list[int]) -> float:
    """Share of the text, by letters, that is running prose. ``facts`` are those of its tokens,
    ``sizes`` the tokens of each line, ``breaks`` the numbers of lines that end a paragraph."""
    weight, clean, glue, loud, spaceless, large, small, ends, commas = facts.T
    firsts = np.cumsum(sizes) - sizes
    # short words in capitals are glue only where the whole line has no small letters
    quiet = np.add.reduceat(small, firsts) > 0
    glue = np.where(np.repeat(quiet, sizes), glue, np.maximum(glue, loud)) * np.repeat(sizes > 2, sizes)
    cleanly, running = _moving(clean, WINDOW) >= CLEAN_SHARE, _moving(glue, WINDOW) >= GLUE_SHARE
    if (cleanly & ~running).any():
        line_ends, paragraph = np.zeros(len(clean)), np.zeros(len(clean))
        line_ends[firsts + sizes - 1] = 1.0
        paragraph[[firsts[k] + sizes[k] - 1 for k in breaks]] = 1.0
        running |= _in_sentence(clean, large, small, ends, commas, line_ends, paragraph)
    inside = cleanly & running
    return float((weight * np.maximum(inside, spaceless)).sum() / weight.sum())


def _repeated(parts: list[str]) -> float:
    """Share, by letters, of parts that came before."""
    total = sum(map(len, parts))
    if not total:
        return 0.0
    return sum(len(p) * (n - 1) for p, n in Counter(parts).items()) / total


def _phrase(words: list[str]) -> float:
    """The largest share of the letters that one repeated run of two to four words covers."""
    total = sum(map(len, words)) or 1
    best = 0.0
    for n in (2, 3, 4):
        if len(words) < 2 * n:
            break
        gram, times = Counter(zip(*(words[i:] for i in range(n)))).most_common(1)[0]
        if times < 2:
            break  # nor does a longer run recur
        # overlapping runs cover no more than the text
        best = max(best, min(1.0, times * sum(map(len, gram)) / total))
    return best


def statistics(text: str | None, common: frozenset[str] = frozenset()) -> tuple:
    tokens = text.split() if text else []
    if not tokens:
        return (len(text or ""), 0, 0, *[None] * (len(COLUMNS) - 3))
    lines, sizes, breaks = [], [], []
    for x in text.splitlines():
        n = len(x.split())
        if n:
            lines.append(x)
            sizes.append(n)
        elif lines:
            breaks.append(len(lines) - 1)
    letters = sum(map(len, tokens))
    symbols = len(_WORDS_AND_SPACES.sub("", text)) + text.count("_")
    digits = len(text) - len(_DIGITS.sub("", text))
    ids = _tokens.look_up(tokens)
    words = [_tokens.words[n] for n in ids]
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    sentences = [s.strip().lower() for s in _SENTENCE.split(text) if s.strip()]
    return (
        len(text),
        len(tokens),
        len(lines),
        letters / len(tokens),
        symbols / letters,
        digits / letters,
        sum(1 for x in lines if x.rstrip().endswith(_ENDS)) / len(lines),
        sum(1 for x in lines if _BULLET.match(x)) / len(lines),
        len(tokens) / len(lines),
        sum(1 for w in words if w in common) / len(tokens),
        _repeated([x.strip() for x in lines]),
        _repeated(paragraphs),
        _repeated(sentences),
        _phrase(words),
        prose_share(_tokens.facts[ids], np.array(sizes), breaks),
    )


def _run(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value if shared else frozenset()
        for pdf in batches:
            rows = [(i, *statistics(t, common)) for i, t in zip(pdf["doc_id"], pdf["text"])]
            out = pd.DataFrame(rows, columns=["doc_id", *COLUMNS])
            for name, kind in COLUMNS.items():
                out[name] = out[name].astype("Int64" if kind == "long" else "float64")
            yield out

    return run


def common_words(df: DataFrame, text: str, percent: int = 1) -> list[str]:
    """Words in at least ``percent`` of the texts. They are at most 100 / ``percent`` times as
    many as an average text has different words, whatever the number of texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)))
    texts = df.where(F.col(text).isNotNull())
    n = texts.count()
    counts = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r.w for r in counts.where(F.col("n") * 100 >= n * percent).select("w").collect())


def describe(df: DataFrame, doc_id: str, text: str, common: list[str] | None = None) -> DataFrame:
    """(doc_id, statistics) of each row; ``common_words`` is the share of words in ``common``."""
    schema = "doc_id long, " + ", ".join(f"{n} {k}" for n, k in COLUMNS.items())
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frozenset(common)) if common else None
    return rows.mapInPandas(_run(shared), schema)


def is_junk() -> F.Column:
    """Whether a row of ``describe`` is mostly no natural prose."""
    repeats = F.greatest("duplicate_sentences", "duplicate_lines", "duplicate_paragraphs") >= REPEATED_SHARE
    items = (F.col("bullet_lines") >= LIST_SHARE) & (F.col("words_per_line") < LIST_WORDS)
    return (F.col("n_words") > 0) & (
        (F.col("prose_share") < PROSE_SHARE) | repeats | (F.col("phrase_share") >= PHRASE_SHARE) | items
    )
