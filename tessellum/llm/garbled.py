"""Text that was decoded with the wrong character encoding.

Fields are cut into tokens at ASCII separators; only tokens with characters beyond ASCII
matter, and each distinct token is judged once, whatever the number of its rows.

Candidates of a token are all strings that a chain of steps ``encode with a, decode with b``
makes of it, up to three steps deep: every reading with UTF-8 at each step, and every pair of
a reading and another writing at one step of a chain, since two of those undo each other or
make any string of any other. A smoothed character trigram model says how likely each string
is. What a chain costs is learned too: the share of doubtless cases that it explains, and, for
UTF-8, how unlikely the bytes would read as UTF-8 by chance.

The model is trained on clean tokens: first those that no chain ending in UTF-8 can read, then
all but those that the first model judged garbled beyond doubt. The row that is judged is left
out of the model and of the chain's cases. n-grams are counted over all rows and kept in tables
of a fixed number of hashed slots, so the model that goes to the executors has a fixed size.

A token is garbled if its likeliest candidate beats it by a margin; a candidate without the
evidence of UTF-8 bytes must itself be no less likely, by its characters beyond ASCII, than
nearly all clean tokens. Floor and margins, one for chains ending in UTF-8 and one for others, are validated on
all clean tokens, each without the row judged, and on copies of them garbled in these ways.

A token with U+FFFD is garbled and can't be restored; so is one with C1 control characters
whose chains lead nowhere. Null and empty fields contain nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.session import tasks
from tessellum.sources.scratch import cut, drop

#: Encodings that texts are wrongly read in, and those they were written in.
READ_AS = ("cp1252", "mac_roman", "cp1251", "cp437", "cp850", "cp852", "cp1250", "cp1254", "koi8_r", "cp866")
WRITTEN_IN = ("cp1251", "koi8_r", "cp866", "cp1250", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr", "cp1252")
SEPARATORS = r"[ ,;|\t\r\n]+"
LOST = "�"
SLOTS = 1 << 18
#: How likely bytes beyond ASCII are a whole UTF-8 sequence by chance, by its length.
BY_CHANCE = {1: 1.0, 2: 30 / 128 * 64 / 128, 3: 16 / 128 * (64 / 128) ** 2, 4: 5 / 128 * (64 / 128) ** 3}
STEPS = len(READ_AS) * (1 + len(WRITTEN_IN))
FIRST_MARGIN, DOUBTLESS, FIRST_FLOOR = 20.0, 15.0, -14.0
#: In the first pass a smaller margin will do where the candidate is a token so many times as frequent.
KNOWN_MARGIN, KNOWN_TIMES = 4.0, 50
NEAR = 0.01
MARGINS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0)


def _reverse_table(name: str) -> dict[str, int]:
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):  # bytes without a character are kept as control characters
        table.setdefault(chr(b), b) if b < 160 or name == "cp1252" else None
    return table


_TABLES = {name: _reverse_table(name) for name in READ_AS}


def _bytes(token: str, read_as: str) -> bytes | None:
    table = _TABLES[read_as]
    try:
        return bytes([table[c] for c in token])
    except KeyError:
        return None


def steps(token: str, writings: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(step, result) of one wrong reading taken back; of chains with one result the first."""
    out: dict[str, str] = {}
    read = [(a, raw) for a in READ_AS if (raw := _bytes(token, a)) is not None]
    for b in ("utf-8", *writings):
        for a, raw in read:
            if a == b:
                continue
            try:
                fixed = raw.decode(b)
            except (UnicodeDecodeError, ValueError):
                continue
            if fixed != token and fixed not in out and LOST not in fixed:
                out[fixed] = f"{b} read as {a}"
    return [(how, fixed) for fixed, how in out.items()]


def candidates(token: str, depth: int = 3) -> dict[str, str]:
    """Results of all chains, with the chain; of chains with one result the shortest."""
    found: dict[str, str] = {}
    level = {token: ("", False)}  # text -> chain, and whether it has a step other than UTF-8
    for _ in range(depth):
        following = {}
        for t, (chain, other) in level.items():
            for how, fixed in steps(t, () if other else WRITTEN_IN):
                if fixed != token and fixed not in found:
                    found[fixed] = f"{how}; {chain}" if chain else how
                    following[fixed] = (found[fixed], other or not how.startswith("utf-8"))
        level = {t: c for t, c in following.items() if not t.isascii()}
    return found


def evidence(fixed: str) -> float:
    """Of a text that was read from bytes as UTF-8: how unlikely that is by chance."""
    return -sum(math.log(BY_CHANCE[len(c.encode("utf-8", "surrogatepass"))]) for c in fixed if c > "\x7f")


def utf8_readable(token: str) -> bool:
    """Whether some chain reads the token as UTF-8, or it holds what no clean text does."""
    if LOST in token or any("\x80" <= c <= "\x9f" for c in token):
        return True
    return any(how.startswith("utf-8") for how, _ in steps(token))


def _unreadable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[not utf8_readable(t) for t in pdf["token"]]]


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS


def _grams(token: str) -> Iterator[tuple[int, str]]:
    padded = f"\x02\x02{token}\x03"
    for i in range(2, len(padded)):
        yield 3, padded[i - 2 : i + 1]
        yield 2, padded[i - 1 : i + 1]
        yield 1, padded[i]


class Model:
    """Log probabilities of strings from slot counts of 1-, 2- and 3-grams, and of chains from
    the cases that their steps explain (``steps``; without it all chains are alike)."""

    def __init__(self, counts: dict[int, np.ndarray], steps: dict[str, int] | None = None) -> None:
        self.counts = counts
        self.total = float(counts[1].sum()) or 1.0
        self.steps = steps
        self.memo: dict[str, tuple[float, tuple]] = {}

    @staticmethod
    def own(token: str, n: float) -> dict[tuple[int, int], float]:
        """What ``n`` rows of ``token`` give to the counts."""
        out: dict[tuple[int, int], float] = {}
        for order, gram in _grams(token):
            for key in ((order, _slot(gram)), *([(order, _slot("\x04" + gram[:-1]))] if order > 1 else [])):
                out[key] = out.get(key, 0) + n
        return out

    def _log(self, keys: tuple, own: dict[tuple[int, int], float]) -> float:
        c1, c2, b2, c3, b3 = (max(0.0, self.counts[order][slot] - own.get((order, slot), 0.0)) for order, slot in keys)
        p1 = (c1 + 0.01) / (self.total + 0.01 * 65536)
        p2 = (c2 + 2.0 * p1) / (b2 + 2.0)
        p3 = (c3 + 1.0 * p2) / (b3 + 1.0)
        return math.log(min(p3, 1.0))

    def score(self, token: str, own: dict[tuple[int, int], float] | None = None) -> tuple[float, float]:
        """Of ``token``, in a model without what ``own`` gave: in sum, and the mean of its
        characters beyond ASCII."""
        padded = f"\x02\x02{token}\x03"
        out, beyond, n = 0.0, 0.0, 0
        for i in range(2, len(padded)):
            gram = padded[i - 2 : i + 1]
            known = self.memo.get(gram)
            if known is None:
                a, b, c = gram
                keys = ((1, _slot(c)), (2, _slot(b + c)), (2, _slot("\x04" + b)), (3, _slot(gram)), (3, _slot("\x04" + a + b)))
                if len(self.memo) > 500_000:
                    self.memo.clear()
                known = self.memo[gram] = (self._log(keys, {}), keys)
            log = self._log(known[1], own) if own and any(k in own for k in known[1]) else known[0]
            out += log
            if gram[2] > "\x7f":
                beyond += log
                n += 1
        return out, beyond / n if n else 0.0

    def chain(self, chain: str, counted: bool) -> float:
        """Of a chain; ``counted`` if the token judged is one of its cases."""
        return 0.0 if self.steps is None else log_share(self.steps, chain, counted)


def log_share(steps: dict[str, int], chain: str, counted: bool) -> float:
    """The share of all steps' cases that those of a chain have, smoothed over all steps there
    are, so that a step that explains nothing else costs most."""
    total = sum(steps.values()) - counted
    return sum(math.log((max(steps.get(s, 0) - counted, 0) + 1 / STEPS) / (max(total, 0) + 1.0)) for s in chain.split("; "))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = {1: np.zeros(SLOTS), 2: np.zeros(SLOTS), 3: np.zeros(SLOTS)}
    for pdf in batches:
        for token, n in zip(pdf["token"], pdf["n"]):
            for order, gram in _grams(token):
                sums[order][_slot(gram)] += n
                if order > 1:
                    sums[order][_slot("\x04" + gram[:-1])] += n
    for order, s in sums.items():
        at = np.flatnonzero(s)
        yield pd.DataFrame({"ord": order, "slot": at, "n": s[at]})


def train(tokens: DataFrame) -> dict[int, np.ndarray]:
    """Slot counts of (token, n); at most 3 * SLOTS sums come to the driver."""
    sums = tokens.mapInPandas(_count_grams, "ord int, slot int, n double").groupBy("ord", "slot").agg(F.sum("n").alias("n"))
    out = {o: np.zeros(SLOTS, dtype=np.float64) for o in (1, 2, 3)}
    pdf = sums.toPandas()
    for o in out:
        part = pdf[pdf["ord"] == o]
        out[o][part["slot"].to_numpy()] = part["n"].to_numpy()
    return out


def _judge(shared, margins: dict[bool, float], floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for pdf in batches:
            rows = []
            for token, n, inside in zip(pdf["token"], pdf["n"], pdf["inside"]):
                fixed, chain, gain, likely = best(model, token, 1 if inside else 0, not inside)
                if LOST in token:
                    rows.append((token, n, None, "lost", 0.0))
                elif fixed is not None and gain > margins[chain.startswith("utf-8")] and likely >= floor:
                    rows.append((token, n, fixed, chain, gain))
                elif any("\x80" <= c <= "\x9f" for c in token):
                    rows.append((token, n, None, "unknown", 0.0))
            yield pd.DataFrame(rows, columns=["token", "n", "fixed", "chain", "gain"])

    return run


def best(model: Model, token: str, n: float = 0, counted: bool = False) -> tuple[str | None, str | None, float, float]:
    """The likeliest candidate, its chain, its gain over ``token`` (``n`` rows of which are in
    the model) and how likely its characters beyond ASCII are; 0 where its bytes read as UTF-8."""
    found = candidates(token)
    if not found:
        return None, None, -math.inf, -math.inf
    own = Model.own(token, n) if n else None
    top: tuple[float, str, float] | None = None
    for text, chain in found.items():
        (score, likely), sure = model.score(text, own), evidence(text) if chain.startswith("utf-8") else 0.0
        key = (score + sure + model.chain(chain, counted), text, 0.0 if sure else likely)
        if top is None or key > top:
            top = key
    total, fixed, likely = top
    return fixed, found[fixed], total - model.score(token, own)[0], likely


_DAMAGE = {
    True: [("utf-8", a) for a in READ_AS],
    False: [("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1250", "cp1252"), ("cp1253", "cp1252"), ("cp1252", "cp1251"), ("cp866", "cp1251"), ("cp437", "cp1252"), ("shift_jis", "cp1252")],
}


def _garble(token: str, utf8: bool, k: int) -> str | None:
    """A wrong reading of a token, the kind chosen by ``k``; none if it can't be written so."""
    kinds = _DAMAGE[utf8]
    for i in range(len(kinds)):
        written, read = kinds[(k + i) % len(kinds)]
        back = {b: c for c, b in _TABLES[read].items() if b is not None}
        try:
            out = "".join(back[b] for b in token.encode(written))
        except (UnicodeEncodeError, KeyError):
            continue
        if out != token:
            return out
    return None


_MEASURED = "what string, token string, n long, fixed string, chain string, gain double, likely double"


def _measure(shared):
    """(what, token, n, fixed, chain, gain, likely): ``token`` with the best candidate of each
    token. Of clean tokens also ``floor`` with how likely the token itself is, and ``spoilt+`` and
    ``spoilt-`` for copies garbled in these ways, with a gain if they are restored; ``plain+`` or
    ``plain-`` instead of ``token`` if a clean token has a candidate by a chain ending in UTF-8 or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for pdf in batches:
            rows = []
            for token, n, inside in zip(pdf["token"], pdf["n"], pdf["inside"]):
                fixed, chain, gain, likely = best(model, token, 1 if inside else 0, not inside)
                what = "token" if not (inside and chain) else "plain+" if chain.startswith("utf-8") else "plain-"
                rows.append((what, token, n, fixed, chain, gain, likely))
                if not inside:
                    continue
                rows.append(("floor", None, n, None, None, 0.0, model.score(token, Model.own(token, 1))[1]))
                for utf8 in (True, False):
                    bad = _garble(token, utf8, zlib.crc32(token.encode()))
                    if bad:
                        fixed, _, gain, likely = best(model, bad, -n / 100)
                        rows.append(("spoilt+" if utf8 else "spoilt-", None, n, None, None, gain if fixed == token else -math.inf, likely))
            yield pd.DataFrame(rows, columns=["what", "token", "n", "fixed", "chain", "gain", "likely"])

    return run


def validate(measured: DataFrame) -> tuple[dict[bool, float], float]:
    """(margins, floor): the floor is what 99.5 % of the clean tokens reach with their
    characters beyond ASCII; a kind's margin (of chains ending in UTF-8, and of others) is the largest of
    MARGINS whose F1, on them and on copies garbled that way, is within NEAR of the best.

    A row of a clean token is judged by the model without it; a garbled copy by the model
    with a hundredth of the token's rows garbled alike.
    """
    margins = dict.fromkeys((True, False), FIRST_MARGIN)
    letters = measured.where("what = 'floor'").select("likely")
    n = letters.count()
    if not n:
        return margins, FIRST_FLOOR
    floor = letters.orderBy("likely").limit(n // 200 + 1).agg(F.max("likely")).first()[0]
    passed = [F.count(F.when((F.col("likely") >= floor) & (F.col("gain") > m), 1)).alias(f"m{i}") for i, m in enumerate(MARGINS)]
    counts = {r["what"]: r for r in measured.groupBy("what").agg(F.count("*").alias("n"), *passed).collect()}
    for utf8, sign in ((True, "+"), (False, "-")):
        plain, spoilt = counts.get(f"plain{sign}"), counts.get(f"spoilt{sign}")
        if spoilt:
            scores = {}
            for i, m in enumerate(MARGINS):
                hit, false = spoilt[f"m{i}"], plain[f"m{i}"] if plain else 0
                # garbled text is rarer than in these copies: a false alarm weighs as ten misses
                scores[m] = 2 * hit / max(1.0, hit + 10 * false + spoilt["n"])
            margins[utf8] = max(m for m, score in scores.items() if score >= max(scores.values()) - NEAR)
    return margins, float(floor)


def _decide(measured: DataFrame, margins: dict[bool, float], floor: float) -> DataFrame:
    """What ``_judge`` says of the tokens measured, by these margins and this floor."""
    margin = F.when(F.col("chain").startswith("utf-8"), margins[True]).otherwise(margins[False])
    lost = F.col("token").contains(LOST)
    likely = F.col("fixed").isNotNull() & (F.col("gain") > margin) & (F.col("likely") >= floor)
    kind = F.when(lost, "lost").when(likely, F.col("chain")).when(F.col("token").rlike(r"[\x80-\x9f]"), "unknown")
    restored = likely & ~lost
    return measured.where(F.col("token").isNotNull() & kind.isNotNull()).select(
        "token", "n", F.when(restored, F.col("fixed")).alias("fixed"), kind.alias("chain"), F.when(restored, F.col("gain")).otherwise(0.0).alias("gain")
    )


def tokens_of(text) -> F.Column:
    return F.filter(F.split(text, SEPARATORS), lambda t: t.rlike(r"[^\x00-\x7f]"))


def long_fields(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(record, field, text) of fields with characters beyond ASCII."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    rows = df.select(F.col(record).alias("record"), F.inline(pairs))
    return rows.where(F.col("text").rlike(r"[^\x00-\x7f]"))


def judge(rows: DataFrame) -> DataFrame:
    """(token, n, fixed, chain, gain) of the garbled tokens of (record, field, text)."""
    spark = rows.sparkSession
    width = tasks(spark)
    tokens = rows.select(F.explode(tokens_of(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    tokens = cut(tokens.repartition(width, "token"), "garble-tokens")
    clean = cut(tokens.mapInPandas(_unreadable, "token string, n long"), "garble-clean")
    # first pass, with a cautious margin: only what it finds does not train the second model,
    # so that unusual but correct tokens speak for themselves there
    first_model = (train(clean), None)
    counts = spark.sparkContext.broadcast(first_model)
    first = tokens.join(clean.select("token", F.lit(True).alias("inside")), "token", "left").fillna(False, ["inside"])
    margins = dict.fromkeys((True, False), KNOWN_MARGIN)
    judged = cut(first.repartition(width, "token").mapInPandas(_judge(counts, margins, FIRST_FLOOR), _JUDGED), "garble-likely")
    known = tokens.select(F.col("token").alias("fixed"), F.col("n").alias("known"))
    likely = judged.join(known, "fixed", "left").fillna(0, ["known"])
    frequent = (F.col("known") >= KNOWN_TIMES * F.col("n")) & F.col("fixed").isNotNull()
    # a step that explains few other tokens beyond doubt is an unlikely explanation, and a text
    # that is rare where it is right is unlikely to be garbled often
    steps = _steps(likely.where(frequent | (F.col("gain") > FIRST_MARGIN)))
    shares = {r.chain: log_share(steps, r.chain, True) for r in judged.where("fixed is not null").select("chain").distinct().collect()}
    odds = F.least(F.lit(0.0), F.log((F.col("known") + 1) / (F.col("n") + 1)))
    sure = F.col("gain") + F.element_at(_literal_map(shares), F.col("chain")) + odds > DOUBTLESS
    found = cut(likely.where(frequent | F.coalesce(sure, F.lit(False)) | (F.col("chain") == "lost")).drop("known"), "garble-first")
    second = tokens.join(found.select("token", F.lit(False).alias("inside")), "token", "left").fillna(True, ["inside"])
    second = cut(second.repartition(width, "token"), "garble-second")
    fine = second.where("inside")
    counts = spark.sparkContext.broadcast((train(fine), _steps(found)))
    # each token is scored once, both to validate and to be judged by what comes of it
    measured = cut(second.repartition(width, "token").mapInPandas(_measure(counts), _MEASURED), "garble-measured")
    out = cut(_decide(measured, *validate(measured)), "garbled")
    for d in (tokens, clean, judged, found, second, measured):
        drop(d)
    return out


def _steps(judged: DataFrame) -> dict[str, int]:
    """Distinct tokens by step; there are at most ``STEPS``."""
    each = judged.where("fixed is not null").select(F.explode(F.split("chain", "; ")).alias("step"))
    return {r.step: r.n for r in each.groupBy("step").agg(F.count("*").alias("n")).collect()}


def _literal_map(values: dict[str, float]) -> F.Column:
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*flat) if flat else F.lit(None).cast("map<string,double>")


_JUDGED = "token string, n long, fixed string, chain string, gain double"


def affected(rows: DataFrame, garbled: DataFrame) -> DataFrame:
    """(record, field) of the fields with a garbled token."""
    each = rows.select("record", "field", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
    return each.join(garbled.select("token"), "token").select("record", "field").distinct()


def restore(rows: DataFrame, garbled: DataFrame) -> DataFrame:
    """(record, field, text, restored, complete) of the affected fields; ``complete`` unless a
    token could not be restored."""
    each = rows.select("record", "field", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
    fixes = each.join(garbled.select("token", "fixed"), "token").groupBy("record", "field").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "fixed"))).alias("fixes")
    )
    pieces = F.split("text", r"(?<=[ ,;|\t\r\n])|(?=[ ,;|\t\r\n])")
    return rows.join(fixes, ["record", "field"]).select(
        "record",
        "field",
        "text",
        F.array_join(F.transform(pieces, lambda t: F.coalesce(F.element_at("fixes", t), t)), "").alias("restored"),
        F.forall(F.map_values("fixes"), lambda v: v.isNotNull()).alias("complete"),
    )
