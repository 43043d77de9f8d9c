"""All pairs of records whose sets of values overlap above a Jaccard threshold.

Pigeonhole partitioning. Sizes fall into classes; the token universe is split by hash into as
many segments as the class asks for. Two sets that differ in at most H tokens can't differ in
more than t(k) tokens in every segment k, if the t(k) + 1 sum up to more than H. The smaller
set of a pair leaves, for its class, each segment's tokens (exact signatures) and each
segment's tokens without one of them (deletion signatures). The larger set chooses for each
segment to look up nothing (t = -1), the exact signature (t = 0), or all that is one token
apart (t = 1: its segment against both kinds, and its own deletions against the exact ones).
It makes the cheapest choice that reaches the sum, a look-up costing the records of the
segment's rarest token, so that frequent tokens and empty segments are looked up only where
nothing else would do; spare segments make that rare at any size. Signatures of frequent
tokens alone are salted: the many sets that leave one are dealt out, the few look-ups repeated.
Sets of frequent tokens share signatures more and more often as the records grow, so each
signature travels with a sketch of its set, 64 bits of which a token turns one over: the
sketches of two sets differ in no more bits than the sets in tokens. Only what passes this
becomes a candidate, and is verified on the sets themselves; nothing is missed.

Records with equal sets are one class: candidates are found between classes, and copies are
attached again at the end. Sets that no other set's size could match are left out before any
set is gathered into a row, which needs just their sizes.

``threshold`` is a fraction (numerator, denominator). Null records and values are none; empty
sets and those under ``least`` values take no part; repeated values count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.session import tasks
from tessellum.sources.scratch import cut, drop

#: Records of a signature's rarest token for each salt of it, and salts at most.
SALT_RECORDS, MOST_SALTS = 50_000, 64


def differ(total: int, num: int, den: int) -> int:
    """Tokens in which two similar sets of ``total`` tokens together differ, at most."""
    return total - 2 * -(-num * total // (num + den))


def most_differ(low: int, high: int, num: int, den: int) -> int:
    """The largest ``differ`` of the totals low..high. It wavers by less than two from a
    straight line that rises with the total, so the last totals decide."""
    steep = -(-4 * (num + den) // max(1, den - num))
    return max(differ(t, num, den) for t in range(max(low, high - steep), high + 1))


@lru_cache(maxsize=None)
def size_class(size: int, num: int, den: int) -> tuple[int, int]:
    """The class (smallest and largest size) of a set size."""
    low = 1
    while True:
        high = low * den // num
        if size <= high:
            return low, high
        low = high + 1


@lru_cache(maxsize=None)
def segments(low: int, high: int, num: int, den: int) -> int:
    """Segments of a class: half the largest difference to a larger set, and spare ones, so
    that segments with no token or just one need not be looked up at any size."""
    most = most_differ(low, high + high * den // num, num, den)
    return most // 2 + 2 + most // 16


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def _split(tokens: list[int], counts: list[int], m: int, low: int) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for t, c in zip(tokens, counts):
        out[xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), seed=low) % m].append((t, c))
    for seg in out:
        seg.sort()
    return out


def _exact(low: int, k: int, seg) -> int:
    return _hash("e", low, k, *[t for t, _ in seg])


def _deleted(low: int, k: int, seg) -> int:
    return _hash("d", low, k, *[t for t, _ in seg])


def salts(seg, total: int) -> int:
    """Salts of a signature: more where all its tokens are frequent. Both sides know the
    counts, so both know the number."""
    return min(MOST_SALTS, 1 + min((c for _, c in seg), default=total) // SALT_RECORDS)


def salted(sig: int, salt: int) -> int:
    """Another signature for each salt."""
    return ((sig + (1 << 63) + salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) - (1 << 63)


def sketch(tokens: list[int]) -> int:
    """A bit for each 64th of the tokens: whether their number is odd."""
    bits = 0
    for t in tokens:
        bits ^= 1 << (t & 63)
    return bits - ((bits >> 63) << 64)


def alike(num: int, den: int) -> Column:
    """Whether the sketches differ in no more bits than similar sets of these sizes in tokens."""
    total = F.col("size") + F.col("rsize")
    both = F.floor((num * total + (num + den - 1)) / F.lit(num + den))
    return F.bit_count(F.col("sketch").bitwiseXOR(F.col("rsketch"))) <= total - 2 * both


def _index(num: int, den: int, total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sid, size, tokens, counts in zip(pdf["sid"], pdf["size"], pdf["tokens"], pdf["counts"]):
                low, high = size_class(int(size), num, den)
                m, sid, tokens = segments(low, high, num, den), int(sid), list(map(int, tokens))
                bits = sketch(tokens)
                for k, seg in enumerate(_split(tokens, list(map(int, counts)), m, low)):
                    kinds = [(_exact(low, k, seg), seg)]
                    for i in range(len(seg)):
                        left = seg[:i] + seg[i + 1 :]
                        kinds.append((_deleted(low, k, left), left))
                    rows.extend((salted(sig, sid % salts(of, total)), sid, size, bits) for sig, of in kinds)
            yield pd.DataFrame(rows, columns=["sig", "sid", "size", "sketch"])

    return run


def choose(costs: list[tuple[float, float]], need: int) -> list[int]:
    """t for each segment (-1, 0 or 1) with the sum of t + 1 at least ``need`` and the least
    cost; ``costs`` are those of t = 0 and t = 1. The step from 0 to 1 never costs less than
    that from -1 to 0, so taking the cheapest steps one by one is the optimum at any size."""
    steps = [(zero, k) for k, (zero, _) in enumerate(costs)] + [(one - zero, k) for k, (zero, one) in enumerate(costs)]
    steps.sort()
    ts = [-1] * len(costs)
    for _, k in steps[:need]:
        ts[k] += 1
    return ts


def _probe(num: int, den: int, total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sid, size, tokens, counts in zip(pdf["sid"], pdf["size"], pdf["tokens"], pdf["counts"]):
                size, sid, tokens, counts = int(size), int(sid), list(map(int, tokens)), list(map(int, counts))
                bits = sketch(tokens)
                least = -(-num * size // den)  # the smallest size that can match
                low, high = size_class(size, num, den)
                while high >= least and low >= 1:
                    partner = min(high, size)
                    most = most_differ(size + max(low, least), size + partner, num, den)
                    m = segments(low, high, num, den)
                    segs = _split(tokens, counts, m, low)
                    costs = []
                    for seg in segs:
                        rarest = min((c for _, c in seg), default=total)
                        fewer = sum(min((c for j, (_, c) in enumerate(seg) if j != i), default=total) for i in range(len(seg)))
                        costs.append((rarest, 2 * rarest + fewer))
                    for k, (t, seg) in enumerate(zip(choose(costs, most + 1), segs)):
                        kinds = []
                        if t >= 0:
                            kinds.append((_exact(low, k, seg), seg))
                        if t == 1:
                            kinds.append((_deleted(low, k, seg), seg))
                            for i in range(len(seg)):
                                left = seg[:i] + seg[i + 1 :]
                                kinds.append((_exact(low, k, left), left))
                        for sig, of in kinds:
                            rows.extend((salted(sig, salt), sid, size, bits) for salt in range(salts(of, total)))
                    if low == 1:
                        break
                    low, high = size_class(low - 1, num, den)
            yield pd.DataFrame(rows, columns=["sig", "rid", "rsize", "rsketch"])

    return run


def sets(df: DataFrame, record: str, value: str | Column, least: int, threshold: tuple[int, int] = (7, 10)) -> tuple[DataFrame, DataFrame]:
    """(members, classes): ``members`` (record, sid) and ``classes`` (id, sid, size, toks, tokens,
    counts) of the sets that take part; equal sets share ``sid``, and ``id`` is as unique."""
    num, den = threshold
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.col(record).cast("string").alias("record"), value.alias("value"))
    rows = cut(rows.where("record is not null and value is not null").distinct(), "set-rows", clean=True)
    sizes = rows.groupBy("record").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    # the distinct sizes are few (their number is at most the root of twice the rows)
    near = W.orderBy("size")
    alive = sizes.groupBy("size").count().select(
        "size",
        (
            (F.col("count") > 1)
            | F.coalesce(F.lag("size").over(near) * den >= F.col("size") * num, F.lit(False))
            | F.coalesce(F.lead("size").over(near) * num <= F.col("size") * den, F.lit(False))
        ).alias("alive"),
    )
    sizes = sizes.join(alive.where("alive"), "size").select("record", "size")
    used = cut(rows.join(sizes, "record"), "set-used", clean=True)
    counts = cut(used.groupBy("value").agg(F.count("*").alias("n")), "set-counts", clean=True)
    # values in more than a thousandth of the rows are under a thousand: these are joined where
    # their rows are, so that no task gets all rows of a frequent value
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * 1000 > total)
    marked = used.join(F.broadcast(hot), "value", "left")
    cold = marked.where("n is null").drop("n").join(counts, "value")
    gathered = (
        marked.where("n is not null")
        .unionByName(cold)
        .groupBy("record", "size")
        .agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("all"))
        .select("record", "size", F.col("all.value").alias("toks"), F.col("all.n").alias("counts"))
    )
    gathered = cut(gathered, "sets", clean=True)
    classes = cut(
        gathered.groupBy("toks")
        .agg(F.min("record").alias("sid"), F.first("size").alias("size"), F.first("counts").alias("counts"))
        .select(F.monotonically_increasing_id().alias("id"), "sid", "size", "toks", F.transform("toks", lambda t: F.xxhash64(t)).alias("tokens"), "counts"),
        "set-classes",
        clean=True,
    )
    members = gathered.join(classes.select("sid", "toks"), "toks").select("record", "sid")
    members = cut(members, "set-members", clean=True)
    for d in (rows, used, counts, gathered):
        drop(d)
    return members, classes


def class_pairs(classes: DataFrame, threshold: tuple[int, int] = (7, 10)) -> DataFrame:
    """(rid, sid, shared, size_r, size_s): pairs of different sets that are similar enough."""
    num, den = threshold
    total = max(1, classes.count())
    # signatures travel with a number for the set, which was written once and so stays the same
    slim = classes.select(F.col("id").alias("sid"), "size", "tokens", "counts").repartition(tasks(classes.sparkSession), "sid")
    index = slim.mapInPandas(_index(num, den, total), "sig long, sid long, size int, sketch long")
    probe = slim.mapInPandas(_probe(num, den, total), "sig long, rid long, rsize int, rsketch long")
    once = (F.col("size") < F.col("rsize")) | ((F.col("size") == F.col("rsize")) & (F.col("sid") < F.col("rid")))
    fits = F.col("size") * den >= F.col("rsize") * num
    hit = probe.join(index, "sig").where(once & fits & alike(num, den))
    found = cut(hit.select(F.col("rid").alias("rh"), F.col("sid").alias("sh")).distinct(), "set-candidates", clean=True)
    left = classes.select(F.col("id").alias("rh"), F.col("sid").alias("rid"), F.col("toks").alias("rt"))
    right = classes.select(F.col("id").alias("sh"), "sid", F.col("toks").alias("st"))
    both = found.join(left, "rh").join(right, "sh").select(
        "rid", "sid", F.size(F.array_intersect("rt", "st")).alias("shared"), F.size("rt").alias("size_r"), F.size("st").alias("size_s")
    )
    return both.where(F.col("shared") * (num + den) >= (F.col("size_r") + F.col("size_s")) * num)


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b of all records whose sets are similar, copies of a set among them."""
    ra = members.select(F.col("record").alias("x"), F.col("sid").alias("rid"))
    sb = members.select(F.col("record").alias("y"), "sid")
    across = pairs.select("rid", "sid").join(ra, "rid").join(sb, "sid").select("x", "y")
    copies = members.select(F.col("record").alias("x"), "sid").join(sb, "sid").where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
