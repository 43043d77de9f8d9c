"""Several values packed in one text field.

Every distinct field text is read under all dialects its characters allow (a wrapper, a set
of quote characters, a set of delimiters). A reading costs the bits of its dialect, of its
values, and of structure characters left at the edges of values. Value codes are shared by
all fields: a value costs ``-log2`` of the share of contexts that support it and its part of
spelling it once for all of them; an unknown value is spelled out letter by letter. A context is a field's text without anything but
letters and digits, so that one list written in many dialects counts once, and a field's own
context is left out of its codes: a list that recurs as a whole can't become a value of
itself. The cheapest reading wins; codes are estimated twice, first with all readings of a
field weighing the same, then from the readings chosen.

Null, blank and ``nan`` fields have no values and give no rows; empty pieces are no values;
a field that is one value gives one row. Rows with equal texts get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.session import tasks
from tessellum.sources.scratch import cut, drop
from tessellum.sources.tables import has_value

#: The parts that dialects are made of.
WRAPPERS = {"[": "]", "{": "}", "(": ")"}
QUOTES = "\"'"
DELIMITERS = {
    ",": r",",
    ";": r";",
    "|": r"\|",
    "tab": r"\t",
    "line": r"[\r\n]+",
    "/": r"(?<!\s)/(?!\s)",
    " / ": r"\s+/\s+",
}

SPELL_BITS = 4.7  # a letter of an unknown value
ESCAPE = 1 / 8  # share of the code space kept for unknown values
RESIDUE_BITS = 8.0  # a quote or bracket left at an edge of a value
INSIDE_BITS = 6.0  # a possible delimiter kept inside a value

_EDGE = re.compile(r"^[\[\](){}\"']|[\[\](){}\"']$")
_INSIDE = re.compile("|".join(DELIMITERS.values()))
_QUOTE_START = {q: re.compile(rf"(?:^|[\s\[\](){{}},;|/]){q}") for q in QUOTES}


def split(text: str, quotes: str, delimiter: re.Pattern | None) -> list[str]:
    """The pieces of ``text``; a quote counts only where it encloses a whole piece."""
    out, i, n = [], 0, len(text)
    while i <= n:
        j = i
        while j < n and text[j] in "  ":
            j += 1
        if j < n and text[j] in quotes:
            q, k, piece = text[j], j + 1, []
            while k < n:
                c = text[k]
                if c == "\\" and k + 1 < n and text[k + 1] in "\\\"'":
                    piece.append(text[k + 1])
                    k += 2
                elif c == q and k + 1 < n and text[k + 1] == q and k > j + 1:
                    piece.append(q)
                    k += 2
                elif c == q:
                    break
                else:
                    piece.append(c)
                    k += 1
            if k < n:
                k += 1
                m = k
                while m < n and text[m] in "  ":
                    m += 1
                if m == n:
                    out.append("".join(piece).strip())
                    return out
                d = delimiter and (delimiter.match(text, m) or delimiter.match(text, k))
                if d:
                    out.append("".join(piece).strip())
                    i = d.end()
                    continue
        d = delimiter.search(text, i) if delimiter else None
        out.append(text[i : d.start() if d else n].strip())
        if not d:
            return out
        i = d.end()
    return out


def _subsets(items: list[str]) -> Iterator[tuple[str, ...]]:
    for size in range(len(items) + 1):
        yield from combinations(items, size)


_patterns: dict[tuple[str, ...], re.Pattern | None] = {(): None}


def readings(text: str) -> tuple[str, list[tuple[str, list[str], float]]]:
    """The field's signature (which structure characters it has) and its distinct readings
    as (dialect, values, bits of structure characters left in values)."""
    body = text.strip()
    delimiters = [k for k, p in DELIMITERS.items() if re.search(p, body)]
    quotes = [q for q in QUOTES if _QUOTE_START[q].search(body)]
    wraps = [""] + [w for w in WRAPPERS if body.startswith(w)]
    seen: dict[tuple[str, ...], tuple[str, list[str], float]] = {}
    for wrap in reversed(wraps):
        for qs in reversed(list(_subsets(quotes))):
            for ds in _subsets(delimiters):
                dialect = f"{wrap}\x1f{''.join(qs)}\x1f{'+'.join(ds)}"
                values = read(text, dialect)
                left = sum(RESIDUE_BITS * len(_EDGE.findall(v)) + INSIDE_BITS * len(_INSIDE.findall(v)) for v in values)
                seen.setdefault(tuple(values), (dialect, values, left))
    return f"{''.join(wraps)}{''.join(quotes)} {'+'.join(delimiters)}", list(seen.values())


def read(text: str, dialect: str) -> list[str]:
    """The values of a field in a dialect."""
    wrap, quotes, names = dialect.split("\x1f")
    ds = tuple(names.split("+")) if names else ()
    if ds not in _patterns:
        _patterns[ds] = re.compile("|".join(DELIMITERS[d] for d in ds))
    body = text.strip()
    if wrap:
        body = body[1:-1] if body.endswith(WRAPPERS[wrap]) and len(body) > 1 else body[1:]
    return [v for v in split(body, quotes, _patterns[ds]) if v and v.lower() != "nan"]


def _normal(value: str) -> str:
    return re.sub(r"\s+", " ", value).lower()


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _all_readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            signature, found = readings(text)
            ids = (_hash(text), _hash("".join(c for c in text.lower() if c.isalnum())))
            for n, (dialect, values, left) in enumerate(found):
                keys = [_normal(v) for v in values]
                rows.append((*ids, n, len(found), signature, dialect, left, [_hash(k) for k in keys], [len(k) for k in keys]))
        yield pd.DataFrame(rows, columns=["field", "context", "n", "of", "signature", "dialect", "residue", "keys", "lens"])


_READINGS = (
    "field long, context long, n int, of int, signature string, dialect string, residue double, "
    "keys array<long>, lens array<int>"
)


def _score(cands: DataFrame, weighted: DataFrame) -> DataFrame:
    """``cands`` with ``bits``; ``weighted`` has the readings that make the codes and, in
    ``weight``, how much each counts. Texts, contexts and values are 64-bit hashes here; a
    text is told apart by two of them."""
    support = weighted.select("field", "context", "weight", F.explode(F.array_distinct("keys")).alias("key"))
    support = support.groupBy("field", "context", "key").agg(F.sum("weight").alias("part"))
    support = support.groupBy("context", "key").agg(F.max("part").alias("own"))
    codes = support.groupBy("key").agg(F.sum("own").alias("mass"))
    total = codes.agg(F.sum("mass").alias("total"))
    dialects = weighted.groupBy("signature", "dialect").agg(F.sum("weight").alias("uses"))
    dialects = dialects.select(
        "signature",
        "dialect",
        (-F.log2((F.col("uses") + 0.5) / (F.sum("uses").over(W.partitionBy("signature")) + 2))).alias("dialect_bits"),
    )
    each = cands.select("field", "context", "n", F.explode_outer(F.arrays_zip("keys", "lens")).alias("v"))
    each = each.select("field", "context", "n", F.col("v.keys").alias("key"), F.col("v.lens").alias("len"))
    each = each.join(codes, "key", "left").join(support, ["context", "key"], "left")
    each = each.crossJoin(F.broadcast(total))  # total is one row
    seen = F.greatest(F.coalesce("mass", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)), F.lit(0.0))
    spelled = F.pow(F.lit(2.0), -SPELL_BITS * F.least("len", F.lit(200)))
    far = SPELL_BITS * F.greatest(F.col("len") - 200, F.lit(0))
    code = far - F.log2((1 - ESCAPE) * seen / F.greatest("total", F.lit(1.0)) + ESCAPE * spelled)
    # the contexts that share a value share what spelling it once costs
    bits = F.least(SPELL_BITS * F.col("len") - F.log2(F.lit(ESCAPE)), code + SPELL_BITS * F.col("len") / (seen + 1))
    costs = each.groupBy("field", "context", "n").agg(
        F.sum(F.when(F.col("key").isNull(), 0.0).otherwise(bits)).alias("value_bits")
    )
    return (
        cands.join(costs, ["field", "context", "n"])
        .join(dialects, ["signature", "dialect"], "left")
        .withColumn(
            "bits",
            F.col("value_bits") + F.col("residue") + F.coalesce("dialect_bits", F.lit(4.0)),
        )
        .drop("value_bits", "dialect_bits")
    )


def _best(scored: DataFrame) -> DataFrame:
    return (
        scored.groupBy("field", "context")
        .agg(F.min_by(F.struct("signature", "dialect", "keys"), F.struct(F.round("bits", 6), F.col("n"))).alias("best"))
        .select("field", "context", "best.*")
    )


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame(
            {"text": pdf["text"], "dialect": pdf["dialect"], "vals": [read(t, d) for t, d in zip(pdf["text"], pdf["dialect"])]}
        )


def choose_dialects(texts: DataFrame) -> DataFrame:
    """(text, dialect, vals) for each distinct value of the column ``text``."""
    fields = texts.select("text").where(has_value("text")).distinct().repartition(tasks(texts.sparkSession), "text")
    fields = cut(fields, "fields")
    cands = cut(fields.mapInPandas(_all_readings, _READINGS), "readings")
    first = cut(_best(_score(cands, cands.withColumn("weight", 1 / F.col("of")))), "dialects")
    # second estimate: a field supports just the values of the reading chosen for it
    chosen = cut(_best(_score(cands, first.withColumn("weight", F.lit(1.0)))).select("field", "context", "dialect"), "chosen")
    drop(cands)
    drop(first)
    keyed = fields.mapInPandas(_keyed, "text string, field long, context long").join(chosen, ["field", "context"])
    out = cut(keyed.select("text", "dialect").mapInPandas(_parse, "text string, dialect string, vals array<string>"), "parsed")
    drop(fields)
    drop(chosen)
    return out


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(pdf["text"])
        contexts = [_hash("".join(c for c in t.lower() if c.isalnum())) for t in texts]
        yield pd.DataFrame({"text": texts, "field": [_hash(t) for t in texts], "context": contexts})


def unpack(df: DataFrame, ids: list[str], col: str | Column, least: int = 1) -> DataFrame:
    """Columns ``ids`` of ``df`` with ``pos`` (from 1) and ``val``, a row for each value of
    the packed field ``col``; only of fields with at least ``least`` values.

    A text that very many rows share is one row here on the dialect side, so the join back
    splits its rows over tasks (adaptive skew handling) or broadcasts when the parsed side
    is measured to be small.
    """
    text = F.col(col) if isinstance(col, str) else col
    rows = df.select(*[F.col(i).alias(f"__{i}") for i in ids], text.cast("string").alias("text"))
    parsed = choose_dialects(rows).where(F.size("vals") >= least)
    out = rows.join(parsed, "text").select(*[F.col(f"__{i}").alias(i) for i in ids], F.posexplode("vals").alias("p", "val"))
    return out.select(*ids, (F.col("p") + 1).alias("pos"), "val")
