"""Column types by vote over cells, the features of subject columns, and the scores made of them.

``ac``, ``cm`` and ``ws`` are 0, a two-word cell that is no number or date has no vote, a short
word counts as an acronym. Cells are expressions over the column's own row, so only narrow rows
are grouped by table. Dates are those of ``text.is_date``; words aren't lemmatized.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import ordering
from tessellum.session import spread
from tessellum.sources.scratch import cut

FRACTION = 100  # cells that vote; the last cell of a column never does
KINDS = ("long_text", "named_entity", "number", "date", "empty", "other")
#: What a CSV reader takes for a missing cell.
MISSING = ("", "#N/A", "NULL", "NaN", "n/a", "nan", "null", "NA", "<NA>", "N/A", "None")


def cells_of(vals: Column) -> Column:
    """The cells of a packed sample: split at the strongest delimiter that it has."""
    sep = F.when(vals.contains(";"), ";").when(vals.contains("|"), r"\|").when(vals.contains("\t"), "\t").when(vals.contains("\n"), "\n").otherwise(",")
    return F.coalesce(F.transform(F.split(vals, sep), lambda c: F.trim(c)), F.array().cast("array<string>"))


def _acronym(c: Column) -> Column:
    lower = (c == F.lower(c)) & (c != F.upper(c))
    rest = F.regexp_replace(F.regexp_replace(c, r"\b[A-Z\\.]{2,}\b", ""), T.PUNCT, "")
    return (~lower & (F.length(c) < 3)) | ((F.length(c) < 6) & (rest == ""))


def _vote(c: Column, stop: Column) -> Column:
    """The kind of a cell; ``other2`` votes twice, ``none`` not at all, ``text`` by its length."""
    single, alpha = ~c.contains(" "), c.rlike(r"^\p{L}+$")
    word = F.lower(T.plain_tokens(c))
    parts, words = F.split(T.tokens_with_digits(c), " "), F.split(T.plain_tokens(c), " ")
    number = T.is_number(c) | (c.contains(",") & T.is_number(F.replace(c, F.lit(","), F.lit(""))))
    listed = F.array_contains(stop, word)
    digits_gone = F.regexp_replace(c, "[0-9]", "")
    return (
        F.when(T.is_empty(c), "empty")
        .when(single & number, "number")
        .when(single & T.is_date(c), "date")
        .when(single & alpha & _acronym(c), "other")
        .when(single & alpha & ~listed & ~word.isin("yes", "no"), "named_entity")
        .when(single & alpha, "other2")
        .when(single & (T.is_url(c) | _acronym(digits_gone)), "other")
        .when(single & word.rlike(r"^\p{L}{6,}$") & ~listed, "named_entity")
        .when(single, "other")
        .when((F.size(parts) == 2) & T.is_number(parts[0]), "number")
        .when((F.size(parts) == 2) & T.is_date(T.tokens_with_digits(c)), "date")
        .when(F.size(parts) == 2, "none")
        .when(F.size(words) >= 3, "text")
        .when(F.exists(words, lambda w: F.length(w) >= 6), "named_entity")
        .otherwise("other")
    )


def _stop_words() -> Column:
    return F.array(*[F.lit(w) for w in StopWordsRemover.loadDefaultStopWords("english")])


def columns(df: DataFrame, table: str, col: str, vals: str) -> DataFrame:
    """(f, col_id, idx, kind, n, emc, tlc, vt, entity) of the columns of each table: place, type,
    cells, share of empty ones, variance of the counts of words but stop words (entities only),
    mean words, and whether the mean is below 20 words (an entity by the sampling rule)."""
    stop = _stop_words()
    rows = spread(df.select(F.col(table).alias("f"), F.col(col).alias("col_id"), F.col(vals).alias("vals")))
    cells = rows.select("f", "col_id", cells_of(F.col("vals")).alias("cells"))
    n = F.size("cells")
    voted = F.slice("cells", F.lit(1), F.greatest(F.lit(0), F.least(F.lit(FRACTION), n - 1)))
    votes = cells.withColumns({"n": n, "voted": voted}).withColumn("votes", F.transform("voted", lambda c: _vote(c, stop)))

    def count(kind: str) -> Column:
        return F.size(F.filter("votes", lambda v: v == kind))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda a, x: a + x)

    texts = F.filter("voted", lambda c, i: F.get("votes", i) == "text")
    tokens = total(F.transform(texts, lambda c: F.size(F.split(T.plain_tokens(c), " "))))
    long = tokens > 15 * count("text")
    counts = F.array(
        F.when(long, count("text")).otherwise(0),
        count("named_entity") + F.when(long, 0).otherwise(count("text")),
        count("number"),
        count("date"),
        count("empty"),
        count("other") + 2 * count("other2"),
    )
    kind = F.array(*[F.lit(k) for k in KINDS])[F.array_position(counts, F.array_max(counts)).cast("int") - 1]
    sizes = F.transform(
        "cells",
        lambda c: F.when(T.is_empty(c), 0).otherwise(F.size(F.filter(F.split(F.lower(T.plain_tokens(c)), " "), lambda w: ~F.array_contains(stop, w)))),
    )
    present = F.filter("cells", lambda c: ~c.isin(*MISSING))
    typed = votes.withColumns({"kind": kind, "sizes": sizes, "present": present}).select(
        "f",
        "col_id",
        "kind",
        "n",
        F.coalesce(F.try_divide(F.size(F.filter("cells", T.is_empty)), "n"), F.lit(0.0)).alias("emc"),
        total(F.col("sizes")).cast("double").alias("s"),
        total(F.transform("sizes", lambda x: x * x)).cast("double").alias("ss"),
        F.try_divide(total(F.transform("cells", lambda c: F.size(F.split(c, " ")))), "n").alias("vt"),
        (total(F.transform("present", lambda c: F.size(F.split(F.trim(c), r"\s+")))) < 20 * F.size("present")).alias("entity"),
    )
    tlc = F.when(F.col("kind") != "named_entity", 0.0).otherwise(F.try_divide(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("n") - 1))
    # written before it is ranked: a sort by ranges reads its input twice
    typed = cut(typed.select("f", "col_id", "kind", "n", "emc", tlc.alias("tlc"), "vt", "entity"), "typed")
    ranked = ordering.group_rank(typed, "f", ["col_id"], "idx")
    return ranked.select("f", "col_id", "idx", "kind", "n", "emc", "tlc", "vt", "entity")


def _by_table(cols: DataFrame, *aggs: Column) -> DataFrame:
    """``cols`` with aggregates of each table. They are few and joined back, so the columns of a
    table that has most of them stay where they are."""
    sums = cols.groupBy(F.col("f").alias("__f")).agg(*aggs)
    return cols.join(sums, F.col("f").eqNullSafe(F.col("__f"))).drop("__f")


def distances(cols: DataFrame) -> DataFrame:
    """``cols`` with ``df``: places after the table's first named-entity column, 0 of others."""
    ne = F.col("kind") == "named_entity"
    both = _by_table(cols, F.min(F.when(ne, F.col("idx"))).alias("first_ne"))
    return both.withColumn("df", F.when(ne, F.col("idx") - F.col("first_ne")).otherwise(0))


def scores(cols: DataFrame, entities_only: bool = True) -> DataFrame:
    """``cols`` with ``df`` and ``score``: the features are z-scored within the column."""
    uc = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    none = F.lit(0.0)  # ac, cm and ws
    features = (F.col("emc"), uc, none, F.col("df").cast("double"), none, none)
    mean = sum(features[1:], features[0]) / 6
    std = F.sqrt(sum(((x - mean) * (x - mean) for x in features), none) / 6)

    def z(x: Column) -> Column:
        return F.coalesce(F.try_divide(x - mean, std), none)

    score = (z(uc) + 2 * (z(none) + z(none)) - z(F.col("emc"))) / F.sqrt(F.col("df") + 1.0)
    if entities_only:
        score = F.when(F.col("kind") == "named_entity", score).otherwise(0.0)
    return distances(cols).withColumn("score", score)


def subject_columns(scored: DataFrame) -> DataFrame:
    """(f, col_id) of the columns with the table's highest score, all of equals."""
    return _by_table(scored, F.max("score").alias("best")).where("score = best").select("f", "col_id")


def weights(scored: DataFrame) -> DataFrame:
    """(f, col_id, w): positive scores by their sum; if there are none, 1 for the first best."""
    up = F.greatest("score", F.lit(0.0))
    ranked = _by_table(scored, F.sum(up).alias("sum"), F.max_by("idx", F.struct("score", -F.col("idx"))).alias("top"))
    return ranked.select("f", "col_id", F.when(F.col("sum") > 0, up / F.col("sum")).otherwise((F.col("idx") == F.col("top")).cast("double")).alias("w"))


def first_entities(cols: DataFrame) -> DataFrame:
    """(f, col_id): the first named-entity column of each table, all columns if there is none."""
    return distances(cols).where("first_ne is null or idx = first_ne").select("f", "col_id")


def leftmost(cols: DataFrame, n: int = 2) -> DataFrame:
    """(f, col_id, idx) of the columns up to the ``n``-th entity (by the sampling rule)."""
    entities = ordering.top_per_group(cols.where("entity").select("f", "idx"), ["f"], ["idx"], n)
    last = entities.groupBy(F.col("f").alias("__f")).agg(F.max("idx").alias("last"), F.count("*").alias("have"))
    both = cols.join(last, F.col("f").eqNullSafe(F.col("__f")), "left")
    return both.where((F.coalesce("have", F.lit(0)) < n) | (F.col("idx") <= F.col("last"))).select("f", "col_id", "idx")
