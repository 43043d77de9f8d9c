"""Occurrence and record counts of every term, kept by signed deltas.

A delta holds records added (sign 1) and removed (sign -1); a changed record is both. Deltas
are first summed by field and text, so a text that a third of all records share is one row
before anything is shuffled, then split into terms, summed by term, and merged into the
partitions of a persistent table that hold those terms. Other partitions are not touched.

``TermStore`` keeps, below one path, ``counts/<batch>/bucket=<k>`` with the rows of the
buckets that a batch rewrote, and ``manifest/<batch>`` with the batch that holds each bucket,
the batches applied and the records counted so far. A batch counts once its manifest is
complete; one that was broken off leaves the store as it was, and one that is applied again is
skipped. The number of buckets follows from the first batch; it doubles, and the next batch
rewrites all of them, when there are more than ``BUCKET_TERMS`` terms for each. ``compact``
removes what no manifest but the last needs.

Null, blank and ``nan`` texts are no values and count nowhere. Records removed before they
were added count negative until the addition arrives; ``counts`` leaves out terms without
records. An empty delta changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.sources import scratch
from tessellum.sources.tables import has_value, squeeze

#: How a field's text becomes an array of terms.
WORDS = "words"
WHOLE = "whole"


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def whole(text: Column) -> Column:
    """The whole text, trimmed, runs of spaces as one, in lower case."""
    return F.array(F.lower(squeeze(text)))


SPLITTERS: dict[str, Callable[[Column], Column]] = {WORDS: words, WHOLE: whole}


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows (field columns of both, sign) that turn ``old`` into ``new``: -1 for rows gone or
    changed, 1 for rows added or changed. ``key`` identifies a record and is not null."""
    cols = [c for c in old.columns if c != key]
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = both.where(F.col(f"o.{key}").isNull() | F.col(f"n.{key}").isNull() | ~same)
    sides = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col(f"o.{key}").alias(key), *[F.col(f"o.{c}").alias(c) for c in cols]),
        F.struct(F.lit(1).alias("sign"), F.col(f"n.{key}").alias(key), *[F.col(f"n.{c}").alias(c) for c in cols]),
    )
    return changed.select(F.inline(sides)).where(F.col(key).isNotNull()).drop(key)


def texts(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, text, sign) of the named columns of ``df``; ``sign`` is 1 where it has none."""
    sign = F.col("sign") if "sign" in df.columns else F.lit(1)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in fields])
    return df.select(F.inline(pairs), sign.alias("sign")).where(has_value("text"))


_MANIFEST = "n long, batches array<string>, held map<int,string>, records map<string,long>, buckets int, terms long"
_COUNTS = "field string, term string, occurrences long, records long"
BUCKET_TERMS = 500_000
LEAST_BUCKETS = 32


class TermStore:
    """Persistent counts of the fields in ``fields`` (column name to splitter name)."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, str], bucket_terms: int = BUCKET_TERMS, buckets: int = LEAST_BUCKETS) -> None:
        self.spark, self.path, self.fields, self.bucket_terms = spark, path, fields, bucket_terms
        self.buckets, self.terms = buckets, 0
        self.held: dict[int, str] = {}
        self.records: dict[str, int] = dict.fromkeys(fields, 0)
        self.batches: list[str] = []
        self._open()

    def _open(self) -> None:
        if not scratch.exists(self.spark, f"{self.path}/manifest"):
            return
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/*").orderBy(F.desc("n")).limit(1)
        for r in rows.collect():
            self.batches, self.held, self.records = list(r.batches), dict(r.held), dict(r.records)
            self.buckets, self.terms = r.buckets, r.terms

    def _read(self, buckets: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/counts/{self.held[b]}/bucket={b}" for b in buckets if b in self.held]
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else None

    def apply(self, delta: DataFrame, batch: str) -> None:
        """Merge ``delta`` (the fields' columns, and ``sign`` if records are removed)."""
        if batch in self.batches:
            return
        by_text = scratch.cut(
            texts(delta, self.fields).groupBy("field", "text").agg(F.sum("sign").alias("n")).where("n <> 0"), "delta-texts"
        )
        added = {r.field: r.n for r in by_text.groupBy("field").agg(F.sum("n").alias("n")).collect()}
        split = F.lit(None).cast("array<string>")
        for field, how in self.fields.items():
            split = F.when(F.col("field") == field, SPLITTERS[how](F.col("text"))).otherwise(split)
        found = by_text.select("field", "n", split.alias("terms"))
        # each occurrence of a term counts, the records of a text once for each of its terms
        times = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("o"), F.lit(0).alias("r")))
        once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("o"), F.lit(1).alias("r")))
        each = found.select("field", "n", F.inline(F.concat(times, once)))
        sums = scratch.cut(
            each.groupBy("field", "term")
            .agg(F.sum(F.col("n") * F.col("o")).alias("occurrences"), F.sum(F.col("n") * F.col("r")).alias("records"))
            .where("occurrences <> 0 or records <> 0"),
            "delta-terms",
        )
        # at least the larger of the two sides: enough to size the buckets by
        terms, buckets = max(self.terms, sums.count()), self.buckets
        while terms > self.bucket_terms * buckets:
            buckets *= 2
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(buckets)).cast("int").alias("bucket")
        placed = sums.select("*", bucket)
        if buckets == self.buckets:
            touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())  # at most self.buckets
            old, held = self._read(touched), dict(self.held)
        else:
            touched, old, held = list(range(buckets)), self._read(sorted(self.held)), {}
        merged = placed if old is None else placed.unionByName(old.select("*", bucket))
        merged = (
            merged.repartition(max(len(touched), 1), "bucket")
            .groupBy("bucket", "field", "term")
            .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            .where("occurrences <> 0 or records <> 0")
        )
        if touched:
            merged.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/counts/{batch}")
            for b in touched:
                if scratch.exists(self.spark, f"{self.path}/counts/{batch}/bucket={b}"):
                    held[b] = batch
                else:  # every term of the bucket is gone
                    held.pop(b, None)
        self.records = {f: self.records.get(f, 0) + added.get(f, 0) for f in self.fields}
        self.held, self.buckets, self.batches = held, buckets, [*self.batches, batch]
        stored = self._read(sorted(held))
        self.terms = stored.count() if stored is not None and touched else self.terms
        row = [(len(self.batches), self.batches, held, self.records, buckets, self.terms)]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        scratch.drop(by_text)
        scratch.drop(sums)

    def compact(self) -> None:
        """Remove the folders of batches that hold no bucket any more, and all manifests but
        the last. Nothing else may read the store meanwhile."""
        last, used = self.batches[-1:], set(self.held.values())
        for batch in self.batches:
            if batch not in used:
                scratch.delete(self.spark, f"{self.path}/counts/{batch}")
            if batch not in last:
                scratch.delete(self.spark, f"{self.path}/manifest/{batch}")

    def counts(self) -> DataFrame:
        """(field, term, occurrences, records)."""
        read = self._read(sorted(self.held))
        if read is None:
            return self.spark.createDataFrame([], _COUNTS)
        return read.where("records > 0")

    def marks(self, rare_below: int = 3, common_percent: int = 1) -> DataFrame:
        """``counts`` with ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common``
        in more than ``common_percent`` of the field's records (rare goes first), else null."""
        limit = F.lit(None).cast("long")
        for field, n in self.records.items():
            limit = F.when(F.col("field") == field, F.lit(n * common_percent)).otherwise(limit)
        mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > limit, "common")
        return self.counts().withColumn("mark", mark)
