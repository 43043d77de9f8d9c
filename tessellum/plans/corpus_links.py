"""Parent-child links of the corpus: types from ``table_gt``, attributes from ``example``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators.packed import unpack
from tessellum.sources.tables import has_value, squeeze, table

#: How example paths are written.
ARROWS = r"\s*(?:-{1,2}>|=>|→|>)\s*"
LIST_MARKS = r"^\s*(?:[-*•]|\d+[.)])\s+"


def _pairs(chains: DataFrame) -> DataFrame:
    """Links of rows (src, chain), a chain running from the lower to the upper name."""
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("chain") - 1, F.lit(1))),
        lambda i: F.struct(
            F.element_at("chain", i.cast("int")).alias("child"),
            F.try_element_at("chain", (i + 1).cast("int")).alias("parent"),
        ),
    )
    return chains.where(F.size("chain") > 0).select("src", F.explode(steps).alias("s")).select("src", "s.*")


def type_links(spark: SparkSession, directory: str) -> DataFrame:
    """(src, child, parent) from class to the first superclass and on along the list."""
    gt = table(spark, directory, "table_gt").select("gt_id", "class", "superclass")
    uppers = unpack(gt, ["gt_id"], "superclass").groupBy("gt_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: F.lower(squeeze(x.val))).alias("up")
    )
    own = F.when(has_value("class"), F.array(F.lower(squeeze("class")))).otherwise(F.array().cast("array<string>"))
    chain = F.filter(
        F.concat(own, F.coalesce("up", F.array().cast("array<string>"))), lambda x: ~x.isin("", "nan")
    )
    return _pairs(gt.join(uppers, "gt_id", "left").select(F.lit("table_gt").alias("src"), chain.alias("chain")))


def attribute_links(spark: SparkSession, directory: str) -> DataFrame:
    """(src, child, parent) from each name of an example path to the one above it."""
    path = table(spark, directory, "example").select(F.explode("attrs_hier").alias("path"))
    path = path.where(has_value("path") & (F.lower(F.trim("path")) != "n/a"))
    names = F.split(F.regexp_replace("path", LIST_MARKS, ""), ARROWS)
    chain = F.filter(F.transform(names, lambda x: F.lower(squeeze(x))), lambda x: ~x.isin("", "nan", "n/a"))
    return _pairs(path.select(F.lit("example").alias("src"), F.reverse(chain).alias("chain")))


def corpus_links(spark: SparkSession, directory: str) -> DataFrame:
    return type_links(spark, directory).unionByName(attribute_links(spark, directory))
