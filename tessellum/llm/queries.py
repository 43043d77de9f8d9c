"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import canon, garbled, leaks, quality, set_pairs, terms, tokenize
from tessellum.sources.scratch import cut, new_path
from tessellum.sources.tables import has_value, table

TERM_FIELDS = {"ColumnLabel": terms.WORDS, "class": terms.WHOLE}
LATE = "2023-12-01"


def _term_rows(spark: SparkSession, directory: str) -> DataFrame:
    """(ColumnLabel, class, late) of all rows of both tables."""
    late = F.coalesce(F.col("loaded_at") >= F.lit(LATE).cast("timestamp"), F.lit(False)).alias("late")
    columns = table(spark, directory, "column_gt").select("ColumnLabel", F.lit(None).cast("string").alias("class"), late)
    types = table(spark, directory, "table_gt").select(F.lit(None).cast("string").alias("ColumnLabel"), "class", late)
    return columns.unionByName(types)


def term_store(spark: SparkSession, directory: str) -> terms.TermStore:
    """A store that got the rows in two deliveries, as they arrive: first those loaded before
    ``LATE``, then the rest as a delta."""
    store = terms.TermStore(spark, new_path(spark, "terms"), TERM_FIELDS)
    rows = _term_rows(spark, directory)
    store.apply(rows.where("not late"), "base")
    store.apply(rows.where("late"), "late")
    return store


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return term_store(spark, directory).marks().where("mark is not null").select("field", "term", "mark")


def p1_counts(spark: SparkSession, directory: str) -> DataFrame:
    return term_store(spark, directory).counts().select("field", "term", "occurrences", "records")


def p1_increment(spark: SparkSession, directory: str) -> DataFrame:
    """Counts after rows were changed and deleted: labels of the columns of one folder's
    files are replaced by their lowest class, and rows loaded late are gone."""
    rows = table(spark, directory, "column_gt").select("col_id", "ColumnLabel", "LowestClass", "fileName", "loaded_at")
    old = rows.select("col_id", "ColumnLabel")
    label = F.when(F.col("fileName").startswith("export_"), F.col("LowestClass")).otherwise(F.col("ColumnLabel"))
    new = rows.where(F.coalesce(F.col("loaded_at") < F.lit(LATE).cast("timestamp"), F.lit(True))).select(
        "col_id", label.alias("ColumnLabel")
    )
    store = terms.TermStore(spark, new_path(spark, "terms"), {"ColumnLabel": terms.WORDS})
    store.apply(old, "base")
    store.apply(terms.changes(old, new, "col_id"), "changes")
    return store.counts().select("term", "occurrences", "records")


def _column_texts(spark: SparkSession, directory: str) -> DataFrame:
    return cut(garbled.long_fields(table(spark, directory, "column_gt"), "col_id", ["colName", "vals"]), "fields")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    rows = _column_texts(spark, directory)
    return garbled.affected(rows, garbled.judge(rows)).select(F.col("record").alias("col_id"), "field")


def p4_restored(spark: SparkSession, directory: str) -> DataFrame:
    rows = _column_texts(spark, directory)
    return garbled.restore(rows, garbled.judge(rows)).withColumnRenamed("record", "col_id")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    columns, reference = table(spark, directory, "column_gt"), table(spark, directory, "label_ref")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("colName", "ColumnLabel")])
    rows = columns.select("col_id", F.inline(pairs)).where(has_value("value"))
    rows = rows.join(reference.select(F.col("label").alias("value")), "value", "left_anti")
    answers = cut(canon.resolve(rows, reference, "label_id", ["label", "alt_label"]), "resolved")
    return rows.join(answers, "value").select("col_id", "field", F.col("entry").alias("label_id"))


def p5_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    """Values that mean no entry, with their number of rows."""
    columns, reference = table(spark, directory, "column_gt"), table(spark, directory, "label_ref")
    values = columns.select(F.explode(F.array("colName", "ColumnLabel")).alias("value")).where(has_value("value"))
    counts = cut(values.groupBy("value").agg(F.count("*").alias("n_rows")), "value-counts")
    answers = canon.resolve(counts, reference, "label_id", ["label", "alt_label"])
    return counts.join(answers.where("entry = 0").select("value"), "value")


def _label_sets(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, directory, "column_gt").where(has_value("ColumnLabel") & F.col("fileName").isNotNull())
    return set_pairs.sets(rows, "fileName", F.lower(F.trim("ColumnLabel")), least=5)


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    members, classes = _label_sets(spark, directory)
    pairs = set_pairs.record_pairs(members, set_pairs.class_pairs(classes))
    return pairs.select(F.col("a").alias("file_a"), F.col("b").alias("file_b"))


def p6_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Each file with its class of equal sets and the number of other classes like it."""
    members, classes = _label_sets(spark, directory)
    pairs = cut(set_pairs.class_pairs(classes), "class-pairs")
    links = pairs.select(F.explode(F.array("rid", "sid")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    return members.join(links, "sid", "left").select(
        F.col("record").alias("file"), F.col("sid").alias("class_file"), F.coalesce("links", F.lit(0)).alias("links")
    )


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokenize.encode(table(spark, directory, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    # an item's own passage follows the instruction and a blank line
    items = table(spark, directory, "benchmark").select(
        "item_id", F.regexp_replace("text", r"(?s)^.*?\n\s*\n", "").alias("passage")
    )
    return leaks.find(table(spark, directory, "documents"), "doc_id", "text", items, "item_id", "passage")


def p8_leaked_items(spark: SparkSession, directory: str) -> DataFrame:
    """Items that leaked, with the number of documents that contain them."""
    return p8_found(spark, directory).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    stats = quality.describe(table(spark, directory, "documents"), "doc_id", "text")
    return stats.where(quality.is_junk()).select("doc_id")


def p9_statistics(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return quality.describe(docs, "doc_id", "text", quality.common_words(docs, "text"))


def p9_counts(spark: SparkSession, directory: str) -> DataFrame:
    """The statistics that SQL can express."""
    stats = quality.describe(table(spark, directory, "documents"), "doc_id", "text")
    return stats.select("doc_id", "n_chars", "n_words", "n_lines", F.round("mean_word_length", 9).alias("mean_word_length"))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p1_increment": p1_increment,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p9_counts": p9_counts,
}

_NO = "(%s is null or lower(trim(regexp_replace(%s, '\\s+', ' ', 'g'))) in ('', 'nan'))"
_LABEL_TERMS = f"""
labels as (select col_id id, unnest(regexp_extract_all(lower(ColumnLabel), '[\\p{{L}}\\p{{Nd}}]+')) term
           from column_gt where not {_NO % ("ColumnLabel", "ColumnLabel")}),
classes as (select gt_id id, lower(trim(regexp_replace(class, '\\s+', ' ', 'g'))) term
            from table_gt where not {_NO % ("class", "class")}),
counts as (select 'ColumnLabel' field, term, count(*) occurrences, count(distinct id) records from labels group by term
           union all
           select 'class', term, count(*), count(*) from classes group by term),
sizes as (select 'ColumnLabel' field, count(*) n from column_gt where not {_NO % ("ColumnLabel", "ColumnLabel")}
          union all select 'class', count(*) from classes)
"""
_SETS = f"""
labels as (select distinct fileName f, lower(trim(ColumnLabel)) l from column_gt
           where fileName is not null and not {_NO % ("ColumnLabel", "ColumnLabel")}),
sizes as (select f, count(*) n from labels group by f having count(*) >= 5),
used as (select * from labels join sizes using (f)),
pairs as (select a.f file_a, b.f file_b from used a join used b on a.l = b.l and a.f < b.f
          group by a.f, b.f, a.n, b.n having 10 * count(*) >= 7 * (a.n + b.n - count(*)))
"""

_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINE = r"[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]+"

SQL = {
    "p9_counts": f"""with t as (select doc_id, coalesce(text, '') text from documents),
        c as (select doc_id, length(text) n_chars, len(list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '')) n_words,
            len(list_filter(regexp_split_to_array(text, '{_LINE}'), lambda x: regexp_matches(x, '[^{_SPACE}]'))) n_lines,
            length(regexp_replace(text, '[{_SPACE}]', '', 'g')) letters from t)
        select doc_id, n_chars, n_words, n_lines, case when n_words > 0 then round(letters / n_words, 9) end mean_word_length from c""",
    "p1_counts": f"with {_LABEL_TERMS} select field, term, occurrences, records from counts",
    "p1_found": f"""with {_LABEL_TERMS}
        select field, term, case when records < 3 then 'rare' else 'common' end mark
        from counts join sizes using (field) where records < 3 or records * 100 > n""",
    "p1_increment": f"""with now as (
            select col_id, case when fileName like 'export\\_%' escape '\\' then LowestClass else ColumnLabel end label
            from column_gt where loaded_at is null or loaded_at < timestamp '{LATE}'),
        words as (select col_id, unnest(regexp_extract_all(lower(label), '[\\p{{L}}\\p{{Nd}}]+')) term
                  from now where not {_NO % ("label", "label")})
        select term, count(*) occurrences, count(distinct col_id) records from words group by term""",
    "p6_found": f"with {_SETS} select file_a, file_b from pairs",
    "p6_classes": f"""with {_SETS},
        matching as (select f from sizes a where exists (
            select 1 from sizes b where a.f <> b.f and 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n))),
        sets as (select f, string_agg(l, chr(31) order by l) s from labels where f in (select f from matching) group by f),
        classes as (select f, min(f) over (partition by s) class_file from sets),
        sides as (select file_a x, file_b y from pairs union all select file_b, file_a from pairs),
        linked as (select a.class_file c, count(distinct b.class_file) links from sides join classes a on x = a.f
            join classes b on y = b.f where a.class_file <> b.class_file group by 1)
        select f file, class_file, coalesce(links, 0) links from classes left join linked on c = class_file""",
}
