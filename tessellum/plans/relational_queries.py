"""Queries of projections, windows, joins, sets and aggregates, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.functions import text as T
from tessellum.operators import ordering, relational as R
from tessellum.plans.base import CELLS_SQL, NO_VALUE_SQL, Plans, cells, number_sql
from tessellum.sources.scratch import cut
from tessellum.sources.tables import has_value, table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query

_IDX = "c as (select fileName f, col_id, row_number() over (partition by fileName order by col_id) - 1 idx, count(*) over (partition by fileName) n from column_gt)"


def columns(s: SparkSession, d: str) -> DataFrame:
    """(f, col_id, idx, n): the columns of each file in the order of their ids."""
    t = table(s, d, "column_gt").select(F.col("fileName").alias("f"), "col_id")
    return ordering.group_rank(t, "f", ["col_id"], "idx", "n")


@query(f"with {_IDX} select f, col_id from c where idx in (0, 2)")
def prj1_positions(s, d):
    return columns(s, d).where(F.col("idx").isin(0, 2)).select("f", "col_id")


@query(f"with {_IDX} select f, col_id, n - 1 - idx new_idx from c")
def prj2_reverse_columns(s, d):
    return columns(s, d).select("f", "col_id", (F.col("n") - 1 - F.col("idx")).alias("new_idx"))


_URLS = "regexp_matches(cell, '^https?://')"


@query(f"""with {CELLS_SQL}, u as (select col_id, bool_or({_URLS}) url, avg(len(string_split(cell, ' '))) words from cells group by 1)
    select col_id, pos, case when url then '[...]' when words > 2 and len(string_split(cell, ' ')) > 3
        then array_to_string(string_split(cell, ' ')[1:3], ' ') || '...' else cell end masked from cells join u using (col_id)""")
def prj4_mask(s, d):
    """Columns with addresses are masked, texts of columns with more than two words on average are shortened."""
    c = cells(s, d)
    kinds = c.groupBy("col_id").agg(F.bool_or(F.col("cell").rlike("^https?://")).alias("url"), F.avg(F.size(F.split("cell", " "))).alias("words"))
    masked = F.when(F.col("url"), "[...]").when(F.col("words") > 2, T.shortened(F.col("cell"))).otherwise(F.col("cell"))
    return c.join(kinds, "col_id").select("col_id", F.col("pos").cast("long").alias("pos"), masked.alias("masked"))


@query(f"""with {CELLS_SQL} select col_id from cells group by 1
    having not (bool_or({_URLS}) or avg(len(string_split(cell, ' '))) > 25 or coalesce(bool_and({number_sql('cell')}) filter (cell <> ''), false))""")
def prj5_wanted_columns(s, d):
    """Columns that are no long text, no numbers and no addresses."""
    c = F.col("cell")
    kinds = cells(s, d).groupBy("col_id").agg(
        F.bool_or(c.rlike("^https?://")).alias("url"),
        (F.avg(F.size(F.split("cell", " "))) > 25).alias("long"),
        F.coalesce(F.bool_and(F.when(c != "", T.is_plain_number(c))), F.lit(False)).alias("numbers"),
    )
    return kinds.where("not (url or long or numbers)").select("col_id")


TRANSFORMS = {
    0: lambda c: c,
    1: lambda c: c.withColumn("idx", F.col("n") - 1 - F.col("idx")),
    2: lambda c: c.where("idx < 2"),
    3: lambda c: c.where("idx > 0"),
}


def transform(cols: DataFrame, how: int) -> DataFrame:
    """The columns of each table as they are, reversed, the leftmost ones, or without the first."""
    if how not in TRANSFORMS:
        raise ValueError(f"no transformation {how}")
    return TRANSFORMS[how](cols)


@query(f"with {_IDX} select 1 how, f, col_id, n - 1 - idx idx from c union all select 2, f, col_id, idx from c where idx < 2 union all select 3, f, col_id, idx from c where idx > 0")
def prj6_dispatch(s, d):
    cols = cut(columns(s, d), "columns")
    parts = [transform(cols, k).select(F.lit(k).alias("how"), "f", "col_id", "idx") for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select source, split_part(source, '_', 1) method, case when split_part(source, '_', 1) in ('portal','wiki') then 'public' else 'other' end kind, count(*) n
    from documents group by 1, 2, 3""")
def prj8_method_names(s, d):
    method = F.substring_index("source", "_", 1)
    kind = F.when(method.isin("portal", "wiki"), "public").otherwise("other")
    return table(s, d, "documents").groupBy("source", method.alias("method"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("select example_id from example where list_has_any(attrs, ['year', 'country', 'title', 'name'])")
def flt3_overlap(s, d):
    return table(s, d, "example").where(F.arrays_overlap("attrs", F.array(*[F.lit(x) for x in ("year", "country", "title", "name")]))).select("example_id")


@query(f"select col_id from column_gt where not {NO_VALUE_SQL.format('colName')} and not {NO_VALUE_SQL.format('ColumnLabel')}")
def flt4_no_blanks(s, d):
    return table(s, d, "column_gt").where(has_value("colName") & has_value("ColumnLabel")).select("col_id")


@query("select example_id, len(attrs) n from example where len(attrs) >= 6")
def flt7_length(s, d):
    return table(s, d, "example").where(F.size("attrs") >= 6).select("example_id", F.size("attrs").cast("long").alias("n"))


_EDGE = "e as (select c_nationkey parent, c_mktsegment child, count(*) weight from customer group by 1, 2)"


@query(f"with {_EDGE}, r as (select *, row_number() over (order by weight, parent, child) r, count(*) over () n from e) select parent, child, weight from r where r <= cast(floor(0.1 * n) as bigint)")
def win4_lightest_edges(s, d):
    e = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("parent"), F.col("c_mktsegment").alias("child")).agg(F.count("*").alias("weight"))
    return ordering.lowest_share(e, ["weight", "parent", "child"], 0.1)


@query("with r as (select event_id, row_number() over (order by event_id) - 1 pos, count(*) over () n from events) select event_id from r where pos % cast(ceil(n / 128.0) as bigint) = 0")
def win6_every_nth(s, d):
    return ordering.every_nth(table(s, d, "events").select("event_id"), ["event_id"], 128)


@query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between current row and 3 following), 6) m from events")
def win7_forward_mean(s, d):
    ahead = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 3)
    return table(s, d, "events").select("event_id", F.round(F.avg("value").over(ahead), 6).alias("m"))


@query("select fileName, count(*) n from column_gt group by 1 order by n desc, fileName limit 20")
def srt1_largest_groups(s, d):
    return table(s, d, "column_gt").groupBy("fileName").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fileName").limit(20)


@query("select c_custkey, c_nationkey, c_mktsegment from customer order by c_nationkey desc, c_mktsegment desc, round(c_acctbal) desc, c_custkey desc limit 1")
def srt2_first_by_four_keys(s, d):
    keys = [F.desc("c_nationkey"), F.desc("c_mktsegment"), F.desc(F.round("c_acctbal")), F.desc("c_custkey")]
    return table(s, d, "customer").orderBy(*keys).limit(1).select("c_custkey", "c_nationkey", "c_mktsegment")


@query(f"with {_IDX} select f, col_id from c where idx < 3")
def lim1_head(s, d):
    t = table(s, d, "column_gt").select(F.col("fileName").alias("f"), "col_id")
    return ordering.top_per_group(t, ["f"], ["col_id"], 3)


@query("select doc_id, left(text, 10000) prompt_text, length(text) > 10000 shortened from documents where text is not null")
def lim2_prompt_cap(s, d):
    """The cap is the feature: a prompt holds 10,000 characters."""
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", F.substring("text", 1, 10_000).alias("prompt_text"), (F.length("text") > 10_000).alias("shortened"))


@query("select c.c_custkey, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey")
def jn1_lookup(s, d):
    return table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("with b as (select distinct fileName, colName, ColumnLabel from column_gt where ColumnLabel is not null) select distinct a.col_id, b.ColumnLabel from column_gt a join b on a.fileName = b.fileName and a.colName = b.colName")
def jn2_composite_lookup(s, d):
    c = table(s, d, "column_gt")
    labels = c.where("ColumnLabel is not null").select("fileName", "colName", "ColumnLabel").distinct()
    return c.select("col_id", "fileName", "colName").join(labels, ["fileName", "colName"]).select("col_id", "ColumnLabel").distinct()


def correlated_update(rows: DataFrame, changes: DataFrame, col: str, old: str, new: str) -> DataFrame:
    """``rows`` with ``col`` set to ``new`` where ``old`` equals it, and whether it was."""
    key = changes.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    joined = rows.join(key, F.col(col) == F.col("__old"), "left")
    return joined.withColumn(col, F.coalesce("__new", col)).withColumn("matched", F.col("__old").isNotNull()).drop("__old", "__new")


@query("select c.col_id, coalesce(r.label, c.ColumnLabel) label, r.label is not null matched from column_gt c left join (select alt_label, min(label) label from label_ref where alt_label is not null group by 1) r on c.ColumnLabel = r.alt_label")
def jn3_correlated_update(s, d):
    names = table(s, d, "label_ref").where("alt_label is not null").groupBy("alt_label").agg(F.min("label").alias("name"))
    rows = table(s, d, "column_gt").select("col_id", F.col("ColumnLabel").alias("label"))
    return correlated_update(rows, names, "label", "alt_label", "name")


@query("select s_nationkey nation, count(*) * (count(*) - 1) // 2 pairs, min(s_suppkey) low, max(s_suppkey) high from supplier group by 1 having count(*) > 1")
def jn4_unordered_pairs(s, d):
    """Pairs i < j of a nation's suppliers, formed and counted."""
    a = table(s, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("i"))
    pairs = a.join(a.withColumnRenamed("i", "j"), "s_nationkey").where("i < j")
    return pairs.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("pairs"), F.min("i").alias("low"), F.max("j").alias("high"))


@query("""select c.col_id, t.fileName from (select col_id, fileName || '.' || colName member from column_gt where colName is not null) c
    join (select distinct fileName from column_gt) t on starts_with(c.member, t.fileName || '.')""")
def jn6_prefix_resolution(s, d):
    """Members ``table.column`` with dots in the names, found by the table's name that they begin with."""
    c = table(s, d, "column_gt").where("colName is not null").select("col_id", F.concat("fileName", F.lit("."), "colName").alias("member"))
    names = table(s, d, "column_gt").where("fileName is not null").select("fileName").distinct()
    # each member offers its beginnings before dots as keys, so names are looked up as equals
    parts = F.split("member", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    keys = c.where(F.col("member").contains(".")).select("col_id", F.explode(begins).alias("fileName"))
    return keys.join(names, "fileName").select("col_id", "fileName")


@query("select c.col_id, coalesce(r.label_id, -1) label_id from column_gt c left join label_ref r on c.ColumnLabel = r.label")
def jn7_default_membership(s, d):
    r = table(s, d, "label_ref").select("label_id", F.col("label").alias("ColumnLabel"))
    c = table(s, d, "column_gt").select("col_id", "ColumnLabel")
    return c.join(r, "ColumnLabel", "left").select("col_id", F.coalesce("label_id", F.lit(-1)).cast("long").alias("label_id"))


@query("""select example_id, i - 1 pos, attrs[i] attr, attrs_hier[i] hier from (select *, unnest(range(1, least(len(attrs), len(attrs_hier)) + 1)) i from example)""")
def jn9_positional_zip(s, d):
    t = table(s, d, "example")
    a = t.select("example_id", F.posexplode("attrs").alias("pos", "attr"))
    h = t.select("example_id", F.posexplode("attrs_hier").alias("pos", "hier"))
    return a.join(h, ["example_id", "pos"]).select("example_id", F.col("pos").cast("long").alias("pos"), "attr", "hier")


@query("""with a as (select o_orderpriority k, count(*) n from orders where o_orderstatus = 'F' group by 1), b as (select o_orderpriority k, count(*) m from orders where o_orderstatus = 'P' group by 1)
    select coalesce(a.k, b.k) k, a.n, b.m from a full outer join b on a.k = b.k""")
def jn13_aligned_concat(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderpriority", "k")
    a = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("n"))
    return a.join(o.where("o_orderstatus = 'P'").groupBy("k").agg(F.count("*").alias("m")), "k", "full_outer")


@query("select c_nationkey k from customer intersect select s_nationkey from supplier")
def set1_intersection(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("select distinct p_name k from part where p_size < 25 and p_name not in (select p_name from part where p_size >= 25)")
def set1_difference(s, d):
    p = table(s, d, "part")
    return p.where("p_size < 25").select(F.col("p_name").alias("k")).subtract(p.where("p_size >= 25").select("p_name"))


_SETS = "ls as (select fileName f, lower(trim(ColumnLabel)) l from column_gt where fileName is not null and not " + NO_VALUE_SQL.format("ColumnLabel") + " group by 1, 2)"


def _label_rows(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "column_gt").where(has_value("ColumnLabel") & F.col("fileName").isNotNull())
    return t.select(F.col("fileName").alias("f"), F.lower(F.trim("ColumnLabel")).alias("l")).distinct()


_WANTED = "('year', 'country', 'release year', 'identifier')"


@query(f"with {_SETS} select f, bool_and(l in {_WANTED}) subset, not bool_or(l in {_WANTED}) disjoint from ls group by 1")
def set2_subset_set3_disjoint(s, d):
    """Whether the labels of a file are all, or none, of a given set: by flags, no set is gathered."""
    inside = F.col("l").isin("year", "country", "release year", "identifier")
    return _label_rows(s, d).groupBy("f").agg(F.bool_and(inside).alias("subset"), (~F.bool_or(inside)).alias("disjoint"))


@query("select 'c' src, c_nationkey k from customer union all select 's', s_nationkey from supplier")
def set4_union_all(s, d):
    c = table(s, d, "customer").select(F.lit("c").alias("src"), F.col("c_nationkey").alias("k"))
    return c.unionByName(table(s, d, "supplier").select(F.lit("s").alias("src"), F.col("s_nationkey").alias("k")))


@query("select lower(colName) k, min(col_id) first_id from column_gt where colName is not null group by 1")
def set5_ordered_distinct(s, d):
    return table(s, d, "column_gt").where("colName is not null").groupBy(F.lower("colName").alias("k")).agg(F.min("col_id").alias("first_id"))


@query("with c as (select class, superclass, count(*) n from table_gt where class is not null and superclass is not null group by 1, 2) select class, superclass, n from c qualify row_number() over (partition by class order by n desc, superclass) = 1")
def agg7_majority_list(s, d):
    t = table(s, d, "table_gt").where("class is not null and superclass is not null")
    return R.majority(t, ["class"], "superclass").withColumnRenamed("freq", "n")


@query("""with u as (select example_id, unnest(attrs) a from example), c as (select a, count(*) n, min(example_id) first from u where a is not null group by 1)
    select a, n from c where n = (select max(n) from c)""")
def agg9_label_lists(s, d):
    """The most frequent labels over all lists, all of equals, with their number."""
    counts = table(s, d, "example").select(F.explode("attrs").alias("a")).where("a is not null").groupBy("a").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("n"))  # one row
    return counts.join(F.broadcast(top), "n").select("a", "n")


@query("select o_orderpriority k, round(avg(o_totalprice), 4) m from orders group by 1")
def agg13_mean_metric(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias("m"))


@query("""with p as (select unnest(attrs_hier) p from example), n as (select len(regexp_split_to_array(p, '\\s*(-{1,2}>|=>|→|>)\\s*')) n from p where p is not null and trim(p) not in ('', 'N/A'))
    select round(avg(n), 6) mean_len, max(n) max_len from n""")
def agg17_path_length(s, d):
    paths = table(s, d, "example").select(F.explode("attrs_hier").alias("p")).where("p is not null and trim(p) not in ('', 'N/A')")
    n = F.size(F.split("p", r"\s*(?:-{1,2}>|=>|→|>)\s*"))
    return paths.agg(F.round(F.avg(n), 6).alias("mean_len"), F.max(n).cast("long").alias("max_len"))


@query("with c as (select user_id, event_type, round(sum(value), 6) s from events group by 1, 2) select user_id, event_type from c qualify rank() over (partition by user_id order by s desc) = 1")
def agg19_best_keys(s, d):
    sums = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("s"))
    best = sums.groupBy("user_id").agg(F.max("s").alias("s"))
    return sums.join(best, ["user_id", "s"]).select("user_id", "event_type")


@query("""with w as (select source, doc_id, unnest(string_split(lower(text), ' ')) w from documents where text is not null),
    b as (select source, doc_id, w, count(*) n from w where w <> '' group by 1, 2, 3) select source, w, max(n) n from b group by 1, 2""")
def agg20_bag_union(s, d):
    """The union of the bags of words of each source's texts: of each word its largest count."""
    words = table(s, d, "documents").where("text is not null").select("source", "doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''")
    bags = words.groupBy("source", "doc_id", "w").agg(F.count("*").alias("n"))
    return bags.groupBy("source", "w").agg(F.max("n").alias("n"))


@query("""select source, sum(len(regexp_extract_all(text, '[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9 \\t\\n\\x0b\\f\\r]')) + 3 + 1) + 3 tokens from documents where text is not null group by 1""")
def agg21_message_tokens(s, d):
    """Tokens of the messages of a conversation: words, numbers and other signs, three for each
    message, one for its name, three for the answer."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9 \t\n\x0b\f\r]"), F.lit(0))) + 4
    return table(s, d, "documents").where("text is not null").groupBy("source").agg((F.sum(n) + 3).alias("tokens"))


@query("""with r as (select fileName f, count(*) cols, count(distinct ColumnLabel) labels from column_gt group by 1), v as (select unnest([1, 5, 50, 100000]) th)
    select th, count(*) filter (cols >= th) n, coalesce(round(avg(labels) filter (cols >= th), 6), 0) avg_labels, coalesce(max(labels) filter (cols >= th), 0) max_labels from v, r group by 1""")
def agg15_variant_statistics(s, d):
    r = table(s, d, "column_gt").groupBy(F.col("fileName").alias("f")).agg(F.count("*").alias("cols"), F.countDistinct("ColumnLabel").alias("labels"))
    v = r.select("cols", "labels", F.explode(F.array(*[F.lit(x) for x in (1, 5, 50, 100000)])).alias("th"))
    hit = F.col("cols") >= F.col("th")
    labels = F.when(hit, F.col("labels"))
    return v.groupBy("th").agg(
        F.sum(hit.cast("long")).alias("n"), F.coalesce(F.round(F.avg(labels), 6), F.lit(0.0)).alias("avg_labels"), F.coalesce(F.max(labels), F.lit(0)).alias("max_labels")
    )


@query(f"""with {CELLS_SQL} select fileName f, sum(length(cell)) chars, count(distinct col_id) cols from cells group by 1""")
def agg14_file_sizes(s, d):
    c = cells(s, d).groupBy(F.col("fileName").alias("f"), "col_id").agg(F.sum(F.length("cell")).alias("chars"))
    return c.groupBy("f").agg(F.sum("chars").alias("chars"), F.count("*").alias("cols"))


@query("""with m as (select avg(n_chars) mu, count(*) n from documents where n_chars is not null),
    c as (select n, avg(power(n_chars - mu, 2)) m2, avg(power(n_chars - mu, 3)) m3, avg(power(n_chars - mu, 4)) m4 from documents, m where n_chars is not null group by 1)
    select n, round(m3 / power(m2, 1.5), 6) skew, round(m4 / (m2 * m2) - 3, 6) kurtosis, round(n / 6e0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) jb,
    round(exp(-n / 12e0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)), 6) p from c""")
def agg12_normality(s, d):
    """Skewness, excess kurtosis and the Jarque-Bera test of normality (its p-value is exp(-JB / 2))."""
    m = table(s, d, "documents").where("n_chars is not null").agg(F.count("*").alias("n"), F.skewness("n_chars").alias("sk"), F.kurtosis("n_chars").alias("ku"))
    jb = F.col("n") / 6.0 * (F.col("sk") * F.col("sk") + F.col("ku") * F.col("ku") / 4)
    return m.select("n", F.round("sk", 6).alias("skew"), F.round("ku", 6).alias("kurtosis"), F.round(jb, 4).alias("jb"), F.round(F.exp(-jb / 2), 6).alias("p"))


_BRANDS = """bg as (select distinct o_custkey tab, c_nationkey class, p_brand attr from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on c_custkey = o_custkey)"""


@query(f"with {_BRANDS} select class, count(distinct attr) attrs, count(distinct tab) tabs, string_agg(distinct attr, ',' order by attr) labels from bg group by 1")
def agg3_sets_and_tables(s, d):
    """The union of the attribute sets of each type's tables, and the tables."""
    from tessellum.plans.reference import bought

    b = bought(s, d).distinct()
    sets = b.groupBy("class").agg(F.countDistinct("tab").alias("tabs"), F.array_sort(F.collect_set("attr")).alias("l"))
    return sets.select("class", F.size("l").cast("long").alias("attrs"), "tabs", F.array_join("l", ",").alias("labels"))


@query("with c as (select p_brand, p_size, count(*) n from part group by 1, 2) select p_brand brand, string_agg(p_size || ':' || n, ' ' order by p_size) sizes from c group by 1")
def agg4_nested_map(s, d):
    """Counts by two keys as a sorted map inside each first key."""
    c = table(s, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    m = c.groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_size", "n"))).alias("l"))
    return m.select("brand", F.array_join(F.transform("l", lambda x: F.concat(x.p_size, F.lit(":"), x.n)), " ").alias("sizes"))


@query("with c as (select user_id, event_type, count(*) n, min(event_id) first from events group by 1, 2) select user_id, event_type, n from c qualify row_number() over (partition by user_id order by n desc, first) = 1")
def agg6_majority_first_seen(s, d):
    """The most frequent label, of equals the one seen first."""
    c = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = c.groupBy("user_id").agg(F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), F.col("first"))).alias("b"))
    return best.select("user_id", "b.event_type", "b.n")


@query(f"""with {CELLS_SQL}, z as (select col_id, case when {number_sql('cell')} then cast(cell as double) end num, length(cell) len, cell from cells where cell <> ''),
    k as (select col_id, bool_and(num is not null) numeric_column from z group by 1), x as (select z.col_id, case when numeric_column then num else len end x, numeric_column from z join k using (col_id)),
    c as (select col_id, x, count(*) n from x group by 1, 2), m as (select col_id, x mode from c qualify row_number() over (partition by col_id order by n desc, x) = 1)
    select col_id, any_value(numeric_column) numeric_column, round(stddev_samp(x), 2) std, round(avg(x), 2) mean, any_value(mode) \"mode\", round(median(x), 2) median, max(x) hi, min(x) lo from x join m using (col_id) group by 1""")
def agg11_meta_of_cells(s, d):
    """Deviation, mean, first mode, median, largest and smallest of each column's cells, of their
    lengths where not all are numbers."""
    z = cells(s, d).where("cell <> ''").select("col_id", F.when(T.is_plain_number(F.col("cell")), F.col("cell").try_cast("double")).alias("num"), F.length("cell").cast("double").alias("len"))
    kinds = z.groupBy("col_id").agg(F.bool_and(F.col("num").isNotNull()).alias("numeric_column"))
    x = z.join(kinds, "col_id").select("col_id", "numeric_column", F.when(F.col("numeric_column"), F.col("num")).otherwise(F.col("len")).alias("x"))
    counts = x.groupBy("col_id", "x").agg(F.count("*").alias("n"))
    mode = counts.groupBy("col_id").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("mode"))
    stats = x.groupBy("col_id").agg(
        F.first("numeric_column").alias("numeric_column"), F.round(F.stddev_samp("x"), 2).alias("std"), F.round(F.avg("x"), 2).alias("mean"),
        F.round(F.median("x"), 2).alias("median"), F.max("x").alias("hi"), F.min("x").alias("lo"),
    )
    return stats.join(mode, "col_id")
