"""Queries of the schema-inference operators over the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.functions import text as T
from tessellum.operators import clustering, forest, graphs, ordering, relational as R, subject, vectors as V
from tessellum.plans.base import unit_vectors
from tessellum.sources.scratch import cut
from tessellum.sources.tables import has_value, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- corpus adapters: a customer is a table, its nation the class, the region the superclass,
# --- the brands it bought the attributes


def bought(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("tab"))
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("attr"))
    types = table(s, d, "customer").select(F.col("c_custkey").alias("tab"), F.col("c_nationkey").alias("class"))
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").join(types, "tab").select("tab", "class", "attr")


_BOUGHT = """bought as (select o_custkey tab, c_nationkey class, p_brand attr from lineitem
    join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on c_custkey = o_custkey)"""
_OVER = f"""{_BOUGHT}, pairs as (select distinct * from bought),
    whole as (select class, count(distinct attr) whole from pairs group by class),
    over as (select tab, class, count(*) shared, whole, count(*) / whole overlap
             from pairs join whole using (class) group by tab, class, whole)"""
THRESHOLDS = [0.25, 0.5, 0.75]


def overlaps(s: SparkSession, d: str) -> DataFrame:
    return R.overlap(bought(s, d), "tab", "class", "attr")


@query(f"""with {_OVER}, th as (select unnest([0.25, 0.5, 0.75]::double[]) threshold)
    select threshold, count(*) filter (overlap >= threshold) n_tables,
    coalesce(round(avg(overlap) filter (overlap >= threshold), 6), 0) avg_overlap,
    coalesce(round(min(overlap) filter (overlap >= threshold), 6), 0) min_overlap,
    coalesce(round(max(overlap) filter (overlap >= threshold), 6), 0) max_overlap
    from over, th group by threshold""")
def gen2_overlap_variants(s, d):
    return R.overlap_variants(overlaps(s, d), THRESHOLDS)


@query(f"with {_OVER} select tab, class, shared, whole, round(overlap, 6) overlap from over where overlap >= 0.25")
def flt2_overlap_filter(s, d):
    return overlaps(s, d).where("overlap >= 0.25").withColumn("overlap", F.round("overlap", 6))


@query(f"with {_BOUGHT} select tab, list_sort(list(distinct attr)) labels from bought group by tab")
def agg1_label_sets(s, d):
    return R.label_sets(bought(s, d), "tab", "attr")


@query("select c_nationkey class, list_sort(list(c_custkey)) tabs from customer group by 1")
def agg2_tables_of_class(s, d):
    c = table(s, d, "customer")
    return c.groupBy(F.col("c_nationkey").alias("class")).agg(F.array_sort(F.collect_list("c_custkey")).alias("tabs"))


@query(f"with {_BOUGHT} select class, list_sort(list(distinct attr)) labels from bought group by class")
def agg3_attributes_of_type(s, d):
    return R.label_sets(bought(s, d), "class", "attr")


@query("select p_brand brand, p_size size, count(*) n from part group by 1, 2")
def agg4_nested_counts(s, d):
    return table(s, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.count("*").alias("n"))


@query("select p_type v, count(*) n from part group by 1")
def agg5_value_frequency(s, d):
    return table(s, d, "part").groupBy(F.col("p_type").alias("v")).agg(F.count("*").alias("n"))


_MAJOR = f"{_BOUGHT}, cnt as (select tab, attr, count(*) freq from bought group by 1, 2)"


@query(f"with {_MAJOR} select tab, attr, freq from cnt qualify row_number() over (partition by tab order by freq desc, attr) = 1")
def agg6_majority(s, d):
    return R.majority(bought(s, d), ["tab"], "attr")


@query(f"with {_MAJOR} select tab, attr, freq from cnt qualify rank() over (partition by tab order by freq desc) = 1")
def agg8_majority_ties(s, d):
    return R.majority(bought(s, d), ["tab"], "attr", ties=True)


@query("""select lang, source, count(*) n, max(length(text)) max_len, min(length(text)) min_len, round(avg(length(text)), 6) avg_len,
    round(stddev_samp(length(text)), 6) std_len, count(distinct text) n_distinct from documents group by 1, 2""")
def agg10_column_statistics(s, d):
    return R.profile(table(s, d, "documents"), ["lang", "source"], "text")


@query("""select source, round(stddev_samp(n_chars), 4) std, round(avg(n_chars), 4) mean, round(median(n_chars), 4) median,
    max(n_chars) max, min(n_chars) min from documents group by 1""")
def agg11_meta_features(s, d):
    c = F.col("n_chars")
    return table(s, d, "documents").groupBy("source").agg(
        F.round(F.stddev_samp(c), 4).alias("std"), F.round(F.avg(c), 4).alias("mean"), F.round(F.median(c), 4).alias("median"),
        F.max(c).alias("max"), F.min(c).alias("min"),
    )


@query("""with m as (select avg(n_chars) mu from documents)
    select round(avg(power(n_chars - mu, 3)) / power(avg(power(n_chars - mu, 2)), 1.5), 4) skew from documents, m""")
def agg12_skewness(s, d):
    return table(s, d, "documents").agg(F.round(F.skewness("n_chars"), 4).alias("skew"))


@query("""select cast(label as int) label, cast(i as int) dim, round(avg(embedding[i + 1]), 5) value
    from embeddings, range(64) t(i) group by 1, 2""")
def agg18_mean_vector(s, d):
    return V.mean_vectors(table(s, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 5))


@query("""select lang, coalesce(sum(1) filter (source = 'portal_oak'), 0) portal_oak, coalesce(sum(1) filter (source = 'forum_oak'), 0) forum_oak
    from documents group by 1""")
def agg22_pivot(s, d):
    p = table(s, d, "documents").groupBy("lang").pivot("source", ["portal_oak", "forum_oak"]).count()
    return p.na.fill(0, ["portal_oak", "forum_oak"])


@query("select count(*) n, sum(n_chars) total from documents")
def agg14_size_totals(s, d):
    return table(s, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@query("select distinct fileName as file_name from column_gt")
def src3_table_names(s, d):
    return table(s, d, "column_gt").select(F.col("fileName").alias("file_name")).distinct()


@query()
def f_listparse(s, d):
    t = table(s, d, "table_gt")
    return t.select("gt_id", T.parse_list(F.col("superclass")).alias("labels"))


_NOVAL = "(%s is null or lower(trim(regexp_replace(%s, '\\s+', ' ', 'g'))) in ('', 'nan'))"


@query(f"select col_id, fileName, ColumnLabel from column_gt where not {_NOVAL % ('ColumnLabel', 'ColumnLabel')}")
def src6_attribute_ground_truth(s, d):
    return table(s, d, "column_gt").select("col_id", "fileName", "ColumnLabel").where(has_value("ColumnLabel"))


@query("select col_id from column_gt where fileName in (select fileName from table_gt where class = 'Place')")
def flt1_membership(s, d):
    keep = table(s, d, "table_gt").where("class = 'Place'").select("fileName")
    return table(s, d, "column_gt").select("col_id", "fileName").join(keep, "fileName", "left_semi").select("col_id")


@query("select col_id from column_gt where fileName not in (select fileName from table_gt where class = 'Place' and fileName is not null)")
def jn8_anti(s, d):
    drop = table(s, d, "table_gt").where("class = 'Place'").select("fileName")
    return table(s, d, "column_gt").select("col_id", "fileName").join(drop, "fileName", "left_anti").select("col_id")


@query("""select fileName, count(*) filter (vals is not null and trim(vals) <> '') / count(*) ratio from column_gt group by 1
    having count(*) filter (vals is not null and trim(vals) <> '') / count(*) > 0.1""")
def flt5_sparse(s, d):
    full = F.avg((F.col("vals").isNotNull() & (F.trim("vals") != "")).cast("int"))
    return table(s, d, "column_gt").groupBy("fileName").agg(full.alias("ratio")).where("ratio > 0.1")


@query(f"select ColumnLabel label, count(*) n from column_gt where not {_NOVAL % ('ColumnLabel', 'ColumnLabel')} group by 1 having count(*) > 5")
def flt6_min_frequency(s, d):
    t = table(s, d, "column_gt").where(has_value("ColumnLabel"))
    return t.groupBy(F.col("ColumnLabel").alias("label")).agg(F.count("*").alias("n")).where("n > 5")


@query("""select p_partkey k, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) name, lower(translate(p_name, ' aeiouyAEIOUY', '')) short,
    cast('0x' || substr(md5(p_name), 1, 8) as bigint) seed from part""")
def f_header_functions(s, d):
    n = F.col("p_name")
    return table(s, d, "part").select(
        F.col("p_partkey").alias("k"), T.capitalized(n).alias("name"), T.drop_vowels(n).alias("short"), T.stable_seed(n).alias("seed")
    )


_P = "[!-/:-@\\[-`{-~]"


@query(f"""select doc_id, trim(regexp_replace(regexp_replace(text, '{_P}|[0-9]', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) plain from documents where text is not null""")
def f_tok(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.plain_tokens(F.col("text")).alias("plain"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def f_json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_CELLS = "cells as (select col_id, fileName, trim(c) cell from column_gt, unnest(string_split(vals, ', ')) t(c) where vals is not null)"


def cells(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "column_gt").select("col_id", "fileName", F.explode(F.split("vals", ", ")).alias("c"))
    return t.select("col_id", "fileName", F.trim("c").alias("cell"))


@query(f"""with {_CELLS} select col_id, avg(case when cell in ('-','NA','na','nan','n/a','NULL','null','nil','empty',' ','') then 1 else 0 end) emc
    from cells group by 1""")
def sc3_empty_share(s, d):
    return cells(s, d).groupBy("col_id").agg(F.avg(T.is_empty(F.col("cell")).cast("int")).alias("emc"))


@query(f"with {_CELLS} select col_id, count(distinct cell) / count(*) uc from cells group by 1")
def sc4_unique_share(s, d):
    return cells(s, d).groupBy("col_id").agg((F.countDistinct("cell") / F.count("*")).alias("uc"))


@query(f"""with {_CELLS}, kinds as (select col_id, case when regexp_matches(cell, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') then 'date'
        when regexp_matches(cell, '^[0-9]+%?$') then 'number' when cell = '' then 'empty' else 'text' end kind from cells),
    cnt as (select col_id, kind, count(*) n from kinds group by 1, 2)
    select col_id, kind, n from cnt qualify row_number() over (partition by col_id order by n desc, kind) = 1""")
def sc1_column_type(s, d):
    c = F.col("cell")
    kind = F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), "date").when(c.rlike(r"^[0-9]+%?$"), "number").when(c == "", "empty").otherwise("text")
    got = R.majority(cells(s, d).withColumn("kind", kind), ["col_id"], "kind")
    return got.select("col_id", "kind", F.col("freq").alias("n"))


@query(f"""with {_CELLS}, cnt as (select fileName, cell, count(*) c from cells group by 1, 2)
    select fileName, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 entropy from cnt group by 1""")
def f_entropy(s, d):
    return R.entropy(cells(s, d), "fileName", "cell").withColumn("entropy", F.col("entropy") + 0.0)


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) w from documents),
    tf as (select doc_id, w, count(*) tf from w group by 1, 2), idf as (select w, count(*) df from tf group by 1),
    x as (select doc_id, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) x from tf join idf using (w))
    select doc_id, round(sum(x) / sqrt(sum(x * x)) / (select count(*) from idf), 8) avg_tfidf from x group by 1""")
def t_tfidf(s, d):
    return R.tfidf(table(s, d, "documents"), "doc_id", "text")


# --- subject columns: no SQL, the votes over cells need more than the engines share


def typed_columns(s: SparkSession, d: str) -> DataFrame:
    return subject.columns(table(s, d, "column_gt"), "fileName", "col_id", "vals")


@query()
def sc2_annotated(s, d):
    """The kind of each column by the vote over its cells."""
    return typed_columns(s, d).select("f", "col_id", "kind")


@query()
def sc16_features(s, d):
    """The features of each column (SC3 to SC7): share of empty cells, unique share, acronyms,
    distance to the first entity, context match, web score."""
    zero = F.lit(0.0)
    t = subject.distances(typed_columns(s, d))
    uc = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    return t.select("f", "col_id", F.round("emc", 6).alias("emc"), uc.alias("uc"), zero.alias("ac"), "df", zero.alias("cm"), zero.alias("ws"))


@query(f"""with {_CELLS} select col_id, avg(case when length(cell) < 3 and cell <> lower(cell) or length(cell) < 6 and regexp_matches(cell, '^[A-Z.]{{2,}}$') then 1 else 0 end) > 0.5 ac from cells group by 1""")
def sc5_acronym_columns(s, d):
    """Whether more than half of a column's cells are acronyms: the documented variant of ``ac``."""
    hit = F.coalesce(T.is_acronym(F.col("cell")), F.lit(False)).cast("int")
    return cells(s, d).groupBy("col_id").agg((F.avg(hit) > 0.5).alias("ac"))


@query("""with w as (select col_id, fileName f, unnest(list_distinct(regexp_extract_all(lower(colName), '[a-z0-9]+'))) w from column_gt where colName is not null),
    t as (select table_name f, w, count(*) n from (select table_name, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w from documents where table_name is not null and text is not null) group by 1, 2),
    x as (select table_name f, w, count(*) n from (select table_name, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) w from documents where table_name is not null) group by 1, 2)
    select w.col_id, cast(sum(coalesce(t.n, 0) + 2 * coalesce(x.n, 0)) as bigint) score from w left join t on t.f = w.f and t.w = w.w left join x on x.f = w.f and x.w = w.w group by 1 having score > 0""")
def sc7_context_score(s, d):
    """How often the words of a header occur in the texts about its table, those of their sources
    counted twice (the scores of SC7 and, with texts in place of search results, SC9)."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    w = table(s, d, "column_gt").where("colName is not null").select("col_id", F.col("fileName").alias("f"), F.explode(F.array_distinct(words("colName"))).alias("w"))
    docs = table(s, d, "documents").where("table_name is not null").withColumnRenamed("table_name", "f")
    said = docs.where("text is not null").select("f", F.explode(words("text")).alias("w"), F.lit(1).alias("n"))
    named = docs.select("f", F.explode(words("source")).alias("w"), F.lit(2).alias("n"))
    counts = said.unionByName(named).groupBy("f", "w").agg(F.sum("n").alias("n"))
    return w.join(counts, ["f", "w"]).groupBy("col_id").agg(F.sum("n").alias("score"))


@query()
def sc9_converged_types(s, d):
    """Event types by rounds of hashed rows until their entropy settles (SC9, UDF2)."""
    from tessellum.operators import incremental

    return incremental.until_settled(table(s, d, "events"), "event_id", "event_type", rounds=10, eps=0.05)


@query()
def sc8_length_variance(s, d):
    return typed_columns(s, d).select("f", "col_id", F.round("tlc", 6).alias("tlc"), F.round("vt", 6).alias("vt"))


@query()
def win8_distance_to_entity(s, d):
    return subject.distances(typed_columns(s, d)).select("f", "col_id", "df")


@query()
def sc10_subject_score(s, d):
    return subject.scores(typed_columns(s, d)).select("f", "col_id", F.round("score", 6).alias("score"))


@query()
def sc11_subject_columns(s, d):
    return subject.subject_columns(subject.scores(typed_columns(s, d)))


@query()
def sc12_score_weights(s, d):
    return subject.weights(subject.scores(typed_columns(s, d), entities_only=False)).withColumn("w", F.round("w", 6))


@query()
def sc13_first_entity(s, d):
    return subject.first_entities(typed_columns(s, d))


@query()
def prj3_leftmost_entities(s, d):
    return subject.leftmost(typed_columns(s, d))


# --- vectors and evaluation


@query("""select vec_id as query, rank, neighbour, dist from (select a.vec_id, b.vec_id neighbour, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) dist,
    row_number() over (partition by a.vec_id order by round(list_distance(a.embedding::double[], b.embedding::double[]), 6), b.vec_id) rank
    from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where rank <= 10""")
def win1_nearest(s, d):
    e = table(s, d, "embeddings")
    return V.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


@query("""select a.vec_id q, b.vec_id v, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) sim
    from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
    and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) >= 0.3""")
def jn5_similar(s, d):
    e = unit_vectors(s, d)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    sim = F.round(V.dot(F.col("qe"), F.col("embedding")), 5).alias("sim")
    return e.join(q, F.col("q") != F.col("vec_id")).select("q", F.col("vec_id").alias("v"), sim).where("sim >= 0.3")


_CONT = """c as (select label t, vec_id % 10 p, count(*)::double n from embeddings group by 1, 2),
    r as (select sum(n) a from c group by t), k as (select sum(n) b from c group by p),
    z as (select (select sum(n) from c) N1, (select sum(n * (n - 1) / 2) from c) bo, (select sum(a * (a - 1) / 2) from r) ra, (select sum(b * (b - 1) / 2) from k) rb,
    (select sum(a * ln(a)) from r) ha, (select sum(b * ln(b)) from k) hb, (select sum(n * ln(n)) from c) hj),
    y as (select *, N1 * (N1 - 1) / 2 al, ln(N1) + (hj - ha - hb) / N1 mi from z)"""


@query(f"""with {_CONT} select round((al + 2 * bo - ra - rb) / al, 6) rand, round((bo - ra * rb / al) / ((ra + rb) / 2 - ra * rb / al), 6) adjusted_rand,
    round(bo / sqrt(ra * rb), 6) fowlkes_mallows, round(mi, 6) mutual_information,
    round(mi / ((ln(N1) - ha / N1 + ln(N1) - hb / N1) / 2), 6) normalized_mi from y""")
def m_ext_scores(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("p"))
    return V.pair_scores(V.contingency(e, "label", "p"))


_LABELS = "l as (select c_custkey item, c_nationkey % 4 cl, c_nationkey % 3 gt from customer)"


def label_cells(s: SparkSession, d: str) -> DataFrame:
    """(t, p, n) of all customers: labels and clusters made of the nation."""
    c = table(s, d, "customer").select((F.col("c_nationkey") % 4).alias("cl"), (F.col("c_nationkey") % 3).alias("gt"))
    return V.contingency(c, "gt", "cl")


@query(f"""with {_LABELS} select round(avg(case when (a.cl = b.cl) = (a.gt = b.gt) then 1e0 else 0e0 end), 6) ri
    from l a join l b on a.item < b.item""")
def m_ri_overlap(s, d):
    """Share of all pairs that agree, counted in the contingency table."""
    return V.pair_scores(label_cells(s, d)).select(F.col("rand").alias("ri"))


@query(f"""with {_LABELS}, p as (select a.cl acl, a.gt agt, b.cl bcl, b.gt bgt from l a join l b on a.item < b.item
        where (a.cl = b.cl) <> (a.gt = b.gt)),
    o as (select *, acl < bcl or (acl = bcl and agt < bgt) up from p)
    select case when acl = bcl then 'cluster' else 'label' end shared, case when up then acl else bcl end cl_i, case when up then agt else bgt end gt_i,
    case when up then bcl else acl end cl_j, case when up then bgt else agt end gt_j, count(*) pairs from o group by 1, 2, 3, 4, 5""")
def m_wrong_pairs(s, d):
    """Wrong pairs of either kind by their two classes (cluster, label): any item of the one
    with any of the other."""
    return V.wrong_pairs(label_cells(s, d), "p", "t")


@query("""with c as (select vec_id % 7 cl, label, count(*) n from embeddings group by 1, 2), b as (select cl, max(n) n from c group by 1)
    select round(sum(n) / (select count(*) from embeddings), 6) purity from b""")
def m_purity(s, d):
    e = table(s, d, "embeddings").select((F.col("vec_id") % 7).alias("cl"), "label")
    best = R.majority(e, ["cl"], "label")
    return best.agg(F.sum("freq").alias("hit")).crossJoin(e.agg(F.count("*").alias("n"))).select(F.round(F.col("hit") / F.col("n"), 6).alias("purity"))


@query()
def cl2_ward(s, d):
    """Ward clusters of the vectors of each pseudo table."""
    e = table(s, d, "embeddings").select((F.col("vec_id") % 20).alias("tab"), "vec_id", "embedding")
    return clustering.ward_by_group(e, "tab", "vec_id", "embedding", 2, 12)


@query(f"""with e as (select distinct 'c:' || lower(class) a, 's:' || lower(superclass) b from table_gt where not {_NOVAL % ('class', 'class')} and not {_NOVAL % ('superclass', 'superclass')}),
    b as (select a x, b y from e union all select b, a from e), r as (with recursive r as (select distinct x node, x m from b union select b.y, r.m from r join b on r.node = b.x where r.m < b.y) select * from r)
    select node, min(m) component from (select * from r union all select x, x from b) group by 1""")
def cl8_components(s, d):
    """Connected components of tables that share a class and superclass text."""
    t = table(s, d, "table_gt").where(has_value("class") & has_value("superclass"))
    edges = t.select(F.concat(F.lit("c:"), F.lower("class")).alias("a"), F.concat(F.lit("s:"), F.lower("superclass")).alias("b"))
    return clustering.components(edges, "a", "b")


_MEMBERS = "m as (select s_nationkey tab, s_suppkey col, cast(s_acctbal / 500 as int) cluster from supplier)"


@query(f"""with {_MEMBERS}, sz as (select tab, count(*) n from m group by 1), l as (select distinct tab, cluster from m),
    p as (select a.tab t_i, b.tab t_j, count(*) k from l a join l b on a.cluster = b.cluster and a.tab < b.tab group by 1, 2)
    select t_i, t_j, round(1 - k / (x.n + y.n + k), 6) dist from p join sz x on x.tab = t_i join sz y on y.tab = t_j""")
def h_jac_distance(s, d):
    m = table(s, d, "supplier").select(
        F.col("s_nationkey").alias("tab"), F.col("s_suppkey").alias("col"), F.round(F.col("s_acctbal") / 500).cast("int").alias("cluster")
    )
    return graphs.shared_cluster_distance(m)


# --- hierarchies and graphs


def type_paths(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.array(F.lit("Thing"), "r_name", "n_name", "c_mktsegment").alias("path")
    )


_EDGES = """p as (select r_name r, n_name n, c_mktsegment m from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    e as (select 'Thing' parent, r child, count(*) weight from p group by r union all select r, n, count(*) from p group by r, n
          union all select n, m, count(*) from p group by n, m)"""


@query(f"with {_EDGES} select * from e")
def g_merge_edges(s, d):
    return graphs.edges_of_paths(type_paths(s, d), "path")


@query(f"""with {_EDGES}, c as (select *, sum(weight) over (partition by parent order by weight desc, child rows unbounded preceding)
        / sum(weight) over (partition by parent) cum from e),
    k as (select *, max(case when cum > 0.7 then weight end) over (partition by parent) cut from c)
    select parent, child, weight from k where cut is null or weight > cut""")
def win3_nucleus(s, d):
    return graphs.nucleus(graphs.edges_of_paths(type_paths(s, d), "path"), 0.7)


@query(f"""with {_EDGES}, n as (select parent node, 1 o, 0 i from e union all select child, 0, 1 from e)
    select node, sum(o)::bigint out_degree, sum(i)::bigint in_degree from n group by 1""")
def g_degrees(s, d):
    return graphs.degrees(graphs.edges_of_paths(type_paths(s, d), "path"))


_FLOW = "e as (select s_nationkey % 6 parent, c_nationkey % 6 child, count(*) weight from supplier join customer on s_suppkey % 25 = c_custkey % 25 group by 1, 2)"


def flow(s: SparkSession, d: str) -> DataFrame:
    sup, cus = table(s, d, "supplier"), table(s, d, "customer")
    j = sup.groupBy((F.col("s_nationkey") % 6).alias("parent"), (F.col("s_suppkey") % 25).alias("k")).count().join(
        cus.groupBy((F.col("c_nationkey") % 6).alias("child"), (F.col("c_custkey") % 25).alias("k")).agg(F.count("*").alias("n")), "k"
    )
    return j.groupBy("parent", "child").agg(F.sum(F.col("count") * F.col("n")).alias("weight"))


@query(f"with {_FLOW} select * from e where parent = child")
def g_self_loops(s, d):
    return graphs.self_loops(flow(s, d))


@query(f"with {_FLOW} select a.* from e a join e b on a.parent = b.child and a.child = b.parent where a.weight < b.weight")
def g_weaker_inverses(s, d):
    return graphs.weaker_inverses(cut(flow(s, d)))


_TREE = """l as (select distinct 'Thing' p, r_name c from region union all select r_name, n_name from nation join region on n_regionkey = r_regionkey),
    t as (with recursive t as (select 'Thing' node, 0 depth, 'Thing' path union all select c, depth + 1, path || ' > ' || c from t join l on p = node) select * from t)"""


def tree_tours(s: SparkSession, d: str) -> DataFrame:
    regions = table(s, d, "region").select(F.lit("t").alias("src"), F.col("r_name").alias("child"), F.lit("Thing").alias("parent"))
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    links = regions.unionByName(nations.select(F.lit("t").alias("src"), F.col("n_name").alias("child"), F.col("r_name").alias("parent")))
    return cut(forest.intervals(cut(links)))


@query(f"with {_TREE} select node, depth from t")
def g_depth(s, d):
    return tree_tours(s, d).select("node", "depth")


@query(f"with {_TREE} select node, path from t")
def g_chain(s, d):
    return forest.paths(tree_tours(s, d)).select("node", "path")


@query(f"with {_TREE} select a.node ancestor, b.node descendant from t a join t b on starts_with(b.path, a.path || ' > ')")
def g_ancestors(s, d):
    return forest.ancestry(tree_tours(s, d)).select("ancestor", F.col("node").alias("descendant"))


@query(f"""with {_TREE}, own as (select n_name node, count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey group by 1)
    select a.node, coalesce(sum(n), 0)::bigint support from t a join t b on b.node = a.node or starts_with(b.path, a.path || ' > ')
    left join own on own.node = b.node group by 1""")
def g_support(s, d):
    tours = tree_tours(s, d)
    own = table(s, d, "nation").join(table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("node")
    ).agg(F.count("*").alias("n"))
    closure = forest.ancestry(tours).select("ancestor", "node").unionByName(tours.select(F.col("node").alias("ancestor"), "node"))
    got = closure.join(own, "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("support"))
    return got


# --- sampling and generators


@query("""select c_custkey k from customer order by md5('7|' || c_custkey), c_custkey
    limit (select greatest(1, cast(round(count(*) * 0.25) as bigint)) from customer)""")
def samp1_ratio(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return R.sample_ratio(c, "k", 0.25, "7")


@query("select c_nationkey class, c_custkey k from customer qualify row_number() over (partition by c_nationkey order by md5('7|' || c_custkey), c_custkey) <= 3")
def samp12_per_class(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("k"))
    return R.sample_per_group(c, "class", "k", 3, "7")


@query("""with h as (select fileName, colName, row_number() over (partition by fileName order by md5('3|' || colName), colName) r, count(*) over (partition by fileName) n
        from (select distinct fileName, colName from column_gt where colName is not null))
    select fileName, colName, case when r <= greatest(1, least(n, cast(ceil(n * 0.25) as bigint))) then lower(translate(colName, ' aeiouyAEIOUY', '')) else colName end new_name from h""")
def gen3_header_noise(s, d):
    """Vowels dropped from a quarter of each table's headers, chosen by hash."""
    heads = table(s, d, "column_gt").select("fileName", "colName").where("colName is not null").distinct()
    ranked = ordering.group_rank(heads.withColumn("h", R.hash_order(F.col("colName"), "3")), "fileName", ["h", "colName"], "r", "n")
    pick = F.col("r") < F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * 0.25)))
    return ranked.select("fileName", "colName", F.when(pick, T.drop_vowels(F.col("colName"))).otherwise(F.col("colName")).alias("new_name"))


@query("""select 'class T' || n_nationkey || ' {' || chr(10) || string_agg('  ' || s, chr(10) order by s) || chr(10) || '}' uml
    from (select distinct n_nationkey, c_mktsegment s from nation join customer on c_nationkey = n_nationkey) group by n_nationkey""")
def uml_classes(s, d):
    j = table(s, d, "nation").join(table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = R.label_sets(j, "n_nationkey", "c_mktsegment")
    body = F.array_join(F.transform("labels", lambda x: F.concat(F.lit("  "), x)), "\n")
    return sets.select(F.concat(F.lit("class T"), "n_nationkey", F.lit(" {\n"), body, F.lit("\n}")).alias("uml"))


@query("select part, user_id, event_id from (select ntile(3) over (partition by user_id order by event_id) part, user_id, event_id from events)")
def f_even_split(s, d):
    part = F.ntile(3).over(W.partitionBy("user_id").orderBy("event_id"))
    return table(s, d, "events").select(part.alias("part"), "user_id", "event_id")
