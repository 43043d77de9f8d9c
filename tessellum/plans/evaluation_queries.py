"""Queries of the evaluation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import evaluation as E, lattice, ordering, vectors as V
from tessellum.plans.base import NO_VALUE_SQL, Plans
from tessellum.plans.graph_queries import dag
from tessellum.sources.scratch import cut
from tessellum.sources.tables import has_value, table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query

_TYPED = f"""lb as (select fileName f, list_sort(list(distinct lower(trim(class)))) labels from table_gt where fileName is not null and not {NO_VALUE_SQL.format('class')} group by 1),
    cl as (select f, split_part(f, '_', 1) \"cluster\", labels from lb), ct as (select \"cluster\", labels, count(*) n from cl group by 1, 2),
    mj as (select \"cluster\", labels majority from ct qualify row_number() over (partition by \"cluster\" order by n desc, labels) = 1),
    jd as (select cl.*, majority, not list_has_any(labels, majority) wrong from cl join mj using (\"cluster\"))"""


def _judged(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "table_gt").where(has_value("class") & F.col("fileName").isNotNull()).select(F.col("fileName").alias("f"), F.lower(F.trim("class")).alias("l"))
    labels = cut(E.label_lists(t, "f", "l"), "labels")
    return E.list_purity(labels.select("f", F.substring_index("f", "_", 1).alias("cluster")), labels, "f")


@query(f"with {_TYPED} select f, \"cluster\", wrong from jd")
def m_pure_tables(s, d):
    return _judged(s, d).select("f", "cluster", "wrong")


@query(f"with {_TYPED} select round(1 - count(*) filter (wrong) / (select count(distinct fileName) from table_gt), 6) purity from jd")
def m_pure(s, d):
    """Purity of tables, by all tables of the ground truth."""
    return E.purity(_judged(s, d), table(s, d, "table_gt").agg(F.countDistinct("fileName").alias("n")))


@query(f"""with c as (select col_id, lower(trim(LowestClass)) cl, lower(trim(ColumnLabel)) l from column_gt where not {NO_VALUE_SQL.format('LowestClass')} and not {NO_VALUE_SQL.format('ColumnLabel')}),
    k as (select cl, l, count(*) n from c group by 1, 2), m as (select cl, max(n) n from k group by 1)
    select round(sum(n) / (select count(*) from c), 6) purity from m""")
def m_purc(s, d):
    """Purity of columns, by the labelled ones."""
    c = table(s, d, "column_gt").where(has_value("LowestClass") & has_value("ColumnLabel"))
    rows = cut(c.select("col_id", F.lower(F.trim("LowestClass")).alias("cluster"), F.array(F.lower(F.trim("ColumnLabel"))).alias("labels")), "labelled")
    judged = E.list_purity(rows.select("col_id", "cluster"), rows.select("col_id", "labels"), "col_id")
    return E.purity(judged, rows.agg(F.count("*").alias("n")))


@query("""with r as (select 0 layer, n_nationkey cl, c_mktsegment l from customer join nation on c_nationkey = n_nationkey union all select 1, n_regionkey, c_mktsegment from customer join nation on c_nationkey = n_nationkey),
    k as (select layer, cl, l, count(*) n from r group by 1, 2, 3), m as (select layer, cl, max(n) n from k group by 1, 2)
    select layer, round(sum(n) / (select count(*) from customer), 6) purity from m group by 1""")
def m_layer(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    low = c.select(F.lit(0).alias("layer"), F.col("n_nationkey").alias("cluster"), F.col("c_mktsegment").alias("label"))
    return E.layer_purity(low.unionByName(c.select(F.lit(1).alias("layer"), F.col("n_regionkey").alias("cluster"), F.col("c_mktsegment").alias("label"))))


_ITEMS = """it as (select n_name node, c_mktsegment l from customer join nation on c_nationkey = n_nationkey), up as (select node, l from it union all select r_name, l from it join nation on node = n_name join region on n_regionkey = r_regionkey union all select 'Thing', l from it),
    k as (select node, l label, count(*) freq from up group by 1, 2)"""


@query(f"with {_ITEMS} select node, label, freq, round(freq / sum(freq) over (partition by node), 6) purity from k qualify rank() over (partition by node order by freq desc) = 1")
def m_lab(s, d):
    """Majority labels of each node by the tables at and below it."""
    edges = dag(s, d).join(table(s, d, "customer").select(F.col("c_mktsegment").alias("child")).distinct(), "child", "left_anti")
    items = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node"), F.col("c_mktsegment").alias("label"))
    return E.node_labels(edges, items)


_WRONG = """tr as (select r.r_name || '' top, n_name mid, c_mktsegment leaf from (select n_name, (n_nationkey * 7 + 1) % 5 rk, n_nationkey from nation) n join region r on r_regionkey = rk join (select distinct c_nationkey, c_mktsegment from customer) on c_nationkey = n_nationkey),
    gt as (select distinct r_name || '|' || n_name || '|' || c_mktsegment tid, r_name top, n_name mid, c_mktsegment leaf from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _inferred(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paths of a tree with many wrong parents, and of the true one."""
    low = table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    n = table(s, d, "nation").join(low, F.col("c_nationkey") == F.col("n_nationkey"))
    r = table(s, d, "region")
    wrong = n.join(r, (F.col("n_nationkey") * 7 + 1) % 5 == F.col("r_regionkey"))
    right = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.array("r_name", "n_name", "c_mktsegment")
    return cut(wrong.select(F.array_join(path, "|").alias("path_id"), path.alias("path"))), cut(right.select(F.array_join(path, "|").alias("truth_id"), path.alias("path")))


@query(f"""with {_WRONG}, h as (select tr.top || '|' || tr.mid || '|' || tr.leaf path_id, tid, (tr.top = gt.top)::int + (tr.mid = gt.mid)::int + (tr.leaf = gt.leaf)::int hit, tr.top = gt.top and tr.leaf = gt.leaf ends from tr join gt on tr.top = gt.top or tr.mid = gt.mid or tr.leaf = gt.leaf)
    select path_id, round(case when bool_or(ends) then max(hit) else 0 end / 3, 6) score from h group by 1""")
def m_tcs_g(s, d):
    """Consistency of each path of an inferred tree with the paths of the true one."""
    return E.path_scores(*_inferred(s, d))


@query(f"""with {_WRONG}, lb as (select distinct n_name node, r_name label from nation join region on n_regionkey = r_regionkey union select r_name, r_name from region union select c_mktsegment, c_mktsegment from customer)
    select tr.top || '|' || mid || '|' || leaf path_id, round((2 + (l.label = tr.top)::int) / 3, 6) share from tr join lb l on l.node = mid""")
def m_tcs_e(s, d):
    """Share of the names of each path that agree with its ends: a nation is labelled with its true region."""
    paths = _inferred(s, d)[0]
    r = table(s, d, "region")
    labels = table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("label"))
    labels = labels.unionByName(r.select(F.col("r_name").alias("node"), F.col("r_name").alias("label")))
    seg = table(s, d, "customer").select(F.col("c_mktsegment").alias("node")).distinct()
    labels = cut(labels.unionByName(seg.select("node", F.col("node").alias("label"))).distinct())
    none = s.createDataFrame([], "ancestor string, node string")
    return E.consistent_shares(paths, labels, none)


@query("""with c as (select r_name cl, c_mktsegment l, count(*) n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2), t as (select sum(n) n from c),
    b as (select sum(n * (n - 1) / 2) x from c), ra as (select sum(a * (a - 1) / 2) x from (select sum(n) a from c group by l)), rb as (select sum(a * (a - 1) / 2) x from (select sum(n) a from c group by cl))
    select round((t.n * (t.n - 1) / 2 + 2 * b.x - ra.x - rb.x) / (t.n * (t.n - 1) / 2), 6) rand, round((select sum(m) from (select max(n) m from c group by cl)) / t.n, 6) purity from t, b, ra, rb""")
def m_top(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return E.top_level(c.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("cluster"), F.col("c_mktsegment").alias("label")))


@query(f"""with t as (select distinct fileName f, lower(trim(class)) l from table_gt where fileName is not null and not {NO_VALUE_SQL.format('class')})
    select l label, count(*) items, dense_rank() over (order by l) - 1 idx from t group by 1""")
def m_gt_index(s, d):
    """Labels with their items and a number in the order of letters."""
    t = table(s, d, "table_gt").where(has_value("class") & F.col("fileName").isNotNull()).select(F.col("fileName").alias("f"), F.lower(F.trim("class")).alias("label")).distinct()
    return ordering.global_rank(t.groupBy("label").agg(F.count("*").alias("items")), ["label"], "idx")


@query("""with g as (select distinct lower(label) k from label_ref), r as (select distinct lower(trim(ColumnLabel)) k from column_gt where ColumnLabel is not null), h as (select count(*) h from r join g using (k))
    select round(h / (select count(*) from r), 6) p, round(h / (select count(*) from g), 6) rec, round(2e0 * h / ((select count(*) from r) + (select count(*) from g)), 6) f1 from h""")
def m_prf_labels(s, d):
    """Labels in use against the canonical ones."""
    r = table(s, d, "column_gt").where("ColumnLabel is not null").select(F.lower(F.trim("ColumnLabel")).alias("k"))
    return E.precision_recall(r, table(s, d, "label_ref").select(F.lower("label").alias("k")), ["k"])


@query()
def m_ext_ami(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("p"))
    return E.adjusted_mutual_information(V.contingency(e, "label", "p"))


@query()
def m_txt_rouge(s, d):
    """ROUGE-L of each column's header with its label, averaged by file."""
    c = table(s, d, "column_gt").where("colName is not null and ColumnLabel is not null")
    score = E.rouge_l(T.words_without(F.col("colName")), T.words_without(F.col("ColumnLabel")))
    return c.select("fileName", score.alias("r")).groupBy("fileName").agg(F.round(F.avg("r"), 6).alias("rouge_l"))


@query("select o_orderpriority item, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 3) F, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 3) O, round(avg(o_totalprice) filter (o_orderstatus = 'P'), 3) P from orders group by 1")
def rpt1_metric_pivot(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("item")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 3))
    return o


@query("""with g as (select s_nationkey q, s_suppkey v from supplier), r as (select c_nationkey q, c_custkey v from customer), s as (select q, count(*) n from g group by 1), h as (select g.q, count(*) h from g join r using (q, v) group by 1)
    select s.q, n, round(coalesce(h, 0) / n, 6) recall from s left join h on s.q = h.q""")
def rpt2_recall(s, d):
    """Recall of each query's results at the size of its ground truth."""
    g = table(s, d, "supplier").select(F.col("s_nationkey").alias("q"), F.col("s_suppkey").alias("v"))
    r = table(s, d, "customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("v"), F.lit(1).alias("hit")).distinct()
    return g.join(r, ["q", "v"], "left").groupBy("q").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("""with l as (select c_nationkey % 4 cl, c_nationkey % 3 gt from customer), c as (select cl % 2 layer, cl, gt, count(*) n from l group by 1, 2, 3), b as (select layer, cl, max(n) hit, sum(n) n from c group by 1, 2)
    select layer, round(cast(sum(hit) as double) / cast(sum(n) as double), 6) purity from b group by layer""")
def m_layer_purity(s, d):
    """Clusters of two made-up layers."""
    cl = F.col("c_nationkey") % 4
    return E.layer_purity(table(s, d, "customer").select((cl % 2).alias("layer"), cl.alias("cluster"), (F.col("c_nationkey") % 3).alias("label")))


@query("""with g as (select distinct n_nationkey k from nation), r as (select distinct c_nationkey k from customer union select s_nationkey + 20 from supplier), h as (select count(*) h from r join g on r.k = g.k)
    select round(h / (select count(*) from r), 6) p, round(h / (select count(*) from g), 6) rec, round(2e0 * h / ((select count(*) from r) + (select count(*) from g)), 6) f1 from h""")
def m_prf(s, d):
    """Keys in use against those that exist."""
    r = table(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(s, d, "supplier").select((F.col("s_nationkey") + 20).alias("k")))
    return E.precision_recall(r, table(s, d, "nation").select(F.col("n_nationkey").alias("k")), ["k"])
