"""Queries of the graph operators over a graph of types in which segments have many parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import graphs, lattice as L
from tessellum.plans.base import Plans
from tessellum.sources.scratch import cut
from tessellum.sources.tables import table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query

_DAG = """rg as (select 'Thing' parent, r_name child, 1 weight from region), ng as (select r_name parent, n_name child, 1 weight from nation join region on n_regionkey = r_regionkey),
    sg as (select n_name parent, c_mktsegment child, count(*) weight from customer join nation on c_nationkey = n_nationkey group by 1, 2),
    e as (select * from rg union all select * from ng union all select * from sg)"""
_CLOSED = f"{_DAG}, c as (with recursive c as (select parent a, child b from e union select c.a, e.child from c join e on c.b = e.parent) select * from c)"


def dag(s: SparkSession, d: str) -> DataFrame:
    region, nation = table(s, d, "region"), table(s, d, "nation")
    tops = region.select(F.lit("Thing").alias("parent"), F.col("r_name").alias("child"), F.lit(1).cast("long").alias("weight"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    middle = named.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(1).cast("long").alias("weight"))
    low = table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("parent"), F.col("c_mktsegment").alias("child")
    ).agg(F.count("*").alias("weight"))
    return cut(tops.unionByName(middle).unionByName(low), "dag")


_ASIA = "(select r_name from region where r_regionkey = 2)"


def _region(s: SparkSession, d: str) -> str:
    return table(s, d, "region").where("r_regionkey = 2").first().r_name


@query(f"with {_CLOSED} select a ancestor, b node from c")
def g_anc_closure(s, d):
    return L.closure(dag(s, d))


_KEPT = "kept as (select n_name node from nation where n_nationkey % 3 = 0)"


def _kept(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("node"))


@query(f"with {_CLOSED}, {_KEPT}, k as (select node from kept union select a from c join kept on b = node) select parent, child from e where parent in (select node from k) and child in (select node from k)")
def g_sub_induced(s, d):
    edges = dag(s, d)
    return L.induced(edges, L.with_ancestors(edges, _kept(s, d))).select("parent", "child")


@query(f"with {_CLOSED}, k as (select b node from c where a = {_ASIA} union select {_ASIA}) select parent, child from e where parent in (select node from k) and child in (select node from k)")
def g_subh_below(s, d):
    return L.below(dag(s, d), _region(s, d)).select("parent", "child")


@query(f"""with {_CLOSED}, lv as (select child node from e where child not in (select parent from e) and child < 'F'), k as (select node from lv union select a from c join lv on b = node)
    select parent, child, child in (select node from lv) leaf from e where parent in (select node from k) and child in (select node from k)""")
def g_clos_of_leaves(s, d):
    """The closure of a set of leaves, its edges, and which of them end in a leaf of the set: none other has no child."""
    edges = dag(s, d)
    leaves = cut(edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_anti").where("node < 'F'"), "leaves")
    kept = L.induced(edges, L.with_ancestors(edges, leaves)).select("parent", "child")
    return kept.join(leaves.select(F.col("node").alias("child"), F.lit(True).alias("leaf")), "child", "left").select("parent", "child", F.coalesce("leaf", F.lit(False)).alias("leaf"))


_PATHS = f"{_DAG}, p as (with recursive p as (select 'Thing' node, 'Thing' path, 0 depth union all select e.child, path || ' > ' || e.child, depth + 1 from p join e on p.node = e.parent) select * from p)"


def _paths(s: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    return L.simple_paths(edges, s.createDataFrame([("Thing",)], "node string"))


@query(f"with {_PATHS} select node, path, depth = min(depth) over (partition by node) shortest, depth = max(depth) over (partition by node) longest from p")
def g_paths_all(s, d):
    p = _paths(s, d, dag(s, d)).select("node", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("depth"))
    ends = p.groupBy("node").agg(F.min("depth").alias("low"), F.max("depth").alias("high"))
    return p.join(ends, "node").select("node", "path", (F.col("depth") == F.col("low")).alias("shortest"), (F.col("depth") == F.col("high")).alias("longest"))


@query(f"with {_PATHS}, q as (select path, depth from p where node not in (select parent from e)) select path, depth, (select max(depth) from q) max_depth from q")
def g_depthmax(s, d):
    edges = dag(s, d)
    leaves = edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_anti")
    ways = _paths(s, d, edges).join(leaves, "node", "left_semi").select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("depth"))
    return ways.crossJoin(F.broadcast(ways.agg(F.max("depth").alias("max_depth"))))


@query(f"""with {_PATHS}, t as (select n_name node, count(*) n, min(c_name) first from customer join nation on c_nationkey = n_nationkey group by 1)
    select path, depth, coalesce(n, 0) n_tables, first from p left join t using (node) where node not in (select c_mktsegment from customer)""")
def g_trav_listing(s, d):
    nation = table(s, d, "nation")
    tables = table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("node")).agg(
        F.count("*").alias("n"), F.min("c_name").alias("first")
    )
    edges = dag(s, d)
    segments = table(s, d, "customer").select(F.col("c_mktsegment").alias("node")).distinct()
    ways = _paths(s, d, edges).join(segments, "node", "left_anti")
    listed = ways.join(tables, "node", "left").select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("depth"), F.coalesce("n", F.lit(0)).alias("n_tables"), "first")
    return listed.orderBy("path")


@query(f"with {_CLOSED} select child node, child branch from e where parent = 'Thing' union select b, a from c where a in (select child from e where parent = 'Thing')")
def g_branch(s, d):
    return L.root_branches(dag(s, d))


@query(f"with {_PATHS}, u as (with recursive u as (select child node, child top, 0 h from e where child not in (select parent from e) union select e.parent, u.top, h + 1 from u join e on u.node = e.child) select * from u) select node, max(h) level from u group by 1")
def g_levels(s, d):
    return L.levels(dag(s, d))


_TAGS = """tags as (select distinct n_name node, s_suppkey % 40 item from supplier join nation on s_nationkey = n_nationkey
    union select distinct r_name, s_suppkey % 40 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal > 2000
    union select distinct 'Thing', s_suppkey % 60 from supplier)"""


def _tags(s: SparkSession, d: str) -> DataFrame:
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = (F.col("s_suppkey") % 40).alias("item")
    low = sup.select(F.col("n_name").alias("node"), item)
    high = sup.where("s_acctbal > 2000").select(F.col("r_name").alias("node"), item)
    top = table(s, d, "supplier").select(F.lit("Thing").alias("node"), (F.col("s_suppkey") % 60).alias("item"))
    return cut(low.unionByName(high).unionByName(top).distinct(), "tags")


@query(f"with {_CLOSED}, {_TAGS} select node, item from tags t where not exists (select 1 from c join tags u on c.b = u.node where c.a = t.node and u.item = t.item)")
def g_spec_columns(s, d):
    return L.specific(_tags(s, d), L.closure(dag(s, d)))


@query(f"""with {_CLOSED}, {_TAGS}, sp as (select node, item from tags t where not exists (select 1 from c join tags u on c.b = u.node where c.a = t.node and u.item = t.item)),
    k as (select item, count(*) n, min(node) sole from sp group by 1), dp as (select 'Thing' node, 0 depth union select r_name, 1 from region union select n_name, 2 from nation),
    up as (select item, dp.node a, dp.depth, count(distinct sp.node) k from sp join dp on dp.node = sp.node or (dp.node, sp.node) in (select (a, b) from c) group by 1, 2, 3),
    cm as (select item, max_by(a, depth * 1000 + 0) common from up join k using (item) where up.k = k.n group by 1)
    select item, case when n = 1 then sole else common end node from k left join cm using (item)""")
def g_spec_most_specific(s, d):
    depth = s.createDataFrame([("Thing", 0)], "node string, depth int")
    depth = depth.unionByName(table(s, d, "region").select(F.col("r_name").alias("node"), F.lit(1).alias("depth")))
    depth = depth.unionByName(table(s, d, "nation").select(F.col("n_name").alias("node"), F.lit(2).alias("depth")))
    return L.most_specific(_tags(s, d), L.closure(dag(s, d)), depth)


@query(f"with {_TAGS} select node from tags group by 1 having count(*) = (select count(distinct item) from tags)")
def g_cover(s, d):
    return L.covering(_tags(s, d))


@query("""select r_name table_group, p_size % 5 cluster, string_agg(distinct p_brand, ',' order by p_brand) members from part join nation on p_partkey % 25 = n_nationkey
    join region on n_regionkey = r_regionkey group by 1, 2""")
def g_regrp(s, d):
    clusters = table(s, d, "part").select((F.col("p_size") % 5).alias("cluster"), (F.col("p_partkey") % 25).cast("int").alias("table_name"), F.col("p_brand").alias("member"))
    groups = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("table_name"), F.col("r_name").alias("table_group"))
    return L.regrouped(clusters, groups).withColumn("members", F.array_join("members", ","))


@query(f"""with {_DAG}, n as (select c_mktsegment node, left(c_mktsegment, 1) label from customer group by 1 union select n_name, left(n_name, 1) from nation),
    i as (select n.label, n.node, count(distinct e.parent) in_degree from n left join e on e.child = n.node group by 1, 2)
    select label, node, in_degree from i qualify rank() over (partition by label order by in_degree) = 1""")
def g_succ_topmost(s, d):
    seg = table(s, d, "customer").select(F.col("c_mktsegment").alias("node")).distinct()
    nodes = seg.unionByName(table(s, d, "nation").select(F.col("n_name").alias("node"))).withColumn("label", F.left("node", F.lit(1)))
    return L.topmost(nodes, dag(s, d), "label")


_FLOW = "f as (select s_nationkey % 6 parent, c_nationkey % 6 child, count(*) weight from supplier join customer on s_suppkey % 25 = c_custkey % 25 group by 1, 2)"


def _flow(s: SparkSession, d: str) -> DataFrame:
    sup = table(s, d, "supplier").groupBy((F.col("s_nationkey") % 6).alias("parent"), (F.col("s_suppkey") % 25).alias("k")).count()
    cus = table(s, d, "customer").groupBy((F.col("c_nationkey") % 6).alias("child"), (F.col("c_custkey") % 25).alias("k")).agg(F.count("*").alias("n"))
    flow = sup.join(cus, "k").groupBy("parent", "child").agg(F.sum(F.col("count") * F.col("n")).alias("weight"))
    return cut(flow.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"), "weight"), "flow")


@query(f"""with {_FLOW}, b as (select parent, child from f where parent = child union select x.parent, x.child from f x join f y on x.parent = y.child and x.child = y.parent where x.weight < y.weight),
    k as (select cast(parent as varchar) parent, cast(child as varchar) child, weight from f where (parent, child) not in (select (parent, child) from b))
    select parent, child, weight from k union all select distinct 'Thing', parent, 1 from k where parent not in (select child from k)""")
def g_post(s, d):
    edges = _flow(s, d)
    bad = graphs.self_loops(edges).unionByName(graphs.weaker_inverses(edges))
    return L.pruned(edges, bad, "Thing")


_RECORDS = """r as (select c_custkey id, list_filter(['Thing', r_name, n_name, c_mktsegment, c_name || ' ' || c_mktsegment || ' of ' || n_name], lambda x: length(x) <= 25) path
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _records(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    long = F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("of"), "n_name")
    return c.select(F.col("c_custkey").alias("id"), F.array(F.lit("Thing"), "r_name", "n_name", "c_mktsegment", long).alias("path"))


@query(f"with {_RECORDS}, u as (select path, unnest(range(1, len(path))) i from r) select path[i] parent, path[i + 1] child, count(*) weight from u group by 1, 2")
def g_merge_records(s, d):
    return L.merge_paths(_records(s, d), 25)[0]


@query(f"with {_RECORDS}, u as (select id, unnest(path) node from r) select node, count(distinct id) records, count(*) n from u group by 1")
def g_merge_nodes(s, d):
    return L.merge_paths(_records(s, d), 25)[1]


@query("with p as (select c_nationkey root, c_mktsegment from customer), r as (select 'Thing' parent, r_name child from region union all select r_name, n_name from nation join region on n_regionkey = r_regionkey), n as (select parent node from r union select child from r) select node, (select count(*) from r where child = node) parents, node not in (select child from r) is_root, node not in (select parent from r) is_leaf from n")
def g_deg_validation(s, d):
    """Parents of each node, and which are roots and leaves; a tree has one root and no second parent."""
    edges = dag(s, d).join(table(s, d, "customer").select(F.col("c_mktsegment").alias("child")).distinct(), "child", "left_anti")
    return graphs.degrees(edges).select("node", F.col("in_degree").cast("long").alias("parents"), (F.col("in_degree") == 0).alias("is_root"), (F.col("out_degree") == 0).alias("is_leaf"))
