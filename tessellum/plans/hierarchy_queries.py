"""Queries of the phases: types, conceptual attributes, hierarchies, relationships and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import clustering, dendro as D, ordering, relational as R, vectors as V
from tessellum.plans.base import NO_VALUE_SQL, Plans, unit_vectors
from tessellum.sources.scratch import cut
from tessellum.sources.tables import has_value, table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query


def members(s: SparkSession, d: str) -> DataFrame:
    """(grp, tab, col, cluster): a nation is a table of its region, its suppliers are columns."""
    n = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cluster = F.round(F.col("s_acctbal") / 800).cast("int").alias("cluster")
    return cut(n.select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("tab"), F.col("s_suppkey").alias("col"), cluster), "members")


@query()
def h_link(s, d):
    return D.dendrograms(members(s, d))


@query()
def h_best_cut(s, d):
    """The best of the cuts at twenty heights (H-CUT, H-BEST)."""
    return D.best_cuts(members(s, d))


@query()
def h_layers_tree(s, d):
    """Layers of cuts as a tree for each type (H-LAYERS, H-TREE, H-RUN)."""
    return D.hierarchies(members(s, d), delta=0.5)


def _dendrogram(s: SparkSession, d: str) -> DataFrame:
    return cut(D.dendrogram_edges(cut(D.dendrograms(members(s, d)), "merges")), "dendrogram")


@query()
def h_dg_edges(s, d):
    return _dendrogram(s, d)


@query()
def h_child_leaves(s, d):
    return D.leaves_below(_dendrogram(s, d))


_FIXED = """fx as (select 'Thing' parent, r_name child from region union all select r_name, n_name from nation join region on n_regionkey = r_regionkey),
    pr as (select 'Thing' a, r_name b from region union select 'Thing', n_name from nation union select r_name, n_name from nation join region on n_regionkey = r_regionkey)"""


def _tree(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "region")
    n = table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return cut(r.select(F.lit("Thing").alias("parent"), F.col("r_name").alias("child")).unionByName(n.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))), "tree")


@query(f"""with {_FIXED}, cl as (select n_nationkey % 7 \"cluster\", n_name leaf, r_name from nation join region on n_regionkey = r_regionkey)
    select \"cluster\", case when count(distinct r_name) = 1 then min(r_name) else 'Thing' end node from cl group by 1""")
def h_slice_common(s, d):
    clusters = table(s, d, "nation").select((F.col("n_nationkey") % 7).alias("cluster"), F.col("n_name").alias("leaf"))
    return D.common_ancestors(_tree(s, d), clusters)


@query(f"with {_FIXED} select 'Thing' parent, n_name child from nation where n_regionkey > 1 union all select 'Thing', r_name from region where r_regionkey <= 1 union all select r_name, n_name from nation join region on n_regionkey = r_regionkey where n_regionkey <= 1")
def h_simp(s, d):
    """Without the regions beyond the second: their nations hang on the root."""
    tree = _tree(s, d)
    gone = table(s, d, "region").where("r_regionkey > 1").select(F.col("r_name").alias("node"))
    kept = tree.select(F.explode(F.array("parent", "child")).alias("node")).distinct().join(gone, "node", "left_anti")
    return D.simplified(tree, kept)


@query(f"""with {_FIXED}, m as (select n_name tab, s_suppkey col, cast(round(s_acctbal / 800) as int) \"cluster\" from supplier join nation on s_nationkey = n_nationkey),
    sb as (select tab, min(col) col from m group by 1), rs as (select m.* from m anti join sb on m.tab = sb.tab and m.col = sb.col)
    select node, \"cluster\", count(*) n from (select tab node, \"cluster\" from rs union all select a, \"cluster\" from rs join pr on tab = b) group by 1, 2""")
def h_attr(s, d):
    m = members(s, d)
    subjects = m.groupBy("tab").agg(F.min("col").alias("col"))
    return D.node_attributes(_tree(s, d), m.select("tab", "col", "cluster"), subjects)


# --- phases


@query()
def p_phase1_types(s, d):
    """Types of tables: mean vectors of their columns, clustered by k-means over a range of
    numbers, with the purity of each cluster."""
    e = table(s, d, "embeddings").withColumn("tab", F.col("vec_id") % 50)
    means = V.mean_vectors(e, "tab", "embedding").groupBy("tab").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x.value).alias("v"))
    return clustering.cluster(cut(means, "means"), "tab", "v", "kmeans", range(3, 8))


@query()
def p_phase2_attributes(s, d):
    """Conceptual attributes: the columns of each type clustered, without the subject column of each table."""
    e = table(s, d, "embeddings").withColumns({"typ": F.col("vec_id") % 10, "tab": F.col("vec_id") % 50})
    subjects = e.groupBy("tab").agg(F.min("vec_id").alias("vec_id"))
    return clustering.ward_by_group(e.join(subjects, ["tab", "vec_id"], "left_anti"), "typ", "vec_id", "embedding", 2, 8)


@query()
def p_phase3_hierarchy(s, d):
    return D.hierarchies(members(s, d))


_SIM = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5)"
_MATCH = f"""e as (select vec_id, vec_id % 50 tab, vec_id % 50 % 10 typ, label, embedding, row_number() over (partition by vec_id % 50 order by vec_id) = 1 subj from embeddings),
    mt as (select a.tab tab1, a.typ type1, b.tab tab2, b.typ type2, b.vec_id attr, b.label \"cluster\", {_SIM} sim from e a join e b on a.subj and not b.subj and a.typ <> b.typ where {_SIM} > 0.25)"""


def matches(s: SparkSession, d: str, least: float = 0.25) -> DataFrame:
    """(tab1, type1, tab2, type2, attr, cluster, sim): the subject vector of each table against
    the other columns of tables of other types, strictly above ``least``."""
    e = unit_vectors(s, d).withColumn("tab", F.col("vec_id") % 50).withColumn("typ", F.col("tab") % 10)
    first = e.groupBy("tab").agg(F.min("vec_id").alias("vec_id"))
    a = e.join(first, ["tab", "vec_id"], "left_semi").select(F.col("tab").alias("tab1"), F.col("typ").alias("type1"), F.col("embedding").alias("x"))
    b = e.join(first, ["tab", "vec_id"], "left_anti").select(
        F.col("tab").alias("tab2"), F.col("typ").alias("type2"), F.col("vec_id").alias("attr"), F.col("label").alias("cluster"), F.col("embedding").alias("y")
    )
    sims = b.join(a, F.col("type1") != F.col("type2")).withColumn("sim", F.round(V.dot(F.col("x"), F.col("y")), 5))
    return cut(sims.where(F.col("sim") > least).select("tab1", "type1", "tab2", "type2", "attr", "cluster", "sim"), "matches")


@query(f"with {_MATCH} select tab1, tab2, attr, sim from mt")
def p4a_entity_relationships(s, d):
    return matches(s, d).select("tab1", "tab2", "attr", "sim")


_GROUPS = "('Place', 'Event', 'Person')"


@query(f"select gt_id, case when class in {_GROUPS} then class when superclass like '[''%' then nullif(regexp_extract(superclass, '^\\[''([^'']*)''', 1), '') end grp from table_gt")
def p4b_group_files(s, d):
    """The class of a table if it is one of those chosen, else its nearest superclass."""
    first = F.when(F.col("superclass").startswith("['"), F.nullif(F.regexp_extract("superclass", r"^\['([^']*)'", 1), F.lit("")))
    return table(s, d, "table_gt").select("gt_id", F.when(F.col("class").isin("Place", "Event", "Person"), F.col("class")).otherwise(first).alias("grp"))


@query(f"""with {_MATCH}, n as (select typ, count(distinct tab) n from e group by 1),
    k as (select type1, type2, \"cluster\", count(distinct tab1) s1, count(distinct tab2) s2, round(avg(sim), 3) sim from mt group by 1, 2, 3)
    select type1, type2, \"cluster\", round(s1 / x.n, 6) ra, round(s2 / y.n, 6) sa, k.sim from k join n x on x.typ = type1 join n y on y.typ = type2 where s1 / x.n >= 0.2 and s2 / y.n >= 0.2""")
def p4c_attribute_relationships(s, d):
    """Relations of types by an attribute cluster: shares of supporting tables on both sides, and the mean similarity."""
    return relationships(matches(s, d), _types(s, d), 0.2, 0.2)


def _types(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select((F.col("vec_id") % 50).alias("tab")).distinct()
    return e.select("tab", (F.col("tab") % 10).alias("typ"))


def relationships(found: DataFrame, types: DataFrame, portion: float, portion_sa: float) -> DataFrame:
    """(type1, type2, cluster, ra, sa, sim) of ``matches`` where at least ``portion`` of the tables
    of the first and ``portion_sa`` of the second type (tab, typ) support the relation."""
    n = types.groupBy("typ").agg(F.countDistinct("tab").alias("n"))
    k = found.groupBy("type1", "type2", "cluster").agg(F.countDistinct("tab1").alias("s1"), F.countDistinct("tab2").alias("s2"), F.round(F.avg("sim"), 3).alias("sim"))
    k = k.join(n.toDF("type1", "n1"), "type1").join(n.toDF("type2", "n2"), "type2")
    ra, sa = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    return k.where((ra >= portion) & (sa >= portion_sa)).select("type1", "type2", "cluster", F.round(ra, 6).alias("ra"), F.round(sa, 6).alias("sa"), "sim")


@query(f"with {_MATCH} select type1, tab1, type2, \"cluster\" attr, attr attr2, tab2, sim from mt")
def p4d_relation_table(s, d):
    return matches(s, d).select("type1", "tab1", "type2", F.col("cluster").alias("attr"), F.col("attr").alias("attr2"), "tab2", "sim")


@query(f"""with {_MATCH}, z as (select typ, label \"cluster\", count(*) n from e where not subj group by 1, 2), h as (select type1, type2, \"cluster\", count(distinct attr) k from mt group by 1, 2, 3)
    select type1, type2, h.\"cluster\", round(k / n, 6) share from h join z on typ = type2 and z.\"cluster\" = h.\"cluster\" where k / n > 0.3""")
def p4e_cluster_share(s, d):
    """Attribute clusters more than a share of which any subject vector of the other type matches."""
    e = table(s, d, "embeddings").withColumn("tab", F.col("vec_id") % 50).withColumn("typ", F.col("tab") % 10)
    first = e.groupBy("tab").agg(F.min("vec_id").alias("vec_id"))
    sizes = e.join(first, ["tab", "vec_id"], "left_anti").groupBy(F.col("typ").alias("type2"), F.col("label").alias("cluster")).agg(F.count("*").alias("n"))
    hits = matches(s, d).groupBy("type1", "type2", "cluster").agg(F.countDistinct("attr").alias("k"))
    share = F.col("k") / F.col("n")
    return hits.join(sizes, ["type2", "cluster"]).where(share > 0.3).select("type1", "type2", "cluster", F.round(share, 6).alias("share"))


@query(f"""with e as (select vec_id, vec_id % 50 tab, embedding from embeddings), al as (select a.tab tab1, b.tab tab2, b.vec_id v, {_SIM} sim from e a join e b on a.tab < b.tab),
    r as (select tab1, tab2, max(sim) best, count(*) filter (sim > 0.4) k from al group by 1, 2) select tab1, tab2, greatest(k, 1) pairs, k > 0 aligned, best from r""")
def p4f_alignment(s, d):
    """Pairs of columns of two tables above a threshold; without one the best pair alone."""
    e = unit_vectors(s, d).select((F.col("vec_id") % 50).alias("tab"), "embedding")
    both = e.alias("a").join(e.alias("b"), F.col("a.tab") < F.col("b.tab"))
    sims = both.select(F.col("a.tab").alias("tab1"), F.col("b.tab").alias("tab2"), F.round(V.dot(F.col("a.embedding"), F.col("b.embedding")), 5).alias("sim"))
    r = sims.groupBy("tab1", "tab2").agg(F.max("sim").alias("best"), F.sum((F.col("sim") > 0.4).cast("long")).alias("k"))
    return r.select("tab1", "tab2", F.greatest("k", F.lit(1)).alias("pairs"), (F.col("k") > 0).alias("aligned"), "best")


@query(f"""with e as (select vec_id, vec_id % 50 tab, embedding from embeddings), al as (select a.tab tab1, b.tab tab2, b.vec_id v, max({_SIM}) sim from e a join e b on a.tab < b.tab group by 1, 2, 3)
    select tab1, tab2, round(avg((sim >= 0.2)::int), 6) ratio from al group by 1, 2 having avg((sim >= 0.2)::int) >= 0.4""")
def p4g_matcher_ratio(s, d):
    """Pairs of tables in which at least four tenths of the second one's columns match one of the first."""
    e = unit_vectors(s, d).select((F.col("vec_id") % 50).alias("tab"), "vec_id", "embedding")
    both = e.alias("a").join(e.alias("b"), F.col("a.tab") < F.col("b.tab"))
    best = both.groupBy(F.col("a.tab").alias("tab1"), F.col("b.tab").alias("tab2"), F.col("b.vec_id").alias("v")).agg(
        F.max(F.round(V.dot(F.col("a.embedding"), F.col("b.embedding")), 5)).alias("sim")
    )
    ratio = F.avg((F.col("sim") >= 0.2).cast("int"))
    return best.groupBy("tab1", "tab2").agg(ratio.alias("r")).where("r >= 0.4").select("tab1", "tab2", F.round("r", 6).alias("ratio"))


@query(f"""with c as (select col_id, nullif(lower(trim(ColumnLabel)), '') l, lower(trim(LowestClass)) k from column_gt),
    m as (select k, l, count(*) n from c where l is not null and l <> 'nan' and k is not null group by 1, 2), b as (select k, l from m qualify row_number() over (partition by k order by n desc, l) = 1)
    select col_id, case when c.l is not null and c.l <> 'nan' then c.l else b.l end attribute from c left join b using (k)""")
def p4h_conceptual_attribute(s, d):
    """The label of a column, else the majority label of the cluster it is in."""
    low = lambda c: F.lower(F.trim(c))
    c = table(s, d, "column_gt").select("col_id", F.when(~low("ColumnLabel").isin("", "nan"), low("ColumnLabel")).alias("l"), low("LowestClass").alias("k"))
    best = R.majority(c.where("l is not null and k is not null"), ["k"], "l").select("k", F.col("l").alias("m"))
    return c.join(best, "k", "left").select("col_id", F.coalesce("l", "m").alias("attribute"))


@query("select p_type \"name\", count(*) tables, min(p_partkey) first, max(p_partkey) last from part group by 1")
def e2e_mrg_equal_names(s, d):
    """Clusters that got one name are merged."""
    return table(s, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("tables"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


@query("select n_regionkey typ, greatest(count(distinct n_name) filter (n_nationkey % 2 = 0), 1) models from nation group by 1")
def e2e_cnt_models(s, d):
    """Types of a model: the nodes that are no tables, 1 where there is no tree."""
    inner = F.countDistinct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    return table(s, d, "nation").groupBy(F.col("n_regionkey").alias("typ")).agg(F.greatest(inner, F.lit(1)).alias("models"))


@query("with e as (select *, vec_id % 50 tab, row_number() over (partition by vec_id % 50 order by vec_id) = 1 subj from embeddings) select label, tab, vec_id from e where not subj")
def e2e_emb_of_clusters(s, d):
    """The vectors of a cluster's columns but subject columns."""
    e = table(s, d, "embeddings").withColumn("tab", F.col("vec_id") % 50)
    return e.join(e.groupBy("tab").agg(F.min("vec_id").alias("vec_id")), ["tab", "vec_id"], "left_anti").select("label", "tab", "vec_id")


@query(f"""with x as (select distinct lower(trim(t.class)) c, lower(trim(k.ColumnLabel)) a, k.fileName || '.' || k.colName src from (select distinct fileName, class from table_gt where not {NO_VALUE_SQL.format('class')}) t
        join column_gt k on t.fileName = k.fileName where not {NO_VALUE_SQL.format('k.ColumnLabel')})
    select c class, a attribute, count(src) sources from x group by 1, 2""")
def ar_list_attributes(s, d):
    """The attribute names of each class, in lower case, with the number of their source columns."""
    t = table(s, d, "table_gt").where(has_value("class")).select("fileName", F.lower(F.trim("class")).alias("class")).distinct()
    k = table(s, d, "column_gt").where(has_value("ColumnLabel")).select("fileName", F.lower(F.trim("ColumnLabel")).alias("attribute"), F.concat("fileName", F.lit("."), "colName").alias("src"))
    return t.join(k, "fileName").select("class", "attribute", "src").distinct().groupBy("class", "attribute").agg(F.count("src").alias("sources"))


@query(f"""select lower(r.label) \"group\", c.col_id from column_gt c join label_ref r on lower(trim(c.ColumnLabel)) = lower(r.label)""")
def ar_map_groups(s, d):
    """Inferred groups of names as clusters of columns, by the name in lower case."""
    groups = table(s, d, "label_ref").select(F.lower("label").alias("group"))
    c = table(s, d, "column_gt").select("col_id", F.lower(F.trim("ColumnLabel")).alias("group"))
    return c.join(groups, "group").select("group", "col_id")


@query("""with a as (select c_nationkey nation, c_mktsegment attr from customer group by 1, 2), k as (select n_regionkey region, attr, count(*) n from a join nation on nation = n_nationkey group by 1, 2),
    z as (select n_regionkey region, count(*) kids from nation group by 1) select k.region, attr, n from k join z using (region) where n >= greatest(1, floor(0.3 * kids))""")
def ar_mrg_bottom_up(s, d):
    """Attributes of a node from those of its children: names that at least 0.3 of them have."""
    a = table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("attr")).distinct()
    n = table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    kids = n.groupBy("region").agg(F.count("*").alias("kids"))
    k = a.join(n, "n_nationkey").groupBy("region", "attr").agg(F.count("*").alias("n")).join(kids, "region")
    return k.where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("kids") * 0.3))).select("region", "attr", "n")


@query("""with c as (select class, count(distinct fileName) n from table_gt where class is not null group by 1), p as (select class from c where n >= 5 order by md5('e|' || class), class limit 10)
    select class, fileName from table_gt join p using (class) where fileName is not null group by 1, 2""")
def ex_exp_files(s, d):
    """An experiment: ten classes with enough tables, by hash, and their files."""
    t = table(s, d, "table_gt").where("class is not null")
    big = t.groupBy("class").agg(F.countDistinct("fileName").alias("n")).where("n >= 5")
    picked = big.orderBy(R.hash_order(F.col("class"), "e"), "class").limit(10)
    return t.where("fileName is not null").join(picked, "class", "left_semi").select("class", "fileName").distinct()


@query("""with b as (select distinct n_regionkey t1, c_mktsegment from nation join customer on c_nationkey = n_nationkey)
    select 'class ' || r_name || ' {' || chr(10) || string_agg('  ' || c_mktsegment, chr(10) order by c_mktsegment) || chr(10) || '}' line from b join region on r_regionkey = t1 group by r_name
    union all select n_name || ' --|> ' || r_name from nation join region on n_regionkey = r_regionkey
    union all select distinct r_name || ' "1" --> "1..*" ' || n_name from nation join region on (n_regionkey + 1) % 5 = r_regionkey""")
def uml_text(s, d):
    """Classes with attributes, inheritance and relations as lines of a diagram."""
    r = table(s, d, "region")
    n = table(s, d, "nation")
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    sets = R.label_sets(c, "r_name", "c_mktsegment")
    body = F.array_join(F.transform("labels", lambda x: F.concat(F.lit("  "), x)), "\n")
    classes = sets.select(F.concat(F.lit("class "), "r_name", F.lit(" {\n"), body, F.lit("\n}")).alias("line"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(" --|> "), "r_name").alias("line"))
    relation = n.join(r, (F.col("n_regionkey") + 1) % 5 == F.col("r_regionkey")).select(F.concat("r_name", F.lit(' "1" --> "1..*" '), "n_name").alias("line"))
    return classes.unionByName(up).unionByName(relation)


# --- generators


@query("""with v as (select unnest([25, 50, 75, 100]) pct, unnest([3, 3, 3, 1]) seeds), g as (select pct, unnest(range(seeds)) seed from v),
    t as (select n_nationkey, n_name, n_regionkey from nation), k as (select pct, seed, n_nationkey, n_regionkey, row_number() over (partition by pct, seed order by md5('g' || seed || '|' || n_nationkey), n_nationkey) r, count(*) over (partition by pct, seed) n from g, t)
    select pct, seed, count(*) tables, count(distinct n_regionkey) types, count(*) + count(distinct n_regionkey) edges from k where r <= greatest(1, round(n * pct / 100.0)) group by 1, 2""")
def gen1_restricted_variants(s, d):
    """Samples of the tables by size and seed, with the schema restricted to what they use: types
    that have a table left, below the root, and their edges."""
    t = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    out = None
    for pct in (25, 50, 75, 100):
        for seed in range(1 if pct == 100 else 3):
            kept = R.sample_ratio(t.select("n_nationkey"), "n_nationkey", pct / 100, f"g{seed}").join(t, "n_nationkey")
            row = kept.groupBy(F.lit(pct).alias("pct"), F.lit(seed).cast("long").alias("seed")).agg(
                F.count("*").alias("tables"), F.countDistinct("n_regionkey").alias("types"), (F.count("*") + F.countDistinct("n_regionkey")).alias("edges")
            )
            out = row if out is None else out.unionByName(row)
    return out


@query("""with h as (select fileName f, colName c, row_number() over (partition by fileName order by md5('3|' || colName), colName) - 1 r, count(*) over (partition by fileName) n from (select distinct fileName, colName from column_gt where colName is not null)),
    w as (select f, c, case when r < greatest(1, least(n, ceil(n * 0.5))) then lower(translate(c, ' aeiouyAEIOUY', '')) else c end new from h),
    x as (select *, count(*) over (partition by f, new) k, new in (select o.c from h o where o.f is not distinct from w.f and o.c <> w.c) clash from w),
    y as (select f, c, case when new = '' or (new <> c and (k > 1 or clash)) then c else new end new_name from x)
    select g.col_id, y.new_name, y.new_name <> g.colName changed from column_gt g join y on g.fileName is not distinct from y.f and g.colName = y.c""")
def gen3_perturbed_ground_truth(s, d):
    """Half of each table's headers lose their vowels, chosen by hash; a header that would be empty
    or meet another one keeps its name; the columns' ground truth gets the new names."""
    from tessellum.functions import text as T

    heads = table(s, d, "column_gt").select(F.col("fileName").alias("f"), F.col("colName").alias("c")).where("c is not null").distinct()
    ranked = ordering.group_rank(heads.withColumn("h", R.hash_order(F.col("c"), "3")), "f", ["h", "c"], "r", "n")
    hit = F.col("r") < F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * 0.5)))
    new = cut(ranked.select("f", "c", F.when(hit, T.drop_vowels(F.col("c"))).otherwise(F.col("c")).alias("new")), "perturbed")
    # names that would be used twice in a table, or that another header has
    both = new.select("f", F.col("c").alias("name"), F.col("c").alias("by")).unionByName(new.select("f", F.col("new").alias("name"), F.col("c").alias("by")))
    taken = both.groupBy(F.col("f").alias("tf"), F.col("name").alias("tn")).agg(F.countDistinct("by").alias("users"))
    named = new.join(taken, F.col("f").eqNullSafe(F.col("tf")) & (F.col("new") == F.col("tn")))
    final = named.select("f", "c", F.when((F.col("new") == "") | ((F.col("new") != F.col("c")) & (F.col("users") > 1)), F.col("c")).otherwise(F.col("new")).alias("new_name"))
    g = table(s, d, "column_gt").select("col_id", "fileName", "colName")
    out = g.join(final, F.col("fileName").eqNullSafe(F.col("f")) & (F.col("colName") == F.col("c")))
    return out.select("col_id", "new_name", (F.col("new_name") != F.col("colName")).alias("changed"))


@query("with k as (select class, fileName, row_number() over (partition by class order by md5(concat('5|', fileName)), gt_id) r from table_gt where class is not null) select class, fileName from k where r <= 2")
def gen5_tables_per_leaf(s, d):
    t = table(s, d, "table_gt").where("class is not null").select("class", "fileName", "gt_id")
    h = F.md5(F.concat(F.lit("5|"), F.coalesce("fileName", F.lit(""))))
    return ordering.top_per_group(t.withColumn("h", h), ["class"], ["h", "gt_id"], 2).select("class", "fileName")


def leaf_metadata(s: SparkSession, d: str) -> DataFrame:
    """(leaf, branch, depth, support) of the leaves of a tree: nations with suppliers."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("support"))
    return n.join(sup, "n_nationkey").select(F.col("n_name").alias("leaf"), F.col("r_name").alias("branch"), F.lit(2).alias("depth"), "support")


def nested_leaves(leaves: DataFrame, shares: list[float]) -> DataFrame:
    """(share, leaf): nested sets of leaves of each share, taken in turns from all branches, the
    best supported first, so that each set keeps the branches balanced; at least one."""
    within = ordering.group_rank(leaves, "branch", [F.desc("support"), "leaf"], "turn")
    ranked = ordering.global_rank(within, ["turn", F.desc("support"), "leaf"], "place")
    total = leaves.agg(F.count("*").alias("total"))  # one row
    each = ranked.crossJoin(F.broadcast(total)).select("leaf", "place", "total", F.explode(F.array(*[F.lit(x) for x in shares])).alias("share"))
    return each.where(F.col("place") < F.greatest(F.lit(1), F.round(F.col("total") * F.col("share")))).select("share", "leaf")


@query("""with l as (select n_name leaf, r_name branch, count(*) support from nation join region on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey group by 1, 2),
    t as (select *, row_number() over (partition by branch order by support desc, leaf) turn from l), p as (select *, row_number() over (order by turn, support desc, leaf) - 1 place, count(*) over () n from t), s as (select unnest([0.25, 0.5, 0.75, 1.0]) share)
    select share::double share, leaf from p, s where place < greatest(1, round(n * share))""")
def gen4_nested_scenarios(s, d):
    return nested_leaves(cut(leaf_metadata(s, d), "leaves"), [0.25, 0.5, 0.75, 1.0])


@query("""with p as (select doc_id, 'Give the type of this table: ' || left(text, 10000) prompt from documents where text is not null)
    select count(*) prompts, sum(len(regexp_extract_all(prompt, '[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9 \\t\\n\\x0b\\f\\r]')) + 6) tokens from p""")
def gen6_token_cost(s, d):
    """Tokens of the prompts for all texts, which hold 10,000 characters of each."""
    prompt = F.concat(F.lit("Give the type of this table: "), F.substring("text", 1, 10_000))
    n = F.size(F.regexp_extract_all(prompt, F.lit(r"[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9 \t\n\x0b\f\r]"), F.lit(0))) + 6
    return table(s, d, "documents").where("text is not null").agg(F.count("*").alias("prompts"), F.sum(n).alias("tokens"))


def end_to_end(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Types of tables, their hierarchy, relationships, number of model types and diagram."""
    tree = D.hierarchies(members(s, d), delta=0.5)
    models = tree.select("grp", "parent").distinct().groupBy("grp").agg(F.count("*").alias("models"))
    kinds = members(s, d).select("grp").distinct().join(models, "grp", "left").select("grp", F.coalesce("models", F.lit(1)).alias("models"))
    return {"types": p_phase1_types(s, d), "hierarchy": tree, "relationships": p4c_attribute_relationships(s, d), "models": kinds, "diagram": uml_text(s, d)}


@query()
def e2e_driver(s, d):
    """The parts of the whole run, with the number of their rows."""
    out = None
    for name, part in end_to_end(s, d).items():
        row = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def cl1_dispatch(s, d):
    """Members of clusters by the name of the method."""
    e = table(s, d, "embeddings").where("label is not null")
    ward = clustering.ward_by_group(e.withColumn("tab", F.col("vec_id") % 25), "tab", "vec_id", "embedding", 2, 4).select(F.lit("ward").alias("method"), "vec_id", "cluster")
    return ward.unionByName(clustering.cluster(e, "vec_id", "embedding", "kmeans", range(4, 6)).select(F.lit("kmeans").alias("method"), "vec_id", "cluster"))
