"""Queries of the operators that ask a model, with the model ``rules``, which answers from the
prompt alone, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.models import encoders, prompts as P
from tessellum.operators import vectors as V
from tessellum.plans.base import Plans, unit_vectors
from tessellum.sources.scratch import cut
from tessellum.sources.tables import table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query

_CAP = "upper(left({0}, 1)) || lower(substr({0}, 2))"
_WORDS = "w as (select p_partkey, p_name, string_split(p_name, ' ') w from part)"


def _parts(s, d):
    return table(s, d, "part").select("p_partkey", "p_name", "p_brand")


@query(f"with {_WORDS} select p_partkey, 'Thing > ' || {_CAP.format('w[1]')} || case when len(w) > 1 then ' > ' || {_CAP.format('w[1]')} || ' ' || {_CAP.format('w[2]')} else '' end path from w")
def llm1_type_paths(s, d):
    got = P.type_paths(_parts(s, d), F.col("p_name"), "rules", "root")
    return got.select("p_partkey", F.array_join(F.get("paths", F.lit(0)), " > ").alias("path"))


@query(f"with {_WORDS} select p_partkey, lower(array_to_string(w[1:2], ' ')) fine from w")
def llm2_fine_types(s, d):
    return P.asked(_parts(s, d), "fine_type", "rules", "fine", table=F.col("p_name")).select("p_partkey", "fine")


@query(f"with {_WORDS} select p_partkey, 'Thing -> ' || {_CAP.format('w[1]')} || case when len(w) > 1 then ' -> ' || {_CAP.format('w[1]')} || ' ' || {_CAP.format('w[2]')} else '' end path from w")
def llm3_column_paths(s, d):
    return P.asked(_parts(s, d), "column_path", "rules", "path", table=F.col("p_brand"), column=F.col("p_name")).select("p_partkey", "path")


@query(f"with {_WORDS} select p_partkey, lower(array_to_string(w[1:2], ' ')) attribute from w")
def llm4_attribute_names(s, d):
    return P.asked(_parts(s, d), "attribute_name", "rules", "attribute", table=F.col("p_brand"), column=F.col("p_name")).select("p_partkey", "attribute")


_NAMES = "nm as (select n_name, r_name from nation join region on n_regionkey = r_regionkey)"


def _pairs(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("a"))
    return n.join(table(s, d, "nation").select(F.col("n_name").alias("b")), F.col("a") < F.col("b"))


@query("select a.n_name a, b.n_name b, case when lower(left(a.n_name, 3)) = lower(left(b.n_name, 3)) then 'yes' else 'no' end relation from nation a join nation b on a.n_name < b.n_name")
def llm5_relations(s, d):
    return P.asked(_pairs(s, d), "relation", "rules", "relation", a=F.col("a"), b=F.col("b"))


@query("with g as (select p_brand, string_agg(distinct p_type, ' ' order by p_type) names from part group by 1) select p_brand, lower(array_to_string(string_split(replace(replace(names, '_', ' '), '-', ' '), ' ')[1:2], ' ')) \"name\" from g")
def llm6_cluster_names(s, d):
    sets = table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("names"))
    return P.asked(sets, "cluster_name", "rules", "name", names=F.col("names")).select("p_brand", "name")


@query("select a.n_name a, b.n_name b, lower(left(a.n_name, 3)) = lower(left(b.n_name, 3)) ok from nation a join nation b on a.n_name < b.n_name")
def llm7_same_types(s, d):
    return P.judged(_pairs(s, d), "same_type", "rules")


@query(f"with {_NAMES} select r_name a, n_name b from nm where lower(left(r_name, 3)) <> lower(left(n_name, 3))")
def llm8_invalid_edges(s, d):
    """Edges that the model doesn't take for a parent and its child."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))
    return P.judged(n, "is_parent", "rules").where("not ok").select("a", "b")


@query("select p_partkey, 'Give the closest type of the entities of this table.' || chr(10) || 'Table: ' || p_name prompt_text from part")
def llm10_prompts(s, d):
    return _parts(s, d).select("p_partkey", P.render("fine_type", table=F.col("p_name")).alias("prompt_text"))


@query("""with a as (select distinct c_nationkey class, c_mktsegment attribute from customer) select class, attribute, case when class % 2 = 0 then 'given' else lower(attribute) end grp from a""")
def ar_fill_missing(s, d):
    """Groups of half of the classes are given, the model is asked for the others."""
    wanted = table(s, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_mktsegment").alias("attribute")).distinct()
    given = wanted.where("class % 2 = 0").withColumn("grp", F.lit("given"))
    ask = lambda missing: P.asked(missing, "cluster_name", "rules", "grp", names=F.col("attribute"))
    return P.fill_missing(wanted, given, ask)


@query()
def ml1_hashed_vectors(s, d):
    """A vector for each header."""
    h = table(s, d, "column_gt").where("colName is not null").select("col_id", F.split(F.lower("colName"), "_").alias("w"))
    return h.select("col_id", encoders.hashed_vector(F.col("w"), 16).alias("v"))


_LOSS = """v as (select label id, list(x order by i) a from (select label, i, round(avg(embedding[i + 1]::double), 9) x from embeddings, range(64) t(i) group by 1, 2) group by 1),
    z as (select id, list_transform(a, lambda x, i: case when i % 8 = 0 then x + 0.05 else x end) b from v), sm as (select v.id, z.id jd, list_cosine_similarity(a, b) / 0.1 s from v, z)"""


@query(f"with {_LOSS} select round(avg(l), 6) loss from (select id, ln(sum(exp(s))) - max(case when id = jd then s end) l from sm group by 1)")
def ml2_contrastive_loss(s, d):
    """The loss of a batch: the labels' mean vectors and a second view of each."""
    m = V.mean_vectors(table(s, d, "embeddings"), "label", "embedding")
    a = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.round("value", 9).alias("x")))), lambda z: z.x).alias("a"))
    views = cut(a.select(F.col("label").alias("id"), "a", F.transform("a", lambda x, i: F.when((i + 1) % 8 == 0, x + 0.05).otherwise(x)).alias("b")), "views")
    return encoders.contrastive_loss(views).select(F.round("loss", 6).alias("loss"))


@query("select doc_id, len(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) n from documents")
def ml4_token_counts(s, d):
    """Words that an encoder gets of each text."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    return table(s, d, "documents").select("doc_id", F.size(words).cast("long").alias("n"))


@query("select a.vec_id i, b.vec_id j from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label = b.label where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) >= 0.3")
def ml6_pair_matcher(s, d):
    """Pairs of one label that a threshold on the cosine matches."""
    e = unit_vectors(s, d).select("label", "vec_id", "embedding")
    a, b = e.toDF("label", "i", "x"), e.toDF("label", "j", "y")
    return a.join(b, "label").where("i < j").where(F.round(V.dot(F.col("x"), F.col("y")), 5) >= 0.3).select("i", "j")
