"""Queries of the sources and sinks: tables are written as files of a corpus and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.plans.base import NO_VALUE_SQL, Plans
from tessellum.sources import corpus, sinks
from tessellum.sources.scratch import new_path
from tessellum.sources.tables import table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query


def _folder(s: SparkSession, d: str) -> str:
    """A corpus of CSV files, with differing headers, of three tables."""
    folder = new_path(s, "corpus")
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs
    for name in ("supplier", "nation", "region"):
        part = f"{folder}/parts/{name}"
        sinks.write_csv(table(s, d, name).coalesce(1), part)
        root = hadoop.Path(part)
        fs = root.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        source = fs.globStatus(hadoop.Path(f"{part}/part-*"))[0].getPath()
        fs.mkdirs(hadoop.Path(f"{folder}/csv"))
        fs.rename(source, hadoop.Path(f"{folder}/csv/{name}.csv"))
    return f"{folder}/csv"


_CELLS = """sup as (select *, row_number() over (order by s_suppkey) - 1 r from supplier), nat as (select *, row_number() over (order by n_nationkey) - 1 r from nation),
    reg as (select *, row_number() over (order by r_regionkey) - 1 r from region),
    cells as (select 'supplier' table_name, 0 col_idx, 's_suppkey' col_name, r row_idx, cast(s_suppkey as varchar) value from sup union all
    select 'supplier', 1, 's_name', r, s_name from sup union all select 'supplier', 2, 's_nationkey', r, cast(s_nationkey as varchar) from sup union all
    select 'nation', 0, 'n_nationkey', r, cast(n_nationkey as varchar) from nat union all select 'nation', 1, 'n_name', r, n_name from nat union all
    select 'nation', 2, 'n_regionkey', r, cast(n_regionkey as varchar) from nat union all
    select 'region', 0, 'r_regionkey', r, cast(r_regionkey as varchar) from reg union all select 'region', 1, 'r_name', r, r_name from reg)"""


def _cells(s: SparkSession, d: str) -> DataFrame:
    # the balances are left out of the comparison: engines write doubles differently
    return corpus.scan(s, _folder(s, d)).where("col_name <> 's_acctbal'")


@query(f"with {_CELLS} select * from cells")
def src1_corpus_scan(s, d):
    return _cells(s, d)


@query(f"with {_CELLS} select table_name || '.' || col_name as \"column\", row_idx, value from cells")
def src2_column_scan(s, d):
    return corpus.columns(_cells(s, d))


@query("select unnest(['nation', 'region', 'supplier']) table_name")
def src3_file_names(s, d):
    return corpus.table_names(s, _folder(s, d))


@query(f"""with {_CELLS}, t as (select table_name, row_idx, string_agg(coalesce(value, ''), ' | ' order by col_idx) line from cells where cast(row_idx as varchar) in ('0', '1', '2', '3', '4') group by 1, 2)
    select table_name, case table_name when 'nation' then 'Place' else 'Thing' end class, string_agg(line, chr(10) order by row_idx) "text" from t where table_name <> 'supplier' group by 1""")
def src4_labelled_sample(s, d):
    types = s.createDataFrame([("nation", "Place"), ("region", "Thing")], "table_name string, class string")
    return corpus.labelled_sample(_cells(s, d), types, 5)


@query(f"select fileName file_name, class, superclass is null or lower(trim(superclass)) in ('', 'nan') or regexp_matches(superclass, '^\\s*\\[\\s*\\]\\s*$') bare from table_gt where fileName is not null and class is not null and trim(class) <> ''")
def src5_table_types(s, d):
    path = new_path(s, "types") + "/gt.csv"
    sinks.write_csv(table(s, d, "table_gt").select("fileName", "class", "superclass").where("trim(class) <> ''"), path)
    return corpus.read_table_types(s, path).select("file_name", "class", (F.size("superclass") == 0).alias("bare"))


@query(f"select fileName file_name, trim(ColumnLabel) label from column_gt where not {NO_VALUE_SQL.format('ColumnLabel')}")
def src6_attributes_file(s, d):
    path = new_path(s, "attributes") + "/column_gt.csv"
    sinks.write_csv(table(s, d, "column_gt").select("fileName", "colName", "ColumnLabel"), path)
    return corpus.read_attributes(s, path, "UTF-8").select("file_name", "label")


@query("select r_name parent, n_name child from nation join region on n_regionkey = r_regionkey")
def src7_edges(s, d):
    path = new_path(s, "edges") + "/schema.csv"
    edges = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sinks.write_csv(edges.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")), path)
    return corpus.read_edges(s, path)


@query("select 'Nation' type1, n_name subject_attr, 'Region' type2, r_name attr from nation join region on n_regionkey = r_regionkey")
def src8_relationships(s, d):
    path = new_path(s, "relations")
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sinks.write_csv(rows.select(F.lit("Nation").alias("a"), F.col("n_name").alias("b"), F.lit("Region").alias("c"), F.col("r_name").alias("d")), path)
    return corpus.read_relationships(s, path)


@query("select p_partkey id, p_name \"type\" from part")
def src9_results(s, d):
    path = new_path(s, "results")
    sinks.append_jsonl(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("type")), path)
    return corpus.read_results(s, path, "id long, type string")


@query("select least(count(*), 10) n from part")
def src10_bounded_results(s, d):
    path = new_path(s, "results")
    sinks.append_jsonl(table(s, d, "part").select(F.col("p_partkey").alias("id")), path)
    return corpus.read_results(s, path, "id long", 10).agg(F.count("*").alias("n"))


@query("select cast(p_partkey as varchar) id, p_name \"name\", p_brand brand from part")
def src11_rrf(s, d):
    path = new_path(s, "rrf")
    line = F.concat(F.concat_ws("|", "p_partkey", "p_name", "p_brand"), F.lit("|"))
    table(s, d, "part").select(line.alias("value")).write.text(path)
    return corpus.read_rrf(s, path, ["id", "name", "brand"])


@query("select vec_id % 20 table_name, vec_id col_idx, round(embedding[1]::double, 6) first, len(embedding) dims from embeddings")
def src12_embeddings(s, d):
    path = new_path(s, "vectors")
    e = table(s, d, "embeddings").select((F.col("vec_id") % 20).alias("table_name"), F.col("vec_id").alias("col_idx"), "embedding")
    e.write.parquet(path)
    return corpus.read_embeddings(s, path).select("table_name", "col_idx", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").cast("long").alias("dims"))


@query("select o_orderpriority k, count(*) n from orders group by 1")
def snk1_csv(s, d):
    path = new_path(s, "metrics")
    sinks.write_csv(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n")), path)
    return s.read.csv(path, header=True, schema="k string, n long")


@query("select n_nationkey id from nation union all select r_regionkey + 100 from region")
def snk2_append(s, d):
    path = new_path(s, "appended")
    sinks.append_jsonl(table(s, d, "nation").select(F.col("n_nationkey").alias("id")), path)
    sinks.append_jsonl(table(s, d, "region").select((F.col("r_regionkey") + 100).alias("id")), path)
    return s.read.schema("id int").json(path)


@query("""with a as (select o_orderpriority k, count(*) n from orders where o_orderstatus = 'F' group by 1), b as (select o_orderpriority k, count(*) + 1000000 n from orders
        where o_orderstatus = 'O' and o_orderpriority < '3' group by 1 union all select 'new', 1)
    select coalesce(b.k, a.k) k, coalesce(b.n, a.n) n from a full join b on a.k = b.k""")
def snk3_upserted_table(s, d):
    path = new_path(s, "scores")
    o = table(s, d, "orders")
    first = o.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    second = o.where("o_orderstatus = 'O' and o_orderpriority < '3'").groupBy(F.col("o_orderpriority").alias("k")).agg((F.count("*") + 1_000_000).alias("n"))
    sinks.upsert(first, path, ["k"])
    return sinks.upsert(second.unionByName(s.createDataFrame([("new", 1)], "k string, n long")), path, ["k"])


@query("select label, count(*) n from embeddings group by 1")
def snk4_artifact(s, d):
    folder = new_path(s, "artifacts")
    make = lambda: table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return sinks.memoized(s, folder, {"of": "label"}, make)


@query(f"with {_CELLS} select table_name, count(*) n from cells where table_name <> 'supplier' group by 1")
def snk5_copy_tables(s, d):
    path = new_path(s, "copied")
    names = s.createDataFrame([("nation",), ("region",), ("nation",), ("absent",)], "table_name string")
    sinks.copy_tables(corpus.scan(s, _folder(s, d)), names, path)
    return s.read.parquet(path).groupBy("table_name").agg(F.count("*").alias("n"))


@query("select p_partkey id from part")
def snk6_merge_shards(s, d):
    folder = new_path(s, "shards")
    part = table(s, d, "part").select(F.col("p_partkey").alias("id"))
    for k in range(3):
        sinks.append_jsonl(part.where(F.col("id") % 3 == k), f"{folder}/shard{k}")
    return sinks.merge_shards(s, folder, "part-", "id long")


@query("select p_brand k, count(*) n from part group by 1")
def cache1_memoized(s, d):
    folder, calls = new_path(s, "memo"), []

    def make() -> DataFrame:
        calls.append(1)
        return table(s, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n"))

    sinks.memoized(s, folder, {"k": "brand"}, make)
    again = sinks.memoized(s, folder, {"k": "brand"}, make)
    assert len(calls) == 1
    return again


@query(f"""select distinct fileName from column_gt where fileName not in (select fileName from table_gt where class = 'Place' and fileName is not null)""")
def cache2_resume(s, d):
    """Files whose results are not there yet; those of one class were written before."""
    path = new_path(s, "done")
    done = table(s, d, "table_gt").where("class = 'Place' and fileName is not null").select("fileName")
    sinks.append_jsonl(done, path)
    return sinks.remaining(table(s, d, "column_gt").select("fileName").distinct(), corpus.read_results(s, path, "fileName string"), "fileName").where("fileName is not null")


@query(f"with {_CELLS} select table_name, count(*) n from cells group by 1")
def sc17_nested_corpus(s, d):
    """A corpus with folders inside."""
    folder = _folder(s, d).rsplit("/", 1)[0]
    cells = corpus.scan(s, folder, nested=True).where("col_name <> 's_acctbal'")
    return cells.where(~F.col("table_name").startswith("part-")).groupBy("table_name").agg(F.count("*").alias("n"))
