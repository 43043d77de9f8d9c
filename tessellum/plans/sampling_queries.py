"""Queries of samples, token rankings, augmentations and serializations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import ordering, relational as R, sampling as S
from tessellum.plans.base import CELLS_SQL, Plans, cells
from tessellum.sources.scratch import cut
from tessellum.sources.tables import table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query


def _u(key: str, seed: str) -> str:
    return f"((cast('0x' || substr(md5('{seed}|' || {key}), 1, 8) as bigint) + 1) / 4294967298.0::double)"


_VALUES = f"{CELLS_SQL}, v as (select col_id, cell, count(*) n, min(pos) first from cells where cell <> '' group by 1, 2)"


def values(s: SparkSession, d: str) -> DataFrame:
    """(col_id, cell, n, first): the different values of each column."""
    return cells(s, d).where("cell <> ''").groupBy("col_id", "cell").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("select c_nationkey class, c_custkey k from customer qualify count(*) over (partition by c_nationkey) <= 5 or row_number() over (partition by c_nationkey order by md5('s|' || c_custkey), c_custkey) <= 5")
def samp2_longer_lists(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("k"))
    return R.sample_per_group(c, "class", "k", 5, "s")


@query("select c_custkey k from customer order by md5('p|' || c_custkey), c_custkey limit (select cast(floor(count(*) * 0.3) as bigint) from customer)")
def samp3_floor_portion(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    h = R.hash_order(F.col("k"), "p")
    return ordering.lowest_share(c.withColumn("h", h), ["h", "k"], 0.3).select("k")


_DRAW = "round(-ln({u}) / {w}, 9)"


@query(f"with {_VALUES} select col_id, cell from v qualify row_number() over (partition by col_id order by {_DRAW.format(u=_u('''col_id || '|' || cell''', 'f'), w='n')}, cell) <= 3")
def samp4_by_frequency(s, d):
    return S.weighted(values(s, d), ["col_id"], "cell", "n", 3, "f").select("col_id", "cell")


_TFIDF = f"""{CELLS_SQL}, w as (select col_id, pos, unnest(regexp_extract_all(lower(cell), '[a-z0-9_]{{2,}}')) w from cells),
    tf as (select col_id, pos, w, count(*) tf from w group by 1, 2, 3), df as (select col_id, w, count(*) df from tf group by 1, 2),
    nn as (select col_id, count(*) n from cells group by 1), vv as (select col_id, count(*) v from df group by 1),
    x as (select col_id, pos, tf * (ln((1 + n) / (1 + df)) + 1) x, v from tf join df using (col_id, w) join nn using (col_id) join vv using (col_id)),
    tt as (select col_id, pos, round(sum(x) / sqrt(sum(x * x)) / any_value(v), 9) t from x group by 1, 2),
    tfidf as (select col_id, pos, cell, coalesce(t, 0) tfidf from cells left join tt using (col_id, pos))"""


def _tfidf(s: SparkSession, d: str) -> DataFrame:
    c = cut(cells(s, d), "cells")
    return c.join(S.cell_tfidf(c, "col_id", "pos", "cell"), ["col_id", "pos"]).select("col_id", F.col("pos").cast("long").alias("pos"), "cell", "tfidf")


@query(f"with {_TFIDF} select col_id, pos, round(tfidf, 7) tfidf from tfidf")
def t_tfidf_cells(s, d):
    return _tfidf(s, d).select("col_id", "pos", F.round("tfidf", 7).alias("tfidf"))


@query(f"""with {_TFIDF}, r as (select col_id, pos, round(tfidf, 7) w from tfidf),
    f as (select *, case when sum(w) over (partition by col_id) = 0 or count(*) filter (w > 0) over (partition by col_id) < 2 then 1.0 else w end fw from r)
    select col_id, pos from f qualify row_number() over (partition by col_id order by case when fw > 0 then {_DRAW.format(u=_u('''col_id || '|' || pos''', 'r'), w='fw')} else 'infinity'::double end, pos) <= 2""")
def samp6_roulette(s, d):
    """Two cells of each column by their TF-IDF (SAMP5), all alike where that says nothing (SAMP6)."""
    weights = _tfidf(s, d).select("col_id", "pos", F.round("tfidf", 7).alias("w"))
    return S.roulette(weights, "col_id", "pos", "w", 2, "r").select("col_id", "pos")


@query(f"""with {_TFIDF}, r as (select fileName f, pos, round(avg(round(t.tfidf, 7)), 7) w from tfidf t join (select col_id, fileName from column_gt) using (col_id) where fileName is not null group by 1, 2),
    fw as (select *, case when sum(w) over (partition by f) = 0 or count(*) filter (w > 0) over (partition by f) < 2 then 1.0 else w end fw from r)
    select f, pos from fw qualify row_number() over (partition by f order by case when fw > 0 then {_DRAW.format(u=_u('''f || '|' || pos''', 'w'), w='fw')} else 'infinity'::double end, pos) <= 2""")
def samp7_roulette_rows(s, d):
    """Two rows of each table by the mean TF-IDF of their cells."""
    files = table(s, d, "column_gt").where("fileName is not null").select("col_id", F.col("fileName").alias("f"))
    rows = _tfidf(s, d).join(files, "col_id").groupBy("f", "pos").agg(F.round(F.avg(F.round("tfidf", 7)), 7).alias("w"))
    return S.roulette(rows, "f", "pos", "w", 2, "w").select("f", "pos")


@query(f"""with {_VALUES}, k as (select *, count(*) over (partition by col_id) m from v)
    select col_id, cell from k qualify m <= 4 or row_number() over (partition by col_id order by n desc, first) <= 4""")
def samp8_value_sample(s, d):
    """All values of a column with few, else the most frequent, first seen first."""
    return ordering.top_per_group(values(s, d), ["col_id"], [F.desc("n"), "first"], 4).select("col_id", "cell")


@query(f"""with {CELLS_SQL}, t as (select distinct col_id, unnest(string_split(lower(cell), ' ')) token from cells)
    select col_id, token from t where token <> '' qualify row_number() over (partition by col_id order by md5('u|' || token), token) <= 3""")
def samp9_unique_tokens(s, d):
    toks = S.tokens(cells(s, d), ["col_id"], ["pos"], "cell").select("col_id", "token").distinct()
    return ordering.top_per_group(toks.withColumn("h", R.hash_order(F.col("token"), "u")), ["col_id"], ["h", "token"], 3).select("col_id", "token")


@query(f"""with {_VALUES}, r as (select col_id, cell, row_number() over (partition by col_id order by first) - 1 i, count(*) over (partition by col_id) m from v),
    p as (select col_id, m, unnest(range(7)) k from (select distinct col_id, m from r))
    select p.col_id, string_agg(cell, '|' order by k) context from p join r on r.col_id = p.col_id and r.i = p.k % p.m group by 1""")
def samp10_context(s, d):
    """The first values of each column, tiled or cut to seven."""
    head = ordering.top_per_group(values(s, d), ["col_id"], ["first"], 7)
    lists = head.groupBy("col_id").agg(F.array_sort(F.collect_list(F.struct("first", "cell"))).alias("l"))
    return lists.select("col_id", F.array_join(S.padded(F.col("l.cell"), 7), "|").alias("context"))


@query(f"""with {CELLS_SQL}, n as (select col_id, count(*) n from cells group by 1), p as (select col_id, n, unnest(range(1, least(10, n - 1) + 1)) pick from n where n > 1),
    a as (select col_id, pick, cast(floor({_u("col_id || '|' || pick", 'b')} * n) as bigint) pos from p)
    select col_id, pick, cell from a join cells using (col_id, pos)""")
def samp11_with_replacement(s, d):
    c = cells(s, d)
    sized = c.join(c.groupBy("col_id").agg(F.count("*").alias("n")), "col_id").select("col_id", F.col("pos").cast("long").alias("pos"), "cell", "n")
    return S.with_replacement(sized, "col_id", "pos", "n", "b").select("col_id", F.col("pick").cast("long").alias("pick"), "cell")


@query(f"""with n as (select count(*) n from embeddings), k as (select unnest(range(500)) id),
    p as (select cast(floor({_u('id', '7i')} * n) as bigint) i, cast(floor({_u('id', '7j')} * (n - 1)) as bigint) j from k, n)
    select i, case when j >= i then j + 1 else j end j from p""")
def samp13_random_pairs(s, d):
    return S.random_pairs(table(s, d, "embeddings").count(), 500, "7", s)


_TOKS = f"""{CELLS_SQL}, tk as (select col_id, pos, i pl, string_split(lower(cell), ' ')[i] token from (select col_id, pos, cell, unnest(range(1, len(string_split(lower(cell), ' ')) + 1)) i from cells)),
    seen as (select col_id, token, count(*) n, min(pos * 1000000 + pl) first from tk where token <> '' group by 1, 2)"""


def _seen(s: SparkSession, d: str) -> DataFrame:
    return S.first_seen(S.tokens(cells(s, d), ["col_id"], ["pos"], "cell"), "col_id", ["pos"])


@query(f"with {_TOKS}, h as (select *, row_number() over (partition by col_id order by first) - 1 place from seen) select col_id, token, place from h where place < 5")
def win5_distinct_head(s, d):
    return S.distinct_head(cut(_seen(s, d), "seen"), "col_id", 5)


@query(f"with {_TOKS}, h as (select * from seen qualify row_number() over (partition by col_id order by n desc, first) <= 4) select col_id, string_agg(token, ' ' order by first) \"text\" from h group by 1")
def t_freq(s, d):
    return S.frequent_tokens(_seen(s, d), "col_id", 4)


_FILE_TOKS = f"""{_TOKS}, ft as (select distinct fileName f, col_id, token from tk join (select col_id, fileName from column_gt) using (col_id) where token <> '' and fileName is not null),
    sz as (select f, col_id, round(log10(count(*)), 9) idf from ft group by 1, 2), idf as (select f, token, max_by(idf, col_id) idf from ft join sz using (f, col_id) group by 1, 2)"""


def _idf(s: SparkSession, d: str) -> DataFrame:
    toks = S.tokens(cells(s, d).where("fileName is not null"), ["fileName", "col_id"], ["pos"], "cell")
    return S.column_idf(toks, "fileName", "col_id").withColumnRenamed("fileName", "f")


@query(f"with {_FILE_TOKS} select f, token, idf from idf")
def t_idf(s, d):
    return _idf(s, d)


@query(f"""with {_FILE_TOKS}, o as (select fileName f, token, min(pos * 1000000 + pl) first from tk join (select col_id, fileName from column_gt) using (col_id) where token <> '' and fileName is not null group by 1, 2),
    h as (select f, token, idf, row_number() over (partition by f order by idf desc, first, token) r from idf join o using (f, token))
    select f, string_agg(token, ' ' order by r) \"text\" from h where r <= 6 group by 1""")
def t_toks(s, d):
    """The six tokens of each table with the largest idf, first seen first."""
    toks = S.tokens(cells(s, d).where("fileName is not null"), ["fileName"], ["pos"], "cell").withColumnRenamed("fileName", "f")
    seen = S.first_seen(toks, "f", ["pos"])
    top = ordering.top_per_group(seen.join(_idf(s, d), ["f", "token"]).withColumn("o", F.struct(-F.col("idf"), "first", "token")), ["f"], ["o"], 6)
    return S.as_text(top, "f", "o", "token")


@query(f"""with {_FILE_TOKS}, r as (select fileName f, pos, round(avg(idf), 6) score from tk join (select col_id, fileName from column_gt) using (col_id)
        join idf on idf.f = fileName and idf.token = tk.token where tk.token <> '' group by 1, 2)
    select f, pos, score from r qualify row_number() over (partition by f order by score desc, pos) <= 3""")
def t_rows(s, d):
    """The three rows of each table with the largest mean idf of their tokens."""
    toks = S.tokens(cells(s, d).where("fileName is not null"), ["fileName"], ["pos"], "cell").withColumnRenamed("fileName", "f")
    rows = toks.join(_idf(s, d), ["f", "token"]).groupBy("f", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("idf"), 6).alias("score"))
    return ordering.top_per_group(rows, ["f"], [F.desc("score"), "pos"], 3)


@query("""with p as (select lower(trim(ColumnLabel)) a, lower(trim(LowestClass)) b from column_gt where ColumnLabel is not null and LowestClass is not null),
    n as (select a, b, count(*) n from p group by 1, 2), na as (select a, count(*) na from p group by 1), nb as (select b, count(*) nb from p group by 1)
    select a, b, round(n / (na * nb), 12) ratio from n join na using (a) join nb using (b)""")
def t_pmi(s, d):
    t = table(s, d, "column_gt").where("ColumnLabel is not null and LowestClass is not null")
    return S.pair_ratios(t.select(F.lower(F.trim("ColumnLabel")).alias("a"), F.lower(F.trim("LowestClass")).alias("b")))


def prepare(seen: DataFrame, how: str, most: int, seed: str = "t") -> DataFrame:
    """(col_id, text): up to ``most`` tokens of each column in first-seen order (``head``), in
    the order of letters (``alphaHead``), picked by hash (``random``) or the most frequent."""
    orders = {"head": ["first"], "alphaHead": ["token"], "random": ["h", "token"], "frequent": [F.desc("n"), "first"]}
    if how not in orders:
        raise ValueError(f"no token selection {how}")
    keyed = seen.withColumn("h", R.hash_order(F.col("token"), seed))
    top = ordering.top_per_group(keyed, ["col_id"], orders[how], most)
    return S.as_text(top, "col_id", "token" if how == "alphaHead" else "first", "token")


@query(f"""with {_TOKS}, a as (select *, row_number() over (partition by col_id order by first) r1, row_number() over (partition by col_id order by token) r2,
        row_number() over (partition by col_id order by md5('t|' || token), token) r3 from seen)
    select 'head' how, col_id, string_agg(token, ' ' order by first) "text" from a where r1 <= 3 group by 2 union all
    select 'alphaHead', col_id, string_agg(token, ' ' order by token) from a where r2 <= 3 group by 2 union all
    select 'random', col_id, string_agg(token, ' ' order by first) from a where r3 <= 3 group by 2""")
def t_prep(s, d):
    seen = cut(_seen(s, d), "seen")
    parts = [prepare(seen, how, 3).select(F.lit(how).alias("how"), "col_id", "text") for how in ("head", "alphaHead", "random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with {CELLS_SQL}, r as (select col_id, pos, cell, row_number() over (partition by col_id order by md5('a|' || col_id || '|' || pos), pos) - 1 k, count(*) over (partition by col_id) n from cells)
    select col_id, pos, case when k < ceil(n * 0.3) then '' else cell end cell from r""")
def aug1_blank_cells(s, d):
    c = cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), "cell")
    return S.blanked(c, "col_id", "pos", "cell", 0.3, "a")


@query(f"""with {_TFIDF}, r as (select col_id, pos, cell, round(tfidf, 7) w from tfidf),
    f as (select *, case when sum(w) over (partition by col_id) = 0 or count(*) filter (w > 0) over (partition by col_id) < 1 then 1.0 else w end fw from r),
    p as (select col_id, pos from f qualify row_number() over (partition by col_id order by case when fw > 0 then {_DRAW.format(u=_u('''col_id || '|' || pos''', 'g'), w='fw')} else 'infinity'::double end, pos) <= 1)
    select col_id, pos, case when (col_id, pos) in (select (col_id, pos) from p) then '' else cell end cell from r""")
def aug2_blank_by_tfidf(s, d):
    """One cell of each column, drawn by its TF-IDF, is blank."""
    w = cut(_tfidf(s, d).select("col_id", "pos", "cell", F.round("tfidf", 7).alias("w")), "weights")
    hit = S.roulette(w, "col_id", "pos", "w", 1, "g").select("col_id", "pos", F.lit(True).alias("hit"))
    return w.join(hit, ["col_id", "pos"], "left").select("col_id", "pos", F.when(F.col("hit"), "").otherwise(F.col("cell")).alias("cell"))


@query("""with w as (select col_id, i, string_split(vals, ' ')[i] w from (select col_id, vals, unnest(range(1, len(string_split(vals, ' ')) + 1)) i from column_gt where vals is not null)),
    r as (select *, row_number() over (partition by col_id order by md5('h|' || col_id || '|' || i), i) r, count(*) over (partition by col_id) n from w)
    select col_id, string_agg(w, ' ' order by i) half from r where r <= greatest(1, n // 2) group by 1""")
def aug3_half_of_words(s, d):
    """Half of the words of each sample, in their order."""
    w = table(s, d, "column_gt").where("vals is not null").select("col_id", F.posexplode(F.split("vals", " ")).alias("p", "w")).withColumn("i", F.col("p") + 1)
    ranked = ordering.group_rank(w.withColumn("h", F.md5(F.concat_ws("|", F.lit("h"), "col_id", "i"))), "col_id", ["h", "i"], "r", "n")
    half = ranked.where(F.col("r") < F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    return S.as_text(half, "col_id", "i", "w").withColumnRenamed("text", "half")


@query(f"with {CELLS_SQL} select col_id, row_number() over (partition by col_id order by md5('x|' || pos), pos) - 1 new_pos, cell from cells")
def aug4_shuffled_rows(s, d):
    """Rows of a table in another order, the same for all its columns."""
    c = cells(s, d).withColumn("h", R.hash_order(F.col("pos"), "x"))
    return ordering.group_rank(c, "col_id", ["h", "pos"], "new_pos").select("col_id", "new_pos", "cell")


@query(f"""with {CELLS_SQL}, v as (select unnest([0.2, 0.5]) share), r as (select share, col_id, pos, row_number() over (partition by share, col_id order by md5('v' || cast(share as varchar) || '|' || col_id || '|' || pos), pos) - 1 k,
        count(*) over (partition by share, col_id) n from cells, v)
    select share::double share, col_id, count(*) filter (k < ceil(n * share)) blank, count(*) cells from r group by 1, 2""")
def aug5_views(s, d):
    """Two views of each column with more and more cells blank, and how many are."""
    return _views(cut(cells(s, d), "cells"))


def _views(c: DataFrame) -> DataFrame:
    parts = []
    for p in (0.2, 0.5):
        marked = S.blanked(c.select("col_id", "pos", F.lit("x").alias("mark")), "col_id", "pos", "mark", p, f"v{p}")
        parts.append(marked.groupBy(F.lit(p).alias("share"), "col_id").agg(F.sum((F.col("mark") == "").cast("long")).alias("blank"), F.count("*").alias("cells")))
    return parts[0].unionByName(parts[1])


_HEAD = f"{CELLS_SQL}, hd as (select col_id, pos, cell from cells where pos < 4)"


@query(f"""with {_HEAD}, t as (select col_id, string_agg(lower(cell), ' ' order by pos) t from hd group by 1) select col_id, '[CLS] ' || coalesce(c.colName, '') || ' [SEP] ' || t "text" from t join column_gt c using (col_id)""")
def ser1_column(s, d):
    """A column as its header and the first four cells, with markers."""
    head = cells(s, d).where("pos < 4").withColumn("v", F.lower("cell"))
    t = S.as_text(head, "col_id", "pos", "v")
    names = table(s, d, "column_gt").select("col_id", F.coalesce("colName", F.lit("")).alias("h"))
    return t.join(names, "col_id").select("col_id", F.concat(F.lit("[CLS] "), "h", F.lit(" [SEP] "), "text").alias("text"))


_FIRST = "fc as (select col_id, fileName f, row_number() over (partition by fileName order by col_id) - 1 idx from column_gt where fileName is not null)"


def _first_columns(s: SparkSession, d: str, n: int) -> DataFrame:
    t = table(s, d, "column_gt").where("fileName is not null").select(F.col("fileName").alias("f"), "col_id")
    head = ordering.top_per_group(t, ["f"], ["col_id"], n)
    return cut(ordering.group_rank(head, "f", ["col_id"], "idx"), "heads")


@query(f"""with {CELLS_SQL}, {_FIRST}, r as (select f, pos, string_agg(cell, ' | ' order by idx) line from cells join fc using (col_id) where idx < 5 and pos < 3 group by 1, 2)
    select f, string_agg(line, chr(10) order by pos) "text" from r group by 1""")
def ser2_rows(s, d):
    """The first three rows of the first five columns of each table, a line each."""
    c = cells(s, d).where("pos < 3").select("col_id", "pos", "cell").join(_first_columns(s, d, 5), "col_id")
    lines = c.groupBy("f", "pos").agg(F.array_sort(F.collect_list(F.struct("idx", "cell"))).alias("l")).select("f", "pos", F.array_join("l.cell", " | ").alias("line"))
    return S.as_text(lines, "f", "pos", "line", "\n")


@query(f"with {_FIRST} select f, string_agg(coalesce(colName, ''), '|' order by idx) header from fc join column_gt using (col_id) where idx < 10 group by 1")
def f_sertab(s, d):
    """The headers of the first ten columns of each table."""
    names = table(s, d, "column_gt").select("col_id", F.coalesce("colName", F.lit("")).alias("h"))
    return S.as_text(_first_columns(s, d, 10).join(names, "col_id"), "f", "idx", "h", "|").withColumnRenamed("text", "header")


@query(f"""with {_VALUES}, o as (select *, sum(length(cell) + 1) over (partition by col_id order by n desc, first rows unbounded preceding) used, row_number() over (partition by col_id order by n desc, first) r from v),
    st as (select col_id, count(*) m, max(length(cell)) hi, min(length(cell)) lo, round(avg(length(cell)), 3) mean from cells group by 1),
    t as (select col_id, string_agg(cell, ', ' order by r) vals from o where used <= 60 group by 1)
    select col_id, coalesce(c.colName, '') || ' contains ' || m || ' values (' || hi || ', ' || lo || '): ' || coalesce(t.vals, '') "text" from st join column_gt c using (col_id) left join t using (col_id)""")
def ser3_column_to_text(s, d):
    """Header, statistics and the most frequent values of a column, as long as they fit into 60 letters."""
    from pyspark.sql.window import Window as W

    stats = cells(s, d).groupBy("col_id").agg(F.count("*").alias("m"), F.max(F.length("cell")).alias("hi"), F.min(F.length("cell")).alias("lo"))
    # a value takes at least two letters, so the first thirty hold all that can fit
    top = ordering.top_per_group(values(s, d), ["col_id"], [F.desc("n"), "first"], 30)
    run = W.partitionBy("col_id").orderBy(F.desc("n"), "first")
    used = top.withColumn("used", F.sum(F.length("cell") + 1).over(run.rowsBetween(W.unboundedPreceding, 0))).withColumn("o", F.struct(-F.col("n"), "first"))
    vals = S.as_text(used.where("used <= 60"), "col_id", "o", "cell", ", ")
    names = table(s, d, "column_gt").select("col_id", F.coalesce("colName", F.lit("")).alias("h"))
    text = F.concat("h", F.lit(" contains "), "m", F.lit(" values ("), "hi", F.lit(", "), "lo", F.lit("): "), F.coalesce("text", F.lit("")))
    return stats.join(names, "col_id").join(vals, "col_id", "left").select("col_id", text.alias("text"))


@query(f"""with {_HEAD}, t as (select col_id, string_agg(' [VAL] ' || cell, '' order by pos) t from hd group by 1) select col_id, '[ATT] ' || coalesce(c.colName, '') || t "text" from t join column_gt c using (col_id)""")
def ser4_att_val(s, d):
    head = cells(s, d).where("pos < 4").withColumn("v", F.concat(F.lit(" [VAL] "), "cell"))
    names = table(s, d, "column_gt").select("col_id", F.coalesce("colName", F.lit("")).alias("h"))
    return S.as_text(head, "col_id", "pos", "v", "").join(names, "col_id").select("col_id", F.concat(F.lit("[ATT] "), "h", "text").alias("text"))


@query("""with t as (select example_id, attrs[1:least(len(attrs), 6)] a from example where attrs is not null)
    select example_id, array_to_string(list_concat(list_transform(a, lambda x: coalesce(x, '')), list_transform(range(6 - len(a)), lambda i: '[PAD]')), '|') "row" from t""")
def ser6_padding(s, d):
    """Attribute lists cut or padded to six."""
    a = F.transform(F.slice("attrs", 1, 6), lambda x: F.coalesce(x, F.lit("")))
    pad = F.array_repeat(F.lit("[PAD]"), F.greatest(6 - F.size(a), F.lit(0)))
    return table(s, d, "example").where("attrs is not null").select("example_id", F.array_join(F.concat(a, pad), "|").alias("row"))


@query(f"""with {CELLS_SQL}, c as (select col_id, count(*) n, count(distinct cell) m from cells group by 1)
    select col_id, coalesce(colName, '') || ': ' || n || ' cells, ' || m || ' different' meta from c join column_gt using (col_id)""")
def sc14_metadata(s, d):
    c = cells(s, d).groupBy("col_id").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("m"))
    names = table(s, d, "column_gt").select("col_id", F.coalesce("colName", F.lit("")).alias("h"))
    return c.join(names, "col_id").select("col_id", F.concat("h", F.lit(": "), "n", F.lit(" cells, "), "m", F.lit(" different")).alias("meta"))


@query(f"with {CELLS_SQL} select col_id from cells where pos = 0 and not coalesce(regexp_matches(cell, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'), false)")
def sc15_no_number_columns(s, d):
    """Columns whose first cell is no number."""
    return cells(s, d).where((F.col("pos") == 0) & ~T.is_plain_number(F.col("cell"))).select("col_id")


@query("""with w as (select class, unnest(string_split(lower(regexp_replace(fileName, '\\.csv$', '')), '_')) w from table_gt where class is not null and fileName is not null),
    c as (select class, w, count(*) n from w where length(w) > 2 group by 1, 2)
    select class, w, n from c qualify row_number() over (partition by class order by n desc, w) <= 5""")
def name1_frequent_words(s, d):
    """A name for each cluster of tables: the five most frequent words of their names."""
    t = table(s, d, "table_gt").where("class is not null and fileName is not null")
    w = t.select("class", F.explode(F.split(F.lower(F.regexp_replace("fileName", r"\.csv$", "")), "_")).alias("w")).where(F.length("w") > 2)
    return ordering.top_per_group(w.groupBy("class", "w").agg(F.count("*").alias("n")), ["class"], [F.desc("n"), "w"], 5)


@query(f"with {_TFIDF}, v as (select col_id, cell, round(max(tfidf), 7) w from tfidf where cell <> '' group by 1, 2) select col_id, cell from v qualify row_number() over (partition by col_id order by case when w > 0 then {_DRAW.format(u=_u('''col_id || '|' || cell''', 'i'), w='w')} else 'infinity'::double end, cell) <= 2")
def samp5_values_by_tfidf(s, d):
    v = _tfidf(s, d).where("cell <> ''").groupBy("col_id", "cell").agg(F.round(F.max("tfidf"), 7).alias("w"))
    return S.weighted(v, ["col_id"], "cell", "w", 2, "i").select("col_id", "cell")


@query("""select n_nationkey class, c_custkey k, 'Thing > ' || r_name || ' > ' || n_name path from (select * from customer qualify row_number() over (partition by c_nationkey order by md5('x|' || c_custkey), c_custkey) = 1)
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def samp12_examples_with_paths(s, d):
    """One table for each class, with the way from the root to the class."""
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("k"))
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("class"), F.concat(F.lit("Thing > "), "r_name", F.lit(" > "), "n_name").alias("path"))
    return R.sample_per_group(c, "class", "k", 1, "x").join(n, "class")


@query()
def ser5_subject_corpus(s, d):
    """Texts of the subject columns and of the others, apart."""
    from tessellum.operators import subject
    from tessellum.plans.reference import typed_columns

    subjects = subject.subject_columns(subject.scores(typed_columns(s, d))).select("col_id", F.lit("subject").alias("part"))
    return ser4_att_val(s, d).join(subjects, "col_id", "left").select("col_id", F.coalesce("part", F.lit("rest")).alias("part"), "text")
