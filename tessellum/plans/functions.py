"""Queries of the scalar functions and the predicates of cells, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.plans.base import CELLS_SQL, PUNCT_SQL, SPACE_SQL, Plans, cells, number_sql, plain_sql
from tessellum.sources.tables import table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query


def headers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "column_gt").where("colName is not null").select("col_id", "fileName", F.col("colName").alias("h"), "ColumnLabel")


_STOP = "(" + ",".join(f"'{w}'" for w in ("", *T.STOP_WORDS)) + ")"
_H = "h as (select col_id, fileName, colName h, ColumnLabel from column_gt where colName is not null)"


def _words(c: str) -> str:
    return f"list_filter(string_split(lower({plain_sql(c)}), ' '), lambda w: w not in {_STOP})"


@query(f"select doc_id, array_to_string({_words('text')}, ' ') words from documents where text is not null")
def f_stop(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.words_without(F.col("text")), " ").alias("words"))


@query(f"select doc_id, trim(regexp_replace(regexp_replace(text, '{PUNCT_SQL}', '', 'g'), '{SPACE_SQL}+', ' ', 'g')) t from documents where text is not null")
def f_toknum(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.tokens_with_digits(F.col("text")).alias("t"))


@query(f"with {_H} select col_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(h), '{SPACE_SQL}+'), lambda x: x <> ''))) t from h")
def f_splittok(s, d):
    return headers(s, d).select("col_id", T.unique_tokens(F.col("h")).alias("t"))


@query("""select col_id, case when contains(vals, ',') then string_split(vals, ',') when contains(vals, '|') then string_split(vals, '|')
    else string_split(vals, ' ') end parts from column_gt where vals is not null""")
def f_delim(s, d):
    return table(s, d, "column_gt").where("vals is not null").select("col_id", T.split_any(F.col("vals")).alias("parts"))


@query(f"""select doc_id, w, count(*) n from (select doc_id, unnest({_words('text')}) w from documents where text is not null) group by 1, 2""")
def f_bow(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(T.words_without(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


_PAIR = f"""p as (select col_id, {_words('colName')} a, {_words('ColumnLabel')} b from column_gt where colName is not null and ColumnLabel is not null)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "column_gt").where("colName is not null and ColumnLabel is not null")
    return t.select("col_id", T.words_without(F.col("colName")).alias("a"), T.words_without(F.col("ColumnLabel")).alias("b"))


@query(f"""with {_PAIR}, ua as (select col_id, unnest(a) w from p), ub as (select col_id, unnest(b) w from p),
    ca as (select col_id, w, count(*) n from ua group by 1, 2), cb as (select col_id, w, count(*) n from ub group by 1, 2),
    sh as (select col_id, sum(ca.n + cb.n) x from ca join cb using (col_id, w) group by 1)
    select col_id, case when len(a) + len(b) > 0 then round(2.0 * coalesce(x, 0) / (len(a) + len(b)), 9) end dice from p left join sh using (col_id)""")
def f_dice(s, d):
    return _pairs(s, d).select("col_id", F.round(T.dice(F.col("a"), F.col("b")), 9).alias("dice"))


@query(f"""with {_PAIR}, u as (select distinct col_id, side, w from (select col_id, 1 side, unnest(a) w from p union all select col_id, 2, unnest(b) from p)),
    k as (select col_id, w, count(*) n from u group by 1, 2), j as (select col_id, count(*) filter (n = 2) / count(*) j from k group by 1)
    select col_id, round(coalesce(j, 0), 9) jaccard from p left join j using (col_id)""")
def f_jacc(s, d):
    return _pairs(s, d).select("col_id", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query(f"""with {_H}, p as (select col_id, i, string_split(regexp_replace(h, '([a-z])([A-Z])', '\\1_\\2', 'g'), '_')[i] w
        from (select col_id, h, unnest(range(1, len(string_split(regexp_replace(h, '([a-z])([A-Z])', '\\1_\\2', 'g'), '_')) + 1)) i from h)),
    n as (select *, ceil(length(w) / 4)::bigint lo, ceil(length(w) / 2)::bigint hi, cast('0x' || substr(md5(w), 1, 8) as bigint) seed from p)
    select col_id, string_agg(left(w, greatest(1, lo + seed % (hi - lo + 1))), '_' order by i) short from n group by 1""")
def f_abbr(s, d):
    return headers(s, d).select("col_id", T.abbreviated(F.col("h")).alias("short"))


@query("""select p_partkey, 'table_' || array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') name from part""")
def f_prefix(s, d):
    return table(s, d, "part").select("p_partkey", T.prefixed(F.col("p_name")).alias("name"))


@query("""select doc_id, case when contains(text, '</think>') then split_part(text, '</think>', 2) else text end answer
    from (select doc_id, case when source like 'wiki%' then '<think>' || source || '</think>' || text else text end text from documents)""")
def f_think(s, d):
    text = F.when(F.col("source").like("wiki%"), F.concat(F.lit("<think>"), "source", F.lit("</think>"), "text")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", T.after_think(text).alias("answer"))


@query(f"with {_H} select col_id, replace(fileName || '.' || h, '.csv.', '.') member, split_part(replace(fileName || '.' || h, '.csv.', '.'), '.', 1) tab from h")
def f_restruct(s, d):
    member = T.restructured(F.concat("fileName", F.lit("."), "h"))
    return headers(s, d).select("col_id", member.alias("member"), T.before_dot(member).alias("tab"))


@query(f"with {_H} select col_id, array_to_string(list_transform(string_split(h, '_'), lambda w: left(w, 1)), '') initials, (length(h) - length(replace(h, 'a', ''))) n_a from h")
def f_init_countin(s, d):
    h = F.col("h")
    return headers(s, d).select("col_id", T.initials(h).alias("initials"), T.occurrences(h, "a").cast("long").alias("n_a"))


@query("""with x as (select event_id, case when cast(json_extract_string(props, '$.k') as bigint) = 0 then 'infinity'::double
        else value / cast(json_extract_string(props, '$.k') as bigint) end x from events)
    select event_id, round(case when isinf(x) then (select max(x) from x where not isinf(x)) else x end, 9) x from x""")
def f_inf(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    x = F.when(k == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("value"), k)).alias("x")
    rows = table(s, d, "events").select("event_id", x)
    top = rows.where("x <> double('infinity')").agg(F.max("x").alias("top"))  # one row
    fixed = F.when(F.col("x") == float("inf"), F.col("top")).otherwise(F.col("x"))
    return rows.crossJoin(F.broadcast(top)).select("event_id", F.round(fixed, 9).alias("x"))


@query(f"""with {CELLS_SQL}, w as (select col_id, pos, array_to_string({_words('cell')}, ' ') t from cells),
    g as (select col_id, string_agg(t, ' | ' order by pos) filter (t <> '') tokens from w group by 1) select * from g""")
def f_toklist(s, d):
    t = table(s, d, "column_gt").where("vals is not null")
    return t.select("col_id", F.array_join(T.token_list(F.split("vals", ", ")), " | ").alias("tokens"))


@query(f"""with {CELLS_SQL} select col_id, pos, coalesce(regexp_matches(cell, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_strptime(cell, '%Y-%m-%d') is not null, false) is_day
    from cells""")
def f_strp(s, d):
    return cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), T.parses_as_day(F.col("cell")).alias("is_day"))


@query(f"""with {CELLS_SQL} select col_id, pos, case when lower(cell) in ('on','true','1') then true when lower(cell) in ('off','false','0') then false end flag from cells""")
def f_bool(s, d):
    return cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), T.flag(F.col("cell")).alias("flag"))


@query("""with c as (select source, n_chars v, count(*) n from documents where n_chars is not null group by 1, 2),
    m as (select source, v from c qualify row_number() over (partition by source order by n desc, v) = 1)
    select source, coalesce(cast(v as varchar), 'N/A') first_mode from (select distinct source from documents) left join m using (source)""")
def f_mode(s, d):
    counts = table(s, d, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    best = F.min_by("n_chars", F.when(F.col("n_chars").isNotNull(), F.struct(-F.col("n"), F.col("n_chars"))))
    return counts.groupBy("source").agg(F.coalesce(best.cast("string"), F.lit("N/A")).alias("first_mode"))


@query("""select example_id, list_filter(range(len(attrs_hier)), lambda i: attrs_hier[i + 1] = 'N/A') places from example where attrs_hier is not null""")
def f_index(s, d):
    places = T.places_of(F.col("attrs_hier"), F.lit("N/A"))
    return table(s, d, "example").where("attrs_hier is not null").select("example_id", F.transform(places, lambda i: i.cast("long")).alias("places"))


_URL = "coalesce(regexp_matches(cell, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/[:space:]]+'), false)"
_DATE = """coalesce(regexp_matches(cell, '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$'), false)"""


@query(f"with {CELLS_SQL} select col_id, pos, {_URL} is_url from cells")
def p_url(s, d):
    return cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), T.is_url(F.col("cell")).alias("is_url"))


@query(f"with {CELLS_SQL} select col_id, pos, {_DATE} is_date from cells")
def p_date(s, d):
    return cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), T.is_date(F.col("cell")).alias("is_date"))


@query(f"with {CELLS_SQL} select col_id, pos, coalesce(try_cast(replace(cell, '%', '') as double) is not null, false) is_number from cells where not regexp_matches(cell, '[dDfF_]|[^ -~]')")
def p_num(s, d):
    """Cells with the letters d or f, which number syntaxes differ in, are left to the tests."""
    plain = cells(s, d).where(~F.col("cell").rlike("[dDfF_]|[^ -~]"))
    return plain.select("col_id", F.col("pos").cast("long").alias("pos"), T.is_number(F.col("cell")).alias("is_number"))


@query(f"""with {CELLS_SQL} select col_id, pos, case when cell <> lower(cell) and length(cell) < 3 then true
    when length(cell) < 6 and regexp_matches(cell, '^[A-Z.]{{2,}}$') then true when length(cell) between 3 and 5 then null else false end is_acronym from cells""")
def p_acr(s, d):
    return cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), T.is_acronym(F.col("cell")).alias("is_acronym"))


@query(f"""with {CELLS_SQL} select col_id, pos, coalesce(try_cast(replace(cell, '%', '') as double) is null, true) and length(regexp_replace(cell, '[!-/:-@\\[-`{{-~A-Za-z \\t\\n\\x0b\\f\\r]', '', 'g')) > 0 is_id
    from cells where not regexp_matches(cell, '[dDfF_]|[^ -~]')""")
def p_id(s, d):
    """No number, but digits are left; the same cells as in ``p_num``."""
    plain = cells(s, d).where(~F.col("cell").rlike("[dDfF_]|[^ -~]"))
    return plain.select("col_id", F.col("pos").cast("long").alias("pos"), T.is_id(F.col("cell")).alias("is_id"))


@query(f"with {CELLS_SQL} select col_id, pos, coalesce(regexp_matches(cell, '[0-9]'), false) has_digit from cells")
def p_hasnum(s, d):
    return cells(s, d).select("col_id", F.col("pos").cast("long").alias("pos"), T.has_digit(F.col("cell")).alias("has_digit"))


@query(f"""with {CELLS_SQL} select col_id, coalesce(bool_and(regexp_matches(cell, '^[0-9]+$')) filter (cell <> ''), false) all_digits,
    coalesce(bool_and({number_sql('cell')}) filter (cell <> ''), false) numeric_column, avg(len(string_split(cell, ' '))) > 25 long_text, avg(len(string_split(cell, ' '))) < 20 entity
    from cells group by 1""")
def p_column_predicates(s, d):
    """All cells digits (P-ALLDIG), all cells numbers (P-NUMCOL), long text, and entity by length (P-LONG)."""
    c, words = F.col("cell"), F.avg(F.size(F.split("cell", " ")))
    full = c != ""
    return cells(s, d).groupBy("col_id").agg(
        F.coalesce(F.bool_and(F.when(full, c.rlike("^[0-9]+$"))), F.lit(False)).alias("all_digits"),
        F.coalesce(F.bool_and(F.when(full, T.is_plain_number(c))), F.lit(False)).alias("numeric_column"),
        (words > 25).alias("long_text"),
        (words < 20).alias("entity"),
    )


_TYPES = "['Boolean','Number','Date','Time','DateTime','Text']"


@query(f"""with {CELLS_SQL}, k as (select col_id, case when lower(cell) in ('true','false','yes','no') then 'Boolean' when {number_sql('cell')} then 'Number'
        when regexp_matches(cell, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') then 'Date' when regexp_matches(cell, '^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$') then 'Time'
        when regexp_matches(cell, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[ T][0-9]{{1,2}}:[0-9]{{2}}') then 'DateTime' else 'Text' end kind from cells),
    c as (select col_id, kind, count(*) n from k group by 1, 2)
    select col_id, kind from c qualify row_number() over (partition by col_id order by n desc, list_position({_TYPES}, kind)) = 1""")
def f_dtype(s, d):
    """Vote of the cells of a column; of equals the first in the order of types wins."""
    c = F.col("cell")
    kind = F.when(F.lower(c).isin("true", "false", "yes", "no"), 0).when(T.is_plain_number(c), 1)
    kind = kind.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), 2).when(c.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), 3)
    kind = kind.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}"), 4).otherwise(5)
    votes = cells(s, d).groupBy("col_id").agg(*[F.sum((kind == k).cast("int")).alias(f"v{k}") for k in range(6)])
    counts = F.array(*[f"v{k}" for k in range(6)])
    names = F.array(*[F.lit(t) for t in ("Boolean", "Number", "Date", "Time", "DateTime", "Text")])
    return votes.select("col_id", F.get(names, (F.array_position(counts, F.array_max(counts)) - 1).cast("int")).alias("kind"))


@query("select p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) name from part")
def prj7_label(s, d):
    return table(s, d, "part").select("p_partkey", T.capitalized(F.col("p_name")).alias("name"))


_PATHS_SQL = "(Thing *(?:->|-->|→|=>)[^\\n#]*)"


@query(f"select doc_id, regexp_extract_all(text, '{_PATHS_SQL}') paths from documents where text is not null and len(regexp_extract_all(text, '{_PATHS_SQL}')) > 0")
def f_paths(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", T.paths_in(F.col("text")).alias("paths"))
    return docs.where(F.size("paths") > 0)


@query(f"""with p as (select doc_id, i, regexp_extract_all(text, '{_PATHS_SQL}')[i] p from (select doc_id, text,
        unnest(range(1, len(regexp_extract_all(text, '{_PATHS_SQL}')) + 1)) i from documents where text is not null)),
    n as (select doc_id, i, list_filter(list_transform(regexp_split_to_array(p, '{SPACE_SQL}*(-{{1,2}}>|=>|→){SPACE_SQL}*'),
        lambda x: regexp_replace(x, '^[ \\t\\n\\x0b\\f\\r*`"''.\\-•0-9)(\\[\\]]+|[ \\t\\n\\x0b\\f\\r*`"''.;,)(\\[\\]]+$', '', 'g')), lambda x: x <> '') names from p),
    k as (select doc_id, i, names, row_number() over (partition by doc_id, lower(array_to_string(names, chr(31))) order by i) r from n where len(names) between 2 and 5)
    select doc_id, string_agg(array_to_string(names, ' -> '), chr(10) order by i) paths from k where r = 1 group by 1""")
def f_cleanp(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", T.clean_paths(F.col("text")).alias("p"))
    lines = F.array_join(F.transform("p", lambda p: F.array_join(p, " -> ")), "\n")
    return docs.where(F.size("p") > 0).select("doc_id", lines.alias("paths"))
