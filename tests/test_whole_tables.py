"""Registered queries read whole tables: rows beyond any id, key or letter that a filter might keep."""

from collections import Counter
from itertools import combinations

import __spark_entry__


def run(spark, path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
    return __spark_entry__.queries()[name](spark, str(path)).collect()


CUSTOMERS = [(k, (k * 7 + k // 5) % 25) for k in range(395, 435)]
KEYS = "c_custkey long, c_nationkey int"


def test_pair_scores_count_all_customers(spark, tmp_path):
    items = [(n % 4, n % 3) for _, n in CUSTOMERS]
    pairs = list(combinations(items, 2))
    agree = sum((a[0] == b[0]) == (a[1] == b[1]) for a, b in pairs)
    assert run(spark, tmp_path, "m_ri_overlap", customer=(CUSTOMERS, KEYS))[0].ri == round(agree / len(pairs), 6)
    wrong = Counter()
    for a, b in pairs:
        if (a[0] == b[0]) != (a[1] == b[1]):
            wrong["cluster" if a[0] == b[0] else "label", *min(a, b), *max(a, b)] += 1
    got = run(spark, tmp_path, "m_wrong_pairs")
    assert {tuple(r)[:5]: r.pairs for r in got} == wrong and len(got) == len(wrong)
    cells, hits, sizes = Counter(items), Counter(), Counter()
    for cl in {a for a, _ in items}:
        sizes[cl % 2] += sum(n for (a, _), n in cells.items() if a == cl)
        hits[cl % 2] += max(n for (a, _), n in cells.items() if a == cl)
    assert {r.layer: r.purity for r in run(spark, tmp_path, "m_layer_purity", nation=([(3,)], "n_nationkey int"))} == {k: round(hits[k] / sizes[k], 6) for k in sizes}


def test_prf_counts_all_customers(spark, tmp_path):
    rows = [(1, 3), (2, 4), (7, 90)]
    got = run(spark, tmp_path, "m_prf", customer=(rows, KEYS), nation=([(3,), (4,)], "n_nationkey int"), supplier=([(70,)], "s_nationkey int"))
    assert (got[0].p, got[0].rec, got[0].f1) == (round(2 / 3, 6), 1.0, 0.8)


def test_composite_lookup_keeps_the_hot_file(spark, tmp_path):
    hot = "merged_portal_export.csv"
    rows = [(1, hot, "a", "x"), (2, hot, "a", "y"), (3, hot, "a", None), (4, hot, "b", "x"), (5, "f", "a", "z"), (6, hot, None, "x")]
    got = run(spark, tmp_path, "jn2_composite_lookup", column_gt=(rows, "col_id long, fileName string, colName string, ColumnLabel string"))
    want = {(i, b[3]) for i, f, c, _ in rows for b in rows if c and b[1:3] == (f, c) and b[3]}
    assert sorted(map(tuple, got)) == sorted(want)


def test_listparse_parses_every_list(spark, tmp_path):
    want = {
        "['A', 'B']": ["A", "B"],
        "[\"Children's Venue\", 'Sports, Leisure']": ["Children's Venue", "Sports, Leisure"],
        "['Children\\'s Venue']": ["Children's Venue"],
        "['ORGANIZATION', ]": ["ORGANIZATION"],
        "['']": [""],
        "[]": [],
        "[1, None]": ["1", None],
        "['Event', 'Place'": ["['Event', 'Place'"],
        " Place ": ["Place"],
        "'Place'": ["Place"],
        "Trade, Import": ["Trade, Import"],
        "12": ["12"],
        " ": [],
        "nan": [],
        None: [],
    }
    rows = list(enumerate(want))
    got = run(spark, tmp_path, "f_listparse", table_gt=(rows, "gt_id long, superclass string"))
    assert {r.gt_id: r.labels for r in got} == {i: want[text] for i, text in rows}


def test_stand_ins_are_not_registered():
    names = set(__spark_entry__.queries()) | set(__spark_entry__.oracle_sql())
    assert not names & {"rpt2_recall_summary", "snk3_upsert", "gen1_size_variants", "p4c_relationships"}
