import re
import statistics
import string

from pyspark.ml.feature import StopWordsRemover

import __spark_entry__

EMPTY = ["-", "NA", "na", "nan", "n/a", "NULL", "null", "nil", "empty", " ", ""]
KINDS = ["long_text", "named_entity", "number", "date", "empty", "other"]
DROP = str.maketrans("", "", string.punctuation)
DIGITS = str.maketrans("", "", string.digits)


def number(s):
    try:
        float(s.replace("%", ""))
        return True
    except ValueError:
        return False


def date(s):
    return bool(re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", s))


def acronym(s):
    if s.islower() is False and len(s) < 3:
        return True
    if len(s) < 6:
        return True if re.sub(r"\b[A-Z\\.]{2,}\b", "", s).translate(DROP) == "" else None
    return False


def plain(s):
    return re.sub(r"\s+", " ", s.translate(DROP).strip().translate(DIGITS).strip())


def judge(cells, stop):
    """The reference's vote over the cells before min(100, n - 1)."""
    votes, texts = [0] * 6, []
    for e in cells[: max(0, min(100, len(cells) - 1))]:
        if e in EMPTY:
            votes[4] += 1
        elif " " not in e:
            if number(e) or "," in e and number(e.replace(",", "")):
                votes[2] += 1
            elif date(e):
                votes[3] += 1
            elif e.isalpha() and acronym(e):
                votes[5] += 1
            elif e.isalpha() and plain(e).lower() not in [*stop, "yes", "no"]:
                votes[1] += 1
            else:
                votes[5] += e.isalpha()
                tokens = [t for t in plain(e).lower().split(" ") if t not in stop]
                other = "://" in e or acronym(e.translate(DIGITS)) is True or not any(t.isalpha() and acronym(t) is False for t in tokens)
                votes[5 if other else 1] += 1
        else:
            words, kept = plain(e).split(" "), re.sub(r"\s+", " ", e.translate(DROP).strip())
            parts = kept.split(" ")
            if len(parts) == 2:
                votes[2] += number(parts[0])
                votes[3] += not number(parts[0]) and date(kept)
            elif len(words) < 3:
                votes[1 if any(acronym(w) is False for w in words) else 5] += 1
            else:
                texts.append(len(words))
    if texts:
        votes[0 if sum(texts) > 15 * len(texts) else 1] += len(texts)
    return KINDS[votes.index(max(votes))]


def score(emc, n, df):
    x = {"emc": emc, "uc": 1 if n else 0, "ac": 0, "df": df, "cm": 0, "ws": 0}
    mean = sum(x.values()) / 6
    std = (sum((v - mean) ** 2 for v in x.values()) / 6) ** 0.5
    z = {k: (v - mean) / std if std else 0 for k, v in x.items()}
    return (z["uc"] + 2 * (z["cm"] + z["ws"]) - z["emc"]) / (df + 1) ** 0.5


TABLES = {
    "a": ["1, 2, 3", "Paris, London, Madrid, -", "NA, Berlin, Vienna, Warsaw", "2020-01-02, 2020-01-03, 2020-01-04", "The Grand Old Town Hall; Museum of Modern Art; Old Bridge House Inn"],
    "b": ["US, UK, NATO, FR", "yes, the, no, because", "12 apples, 13 pears, 1 kiwi", "Old Town, New Town, Far Town", None],
    "c": [" ".join(["word"] * 22) + "; " + " ".join(["more"] * 22) + "; x", "http://a.org/x, http://a.org/y, z", "Bristol-7, Norwich-9, x1", "", "1.234|2.5%|x"],
    "d": ["Ясный; Зелёный; Старый", "Springfield", "NA|NA|Boston|Quincy"],
}


def test_subject_columns_follow_the_reference(spark, tmp_path):
    rows = [(i * 10 + k, f"{f}.csv", v) for i, (f, vs) in enumerate(TABLES.items()) for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "col_id long, fileName string, vals string").write.parquet(f"{tmp_path}/column_gt.parquet")
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    want = {k: {} for k in ("sc8_length_variance", "win8_distance_to_entity", "sc10_subject_score", "sc11_subject_columns", "sc12_score_weights", "sc13_first_entity", "prj3_leftmost_entities")}
    seen_kinds = set()
    for i, (f, vs) in enumerate(TABLES.items()):
        split = [[] if v is None else [c.strip() for c in v.split(next((x for x in ";|" if x in v), ","))] for v in vs]
        kinds = [judge(c, stop) for c in split]
        seen_kinds |= set(kinds)
        ne = [k for k, kind in enumerate(kinds) if kind == "named_entity"]
        df = [k - ne[0] if k in ne else 0 for k in range(len(vs))]
        emc = [sum(c in EMPTY for c in cs) / len(cs) if cs else 0 for cs in split]
        every = [score(emc[k], len(split[k]), df[k]) for k in range(len(vs))]
        best = [every[k] if k in ne else 0 for k in range(len(vs))]
        up = [max(x, 0) for x in every]
        entities = 0
        for k, cs in enumerate(split):
            key = (f"{f}.csv", i * 10 + k)
            counts = [0 if c in EMPTY else len([w for w in plain(c).lower().split(" ") if w not in stop]) for c in cs]
            tlc = (round(statistics.variance(counts), 6) if len(counts) > 1 else None) if k in ne else 0
            want["sc8_length_variance"][key] = (tlc, round(sum(len(c.split(" ")) for c in cs) / len(cs), 6) if cs else None)
            want["win8_distance_to_entity"][key] = (df[k],)
            want["sc10_subject_score"][key] = (round(best[k], 6),)
            want["sc12_score_weights"][key] = (round(up[k] / sum(up) if sum(up) else float(k == every.index(max(every))), 6),)
            if best[k] == max(best):
                want["sc11_subject_columns"][key] = ()
            if not ne or k == ne[0]:
                want["sc13_first_entity"][key] = ()
            if entities < 2:
                want["prj3_leftmost_entities"][key] = (k,)
            present = [c for c in cs if c not in ("", "NA")]
            entities += bool(present) and sum(len(c.split()) for c in present) / len(present) < 20
    assert seen_kinds >= {"long_text", "named_entity", "number", "date", "other"}
    for name, rows in want.items():
        got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
        assert {tuple(r)[:2]: tuple(r)[2:] for r in got} == rows, name
        assert len(got) == len(rows)
