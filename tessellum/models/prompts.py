"""Prompts for language models, and how their answers become rows.

A model is anything that answers a list of prompts with a list of texts; ``choose`` makes one
from a name, in the worker, so that only the name travels. There is no network here: the
model ``rules`` answers from the prompt's last line, which tests and examples need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import text as T

Model = Callable[[list[str]], list[str]]
_makers: dict[str, Callable[[], Model]] = {}

#: Modes of the type prompt: how far the answer is constrained.
MODES = {
    "free": "",
    "root": "Begin with Thing.",
    "depth": "Begin with Thing and give at most five names.",
    "known": "Use only these names where they fit: {known}.",
    "examples": "Answer as in these examples:\n{examples}",
}
TEMPLATES = {
    "type_path": "Give the path of types of this table, from the widest to the closest, joined by ->.\n{mode}\nTable: {table}",
    "fine_type": "Give the closest type of the entities of this table.\nTable: {table}",
    "column_path": "Give the path of types of this column, joined by ->.\nTable: {table}\nColumn: {column}",
    "attribute_name": "Give the name of the attribute that this column holds.\nTable: {table}\nColumn: {column}",
    "resolution": "Group these names so that each group means one attribute.\nClass: {label}\nNames: {names}",
    "cluster_name": "Give one name for these tables.\nTables: {names}",
    "same_type": "Do these two mean one type? Answer yes or no.\nTypes: {a} | {b}",
    "is_parent": "Is the first a parent of the second? Answer yes or no.\nTypes: {a} | {b}",
    "relation": "Name the relation of the first type to the second.\nTypes: {a} | {b}",
}


def register(name: str, maker: Callable[[], Model]) -> None:
    _makers[name] = maker


def choose(name: str) -> Model:
    if name not in _makers:
        raise ValueError(f"no model {name}; there are {', '.join(sorted(_makers))}")
    return _makers[name]()


def _rule(prompt: str) -> str:
    """The answer of the model ``rules``: made of the prompt's last line alone."""
    kind, _, rest = prompt.rstrip().rsplit("\n", 1)[-1].partition(": ")
    words = rest.replace(".csv", "").replace("_", " ").replace("-", " ").split()
    name = words[0].capitalize() if words else ""
    if kind in ("Table", "Column"):
        wanted = prompt.split("\n", 1)[0]
        if "joined by" in wanted:
            return f"<think>{len(words)} words</think>Thing -> {name} -> {' '.join(w.capitalize() for w in words[:2])}" if len(words) > 1 else f"Thing -> {name}"
        return " ".join(words[:2]).lower()
    if kind == "Types":
        a, _, b = rest.partition(" | ")
        return "yes" if a[:3].lower() == b[:3].lower() else "no"
    return " ".join(words[:2]).lower()


register("rules", lambda: lambda prompts: [_rule(p) for p in prompts])


def render(template: str, **columns: Column) -> Column:
    """A template with the text of columns in its places; null counts as nothing, blank lines go."""
    text = F.lit(TEMPLATES[template])
    for name, c in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(text, r"\n\s*\n", "\n")


def answer(df: DataFrame, prompt: str, model: str, retries: int = 3, batch: int = 64, out: str = "answer") -> DataFrame:
    """``df`` with the model's answer; blank answers are asked for again, then null. Prompts go
    to the model in batches, in the tasks where the rows are."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = choose(model)
        for pdf in batches:
            prompts = list(pdf[prompt])
            found: list[str | None] = [None] * len(prompts)
            for _ in range(retries):
                open_ones = [k for k, a in enumerate(found) if not a and prompts[k]]
                for at in range(0, len(open_ones), batch):
                    part = open_ones[at : at + batch]
                    for k, a in zip(part, ask([prompts[k] for k in part])):
                        found[k] = a.strip() if a and a.strip() else None
            yield pdf.assign(**{out: found})

    return df.mapInPandas(run, f"{fields}, `{out}` string")


def type_paths(df: DataFrame, table: Column, model: str, mode: str = "root", known: str = "", examples: str = "") -> DataFrame:
    """``df`` with ``paths``: the type paths of each table in the answer, cleaned; none without
    an answer."""
    said = MODES[mode].format(known=known, examples=examples)
    asked = answer(df.withColumn("__prompt", render("type_path", mode=F.lit(said), table=table)), "__prompt", model)
    return asked.withColumn("paths", T.clean_paths(T.after_think(F.coalesce("answer", F.lit(""))))).drop("__prompt", "answer")


def asked(df: DataFrame, template: str, model: str, out: str, **columns: Column) -> DataFrame:
    """``df`` with the answer to a template as ``out``."""
    done = answer(df.withColumn("__prompt", render(template, **columns)), "__prompt", model, out=out)
    return done.withColumn(out, T.after_think(F.col(out))).drop("__prompt")


def judged(pairs: DataFrame, template: str, model: str, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``ok``: whether the answer begins with yes."""
    said = asked(pairs, template, model, "__said", a=F.col(a), b=F.col(b))
    return said.withColumn("ok", F.coalesce(F.lower("__said").startswith("yes"), F.lit(False))).drop("__said")


def fill_missing(wanted: DataFrame, groups: DataFrame, ask: Callable[[DataFrame], DataFrame], stagnant: int = 3) -> DataFrame:
    """(class, attribute, grp): ``groups`` and what ``ask`` answers for the attributes (class,
    attribute) still without one, until none is missing or nothing new came ``stagnant`` times."""
    from tessellum.sources.scratch import cut

    found, idle = cut(groups.select("class", "attribute", "grp"), "groups"), 0
    while idle < stagnant:
        missing = wanted.select("class", "attribute").distinct().join(found, ["class", "attribute"], "left_anti")
        if not missing.take(1):
            break
        new = cut(ask(missing).select("class", "attribute", "grp").join(missing, ["class", "attribute"], "left_semi").where("grp is not null"), "filled")
        idle = 0 if new.take(1) else idle + 1
        found = found.unionByName(new)
    return found
