"""Column expressions over cell texts and headers. All but ``parse_list`` stay in the JVM;
patterns use ASCII classes so that other engines agree."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Cells that count as empty.
EMPTY_CELLS = ("-", "NA", "na", "nan", "n/a", "NULL", "null", "nil", "empty", " ", "")
PUNCT = r"[!-/:-@\[-`{-~]"


def is_empty(c: Column) -> Column:
    return c.isNull() | c.isin(*EMPTY_CELLS)


def plain_tokens(c: Column) -> Column:
    """Punctuation and digits gone, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, PUNCT + "|[0-9]", ""), r"\s+", " "))


def tokens_with_digits(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, PUNCT, ""), r"\s+", " "))


def unique_tokens(c: Column) -> Column:
    """Distinct lower-case tokens in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")))


def is_number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "%", "").try_cast("double").isNotNull(), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s]+"), F.lit(False))


def is_date(c: Column) -> Column:
    """ISO, slash and dotted dates, optionally with a time: the documented subset."""
    return F.coalesce(
        c.rlike(r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})([ T]\d{1,2}:\d{2}(:\d{2})?)?$"), F.lit(False)
    )


def is_acronym(c: Column) -> Column:
    """Three-valued: short words of three to five letters that fit no rule give null."""
    return (
        F.when((c != F.lower(c)) & (F.length(c) < 3), True)
        .when((F.length(c) < 6) & c.rlike(r"^[A-Z.]{2,}$"), True)
        .when((F.length(c) >= 3) & (F.length(c) < 6), F.lit(None).cast("boolean"))
        .otherwise(False)
    )


def is_id(c: Column) -> Column:
    """No number, but digits are left without letters and punctuation."""
    return ~is_number(c) & (F.length(F.regexp_replace(c, PUNCT + r"|[A-Za-z\s]", "")) > 0)


def drop_vowels(c: Column) -> Column:
    return F.lower(F.translate(c, " aeiouyAEIOUY", ""))


def stable_seed(c: Column) -> Column:
    """First eight hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def list_values(text: str | None) -> list[str | None]:
    """The elements of a list in Python's notation, any other text as one element, none of a
    blank text or ``nan``."""
    text = (text or "").strip()
    if text.lower() in ("", "nan"):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = ast.literal_eval(text)
    except Exception:  # no literal: a plain text
        return [text]
    if isinstance(found, list):
        return [v if v is None else str(v) for v in found]
    return [found if isinstance(found, str) else text]


@F.pandas_udf(ArrayType(StringType()))
def _parse_list(texts: pd.Series) -> pd.Series:
    return texts.map(list_values)


def parse_list(c: Column) -> Column:
    """``['A', 'B']`` as an array, a scalar as one element, blank as none. Quotes and escapes
    inside elements need a parser, so this runs in Arrow batches."""
    return _parse_list(c)


def initials(c: Column) -> Column:
    """First letters of the ``_`` words."""
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.left(x, F.lit(1))), "")


def value_type(c: Column) -> Column:
    """Boolean, Number, Date, Time, DateTime or Text."""
    return (
        F.when(F.lower(c).isin("true", "false", "yes", "no"), "Boolean")
        .when(is_number(c), "Number")
        .when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), "Date")
        .when(c.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), "Time")
        .when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"), "DateTime")
        .otherwise("Text")
    )


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


#: A short list of English stop words, the default where none is given.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "was", "were", "with",
)


def words_without(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of ``plain_tokens``, in order, but stop words."""
    return F.filter(F.split(F.lower(plain_tokens(c)), " "), lambda w: ~w.isin("", *stop))


def token_list(cells: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Each cell as its words but stop words, joined by spaces; cells without any are left out,
    and null stands for no cell at all."""
    texts = F.filter(F.transform(cells, lambda c: F.array_join(words_without(c, stop), " ")), lambda t: t != "")
    return F.when(F.size(texts) > 0, texts)


def split_any(c: Column) -> Column:
    """Split at commas, else at bars, else at spaces."""
    return F.when(c.contains(","), F.split(c, ",")).when(c.contains("|"), F.split(c, r"\|")).otherwise(F.split(c, " "))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two bags of words (arrays): twice the occurrences of shared words by
    all occurrences; it may exceed 1. Null for two empty bags."""
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x))) + F.size(F.filter(b, lambda x: F.array_contains(a, x)))
    return F.try_divide(2.0 * shared, F.size(a) + F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays as sets, 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def abbreviated(c: Column) -> Column:
    """A header with each part (at ``_`` and case changes) cut to between a quarter and a half
    of its letters, chosen by the part's hash."""

    def cut(part: Column) -> Column:
        n = F.length(part)
        low, high = F.ceil(n / 4), F.ceil(n / 2)
        return F.left(part, F.greatest(F.lit(1), low + stable_seed(part) % (high - low + 1)).cast("int"))

    return F.array_join(F.transform(F.split(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"), "_"), cut), "_")


def prefixed(c: Column, prefix: str = "table_") -> Column:
    """``prefix`` and the words run together, each with a capital."""
    return F.concat(F.lit(prefix), F.array_join(F.transform(F.split(c, " "), capitalized), ""))


def after_think(c: Column, mark: str = "</think>") -> Column:
    """The answer of a model: what follows the first ``mark``, up to a second one; all of a text without."""
    return F.coalesce(F.get(F.split(c, mark), F.lit(1)), c)


def restructured(c: Column) -> Column:
    """``file.csv.column`` as ``file.column``."""
    return F.replace(c, F.lit(".csv."), F.lit("."))


def before_dot(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def parses_as_day(c: Column) -> Column:
    """Whether a text is a day written year-month-day."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def flag(c: Column, strict: bool = False) -> Column:
    """``on``, ``true``, ``1`` or ``off``, ``false``, ``0``; others are null, or an error."""
    low = F.lower(c)
    other = F.raise_error(F.concat(F.lit("no flag: "), c)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(low.isin("on", "true", "1"), True).when(low.isin("off", "false", "0"), False).otherwise(other)


def places_of(values: Column, value: Column) -> Column:
    """Places, from 0, at which an array holds ``value``."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0))), lambda i: F.get(values, i) == value)


def is_plain_number(c: Column) -> Column:
    """A decimal number, with or without an exponent."""
    return F.coalesce(c.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def has_digit(c: Column) -> Column:
    return F.coalesce(c.rlike("[0-9]"), F.lit(False))


def shortened(c: Column, words: int = 3) -> Column:
    """The first words of a longer text, and dots."""
    parts = F.split(c, " ")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(c)


def repeats_compressed(c: Column) -> Column:
    """Initials of the ``_`` words; a letter that is repeated is followed by its number."""
    letters = F.split(initials(c), "")
    runs = F.aggregate(
        F.filter(letters, lambda x: x != ""),
        F.array().cast("array<struct<l:string,n:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["l"] == x),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x.alias("l"), (F.element_at(acc, -1)["n"] + 1).alias("n")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.alias("l"), F.lit(1).alias("n"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.concat(r["l"], F.when(r["n"] > 1, r["n"].cast("string")).otherwise(""))), "")


#: How paths are written, and what is no part of a name.
PATH_START = r"(Thing\s*(?:->|-->|→|=>)[^\n#]*)"
PATH_ARROW = r"\s*(?:-{1,2}>|=>|→)\s*"
PATH_JUNK = r"^[\s*`\"'.\-•\d)(\[\]]+|[\s*`\"'.;,)(\[\]]+$"


def paths_in(c: Column) -> Column:
    """The paths from ``Thing`` on that a text holds."""
    return F.regexp_extract_all(c, F.lit(PATH_START), F.lit(1))


def clean_paths(c: Column, most: int = 5) -> Column:
    """Array of paths (arrays of names) in a text: arrows in any writing, names without marks
    at their edges, at least two and at most ``most`` names, each path once whatever its case
    (the first writing stays)."""
    names = F.transform(
        paths_in(c), lambda p: F.filter(F.transform(F.split(p, PATH_ARROW), lambda n: F.regexp_replace(n, PATH_JUNK, "")), lambda n: n != "")
    )
    fit = F.filter(names, lambda p: (F.size(p) >= 2) & (F.size(p) <= most))
    keys = F.transform(fit, lambda p: F.lower(F.array_join(p, "\x1f")))
    return F.filter(fit, lambda p, i: F.array_position(keys, F.lower(F.array_join(p, "\x1f"))) == i + 1)
