"""Tolerant casts, line splitting and text cleaning as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def to_float(text: Column, default: float | None = None) -> Column:
    """A number however written, else the default."""
    value = strip(text.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(default).cast("double"))


def to_int(text: Column, default: int | None = None) -> Column:
    """A number truncated toward zero, else the default."""
    value = strip(text.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value).try_cast("long"), F.lit(default).cast("long"))


def to_bool(text: Column) -> Column:
    """1, true, yes, y, t in any case are true; anything else is false."""
    return F.coalesce(F.lower(strip(text.cast("string"))).isin("1", "true", "yes", "y", "t", "1.0"), F.lit(False))


def split_line(line: Column) -> Column:
    """Fields by the first separator that fits: ``::``, tab, comma (not for a line that opens with a bracket), white space."""
    line = strip(line)
    return (
        F.when(F.contains(line, F.lit("::")), F.split(line, "::"))
        .when(F.contains(line, F.lit("\t")), F.split(line, "\t"))
        .when(F.contains(line, F.lit(",")) & ~F.startswith(line, F.lit("(")), F.split(line, ","))
        .otherwise(F.split(line, r"\s+"))
    )


def first_of(*values: Column) -> Column:
    """The first of some aliases that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(v.cast("string")) != "", v.cast("string")) for v in values], F.lit(None).cast("string"))


def clean_text(text: Column, most: int) -> Column:
    """White space collapsed; over ``most`` characters cut at the last space and ended by dots."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), " [^ ]*$", ""), F.lit("...")))


def clean_document(text: Column) -> Column:
    """Line ends unified, ideographic spaces and tabs to blanks, four or more line ends to three."""
    unified = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "[　\t ]+", " ")
    return strip(F.regexp_replace(unified, r"\n{4,}", "\n\n\n"))


def distinct_list(text: Column, most: int) -> Column:
    """Entries between ``|,;/`` in order, once in any case, at most ``most``, joined by ", "; else "Not specified"."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|,;/]"), strip), lambda x: x != "")
    keys = F.transform(parts, F.lower)
    once = F.filter(parts, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    joined = F.array_join(F.slice(once, 1, most), ", ")
    return F.when(joined != "", joined).otherwise(F.lit("Not specified"))


#: Genre spellings brought together, and values that are no genre.
GENRE_SYNONYMS = {"children's": "children", "sci-fi": "sci fi"}
NO_GENRE = ("", "unknown", "none", "nan", "n/a", "(no genres listed)", "not specified")


def genre_set(text: Column) -> Column:
    """Sorted distinct lower-case genres."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[|,;/]"), strip)
    def common(x: Column) -> Column:
        out = x
        for spelling, name in GENRE_SYNONYMS.items():
            out = F.when(x == spelling, F.lit(name)).otherwise(out)
        return out

    parts = F.transform(parts, common)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~x.isin(*NO_GENRE))))


#: Rating texts by leading mark, their bucket and code.
BUCKETS = (("Rx", "RX", 5), ("R+", "RPLUS", 4), ("R - 17+", "R17", 3), ("PG-13", "PG13", 2), ("PG", "PG", 1), ("G", "G", 0))


def rating_bucket(text: Column) -> Column:
    text = strip(F.coalesce(text, F.lit("")))
    out = F.lit("UNKNOWN")
    for mark, name, _ in reversed(BUCKETS):
        out = F.when(F.startswith(text, F.lit(mark)), name).otherwise(out)
    return out


def bucket_code(bucket: Column) -> Column:
    out = F.lit(-1)
    for _, name, code in BUCKETS:
        out = F.when(bucket == name, code).otherwise(out)
    return out


def milliseconds(seconds: Column, fallback: Column) -> Column:
    """Seconds below 1e12 become milliseconds; missing or non-positive ones take the fallback."""
    return F.when(seconds.isNull() | (seconds <= 0), fallback).when(seconds < 10**12, seconds * 1000).otherwise(seconds)


def sort_key(text: Column) -> Column:
    """The first six digit groups, zero-padded to a sortable text of 14 digits."""
    groups = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), 1, 6)
    padded = F.array_join(F.transform(groups, lambda g, i: F.lpad(g, F.when(i == 0, 4).otherwise(2), "0")), "")
    return F.rpad(padded, 14, "0")


def age_at(birth: Column, at: Column) -> Column:
    """Whole years between two dates; null outside 0 to 100."""
    earlier = (F.month(at) < F.month(birth)) | ((F.month(at) == F.month(birth)) & (F.day(at) < F.day(birth)))
    years = F.year(at) - F.year(birth) - F.when(earlier, 1).otherwise(0)
    return F.when(years.between(0, 100), years)


def title_id(text: Column) -> Column:
    """``tt`` and at least seven digits."""
    digits = F.regexp_replace(strip(text), "^tt", "")
    return F.when(digits != "", F.concat(F.lit("tt"), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)))


#: Age codes and what they say.
AGE_CODES = {1: "Under 18", 18: "18-24", 25: "25-34", 35: "35-44", 45: "45-49", 50: "50-55", 56: "56+"}


def age_text(code: Column) -> Column:
    out = F.lit("unknown")
    for value, text in AGE_CODES.items():
        out = F.when(code == value, text).otherwise(out)
    return out


def is_minor(flag: Column, described: Column, age: Column) -> Column:
    """By the stated flag, else the description, else the age."""
    told = F.when(strip(described) != "", F.contains(F.lower(described), F.lit("under 18")))
    return F.coalesce(flag, told, age < 18, F.lit(False))


#: Other spellings of the rating buckets, exact and by beginning or part.
BUCKET_WORDS = {"G": ("g", "g - all ages", "0"), "PG": ("pg", "pg - children", "1"), "PG13": ("pg13", "2"), "R17": ("r17", "3"), "RPLUS": ("rplus", "r_plus", "4"), "RX": ("rx", "5")}
BUCKET_STARTS = {"R17": "r - 17", "RPLUS": "r+", "RX": "rx"}


def loose_bucket(text: Column) -> Column:
    """A bucket from any known spelling or code; another text in upper case; UNKNOWN for none."""
    bare = strip(F.coalesce(text.cast("string"), F.lit("")))
    low = F.lower(bare)
    out = F.when(bare == "", "UNKNOWN").otherwise(F.upper(bare))
    for name in reversed(BUCKET_WORDS):
        fits = low.isin(*BUCKET_WORDS[name])
        if name in BUCKET_STARTS:
            fits = fits | F.startswith(low, F.lit(BUCKET_STARTS[name]))
        if name == "PG13":
            fits = fits | F.contains(low, F.lit("pg-13"))
        out = F.when(fits, name).otherwise(out)
    return out


def gender_word(text: Column) -> Column:
    mark = F.upper(strip(F.coalesce(text.cast("string"), F.lit(""))))
    return F.when(mark.isin("F", "FEMALE", "WOMAN"), "female").when(mark.isin("M", "MALE", "MAN"), "male").otherwise("unknown-gender")


def cutoffs(text: Column) -> Column:
    """Sorted distinct positive whole numbers of a comma-separated list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: to_int(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x > 0)))


def first_numbers(values: Column) -> Column:
    """The whole numbers of a list of texts, each where it first stands."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: to_int(x)), lambda x: x.isNotNull()))


def after(text: Column, marker: str) -> Column:
    """What follows the first marker, trimmed; the whole text where there is none."""
    at = F.instr(text, F.lit(marker))
    return strip(F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text))


def last_json_line(text: Column) -> Column:
    """The last line that is a JSON object."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.startswith(x, F.lit("{")) & F.get_json_object(x, "$").isNotNull())
    return F.get(lines, F.size(lines) - 1)


def item_text(title: Column, genres: Column, overview: Column, most: int = 1200) -> Column:
    """One cleaned line of title, genres and overview, each with its default."""
    known = lambda x, default: F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(default))
    line = F.concat(F.lit("Title: "), known(title, "Unknown"), F.lit(". Genres: "), known(genres, "Not specified"), F.lit(". Overview: "), known(overview, "Not available"))
    return clean_text(line, most)


def rounded(x: Column, kind: T.DataType, digits: int) -> Column:
    """Every double inside a nested value rounded; all else as it is."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.round(x.cast("double"), digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: rounded(v, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: rounded(v, kind.valueType, digits))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[rounded(x[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    return x
