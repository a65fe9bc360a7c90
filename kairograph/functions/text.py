"""Column expressions on text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text: Column | str) -> Column:
    """White space collapsed, empty brackets removed, ends stripped."""
    flat = F.regexp_replace(_c(text), r"(?U)\s+", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\[\s*\]", ""), r"\(\s*\)", "")
    return F.trim(flat)


def words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def all_text(*parts: Column | str) -> Column:
    """The non-empty parts, with a blank line between them."""
    return F.array_join(F.filter(F.array(*[F.coalesce(_c(p), F.lit("")) for p in parts]), lambda x: x != ""), "\n\n")


def parse_pub_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """A date from text parts; month and day default to 1 and are clamped, impossible dates are null."""
    part = lambda x, top: F.least(F.lit(top), F.greatest(F.lit(1), F.coalesce(F.expr("null").cast("int"), _c(x).try_cast("int"), F.lit(1))))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", _c(year).try_cast("int"), part(month, 12), part(day, 31)))


def citation_year(citation: Column | str) -> Column:
    """The first year from 1900 to 2099 in a citation, null where it has none."""
    return F.regexp_extract(_c(citation), r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")


def citation_journal(citation: Column | str) -> Column:
    """What stands before the year, without dots and spaces at its end."""
    return F.regexp_replace(F.regexp_extract(_c(citation), r"^(.*?)\b(?:19\d{2}|20\d{2})\b", 1), r"[. ]+$", "")


def fact_text(subject="subject_label", relation="relation_type", obj="object_label") -> Column:
    return F.concat_ws(" ", _c(subject), _c(relation), _c(obj))


def pmcid(value: Column | str, path: Column | str) -> Column:
    """An id with its prefix; without one, the id in the file's name."""
    given = F.trim(_c(value))
    own = F.when(given.rlike("(?i)^PMC"), F.upper(given)).when(F.length(given) > 0, F.concat(F.lit("PMC"), given))
    named = F.upper(F.regexp_extract(_c(path), r"(?i)PMC\d+", 0))
    return F.coalesce(own, F.nullif(named, F.lit("")))
