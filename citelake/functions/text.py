"""Text functions with the reference semantics of white space, slices and renderings."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import WHITE


def words(text: Column) -> Column:
    """The words between runs of white space."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def trim_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def text_slice(text: Column, start: Column | int, end: Column | int) -> Column:
    """Characters start to end, counted in code points from 0."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def list_items(text: Column) -> Column:
    """The lines of a list cell, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")


def blockquote(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * part / whole)


def band_text(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("–"), high.cast("string"))).when(low.isNotNull(), F.concat(F.lit("at least "), low.cast("string"))).otherwise("no target")


def normalise(value: str) -> str:
    """Compatibility characters and case folded, white space runs as one space."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


@cache
def _normalise_udf():
    @F.pandas_udf("string")
    def normalised(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else normalise(v))

    return normalised


def normalise_value(value: Column) -> Column:
    """normalise() over a column; the one function that no built-in expresses."""
    return _normalise_udf()(value)


def candidate_id(ref: Column, start: Column, end: Column, normalised: Column) -> Column:
    """A stable id from where a value stands and what it says; which method found it plays no part."""
    return F.concat(F.lit("cand-"), F.substr(F.sha2(F.concat_ws("|", ref, start.cast("string"), end.cast("string"), normalised), 256), F.lit(1), F.lit(16)))


def cell(text: Column, kind: str, allowed: tuple = ()) -> tuple[Column, Column]:
    """A sheet cell's value as text, and whether the cell does not fit its kind.

    Lists are handled by list_items(); a blank cell is null and always fits.
    """
    value = trim_to_null(text)
    if kind == "boolean":
        low = F.lower(value)
        out = F.when(low.isin("true", "yes", "y", "1"), "true").when(low.isin("false", "no", "n", "0"), "false")
    elif kind == "number":
        out = _whole(value)
    elif allowed:
        out = F.when(value.isin(*[str(a) for a in allowed]), value)
    else:
        out = value
    return out, value.isNotNull() & out.isNull()


def _whole(value: Column) -> Column:
    """The number's whole part, towards zero; null if it is no finite number."""
    number = F.when(value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    return F.when(F.abs(number) < 9e18, number.cast("bigint").cast("string"))
