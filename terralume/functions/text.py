"""Reviewer texts, file names, reports and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of numbered answer lines, product file names and their dates, and of JSON slips.
NUMBERED = r"^\W*#?(\d+)\s*[:.)\-]\s*(.+)$"
PRODUCT = r"^(S2[ABC]_\w{5}_(\d{8})_\d+)_L2A_(\w+)\.tif$"
FILE_DATE = r"_(\d{8})_"
TRAILING_COMMA = r",\s*([}\]])"
BARE_KEY = r"([{,])\s*(\w+)\s*:"
AUDIT = "struct<regions:array<struct<id:string,real_change:string,category:string,reason:string>>>"


def dashed_date(d: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; other texts stay."""
    return F.when(d.rlike(r"^\d{8}$"), F.regexp_replace(d, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(d)


def file_date(name: Column) -> Column:
    return F.regexp_extract(name, FILE_DATE, 1)


def file_id(name: Column) -> Column:
    """What stands between the last underscore and the ending."""
    return F.regexp_replace(F.element_at(F.split(name, "_"), -1), r"\.[A-Za-z0-9]+$", "")


def is_confirmed(text: Column) -> Column:
    """CONFIRMED without REJECTED; "no significant change" does not hide it."""
    up = F.upper(text)
    return up.contains("CONFIRMED") & ~F.regexp_replace(up, "NO SIGNIFICANT CHANGE", "").contains("REJECTED")


def repaired_json(text: Column) -> Column:
    """The outermost braces of a text, without trailing commas and with all keys quoted."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(body, TRAILING_COMMA, "$1")
    return F.regexp_replace(body, BARE_KEY, '$1"$2":')


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "yes", "1"), F.lit(False))


def source_list(sources: Column) -> Column:
    """Sorted and joined by +, or none."""
    joined = F.array_join(F.array_sort(sources), "+")
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, joined).otherwise("none")


def cache_key(*parts: Column, kind: str = "sha1", length: int = 16) -> Column:
    text = F.concat_ws("_", *parts)
    return F.substring(F.sha1(text) if kind == "sha1" else F.md5(text), 1, length)
