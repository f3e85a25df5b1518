"""Domain checks as boolean columns (F21, F25) and JSON access that never fails."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIELD_RECORD = (
    "map<string,struct<value:string,confidence:double,"
    "bbox:struct<x:double,y:double,w:double,h:double>,pageId:bigint,pinned:boolean>>"
)


def is_relative_path(path: Column) -> Column:
    """library-relative, without drive letter or parent step."""
    return ~(path.startswith("/") | path.rlike(r"^[A-Za-z]:[\\/]") | path.contains(".."))


def is_inside(root: Column, path: Column) -> Column:
    """equal to the root or below it; a parent step is never inside."""
    base = F.regexp_replace(root, r"/+$", "")
    tail = F.regexp_replace(path, r"/+$", "")
    return ((tail == base) | tail.startswith(F.concat(base, F.lit("/")))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def is_currency(code: Column) -> Column:
    return code.rlike(r"^[A-Z]{3}$")


def is_civil_text(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def is_whole_minor(amount: Column) -> Column:
    return amount.isNotNull() & (amount.cast("decimal(38,6)") % 1 == 0)


def json_list(text: Column) -> Column:
    """JSON array of strings; anything else reads as empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_fields(text: Column) -> Column:
    """the extraction record; bad JSON reads as an empty map."""
    return F.coalesce(F.from_json(text, FIELD_RECORD), F.from_json(F.lit("{}"), FIELD_RECORD))
