"""Integrity audits as set queries (Q1-Q8, Q10, Q11): rows (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.operators.canonical import count_where, split_reconciliation
from tillbook.schemas import ALLOWED_VALUES, Library

FOREIGN_KEYS = [
    ("folder", "parent_id", "folder"),
    ("vendor", "default_category_id", "category"),
    ("category", "parent_id", "category"),
    ("item", "folder_id", "folder"),
    ("item", "split_group_id", "split_group"),
    ("receipt_data", "item_id", "item"),
    ("receipt_data", "vendor_id", "vendor"),
    ("receipt_data", "category_id", "category"),
    ("receipt_data", "tax_category_id", "tax_category"),
    ("receipt_data", "payment_type_id", "payment_type"),
    ("receipt_data", "project_id", "project"),
    ("receipt_tax_line", "item_id", "item"),
    ("receipt_tax_line", "tax_category_id", "tax_category"),
    ("document_data", "item_id", "item"),
    ("contact_data", "item_id", "item"),
    ("page", "item_id", "item"),
    ("split_group", "origin_item_id", "item"),
    ("split_group", "origin_page_id", "page"),
    ("merge_group", "result_item_id", "item"),
    ("merge_group_member", "merge_group_id", "merge_group"),
    ("merge_group_member", "page_id", "page"),
    ("custom_field_value", "item_id", "item"),
    ("custom_field_value", "def_id", "custom_field_def"),
    ("item_search_src", "id", "item"),
    ("item_source_file", "item_id", "item"),
]


def _rows(df: DataFrame, check: str, key: str, detail: Column | str) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _broken_rows(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One scan per table, whatever the number of its checks."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()])
    )
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("check")).select(
        "check", "key", F.lit("").alias("detail")
    )


def row_checks(lib: Library) -> DataFrame:
    """Q1: what the reference's CHECK constraints forbid."""
    c = F.col
    checks: dict[str, tuple[str, dict[str, Column]]] = {
        "item": (
            "id",
            {
                "split group and role go together": c("split_group_id").isNull() != c("split_role").isNull(),
                "origin is superseded": (c("split_role") == "origin") & c("superseded_at").isNull(),
            },
        ),
        "receipt_data": ("item_id", {"currency code": ~c("currency").rlike("^[A-Z]{3}$") | c("currency").isNull()}),
        "receipt_tax_line": ("id", {"rate not negative": c("rate_bp") < 0}),
        "page": ("id", {"confidence range": ~c("ocr_conf").between(0, 1)}),
    }
    for (table, column), allowed in ALLOWED_VALUES.items():
        bad = ~c(column).isin(*allowed)
        if (table, column) != ("item", "split_role"):
            bad = bad | c(column).isNull()
        checks.setdefault(table, ("id", {}))[1][f"{table}.{column} allowed"] = bad
    return _union([_broken_rows(lib[t], key, tests) for t, (key, tests) in checks.items()])


def split_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q2: illegal changes of the split flags between two item tables."""
    old = before.select("id", F.col("split_role").alias("r0"), F.col("split_group_id").alias("g0"))
    new = after.select("id", F.col("split_role").alias("r1"), F.col("split_group_id").alias("g1"), F.col("superseded_at").alias("s1"))
    kids = before.filter("split_role = 'child'").select(F.col("split_group_id").alias("g0"), F.lit(True).alias("_kids")).distinct()
    pair = old.filter("r0 IS NOT NULL").join(new, "id").join(kids, "g0", "left")
    left = ~F.col("g0").eqNullSafe(F.col("g1"))
    unwound = (F.col("r0") == "origin") & F.col("_kids").isNotNull() & (
        ~F.col("r1").eqNullSafe(F.lit("origin")) | F.col("s1").isNull() | left
    )
    promoted = (F.col("r0") == "child") & F.col("r1").eqNullSafe(F.lit("origin"))
    detached = (F.col("r0") == "child") & ~promoted & (F.col("r1").isNull() | F.col("g1").isNull() | left)
    return _broken_rows(
        pair, "id",
        {"origin unwound while children exist": unwound, "child became an origin": promoted, "child left its group": detached},
    )


def purge_violations(lib: Library, deletes: DataFrame) -> DataFrame:
    """Q3: origins to be deleted while a child of theirs survives.  ``deletes``: item_id."""
    gone = deletes.select(F.col("item_id").alias("id")).distinct()
    survivors = lib["item"].filter("split_role = 'child'").join(gone, "id", "left_anti").select("split_group_id").distinct()
    origins = lib["item"].filter("split_role = 'origin'").join(gone, "id", "left_semi")
    return _rows(origins.join(survivors, "split_group_id", "left_semi"), "purge guard", "id", "split children survive")


def cited_page_violations(lib: Library, deletes: DataFrame) -> DataFrame:
    """Q4: pages to be deleted that split children cite.  ``deletes``: page_id."""
    from tillbook.operators.edits import cited_pages

    return _rows(
        cited_pages(lib).join(deletes.select("page_id").distinct(), "page_id", "left_semi"),
        "cited page", "page_id", F.concat(F.lit("cited through item "), F.col("item_id").cast("string")))


def foreign_key_violations(lib: Library) -> DataFrame:
    parts = []
    for table, column, target in FOREIGN_KEYS:
        key = "id" if "id" in lib[table].columns else "item_id"
        refs = lib[table].select(F.col(key).alias("key"), F.col(column).alias("ref")).filter("ref IS NOT NULL")
        orphans = refs.join(lib[target].select(F.col("id").alias("ref")), "ref", "left_anti")
        parts.append(_rows(orphans, f"{table}.{column} -> {target}", "key", F.col("ref")))
    return _union(parts)


INTEGRITY_CHECKS = (
    "foreign keys", "split totals reconcile", "split tax reconciles", "split currencies consistent", "media paths are relative",
)


def integrity_report(lib: Library) -> DataFrame:
    """Q5: (name, ok, detail), one row per check."""

    def line(df: DataFrame, name: str, count: Column, clean: str, found: str) -> DataFrame:
        return df.agg(count.alias("n")).select(
            F.lit(name).alias("name"),
            (F.col("n") == 0).alias("ok"),
            F.when(F.col("n") == 0, clean).otherwise(F.concat(F.col("n").cast("string"), F.lit(found))).alias("detail"),
        )

    recon = split_reconciliation(lib).agg(
        count_where((F.col("child_count") > 0) & (F.col("drift_minor") != 0)).alias("drift"),
        count_where((F.col("child_count") > 0) & (F.col("tax_drift_minor") != 0)).alias("tax"),
        count_where(F.col("currency_mismatch_count") > 0).alias("mix"),
    )
    absolute = F.col("file_relpath").rlike(r"^/|^.:")
    return _union(
        [
            line(foreign_key_violations(lib), INTEGRITY_CHECKS[0], F.count("*"), "clean", " violation(s)"),
            line(recon, INTEGRITY_CHECKS[1], F.max("drift"), "no drift", " split group(s) drift"),
            line(recon, INTEGRITY_CHECKS[2], F.max("tax"), "no drift", " group(s) tax drift"),
            line(recon, INTEGRITY_CHECKS[3], F.max("mix"), "consistent", " group(s) mismatched"),
            line(lib["page"], INTEGRITY_CHECKS[4], count_where(absolute), "all relative", " absolute path(s)"),
        ]
    )


def merge_split_overlaps(lib: Library) -> DataFrame:
    """Q6: an item is the result of a combine or part of a split, never both."""
    results = lib["merge_group"].select(F.col("result_item_id").alias("id")).distinct()
    both = lib["item"].filter("split_group_id IS NOT NULL").join(results, "id", "left_semi")
    return _rows(both, "combined and split", "id", F.col("split_role"))


def items_in_trash_folder(lib: Library) -> DataFrame:
    """Q7: trash membership is an instant, never a folder."""
    trash = lib["folder"].filter("kind = 'trash'").select(F.col("id").alias("folder_id"))
    return _rows(lib["item"].join(trash, "folder_id", "left_semi"), "item in trash folder", "id", F.col("folder_id"))


def child_currency_violations(lib: Library) -> DataFrame:
    """Q8: a split child keeps its group's currency."""
    group = lib["split_group"].select(F.col("id").alias("split_group_id"), F.col("currency").alias("want"))
    child = lib["item"].filter("split_role = 'child'").select(F.col("id").alias("item_id"), "split_group_id")
    bad = child.join(group, "split_group_id").join(lib["receipt_data"].select("item_id", "currency"), "item_id").filter("currency <> want")
    return _rows(bad, "child currency", "item_id", F.concat_ws(" is not ", "currency", "want"))


def content_hash_check(files: DataFrame) -> DataFrame:
    """Q10: a stored file's name is the hash of its bytes.  ``files``: path, content (null = missing)."""
    stem = F.regexp_extract("path", r"([0-9a-f]{64})(?:\.[A-Za-z0-9]+)?$", 1)
    actual = F.sha2("content", 256)
    return files.select(
        "path",
        F.coalesce(stem == actual, F.lit(False)).alias("ok"),
        F.when(F.col("content").isNull(), "missing").when(stem != actual, "hash mismatch").alias("reason"),
    )


def system_folder_violations(lib: Library) -> DataFrame:
    """Q11: at most one inbox and one trash."""
    many = lib["folder"].filter("kind IN ('inbox','trash')").groupBy("kind").agg(F.count("*").alias("n")).filter("n > 1")
    return _rows(many, "one system folder per kind", "kind", F.col("n"))
