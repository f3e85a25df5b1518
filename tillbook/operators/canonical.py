"""The canonical views V1-V8: the only sanctioned way to sum or list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.schemas import Library, shaped


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def summable_receipts(lib: Library) -> DataFrame:
    """V1: live, not superseded receipts."""
    live = lib["item"].filter("trashed_at IS NULL AND superseded_at IS NULL AND type = 'receipt'").select(
        F.col("id").alias("item_id"), "folder_id", "split_group_id", "reviewed_at", "created_at"
    )
    return lib["receipt_data"].join(live, "item_id").select(
        "item_id",
        "folder_id",
        "txn_date",
        "vendor_id",
        "total_minor",
        "currency",
        "tax_total_minor",
        "category_id",
        "tax_category_id",
        "project_id",
        "split_group_id",
        "reviewed_at",
        "created_at",
    )


def page_links(lib: Library) -> DataFrame:
    """V2 unexpanded: (item_id, owner_id, page_id, via_split) – whose pages an item shows.

    Every item shows its own pages; a split child also shows its origin's, or the one page that its group names. A null
    page_id stands for all pages of the owner: children times pages is only ever written out by who asks for it.
    """
    none = F.lit(None).cast("bigint")
    own = lib["item"].select(
        F.col("id").alias("item_id"), F.col("id").alias("owner_id"), none.alias("page_id"), F.lit(False).alias("via_split")
    )
    group = lib["split_group"].select(
        F.col("id").alias("split_group_id"), F.col("origin_item_id").alias("owner_id"), F.col("origin_page_id").alias("page_id")
    )
    cited = lib["item"].filter("split_role = 'child'").select(F.col("id").alias("item_id"), "split_group_id").join(group, "split_group_id")
    return own.unionByName(cited.select("item_id", "owner_id", "page_id", F.lit(True).alias("via_split")))


def item_pages(lib: Library, ids: DataFrame | None = None) -> DataFrame:
    """V2: own pages, and for split children the pages of the origin they cite.

    With ``ids`` (item_id) only the links of those items are expanded.
    """
    links = page_links(lib).withColumnRenamed("page_id", "only")
    if ids is not None:
        links = links.join(ids.select("item_id").distinct(), "item_id", "left_semi")
    page = lib["page"].select(
        F.col("id").alias("page_id"),
        F.col("item_id").alias("owner_id"),
        "seq",
        "file_relpath",
        "thumb_relpath",
        "rotation",
        "content_hash",
    )
    columns = ["page_id", "seq", "file_relpath", "thumb_relpath", "rotation", "content_hash", "via_split"]
    return links.join(page, "owner_id").filter("only IS NULL OR only = page_id").select("item_id", *columns)


def summable_tax(lib: Library) -> DataFrame:
    """V3: tax lines of summable receipts."""
    lines = lib["receipt_tax_line"].select(
        F.col("id").alias("tax_line_id"), "item_id", "label", "rate_bp", "tax_category_id", "amount_minor"
    )
    return lines.join(summable_receipts(lib).select("item_id", "folder_id", "currency"), "item_id")


def folder_totals(lib: Library) -> DataFrame:
    """V4: money never crosses a currency."""
    return (
        summable_receipts(lib)
        .groupBy("folder_id", "currency")
        .agg(
            F.count("*").alias("item_count"),
            F.sum(F.coalesce("total_minor", F.lit(0))).alias("total_minor"),
            F.sum(F.coalesce("tax_total_minor", F.lit(0))).alias("tax_minor"),
            count_where(F.col("total_minor").isNull()).alias("missing_amount_count"),
            count_where(F.col("reviewed_at").isNull()).alias("unreviewed_count"),
        )
    )


def split_reconciliation(lib: Library) -> DataFrame:
    """V5: arithmetic of every split group; drift must be zero at rest."""
    live_children = (
        lib["item"]
        .filter("split_role = 'child' AND trashed_at IS NULL")
        .select(F.col("id").alias("item_id"), "split_group_id")
    )
    money = lib["receipt_data"].select(
        "item_id", "total_minor", "tax_total_minor", F.col("currency").alias("child_currency")
    )
    child = live_children.join(money, "item_id", "left").withColumnRenamed("split_group_id", "id")
    group = lib["split_group"].select(
        "id", "origin_item_id", "origin_total_minor", "origin_tax_minor", "currency"
    )
    # Children are summed per (group, currency) first, so the wide join sees few rows per group.
    sums = child.groupBy("id", "child_currency").agg(
        F.count("*").alias("n"), F.sum("total_minor").alias("total"), F.sum("tax_total_minor").alias("tax")
    )
    joined = group.join(sums, "id", "left")
    return joined.groupBy("id", "origin_item_id", "origin_total_minor", "origin_tax_minor", "currency").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_count"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("children_total_minor"),
        F.coalesce(F.sum("tax"), F.lit(0)).alias("children_tax_minor"),
        F.sum(F.when(F.col("child_currency") != F.col("currency"), F.col("n")).otherwise(0)).alias(
            "currency_mismatch_count"
        ),
    ).select(
        F.col("id").alias("split_group_id"),
        "origin_item_id",
        "origin_total_minor",
        "origin_tax_minor",
        "currency",
        "child_count",
        "children_total_minor",
        (F.col("children_total_minor") - F.col("origin_total_minor")).alias("drift_minor"),
        "children_tax_minor",
        (F.col("children_tax_minor") - F.coalesce("origin_tax_minor", F.lit(0))).alias("tax_drift_minor"),
        "currency_mismatch_count",
    )


def searchable_pages(lib: Library) -> DataFrame:
    """V6: pages of live items."""
    live = lib["item"].filter("trashed_at IS NULL").select(F.col("id").alias("item_id"), "folder_id", "type")
    return lib["page"].select(F.col("id").alias("page_id"), "item_id").join(live, "item_id")


MISSING_FLAGS = {
    "missing_vendor": "vendor_id",
    "missing_date": "txn_date",
    "missing_total": "total_minor",
    "missing_category": "category_id",
    "missing_tax_category": "tax_category_id",
}


def missing_key_data(lib: Library) -> DataFrame:
    """V7: summable receipts with any key field empty."""
    flags = {flag: F.col(source).isNull() for flag, source in MISSING_FLAGS.items()}
    anything = F.lit(False)
    for flag in flags.values():
        anything = anything | flag
    return (
        summable_receipts(lib)
        .filter(anything)
        .select("item_id", "folder_id", *[c.alias(name) for name, c in flags.items()])
    )


def search_source(lib: Library) -> DataFrame:
    """V8: the text an item is found by; recomputed, so renames and deletions follow."""
    vendor = lib["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    receipts = lib["receipt_data"].select(F.col("item_id").alias("id"), "vendor_id", "description").join(
        vendor, "vendor_id", "left"
    )
    documents = lib["document_data"].select(F.col("item_id").alias("id"), "title", "notes")
    contacts = lib["contact_data"].select(F.col("item_id").alias("id"), "org", "title", "notes")
    side = shaped(receipts, "item_search_src")
    for other in (documents, contacts):
        side = side.unionByName(shaped(other, "item_search_src"))
    return side
