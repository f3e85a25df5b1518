"""The item list: grid rows, filters, totals, flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.checks import json_fields
from tillbook.operators.canonical import (
    MISSING_FLAGS,
    count_where,
    item_pages,
    summable_receipts,
)
from tillbook.operators.lists import ascii_fold
from tillbook.plans.scale import number_rows
from tillbook.schemas import Library

# Thresholds and defaults.
UNUSABLE_PAGE_CONFIDENCE = 0.3
LOW_FIELD_CONFIDENCE = 0.5
UNFLAGGED_FIELDS = ["description"]
RECENT_MS = 30 * 24 * 60 * 60 * 1000
LIST_LIMIT = 10_000


@dataclass(frozen=True)
class ListRequest:
    smart_filter: str = "all"
    folder_id: int | None = None
    include_subfolders: bool = False
    type: str | None = None
    include_superseded: bool = False
    sort: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = LIST_LIMIT
    offset: int = 0
    now: int = 0


# --- folders -------------------------------------------------------------------------


def folder_paths(lib: Library) -> DataFrame:
    """Ancestors, depth and depth-first position of every folder; cycles are cut.

    Roots are folders without a parent or whose parent is gone.
    """
    spark = lib["folder"].sparkSession
    _lift_recursion_caps(spark)
    lib["folder"].select("id", "parent_id", "kind", "name", "sort_order").createOrReplaceTempView("folder_rows")
    # Siblings sort by sort_order, name, id: each step appends one comparable text key.
    step = "concat(lpad(cast({0}.sort_order + 1000000000 as string), 10, '0'), '/', {0}.name, '/', lpad(cast({0}.id as string), 19, '0'))"
    return spark.sql(f"""
        WITH RECURSIVE tree(id, parent_id, kind, name, depth, path_ids, path, position) AS (
          SELECT f.id, f.parent_id, f.kind, f.name, 0, array(f.id), f.name, array({step.format('f')})
          FROM folder_rows f LEFT ANTI JOIN folder_rows p ON f.parent_id = p.id
          UNION ALL
          SELECT f.id, f.parent_id, f.kind, f.name, t.depth + 1, array_append(t.path_ids, f.id),
                 concat(t.path, ' / ', f.name), array_append(t.position, {step.format('f')})
          FROM folder_rows f JOIN tree t ON f.parent_id = t.id
          WHERE NOT array_contains(t.path_ids, f.id)
        )
        SELECT * FROM tree""")


def folder_tree(lib: Library) -> DataFrame:
    """Depth-first order, siblings by sort order, name, id."""
    ordered = folder_paths(lib).select("id", "parent_id", "kind", "name", "depth", "path", "position")
    return number_rows(ordered, ["position"], out="ordinal").drop("position").orderBy("ordinal")


def subtree_ids(lib: Library, folder_id: int) -> DataFrame:
    """A folder and everything below it; the recursion starts at the folder and cuts cycles."""
    spark = lib["folder"].sparkSession
    _lift_recursion_caps(spark)
    lib["folder"].select("id", "parent_id").createOrReplaceTempView("folder_links")
    return spark.sql(f"""
        WITH RECURSIVE below(id, path_ids) AS (
          SELECT id, array(id) FROM folder_links WHERE id = {int(folder_id)}
          UNION ALL
          SELECT f.id, array_append(b.path_ids, f.id) FROM folder_links f JOIN below b ON f.parent_id = b.id
          WHERE NOT array_contains(b.path_ids, f.id)
        )
        SELECT id AS folder_id FROM below""")


def _lift_recursion_caps(spark) -> None:
    # A tree is as large as the folder table and no deeper than it.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")


def reparent_allowed(lib: Library, moves: DataFrame) -> DataFrame:
    """A folder may not move under itself or its own descendant.  ``moves``: id, new_parent_id."""
    target = folder_paths(lib).select(F.col("id").alias("new_parent_id"), "path_ids")
    return moves.join(target, "new_parent_id", "left").select(
        "id", "new_parent_id", (~F.coalesce(F.expr("array_contains(path_ids, id)"), F.lit(False))).alias("allowed")
    )


def in_folder(lib: Library, df: DataFrame, folder_id: int | None, subfolders: bool) -> DataFrame:
    if folder_id is None:
        return df
    if not subfolders:
        return df.filter(F.col("folder_id") == folder_id)
    return df.join(subtree_ids(lib, folder_id), "folder_id", "left_semi")


# --- flags ---------------------------------------------------------------------------


def page_rollup(lib: Library) -> DataFrame:
    """OCR counts and worst confidence per item, one pass over pages."""
    status = F.col("ocr_status")
    return lib["page"].groupBy("item_id").agg(
        count_where(status == "failed").alias("ocr_failed"),
        count_where(status.isin("pending", "queued", "running")).alias("ocr_pending"),
        count_where(status == "done").alias("ocr_done"),
        F.count("*").alias("n_pages"),
        F.min("ocr_conf").alias("ocr_min_conf"),
    )


def first_thumbs(lib: Library) -> DataFrame:
    """Thumbnail (or file) of the first page, split children included.

    A child cites the first page of its origin, or the pinned one: one row per child, never its origin's pages.
    """
    page = lib["page"].select(
        "item_id", F.coalesce("thumb_relpath", "file_relpath").alias("thumb"), F.struct("seq", F.col("id").alias("page_id")).alias("at")
    )
    item = lib["item"].select(F.col("id").alias("item_id"), "split_group_id", "split_role")
    first = page.groupBy("item_id").agg(F.min_by("thumb", "at").alias("thumb"), F.min("at").alias("at"))
    group = lib["split_group"].select(F.col("id").alias("split_group_id"), F.col("origin_item_id"), "origin_page_id")
    child = item.filter("split_role = 'child'").select("item_id", "split_group_id").join(group, "split_group_id")
    origin = first.withColumnRenamed("item_id", "origin_item_id")
    pinned = page.withColumnRenamed("item_id", "origin_item_id").withColumn("origin_page_id", F.col("at.page_id"))
    cited = child.filter("origin_page_id IS NULL").join(origin, "origin_item_id").select("item_id", "thumb", "at").unionByName(
        child.filter("origin_page_id IS NOT NULL").join(pinned, ["origin_item_id", "origin_page_id"]).select("item_id", "thumb", "at"))
    return (
        first.join(item.select("item_id"), "item_id", "left_semi")
        .unionByName(cited)
        .groupBy("item_id")
        .agg(F.min_by("thumb", "at").alias("thumb_relpath"), F.lit(True).alias("has_images"))
    )


def low_confidence_fields(extraction: Column) -> Column:
    """Sorted names of fields read with low confidence."""
    weak = F.map_filter(
        json_fields(extraction),
        lambda name, p: ~name.isin(*UNFLAGGED_FIELDS) & (p["confidence"] < LOW_FIELD_CONFIDENCE),
    )
    return F.sort_array(F.map_keys(weak))


def flagged_items(lib: Library) -> DataFrame:
    """One row per item with everything the list, its filters and its counters need."""
    receipt = lib["receipt_data"].withColumn("has_receipt", F.lit(True))
    rows = (
        lib["item"]
        .withColumnRenamed("id", "item_id")
        .join(receipt, "item_id", "left")
        .join(page_rollup(lib), "item_id", "left")
    )
    # The flags of the view of missing data, from the columns at hand: null outside the view.
    summable = F.col("has_receipt") & (F.col("type") == "receipt") & F.col("trashed_at").isNull() & F.col("superseded_at").isNull()
    empty_field = F.lit(False)
    for source in MISSING_FLAGS.values():
        empty_field = empty_field | F.col(source).isNull()
    rows = rows.withColumn("in_missing_view", F.when(summable & empty_field, F.lit(True)))
    rows = rows.withColumns({flag: F.when(F.col("in_missing_view"), F.col(source).isNull()) for flag, source in MISSING_FLAGS.items()})
    pages = F.coalesce("n_pages", F.lit(0)) > 0
    receipt_without_total = (F.col("type") == "receipt") & pages & F.col("total_minor").isNull()
    unreadable = F.coalesce(F.col("ocr_min_conf") < UNUSABLE_PAGE_CONFIDENCE, F.lit(False))
    failed = F.coalesce(F.col("ocr_failed") > 0, F.lit(False))
    key_missing = F.coalesce(
        F.col("missing_vendor") | F.col("missing_date") | F.col("missing_total"), F.lit(False)
    )
    # Only pages with a recognised status decide the status; the worst one wins.
    known = F.coalesce(F.col("ocr_failed") + F.col("ocr_pending") + F.col("ocr_done"), F.lit(0)) > 0
    status = (
        F.when(~known, "none")
        .when(failed, "failed")
        .when(F.col("ocr_pending") > 0, "pending")
        .otherwise("done")
    )
    return rows.withColumns(
        {
            "ocr_status": status,
            "needs_manual_entry": failed | unreadable | receipt_without_total,
            "missing_data": key_missing,
            "needs_review": failed | unreadable | receipt_without_total | key_missing,
        }
    )


def listed_items(lib: Library, req: ListRequest) -> DataFrame:
    """The items a list request asks for, with item columns at least; only "needs review" looks beyond them."""
    rows = flagged_items(lib) if req.smart_filter == "needsReview" else lib["item"].withColumnRenamed("id", "item_id")
    return filtered(lib, rows, req)


def filtered(lib: Library, rows: DataFrame, req: ListRequest) -> DataFrame:
    """The item filter of a list request over items, flagged ones where it asks for flags."""
    trash = req.smart_filter == "trash"
    rows = rows.filter(F.col("trashed_at").isNotNull() if trash else F.col("trashed_at").isNull())
    if not req.include_superseded:
        rows = rows.filter("superseded_at IS NULL")
    if req.smart_filter == "unreviewed":
        rows = rows.filter("reviewed_at IS NULL")
    elif req.smart_filter == "needsReview":
        rows = rows.filter("needs_review")
    elif req.smart_filter == "inbox":
        rows = rows.join(inbox_folders(lib), "folder_id", "left_semi")
    elif req.smart_filter == "recent":
        rows = rows.filter(F.col("created_at") >= req.now - RECENT_MS)
    if req.type:
        rows = rows.filter(F.col("type") == req.type)
    return in_folder(lib, rows, req.folder_id, req.include_subfolders)


def inbox_folders(lib: Library) -> DataFrame:
    return lib["folder"].filter("kind = 'inbox'").select(F.col("id").alias("folder_id"))


def filtered_summable(lib: Library, rows: DataFrame, req: ListRequest) -> DataFrame:
    """The same filter over summable receipts; other types and the trash have no money."""
    if req.smart_filter == "trash" or (req.type and req.type != "receipt"):
        return rows.filter(F.lit(False))
    rows = rows.filter("type = 'receipt' AND superseded_at IS NULL AND has_receipt")
    return filtered(lib, rows, ListRequest(**{**req.__dict__, "include_superseded": False, "type": None}))


# --- rows ----------------------------------------------------------------------------


def missing_fields() -> Column:
    """P10: from the view's flags; a receipt outside the view is judged by its columns."""
    flags = [("missing_vendor", "vendor"), ("missing_date", "txnDate"), ("missing_total", "total")]
    from_view = [F.when(F.col(flag), F.lit(name)) for flag, name in flags]
    columns = [("vendor_name", "vendor"), ("txn_date", "txnDate"), ("total_minor", "total"), ("category_name", "category")]
    from_row = [F.when(F.col(c).isNull(), F.lit(name)) for c, name in columns]
    none = F.array().cast("array<string>")
    return (
        F.when(F.col("type") != "receipt", none)
        .when(F.col("in_missing_view"), F.array_compact(F.array(*from_view)))
        .when(F.col("has_receipt"), F.array_compact(F.array(*from_row)))
        .otherwise(none)
    )


def grid_rows(lib: Library, rows: DataFrame) -> DataFrame:
    """Flat display rows."""
    for table, key, name in (
        ("vendor", "vendor_id", "vendor_name"),
        ("category", "category_id", "category_name"),
        ("payment_type", "payment_type_id", "payment_type_name"),
    ):
        rows = rows.join(lib[table].select(F.col("id").alias(key), F.col("name").alias(name)), key, "left")
    rows = rows.join(first_thumbs(lib), "item_id", "left")
    return rows.select(
        "item_id",
        "type",
        "folder_id",
        "txn_date",
        "vendor_name",
        "category_name",
        "payment_type_name",
        "tax_total_minor",
        "total_minor",
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.col("reviewed_at").isNotNull().alias("reviewed"),
        F.coalesce("has_images", F.lit(False)).alias("has_images"),
        F.coalesce(F.col("split_role") == "child", F.lit(False)).alias("is_split_child"),
        "ocr_status",
        F.col("ocr_min_conf").alias("ocr_confidence"),
        "needs_manual_entry",
        F.array_join(low_confidence_fields(F.col("extraction_json")), ",").alias("low_confidence_fields"),
        F.array_join(missing_fields(), ",").alias("missing_fields"),
        "thumb_relpath",
        "reviewed_at",
        "created_at",
        "modified_at",
        F.col("currency").alias("_currency"),
    )


SORT_KEYS: dict[str, Column | str] = {
    "txnDate": "txn_date",
    "vendorName": "vendor_name",
    "categoryName": "category_name",
    "paymentTypeName": "payment_type_name",
    "taxTotalMinor": "tax_total_minor",
    "totalMinor": "total_minor",
    "reviewed": "reviewed_at",
    "type": "type",
    "currency": "_currency",
    "createdAt": "created_at",
    "modifiedAt": "modified_at",
    "folderId": "folder_id",
}
FOLDED_KEYS = {"vendorName", "categoryName", "paymentTypeName"}


def list_order(sort: list[tuple[str, str]]) -> list[Column]:
    """Whitelisted keys, nulls last both ways, item id last; unknown keys are ignored."""
    known = [(key, way) for key, way in sort if key in SORT_KEYS] or [("txnDate", "desc")]
    order = []
    for key, way in known:
        column = F.col(SORT_KEYS[key])
        column = ascii_fold(column) if key in FOLDED_KEYS else column
        order.append(column.asc_nulls_last() if way == "asc" else column.desc_nulls_last())
    return [*order, F.col("item_id").asc()]


def list_items(lib: Library, req: ListRequest) -> DataFrame:
    """The rows of a list request, in order, one page."""
    rows = grid_rows(lib, filtered(lib, flagged_items(lib), req))
    page = rows.orderBy(*list_order(req.sort))
    if req.offset:
        page = page.offset(req.offset)
    if req.limit is not None:
        page = page.limit(req.limit)
    return page.drop("_currency")


def list_total(lib: Library, req: ListRequest) -> DataFrame:
    """Rows the filter matches without the page limit."""
    return listed_items(lib, req).agg(F.count("*").alias("total"))


# --- totals --------------------------------------------------------------------------


def sum_by_currency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("currency").agg(
        F.count("*").alias("item_count"),
        F.coalesce(F.sum("total_minor"), F.lit(0)).alias("total_minor"),
        F.coalesce(F.sum("tax_total_minor"), F.lit(0)).alias("tax_minor"),
        count_where(F.col("total_minor").isNull()).alias("missing_amount_count"),
    )


def totals_by_currency(lib: Library, req: ListRequest | None = None) -> DataFrame:
    """A1: per currency, never blended."""
    if req is None or req == ListRequest():
        return sum_by_currency(summable_receipts(lib))
    return sum_by_currency(filtered_summable(lib, flagged_items(lib), req))


def flag_counts(lib: Library, req: ListRequest) -> DataFrame:
    """A2/A3: every counter of a list in one pass over the flagged items."""
    rows = filtered(lib, flagged_items(lib), ListRequest(**{**req.__dict__, "include_superseded": True}))
    listed = F.col("superseded_at").isNull() | F.lit(req.include_superseded)
    money = F.col("superseded_at").isNull() & (F.col("type") == "receipt") & F.col("has_receipt")
    if req.smart_filter == "trash" or (req.type and req.type != "receipt"):
        money = F.lit(False)
    shown = listed & F.lit(req.smart_filter != "trash")
    weak = F.size(low_confidence_fields(F.col("extraction_json"))) > 0
    return rows.agg(
        count_where(money & F.col("reviewed_at").isNull()).alias("unreviewed_count"),
        F.coalesce(F.max(money & F.col("total_minor").isNull()), F.lit(False)).alias("has_incomplete_amounts"),
        count_where(shown & F.col("needs_manual_entry")).alias("needs_manual_entry_count"),
        count_where(shown & F.col("missing_data")).alias("missing_data_count"),
        count_where(shown & F.col("needs_review")).alias("needs_review_count"),
        count_where(shown & weak).alias("low_confidence_count"),
    )


def page_low_confidence_count(page: DataFrame) -> DataFrame:
    """A3: low-confidence rows of one returned page."""
    return page.agg(F.count_if(F.col("low_confidence_fields") != "").alias("low_confidence_count"))


def flag_severity(rows: DataFrame) -> DataFrame:
    """Danger, warn, pending or nothing, with the reason."""
    conf = F.col("ocr_confidence")
    percent = F.floor(conf * 100 + 0.5).cast("string")
    danger = (
        F.when(F.col("ocr_status") == "failed", "OCR failed on this image — enter the details manually")
        .when(
            conf < UNUSABLE_PAGE_CONFIDENCE,
            F.concat(F.lit("Text was unreadable ("), percent, F.lit("% confidence) — enter the details manually")),
        )
        .otherwise("This receipt has an image but no amount was found — enter it manually")
    )
    spaced = lambda c: F.replace(F.col(c), F.lit(","), F.lit(", "))
    warn = F.concat_ws(
        " · ",
        F.when(F.col("missing_fields") != "", F.concat(F.lit("missing: "), spaced("missing_fields"))),
        F.when(F.col("low_confidence_fields") != "", F.concat(F.lit("low confidence: "), spaced("low_confidence_fields"))),
    )
    kind = (
        F.when(F.col("needs_manual_entry"), "danger")
        .when(warn != "", "warn")
        .when(F.col("ocr_status") == "pending", "pending")
    )
    return rows.select(
        "item_id",
        kind.alias("kind"),
        F.when(kind == "danger", danger).when(kind == "warn", warn).when(kind == "pending", "OCR still running").alias("title"),
    )


# --- inbox and lookups ---------------------------------------------------------------


def inbox_list(lib: Library, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The inbox, oldest first; all of it unless a page is asked for."""
    return list_items(lib, ListRequest(smart_filter="inbox", sort=[("createdAt", "asc")], limit=limit, offset=offset))


def inbox_counts(lib: Library) -> DataFrame:
    """Both counts in use: all live inbox items, and the unreviewed ones."""
    rows = lib["item"].filter("trashed_at IS NULL").join(inbox_folders(lib), "folder_id", "left_semi")
    return rows.agg(
        F.count("*").alias("live_count"),
        count_where(F.col("reviewed_at").isNull()).alias("unreviewed_count"),
    )


def next_unreviewed(lib: Library) -> DataFrame:
    """The oldest inbox item nobody has reviewed."""
    rows = filtered(lib, lib["item"].withColumnRenamed("id", "item_id"), ListRequest(smart_filter="unreviewed"))
    rows = rows.join(inbox_folders(lib), "folder_id", "left_semi")
    return rows.orderBy("created_at", "item_id").limit(1).select("item_id", "type", "folder_id", "created_at")


def ocr_states(lib: Library, page_ids: DataFrame) -> DataFrame:
    """Status and confidence of pages; unknown pages are pending."""
    page = lib["page"].select(F.col("id").alias("page_id"), "ocr_status", "ocr_conf")
    return page_ids.join(page, "page_id", "left").select(
        "page_id", F.coalesce("ocr_status", F.lit("pending")).alias("ocr_status"), "ocr_conf"
    )


def group_members(lib: Library, ids: DataFrame) -> DataFrame:
    """(split_group_id, member_id, role, asked) of every split group that one of the items is in, each member once.

    Who shows an item's siblings reads its group's members but for itself: rows grow with the members of a group, not
    with their pairs.
    """
    item = lib["item"].filter("split_group_id IS NOT NULL").select(
        "split_group_id", F.col("id").alias("member_id"), F.col("split_role").alias("role"))
    wanted = ids.select(F.col("item_id").alias("member_id")).distinct().withColumn("asked", F.lit(True))
    known = item.join(wanted, "member_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    touched = known.filter("asked").select("split_group_id").distinct()
    return known.join(touched, "split_group_id", "left_semi").select("split_group_id", "member_id", "role", "asked")


def item_detail(lib: Library, ids: DataFrame, siblings: bool = True) -> DataFrame:
    """Everything about some items, as ordered sections instead of one wide nested row.

    (item_id, section, ord, ref_id, payload): lists of any length stay rows, so one item
    with very many lines is spread over tasks like any other data.  Asked for whole groups,
    leave ``siblings`` out, which are all pairs then, and read ``group_members``.
    """
    ids = ids.select("item_id").distinct()

    def section(name: str, df: DataFrame, order: str, ref: str, columns: list[str]) -> DataFrame:
        return df.join(ids, "item_id", "left_semi").select(
            "item_id",
            F.lit(name).alias("section"),
            F.col(order).cast("bigint").alias("ord"),
            F.col(ref).cast("bigint").alias("ref_id"),
            F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"),
        )

    item = lib["item"].withColumnRenamed("id", "item_id")
    groups = lib["split_group"].withColumnRenamed("id", "split_group_id")
    fields = lib["custom_field_value"].join(
        lib["custom_field_def"].select(F.col("id").alias("def_id"), "key", "sort_order"), "def_id")
    receipt = lib["receipt_data"]
    parts = [
        section("item", item, "item_id", "item_id", ["type", "folder_id", "split_role", "reviewed_at", "trashed_at"]),
        section("receipt", receipt, "item_id", "item_id", [c for c in receipt.columns if c != "item_id"]),
        section("document", lib["document_data"], "item_id", "item_id", ["title", "doc_date", "doc_type", "notes"]),
        section("contact", lib["contact_data"], "item_id", "item_id", ["first_name", "last_name", "org", "title"]),
        section("tax_line", lib["receipt_tax_line"], "id", "id", ["label", "rate_bp", "amount_minor"]),
        section("page", item_pages(lib, ids), "seq", "page_id", ["seq", "file_relpath", "via_split"]),
        section("split_group", item.join(groups, "split_group_id"), "split_group_id", "split_group_id",
                ["origin_item_id", "origin_total_minor", "currency"]),
        section("custom_field", fields, "sort_order", "def_id", ["key", "value"]),
    ]
    if siblings:
        members = group_members(lib, ids)
        others = members.select("split_group_id", F.col("member_id").alias("sibling_id"), F.col("role").alias("sibling_role"))
        pairs = members.filter("asked").select("split_group_id", F.col("member_id").alias("item_id")).join(others, "split_group_id")
        parts.append(section("sibling", pairs.filter("sibling_id <> item_id"), "sibling_id", "sibling_id", ["sibling_role"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
