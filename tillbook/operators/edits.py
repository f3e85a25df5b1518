"""Batch edits driven by command tables.

Each takes library tables and a command table and returns new tables plus the commands
that were refused, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.checks import FIELD_RECORD, is_civil_text, is_currency, json_fields
from tillbook.functions.money import parse_money_text, trimmed
from tillbook.operators.lists import resolve_names
from tillbook.operators.rules import put_fields
from tillbook.operators.splits import first_reason
from tillbook.plans.scale import next_id, number_rows, rank_rows
from tillbook.schemas import Library, shaped, with_tables
from tillbook.session import checkpointed

# Patch field → extraction field; an edit by hand pins the field.
PINNED_FIELDS = {
    "txnDate": "txnDate",
    "vendorName": "vendor",
    "totalText": "total",
    "paymentTypeName": "paymentType",
    "taxTotalText": "taxTotal",
    "categoryName": "category",
    "taxCategoryName": "taxCategory",
    "externalRef": "externalRef",
    "description": "description",
}
LIST_FIELDS = {
    "vendorName": ("vendor", "vendor_id"),
    "categoryName": ("category", "category_id"),
    "taxCategoryName": ("tax_category", "tax_category_id"),
    "paymentTypeName": ("payment_type", "payment_type_id"),
    "projectName": ("project", "project_id"),
}
PATCH_FIELDS = [
    *LIST_FIELDS, "folderId", "reviewed", "txnDate", "totalText", "taxTotalText", "currency",
    "externalRef", "description", "title", "docDate", "notes",
]


def patch_items(lib: Library, edits: DataFrame, now: int) -> tuple[Library, DataFrame, DataFrame]:
    """M1: typed edits, one row per field: (item_id, seq, field, value).

    The last edit of a field wins.  An item with any bad value keeps everything as it was.
    Returns (library, errors(item_id, field, error), created list values(list, name)).
    """
    # One row per item: for each field the last value, as a struct so that "set to null" shows.
    latest = edits.groupBy("item_id").agg(
        *[F.max(F.when(F.col("field") == f, F.struct("seq", "value"))).alias(f) for f in PATCH_FIELDS]
    )
    value = lambda f: F.col(f"{f}.value")
    filled = lambda f: F.coalesce(value(f) != "", F.lit(False))
    kinds = lib["item"].select(F.col("id").alias("item_id"), "type")
    folders = lib["folder"].select(F.col("id").cast("string").alias("_folder"), F.col("kind").alias("_folder_kind"))
    checked = latest.join(kinds, "item_id", "left").join(folders, value("folderId") == F.col("_folder"), "left")
    not_a_date = lambda f: filled(f) & (~is_civil_text(value(f)) | value(f).try_cast("date").isNull())
    blank_name = lambda f: filled(f) & (trimmed(value(f)) == "")
    problems = [
        ("id", F.when(F.col("type").isNull(), "item not found")),
        ("totalText", parse_money_text(value("totalText"))["error"]),
        ("taxTotalText", parse_money_text(value("taxTotalText"))["error"]),
        ("txnDate", F.when(not_a_date("txnDate"), F.concat(F.lit("not a civil date: "), value("txnDate")))),
        ("docDate", F.when(not_a_date("docDate"), F.concat(F.lit("not a civil date: "), value("docDate")))),
        (
            "currency",
            F.when(
                F.col("currency").isNotNull() & ~F.coalesce(is_currency(value("currency")), F.lit(False)),
                F.concat(F.lit("not an ISO-4217 code: "), F.coalesce(value("currency"), F.lit("null"))),
            ),
        ),
        (
            "folderId",
            F.when(F.col("folderId").isNotNull() & F.col("_folder").isNull(), "folder not found").when(
                F.col("_folder_kind") == "trash", "items are never stored in the trash folder"
            ),
        ),
        *[(f, F.when(blank_name(f), f"{table} name is empty")) for f, (table, _) in LIST_FIELDS.items()],
    ]
    entries = F.array_compact(
        F.array(*[F.when(e.isNotNull(), F.struct(F.lit(f).alias("field"), e.alias("error"))) for f, e in problems])
    )
    checked = checkpointed(checked.withColumn("_errors", entries))
    errors = checked.select("item_id", F.explode("_errors").alias("e")).select("item_id", "e.field", "e.error")
    good = checked.filter(F.size("_errors") == 0).drop("_errors", "_folder", "_folder_kind")

    # Names to ids, creating list values on the way.
    receipts_good = good.filter("type = 'receipt'")
    names = F.array_compact(
        F.array(*[
            F.when(filled(f), F.struct(F.lit(table).alias("list"), trimmed(value(f)).alias("name")))
            for f, (table, _) in LIST_FIELDS.items()
        ])
    )
    named = receipts_good.select("item_id", F.explode(names).alias("n")).select("item_id", "n.*")
    lib, mapping = resolve_names(lib, named, now, [table for table, _ in LIST_FIELDS.values()])
    created = mapping.filter("created").select("list", "name")
    ids = named.join(mapping, ["list", "name"]).groupBy("item_id").agg(
        *[F.max(F.when(F.col("list") == table, F.col("id"))).alias(f"_{target}") for table, target in LIST_FIELDS.values()]
    )
    receipts_good = receipts_good.join(ids, "item_id", "left")

    is_set = lambda f: F.col(f).isNotNull()

    # item
    item_patch = good.select(F.col("item_id").alias("id"), "folderId", "reviewed", F.lit(True).alias("_hit"))
    items = lib["item"].join(item_patch, "id", "left").withColumns(
        {
            "folder_id": F.when(is_set("folderId"), value("folderId").cast("bigint")).otherwise(F.col("folder_id")),
            "reviewed_at": F.when(is_set("reviewed"), F.when(value("reviewed") == "true", F.lit(now))).otherwise(
                F.col("reviewed_at")
            ),
            "modified_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("modified_at")),
        }
    )

    # receipt_data: a receipt without a row gets one first.
    missing = receipts_good.join(lib["receipt_data"], "item_id", "left_anti").select("item_id", F.lit("USD").alias("currency"))
    receipts = lib["receipt_data"].unionByName(shaped(missing, "receipt_data"))
    # Renamed: the patch's own currency and description columns are structs.
    patch = receipts_good.drop("type").withColumnsRenamed({"currency": "p_currency", "description": "p_description"})
    receipts = receipts.join(patch, "item_id", "left")
    total, tax = parse_money_text(F.col("totalText.value")), parse_money_text(F.col("taxTotalText.value"))
    new_values = {
        "txn_date": ("txnDate", F.col("txnDate.value").try_cast("date")),
        "total_minor": ("totalText", total["minor"]),
        "tax_total_minor": ("taxTotalText", tax["minor"]),
        "currency": ("p_currency", F.col("p_currency.value")),
        "external_ref": ("externalRef", F.col("externalRef.value")),
        "description": ("p_description", F.col("p_description.value")),
        **{target: (field, F.col(f"_{target}")) for field, (_, target) in LIST_FIELDS.items()},
    }
    pins = []
    for field, name in PINNED_FIELDS.items():
        source = f"p_{field}" if field == "description" else field
        shown = {"totalText": total["minor"].cast("string"), "taxTotalText": tax["minor"].cast("string")}.get(
            field, F.col(f"{source}.value")
        )
        pins.append(
            F.when(
                F.col(source).isNotNull(),
                F.struct(
                    F.lit(name).alias("key"),
                    F.struct(
                        shown.alias("value"),
                        F.lit(1.0).alias("confidence"),
                        F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("bbox"),
                        F.lit(None).cast("bigint").alias("pageId"),
                        F.lit(True).alias("pinned"),
                    ).alias("value"),
                ),
            )
        )
    pinned = F.map_from_entries(F.array_compact(F.array(*pins))).cast(FIELD_RECORD)
    receipts = receipts.withColumn("_pins", pinned).withColumns(
        {
            **{c: F.when(F.col(field).isNotNull(), new).otherwise(F.col(c)) for c, (field, new) in new_values.items()},
            "extraction_json": F.when(
                F.size("_pins") > 0, put_fields(json_fields(F.col("extraction_json")), F.col("_pins"))
            ).otherwise(F.col("extraction_json")),
        }
    )

    # document_data
    docs_good = good.filter("type = 'document'").select(
        "item_id", F.col("title").alias("p_title"), "docDate", F.col("notes").alias("p_notes")
    )
    absent = docs_good.join(lib["document_data"], "item_id", "left_anti").select("item_id")
    docs = lib["document_data"].unionByName(shaped(absent, "document_data")).join(docs_good, "item_id", "left").withColumns(
        {
            "title": F.when(is_set("p_title"), F.col("p_title.value")).otherwise(F.col("title")),
            "doc_date": F.when(is_set("docDate"), F.col("docDate.value").try_cast("date")).otherwise(F.col("doc_date")),
            "notes": F.when(is_set("p_notes"), F.col("p_notes.value")).otherwise(F.col("notes")),
        }
    )
    return (
        with_tables(
            lib,
            item=shaped(items, "item"),
            receipt_data=shaped(receipts, "receipt_data"),
            document_data=shaped(docs, "document_data"),
        ),
        errors,
        created,
    )


def bulk_edit(lib: Library, commands: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """M2/M4: move, delete, restore, reviewed, clear.  Commands: item_id, seq, op, target_folder_id.

    Every command is judged against the item as it was; the last accepted command per field
    (folder, trash, review) wins.  Returns (item table, errors(item_id, seq, reason)).
    """
    item = lib["item"].select(F.col("id").alias("item_id"), "trashed_at", F.lit(True).alias("_known"))
    folder = lib["folder"].select(F.col("id").alias("target_folder_id"), F.col("kind").alias("_kind"))
    op = F.col("op")
    judged = commands.join(item, "item_id", "left").join(folder, "target_folder_id", "left").withColumn(
        "reason",
        first_reason(
            (~op.isin("move", "delete", "restore", "reviewed", "clear"), F.concat(F.lit("unknown op "), op)),
            ((op == "move") & F.col("target_folder_id").isNull(), "target folder required for move"),
            (
                F.col("_known").isNull(),
                F.when(op == "delete", "not found or already trashed")
                .when(op == "restore", "not found or not trashed")
                .otherwise("not found"),
            ),
            ((op == "delete") & F.col("trashed_at").isNotNull(), "not found or already trashed"),
            ((op == "restore") & F.col("trashed_at").isNull(), "not found or not trashed"),
            ((op == "move") & F.col("_kind").isNull(), "folder not found"),
            ((op == "move") & (F.col("_kind") == "trash"), "items are never stored in the trash folder"),
        ),
    )
    errors = judged.filter("reason IS NOT NULL").select("item_id", "seq", "reason")
    last = lambda ops, what: F.max_by(F.when(op.isin(*ops), what), F.when(op.isin(*ops), F.col("seq")))
    accepted = judged.filter("reason IS NULL").groupBy(F.col("item_id").alias("id")).agg(
        last(["move"], F.col("target_folder_id")).alias("_folder"),
        last(["delete", "restore"], op).alias("_trash"),
        last(["reviewed", "clear"], op).alias("_review"),
    )
    changed = lib["item"].join(accepted, "id", "left").withColumns(
        {
            "modified_at": F.when(F.coalesce(F.col("_folder").cast("string"), "_trash", "_review").isNotNull(), F.lit(now)).otherwise(
                F.col("modified_at")
            ),
            "folder_id": F.coalesce("_folder", "folder_id"),
            "trashed_at": F.when(F.col("_trash") == "delete", F.lit(now))
            .when(F.col("_trash") == "restore", F.lit(None))
            .otherwise(F.col("trashed_at")),
            "reviewed_at": F.when(F.col("_review") == "reviewed", F.lit(now))
            .when(F.col("_review") == "clear", F.lit(None))
            .otherwise(F.col("reviewed_at")),
        }
    )
    return shaped(changed, "item"), errors


def create_items(lib: Library, commands: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """M3: new items with an empty side row.  Commands: ord (unique), folder_id, type."""
    new = number_rows(commands.select("ord", "folder_id", "type"), ["ord"], out="id", start=next_id(lib["item"]))
    items = new.withColumns({"created_at": F.lit(now), "modified_at": F.lit(now)})
    side = {}
    for kind, table in (("receipt", "receipt_data"), ("document", "document_data"), ("contact", "contact_data")):
        rows = new.filter(F.col("type") == kind).select(F.col("id").alias("item_id"))
        if kind == "receipt":
            rows = rows.withColumn("currency", F.lit("USD"))
        side[table] = lib[table].unionByName(shaped(rows, table))
    lib = with_tables(lib, item=lib["item"].unionByName(shaped(items, "item")), **side)
    return lib, new.select("ord", F.col("id").alias("item_id"), "folder_id", "type")


def set_trashed(lib: Library, ids: DataFrame, trashed: bool, now: int) -> DataFrame:
    """M4: trash or restore; nothing changes for items already in that state."""
    commands = ids.select(
        "item_id", F.lit(1).alias("seq"), F.lit("delete" if trashed else "restore").alias("op"),
        F.lit(None).cast("bigint").alias("target_folder_id"))
    return bulk_edit(lib, commands, now)[0]


def file_into(lib: Library, moves: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Move into a user folder and mark reviewed.  Moves: item_id, folder_id."""
    folder = lib["folder"].select(F.col("id").alias("folder_id"), "kind")
    known = lib["item"].select(F.col("id").alias("item_id"), F.lit(True).alias("_known"))
    judged = moves.join(folder, "folder_id", "left").join(known, "item_id", "left").withColumn(
        "reason",
        first_reason(
            (F.col("kind").isNull(), "folder not found"),
            (F.col("kind") == "trash", "cannot file into trash"),
            (F.col("_known").isNull(), "item not found"),
        ),
    )
    good = judged.filter("reason IS NULL").groupBy(F.col("item_id").alias("id")).agg(F.max("folder_id").alias("_to"))
    hit = F.col("_to").isNotNull()
    items = lib["item"].join(good, "id", "left").withColumns(
        {
            "folder_id": F.coalesce("_to", "folder_id"),
            "reviewed_at": F.when(hit, F.lit(now)).otherwise(F.col("reviewed_at")),
            "modified_at": F.when(hit, F.lit(now)).otherwise(F.col("modified_at")),
        }
    )
    return shaped(items, "item"), judged.filter("reason IS NOT NULL").select("item_id", "folder_id", "reason")


# --- folders -------------------------------------------------------------------------


def create_folders(lib: Library, commands: DataFrame, now: int) -> DataFrame:
    """Ord, parent_id, name, kind (null = user)."""
    new = number_rows(commands, ["ord"], out="id", start=next_id(lib["folder"])).withColumns(
        {
            "name": trimmed(F.col("name")),
            "kind": F.coalesce("kind", F.lit("user")),
            "sort_order": F.lit(0),
            "created_at": F.lit(now),
            "modified_at": F.lit(now),
        }
    )
    return lib["folder"].unionByName(shaped(new, "folder"))


def update_folders(lib: Library, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Id plus the columns to change; a null keeps the old value."""
    columns = [c for c in ("name", "parent_id", "period_end", "comments", "template", "sort_order") if c in changes.columns]
    new = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = lib["folder"].join(new, "id", "left").withColumns(
        {
            **{c: F.coalesce(trimmed(F.col("_name")) if c == "name" else F.col(f"_{c}"), F.col(c)) for c in columns},
            "modified_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("modified_at")),
        }
    )
    unknown = changes.join(lib["folder"], "id", "left_anti").select("id", F.lit("folder not found").alias("reason"))
    return shaped(rows, "folder"), unknown


def delete_folders(lib: Library, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refused for system folders, parents and folders with items."""
    folder = lib["folder"].select("id", "kind")
    parents = lib["folder"].select(F.col("parent_id").alias("id"), F.lit(True).alias("_parent")).filter("id IS NOT NULL").distinct()
    used = lib["item"].select(F.col("folder_id").alias("id"), F.lit(True).alias("_used")).distinct()
    judged = (
        ids.select("id").distinct().join(folder, "id", "left").join(parents, "id", "left").join(used, "id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("kind").isNull(), "folder not found"),
                (F.col("kind").isin("inbox", "trash"), F.concat(F.lit("cannot delete system folder kind="), F.col("kind"))),
                (F.col("_parent").isNotNull(), "folder has child folders"),
                (F.col("_used").isNotNull(), "folder is not empty"),
            ),
        )
    )
    gone = judged.filter("reason IS NULL").select("id")
    return lib["folder"].join(gone, "id", "left_anti"), judged.filter("reason IS NOT NULL").select("id", "reason")


# --- pages ---------------------------------------------------------------------------


def add_pages(lib: Library, commands: DataFrame, now: int) -> DataFrame:
    """Pages appended after the last one of their item.  Commands: item_id, ord, file_relpath, …"""
    last = lib["page"].groupBy("item_id").agg(F.max("seq").alias("_last"))
    ranked = rank_rows(commands, ["item_id"], ["ord"], out="_n").join(last, "item_id", "left")
    new = number_rows(ranked, ["item_id", "ord"], out="id", start=next_id(lib["page"])).withColumns(
        {
            "seq": F.coalesce("_last", F.lit(0)) + F.col("_n"),
            "rotation": F.lit(0),
            "ocr_status": F.lit("pending"),
            "ocr_generation": F.lit(0),
            "created_at": F.lit(now),
        }
    )
    return lib["page"].unionByName(shaped(new, "page"))


def reorder_pages(lib: Library, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense seq 1..n; the order must name every page of the item exactly once.

    Orders: item_id, page_id, ord.  Returns (page table, rejected(item_id, reason)).
    """
    owned = lib["page"].select("item_id", F.col("id").alias("page_id"), F.lit(1).alias("_owned"))
    named = orders.groupBy("item_id", "page_id").agg(F.min("ord").alias("ord"), F.count("*").alias("_times"))
    asked = orders.select("item_id").distinct()
    both = owned.join(asked, "item_id", "left_semi").join(named, ["item_id", "page_id"], "full")
    verdict = both.groupBy("item_id").agg(
        F.count("_owned").alias("n_owned"),
        F.coalesce(F.sum("_times"), F.lit(0)).alias("n_named"),
        F.min(F.when(F.col("_owned").isNull(), F.col("page_id"))).alias("stranger"),
    ).withColumn(
        "reason",
        first_reason(
            (F.col("n_owned") != F.col("n_named"), "the order must name every page of the item"),
            (F.col("stranger").isNotNull(), F.format_string("page %d is not on item %d", "stranger", "item_id")),
        ),
    )
    good = named.join(verdict.filter("reason IS NULL").select("item_id"), "item_id", "left_semi")
    seqs = rank_rows(good, ["item_id"], ["ord", "page_id"], out="_seq").select(F.col("page_id").alias("id"), "_seq")
    pages = lib["page"].join(seqs, "id", "left").withColumn("seq", F.coalesce(F.col("_seq").cast("bigint"), F.col("seq")))
    return shaped(pages, "page"), verdict.filter("reason IS NOT NULL").select("item_id", "reason")


def rotate_pages(lib: Library, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_id, rotation."""
    known = lib["page"].select(F.col("id").alias("page_id"), F.lit(True).alias("_known"))
    judged = commands.join(known, "page_id", "left").withColumn(
        "reason",
        first_reason(
            (~F.coalesce(F.col("rotation").isin(0, 90, 180, 270), F.lit(False)), "rotation must be 0, 90, 180, or 270"),
            (F.col("_known").isNull(), "page not found"),
        ),
    )
    good = judged.filter("reason IS NULL").groupBy(F.col("page_id").alias("id")).agg(F.max("rotation").alias("_rot"))
    pages = lib["page"].join(good, "id", "left").withColumn("rotation", F.coalesce("_rot", "rotation"))
    return shaped(pages, "page"), judged.filter("reason IS NOT NULL").select("page_id", "rotation", "reason")


def cited_pages(lib: Library) -> DataFrame:
    """Q4: pages that split children cite and that therefore must stay."""
    with_children = lib["item"].filter("split_role = 'child'").select(F.col("split_group_id").alias("id")).distinct()
    group = lib["split_group"].join(with_children, "id", "left_semi").select(
        F.col("origin_item_id").alias("item_id"), "origin_page_id")
    count = lib["page"].groupBy("item_id").agg(F.count("*").alias("_pages"))
    page = lib["page"].select(F.col("id").alias("page_id"), "item_id")
    return (
        page.join(group, "item_id")
        .join(count, "item_id")
        .filter("origin_page_id = page_id OR (origin_page_id IS NULL AND _pages = 1)")
        .select("page_id", "item_id")
        .distinct()
    )


def delete_pages(lib: Library, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cited pages are kept."""
    known = lib["page"].select(F.col("id").alias("page_id"), F.lit(True).alias("_known"))
    cited = cited_pages(lib).select("page_id", F.lit(True).alias("_cited"))
    judged = ids.select("page_id").distinct().join(known, "page_id", "left").join(cited, "page_id", "left").withColumn(
        "reason",
        first_reason(
            (F.col("_known").isNull(), "page not found"),
            (F.col("_cited").isNotNull(), "this page is the cited image for split children"),
        ),
    )
    gone = judged.filter("reason IS NULL").select(F.col("page_id").alias("id"))
    return lib["page"].join(gone, "id", "left_anti"), judged.filter("reason IS NOT NULL").select("page_id", "reason")


def apply_ocr_results(lib: Library, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results count only if their generation is still the page's.

    Results: page_id, generation, text, words, confidence, engine.  Of several results of
    the same generation the greatest (confidence, text) is kept, so replays agree.
    """
    page = lib["page"].select(F.col("id").alias("page_id"), F.col("ocr_generation").alias("_now"))
    judged = results.join(page, "page_id", "left").withColumn(
        "reason",
        first_reason(
            (F.col("_now").isNull(), "page not found"),
            (
                F.col("_now") != F.col("generation"),
                F.format_string("stale generation: result=%d, page=%d", "generation", "_now"),
            ),
        ),
    )
    best = judged.filter("reason IS NULL").groupBy(F.col("page_id").alias("id")).agg(
        F.max_by(F.struct("text", "words", "confidence", "engine"), F.struct("confidence", "text")).alias("_r")
    )
    hit = F.col("_r").isNotNull()
    pages = lib["page"].join(best, "id", "left").withColumns(
        {
            "ocr_status": F.when(hit, "done").otherwise(F.col("ocr_status")),
            "ocr_text": F.when(hit, F.col("_r.text")).otherwise(F.col("ocr_text")),
            "ocr_conf": F.when(hit, F.col("_r.confidence")).otherwise(F.col("ocr_conf")),
            "ocr_engine": F.when(hit, F.col("_r.engine")).otherwise(F.col("ocr_engine")),
            "ocr_words": F.when(hit, F.col("_r.words")).otherwise(F.col("ocr_words")),
        }
    )
    return shaped(pages, "page"), judged.filter("reason IS NOT NULL").select("page_id", "generation", "reason")


def invalidate_ocr(lib: Library, ids: DataFrame) -> DataFrame:
    """Next generation, everything read so far is dropped."""
    hit = ids.select(F.col("page_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    stale = F.col("_hit").isNotNull()
    pages = lib["page"].join(hit, "id", "left").withColumns(
        {
            "ocr_generation": F.col("ocr_generation") + F.when(stale, 1).otherwise(0),
            "ocr_status": F.when(stale, "pending").otherwise(F.col("ocr_status")),
            **{c: F.when(~stale, F.col(c)) for c in ("ocr_text", "ocr_conf", "ocr_engine", "ocr_words")},
        }
    )
    return shaped(pages, "page")


def set_ocr_status(lib: Library, commands: DataFrame) -> DataFrame:
    """page_id, status."""
    new = commands.groupBy(F.col("page_id").alias("id")).agg(F.max("status").alias("_status"))
    pages = lib["page"].join(new, "id", "left").withColumn("ocr_status", F.coalesce("_status", "ocr_status"))
    return shaped(pages, "page")


def requeue_list(lib: Library, item_ids: DataFrame) -> DataFrame:
    """Pages to read again, with the generation a result must carry."""
    return lib["page"].join(item_ids.select("item_id").distinct(), "item_id", "left_semi").select(
        F.col("id").alias("page_id"), F.col("ocr_generation").alias("generation")
    )


# --- custom fields -------------------------------------------------------------------


def custom_fields(lib: Library, item_ids: DataFrame) -> DataFrame:
    """One map of key → value per item."""
    defs = lib["custom_field_def"].select(F.col("id").alias("def_id"), "key")
    rows = lib["custom_field_value"].join(item_ids.select("item_id").distinct(), "item_id", "left_semi").join(defs, "def_id")
    # One value per (item, definition): the list is bounded by the number of definitions.
    return rows.groupBy("item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("fields"))


def set_custom_fields(lib: Library, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item_id, seq, key, value; last write per (item, key) wins, unknown keys are refused."""
    defs = lib["custom_field_def"].select(F.col("id").alias("def_id"), "key")
    judged = commands.join(defs, "key", "left")
    rejected = judged.filter("def_id IS NULL").select(
        "item_id", "key", F.concat(F.lit("unknown custom field key: "), F.col("key")).alias("reason"))
    new = judged.filter("def_id IS NOT NULL").groupBy("item_id", "def_id").agg(F.max_by("value", "seq").alias("value"))
    kept = lib["custom_field_value"].join(new, ["item_id", "def_id"], "left_anti")
    return kept.unionByName(shaped(new, "custom_field_value")), rejected
