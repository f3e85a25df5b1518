"""List, filters, flags, inbox, folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import listing
from tillbook.operators.listing import ListRequest
from tillbook.sources import star

GRID = """item_id, type, folder_id, txn_date, vendor_name, category_name, payment_type_name, tax_total_minor, total_minor,
  coalesce(currency, 'USD') currency, reviewed_at is not null reviewed, has_images, coalesce(split_role = 'child', false) is_split_child,
  ocr_status, ocr_min_conf ocr_confidence, needs_manual_entry, low_confidence_fields, missing_fields, thumb_relpath, reviewed_at, created_at, modified_at"""


@query("grid_rows", f"select {GRID} from grid where trashed_at is null and superseded_at is null")
def grid_rows(spark, sf):
    lib = star.library(spark, sf)
    rows = listing.filtered(lib, listing.flagged_items(lib), ListRequest())
    return listing.grid_rows(lib, rows).drop("_currency")


@query("list_items_page", f"""
    select {GRID} from grid where trashed_at is null and superseded_at is null
    order by translate(vendor_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') asc nulls last, total_minor desc nulls last, item_id limit 200 offset 50""")
def list_items_page(spark, sf):
    req = ListRequest(sort=[("vendorName", "asc"), ("hostile; drop", "asc"), ("totalMinor", "desc")], limit=200, offset=50)
    return listing.list_items(star.library(spark, sf), req)


@query("list_items_default_order", f"""
    select {GRID} from grid where trashed_at is null and superseded_at is null order by txn_date desc nulls last, item_id limit 10000""")
def list_items_default_order(spark, sf):
    return listing.list_items(star.library(spark, sf), ListRequest(sort=[("nope", "asc")]))


@query("list_total_subtree", """
    select count(*) total from flagged where trashed_at is null and superseded_at is null and folder_id in (select folder_id from subtree_2)""")
def list_total_subtree(spark, sf):
    return listing.list_total(star.library(spark, sf), ListRequest(folder_id=2, include_subfolders=True))


@query("filter_recent", "select item_id from flagged where trashed_at is null and superseded_at is null and created_at >= 1600000000000")
def filter_recent(spark, sf):
    lib = star.library(spark, sf)
    req = ListRequest(smart_filter="recent", now=1_600_000_000_000 + listing.RECENT_MS)
    return listing.listed_items(lib, req).select("item_id")


@query("filter_trash_with_superseded", "select item_id from flagged where trashed_at is not null")
def filter_trash_with_superseded(spark, sf):
    lib = star.library(spark, sf)
    req = ListRequest(smart_filter="trash", include_superseded=True)
    return listing.listed_items(lib, req).select("item_id")


@query("filter_needs_review", "select item_id from flagged where trashed_at is null and superseded_at is null and needs_review and type = 'receipt'")
def filter_needs_review(spark, sf):
    lib = star.library(spark, sf)
    req = ListRequest(smart_filter="needsReview", type="receipt")
    return listing.listed_items(lib, req).select("item_id")


@query("filter_unreviewed_inbox", "select item_id from flagged where trashed_at is null and superseded_at is null and reviewed_at is null and folder_id = 900")
def filter_unreviewed_inbox(spark, sf):
    lib = star.library(spark, sf)
    req = ListRequest(smart_filter="unreviewed", folder_id=900)
    return listing.listed_items(lib, req).select("item_id")


@query("summable_filter_totals", """
    select currency, count(*) item_count, cast(coalesce(sum(total_minor), 0) as bigint) total_minor, cast(coalesce(sum(tax_total_minor), 0) as bigint) tax_minor,
      count(*) filter (where total_minor is null) missing_amount_count
    from flagged where trashed_at is null and superseded_at is null and has_receipt and needs_review and folder_id in (select folder_id from subtree_2) group by 1""")
def summable_filter_totals(spark, sf):
    req = ListRequest(smart_filter="needsReview", folder_id=2, include_subfolders=True)
    return listing.totals_by_currency(star.library(spark, sf), req)


@query("flag_counts", """
    select count(*) filter (where type = 'receipt' and has_receipt and reviewed_at is null) unreviewed_count,
      coalesce(bool_or(type = 'receipt' and has_receipt and total_minor is null), false) has_incomplete_amounts,
      count(*) filter (where needs_manual_entry) needs_manual_entry_count, count(*) filter (where missing_data) missing_data_count,
      count(*) filter (where needs_review) needs_review_count, count(*) filter (where low_confidence_fields <> '') low_confidence_count
    from flagged where trashed_at is null and superseded_at is null""")
def flag_counts(spark, sf):
    return listing.flag_counts(star.library(spark, sf), ListRequest())


@query("page_low_confidence_count", """
    select count(*) filter (where low_confidence_fields <> '') low_confidence_count from (
      select low_confidence_fields from grid where trashed_at is null and superseded_at is null order by txn_date desc nulls last, item_id limit 500)""")
def page_low_confidence_count(spark, sf):
    return listing.page_low_confidence_count(listing.list_items(star.library(spark, sf), ListRequest(limit=500)))


@query("low_confidence_fields", "select item_id, low_confidence_fields from flagged where extraction_json is not null")
def low_confidence_fields(spark, sf):
    fields = F.array_join(listing.low_confidence_fields(F.col("extraction_json")), ",")
    return star.library(spark, sf)["receipt_data"].filter("extraction_json IS NOT NULL").select(
        "item_id", fields.alias("low_confidence_fields"))


@query("ocr_page_rollup", "select * from page_rollup")
def ocr_page_rollup(spark, sf):
    return listing.page_rollup(star.library(spark, sf))


@query("first_page_thumbs", "select item_id, thumb thumb_relpath from thumbs")
def first_page_thumbs(spark, sf):
    return listing.first_thumbs(star.library(spark, sf)).drop("has_images")


@query("flag_severity", """
    select item_id, kind, case kind when 'danger' then case when ocr_status = 'failed' then 'OCR failed on this image — enter the details manually'
        when ocr_min_conf < 0.3 then 'Text was unreadable (' || cast(floor(ocr_min_conf * 100 + 0.5) as int) || '% confidence) — enter the details manually'
        else 'This receipt has an image but no amount was found — enter it manually' end
      when 'warn' then warn when 'pending' then 'OCR still running' end title
    from (select *, case when needs_manual_entry then 'danger' when warn <> '' then 'warn' when ocr_status = 'pending' then 'pending' end kind
      from (select *, concat_ws(' · ', case when missing_fields <> '' then 'missing: ' || replace(missing_fields, ',', ', ') end,
              case when low_confidence_fields <> '' then 'low confidence: ' || replace(low_confidence_fields, ',', ', ') end) warn
            from grid where trashed_at is null and superseded_at is null))""")
def flag_severity(spark, sf):
    return listing.flag_severity(grid_rows(spark, sf))


@query("missing_key_data_in_folder", "select * from v_missing where folder_id = 900 order by item_id")
def missing_key_data_in_folder(spark, sf):
    from tillbook.operators.canonical import missing_key_data

    return missing_key_data(star.library(spark, sf)).filter("folder_id = 900").orderBy("item_id")


@query("inbox_list", f"select {GRID} from grid where trashed_at is null and superseded_at is null and folder_id = 900")
def inbox_list(spark, sf):
    """The whole inbox."""
    return listing.inbox_list(star.library(spark, sf))


@query("inbox_counts", """
    select count(*) live_count, count(*) filter (where reviewed_at is null) unreviewed_count
    from item where trashed_at is null and folder_id = 900""")
def inbox_counts(spark, sf):
    return listing.inbox_counts(star.library(spark, sf))


@query("next_unreviewed", """
    select id item_id, type, folder_id, created_at from item where trashed_at is null and superseded_at is null and reviewed_at is null and folder_id = 900 order by created_at, id limit 1""")
def next_unreviewed(spark, sf):
    return listing.next_unreviewed(star.library(spark, sf))


@query("ocr_state_lookup", """
    select x.page_id, coalesce(p.ocr_status, 'pending') ocr_status, p.ocr_conf
    from (select event_id * 2 page_id from events) x left join page p on p.id = x.page_id""")
def ocr_state_lookup(spark, sf):
    ids = star.read(spark, sf, "events").select((F.col("event_id") * 2).alias("page_id"))
    return listing.ocr_states(star.library(spark, sf), ids)


@query("list_values_vendor", "select id, name from vendor")
def list_values_vendor(spark, sf):
    from tillbook.operators.lists import list_values

    return list_values(star.library(spark, sf), "vendor")


@query("folder_tree", """
    with recursive tree as (
      select id, parent_id, kind, name, 0 depth, name path, [lpad((sort_order + 1000000000)::varchar, 10, '0') || '/' || name || '/' || lpad(id::varchar, 19, '0')] pos from folder where parent_id is null
      union all select f.id, f.parent_id, f.kind, f.name, depth + 1, path || ' / ' || f.name,
        list_append(pos, lpad((f.sort_order + 1000000000)::varchar, 10, '0') || '/' || f.name || '/' || lpad(f.id::varchar, 19, '0')) from folder f join tree t on f.parent_id = t.id)
    select id, parent_id, kind, name, depth, path, row_number() over (order by pos) ordinal from tree""")
def folder_tree(spark, sf):
    return listing.folder_tree(star.library(spark, sf))


@query("folder_subtree", "select folder_id from subtree_2")
def folder_subtree(spark, sf):
    return listing.subtree_ids(star.library(spark, sf), 2)


@query("folder_reparent_check", """
    select f.id, g.id new_parent_id, not (g.id = f.id or coalesce(g.parent_id = f.id, false)) allowed
    from folder f join folder g on g.sort_order = f.sort_order""")
def folder_reparent_check(spark, sf):
    lib = star.library(spark, sf)
    f = lib["folder"].select("id", "sort_order")
    moves = f.join(f.withColumnRenamed("id", "new_parent_id"), "sort_order").drop("sort_order")
    return listing.reparent_allowed(lib, moves)


@query("item_payloads", """
    with ids as (select id item_id from item where split_role = 'origin' or type in ('contact', 'document')),
    parts as (
      select id item_id, 'item' section, id ord, id ref_id, to_json({'type': type, 'folder_id': folder_id, 'split_role': split_role, 'reviewed_at': reviewed_at, 'trashed_at': trashed_at}) payload from item
      union all select item_id, 'receipt', item_id, item_id, to_json({'txn_date': txn_date, 'vendor_id': vendor_id, 'total_minor': total_minor, 'currency': currency, 'payment_type_id': payment_type_id,
        'tax_total_minor': tax_total_minor, 'category_id': category_id, 'tax_category_id': tax_category_id, 'project_id': project_id, 'external_ref': external_ref, 'description': description, 'extraction_json': extraction_json}) from receipt_data
      union all select item_id, 'contact', item_id, item_id, to_json({'first_name': first_name, 'last_name': last_name, 'org': org, 'title': title}) from contact_data
      union all select item_id, 'document', item_id, item_id, to_json({'title': title, 'doc_date': doc_date, 'doc_type': null, 'notes': notes}) from document_data
      union all select item_id, 'tax_line', id, id, to_json({'label': label, 'rate_bp': rate_bp, 'amount_minor': amount_minor}) from receipt_tax_line
      union all select item_id, 'page', seq, page_id, to_json({'seq': seq, 'file_relpath': file_relpath, 'via_split': via_split}) from v_item_pages
      union all select i.id, 'split_group', g.id, g.id, to_json({'origin_item_id': origin_item_id, 'origin_total_minor': origin_total_minor, 'currency': currency}) from item i join split_group g on g.id = i.split_group_id
      union all select a.id, 'sibling', b.id, b.id, to_json({'sibling_role': b.split_role}) from item a join item b on a.split_group_id = b.split_group_id and a.id <> b.id where a.split_role = 'origin')
    select item_id, section, ord, ref_id, cast(payload as varchar) payload from parts where item_id in (select item_id from ids)""")
def item_payloads(spark, sf):
    """Everything that is told of origins, contacts and documents, field by field."""
    lib = star.library(spark, sf)
    ids = lib["item"].filter("split_role = 'origin' OR type IN ('contact', 'document')").select(F.col("id").alias("item_id"))
    return listing.item_detail(lib, ids)


@query("group_members", """
    with asked as (select id, split_group_id from item where split_role = 'child')
    select split_group_id, id member_id, split_role as role, id in (select id from asked) asked
    from item where split_group_id in (select split_group_id from asked)""")
def group_members(spark, sf):
    """The groups of all split children, each member told once and not once per sibling."""
    lib = star.library(spark, sf)
    return listing.group_members(lib, lib["item"].filter("split_role = 'child'").select(F.col("id").alias("item_id")))


@query("item_detail", """
    with ids as (select id item_id from item where split_role = 'origin' or type = 'contact'),
    parts as (
      select item_id, 'item' section, 1 n from ids
      union all select item_id, 'receipt', 1 from receipt_data
      union all select item_id, 'contact', 1 from contact_data
      union all select item_id, 'document', 1 from document_data
      union all select item_id, 'tax_line', 1 from receipt_tax_line
      union all select item_id, 'page', 1 from v_item_pages
      union all select id, 'split_group', 1 from item where split_group_id is not null
      union all select a.id, 'sibling', 1 from item a join item b on a.split_group_id = b.split_group_id and a.id <> b.id where a.split_role = 'origin')
    select item_id, section, count(*) row_count from parts where item_id in (select item_id from ids) group by 1, 2""")
def item_detail(spark, sf):
    lib = star.library(spark, sf)
    ids = lib["item"].filter("split_role = 'origin' OR type = 'contact'").select(F.col("id").alias("item_id"))
    return listing.item_detail(lib, ids).groupBy("item_id", "section").agg(F.count("payload").alias("row_count"))
