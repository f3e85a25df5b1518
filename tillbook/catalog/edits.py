"""Batch edits, combines, custom fields, page upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import edits, merges
from tillbook.schemas import shaped, with_tables
from tillbook.sources import star


def _patches(spark, sf):
    """Three edits per event: an amount, a date or a name; some of them bad."""
    e = star.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id")
    amount = F.when(k == 0, "12.345").when(k % 10 == 1, "").otherwise(
        F.concat(F.lit("$"), F.format_number(F.round(F.col("value") * 100).cast("decimal(18,0)") / 100, 2)))
    date = F.when(k == 5, "2024-02-31").when(k % 10 == 2, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    name = F.when(i % 3 == 0, F.concat(F.lit("Category "), (k % 7).cast("string"))).otherwise("furniture")
    row = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    both = F.array(row("totalText", amount), row("txnDate", date), row("categoryName", name), row("reviewed", F.lit("true")))
    item = F.when(k == 99, i + 900_000_000_000).otherwise(i)
    return e.select(item.alias("item_id"), F.col("event_id").alias("seq"), F.explode(both).alias("p")).select("item_id", "seq", "p.*")


PATCH_SQL = """
    with e as (select event_id, ts, value, cast(json_extract_string(props, '$.k') as int) k from events),
    p as (select case when k = 99 then event_id + 900000000000 else event_id end item_id, k,
        case when k % 10 = 1 then null else cast(round(value * 100) as bigint) end total,
        case when k % 10 = 2 then null else cast(ts as date) end d,
        case when event_id % 3 = 0 then 'Category ' || (k % 7) else 'furniture' end cat from e)"""


@query("patch_errors", PATCH_SQL + """
    select item_id, 'id' field, 'item not found' error from p where item_id not in (select id from item)
    union all select item_id, 'totalText', 'invalid amount: 12.345' from p where k = 0
    union all select item_id, 'txnDate', 'not a civil date: 2024-02-31' from p where k = 5""")
def patch_errors(spark, sf):
    """M1: every bad value is reported, nothing of that item is written."""
    return edits.patch_items(star.library(spark, sf), _patches(spark, sf), star.NOW)[1]


@query("patched_receipts", PATCH_SQL + """,
    good as (select * from p where k not in (0, 5) and item_id in (select id from item where type = 'receipt'))
    select r.item_id, case when g.item_id is not null then g.d else r.txn_date end txn_date, case when g.item_id is not null then g.total else r.total_minor end total_minor,
      case when g.item_id is not null then case when g.cat = 'furniture' then 3 else 6 + cast(substr(g.cat, 10) as int) end else r.category_id end category_id,
      case when g.item_id is not null then 'category,total,txnDate' else '' end pinned
    from receipt_data r left join good g using (item_id)""")
def patched_receipts(spark, sf):
    """M1: typed values, list names resolved or created, edited fields pinned."""
    from tillbook.functions.checks import json_fields

    lib, _, _ = edits.patch_items(star.library(spark, sf), _patches(spark, sf), star.NOW)
    sure = F.map_filter(json_fields(F.col("extraction_json")), lambda k, v: v["pinned"] & (v["confidence"] == 1.0))
    return lib["receipt_data"].select(
        "item_id", "txn_date", "total_minor", "category_id",
        F.array_join(F.sort_array(F.map_keys(sure)), ",").alias("pinned"))


@query("patch_created_values", PATCH_SQL + """
    select distinct 'category' list, cat as name from p where k not in (0, 5) and cat <> 'furniture' and item_id in (select id from item where type = 'receipt')""")
def patch_created_values(spark, sf):
    return edits.patch_items(star.library(spark, sf), _patches(spark, sf), star.NOW)[2]


def _bulk(spark, sf):
    e = star.read(spark, sf, "events")
    op = star.pick(["move", "delete", "restore", "reviewed", "clear", "burn"], F.col("event_id") % 6)
    folder = F.when(F.col("event_id") % 12 == 0, star.TRASH).otherwise(100 + F.col("event_id") % 25)
    item = F.when(F.col("event_id") % 7 == 0, F.col("event_id") + 900_000_000_000).otherwise(F.col("event_id"))
    return e.select(item.alias("item_id"), F.col("event_id").alias("seq"), op.alias("op"), folder.alias("target_folder_id"))


BULK_SQL = """
    with c as (select case when event_id % 7 = 0 then event_id + 900000000000 else event_id end item_id, event_id seq,
        ['move','delete','restore','reviewed','clear','burn'][event_id % 6 + 1] op, case when event_id % 12 = 0 then 901 else 100 + event_id % 25 end f from events),
    j as (select c.*, i.id, i.trashed_at, case when op = 'burn' then 'unknown op burn'
        when i.id is null then case op when 'delete' then 'not found or already trashed' when 'restore' then 'not found or not trashed' else 'not found' end
        when op = 'delete' and trashed_at is not null then 'not found or already trashed' when op = 'restore' and trashed_at is null then 'not found or not trashed'
        when op = 'move' and f = 901 then 'items are never stored in the trash folder' end reason from c left join item i on i.id = c.item_id)"""


@query("bulk_edit_errors", BULK_SQL + " select item_id, seq, reason from j where reason is not null")
def bulk_edit_errors(spark, sf):
    return edits.bulk_edit(star.library(spark, sf), _bulk(spark, sf), star.NOW)[1]


@query("bulk_edited_items", BULK_SQL + """
    select i.id, case when j.op = 'move' then j.f else i.folder_id end folder_id,
      case when j.op = 'delete' then 1700000000000 when j.op = 'restore' then null else i.trashed_at end trashed_at,
      case when j.op = 'reviewed' then 1700000000000 when j.op = 'clear' then null else i.reviewed_at end reviewed_at,
      case when j.op is not null then 1700000000000 else i.modified_at end modified_at
    from item i left join (select * from j where reason is null) j on j.item_id = i.id""")
def bulk_edited_items(spark, sf):
    """M2/M4: one pass over the item table."""
    table, _ = edits.bulk_edit(star.library(spark, sf), _bulk(spark, sf), star.NOW)
    return table.select("id", "folder_id", "trashed_at", "reviewed_at", "modified_at")


@query("created_items", """
    select event_id ord, (select max(id) from item) + row_number() over (order by event_id) item_id, 900 folder_id,
      ['receipt','document','contact'][event_id % 3 + 1] as type from events where event_type = 'signup'""")
def created_items(spark, sf):
    """M3: ids follow the largest one in use."""
    e = star.read(spark, sf, "events").filter("event_type = 'signup'")
    commands = e.select(F.col("event_id").alias("ord"), F.lit(900).cast("bigint").alias("folder_id"),
                        star.pick(["receipt", "document", "contact"], F.col("event_id") % 3).alias("type"))
    return edits.create_items(star.library(spark, sf), commands, star.NOW)[1]


@query("filed_items", """
    with m as (select event_id item_id, case when event_id % 5 = 0 then 901 when event_id % 5 = 1 then 5 * 1000 else 100 + event_id % 25 end f from events)
    select i.id, case when f between 100 and 899 then f else folder_id end folder_id, case when f between 100 and 899 then 1700000000000 else reviewed_at end reviewed_at
    from item i left join m on m.item_id = i.id""")
def filed_items(spark, sf):
    """Trash and unknown folders are refused."""
    k = F.col("event_id")
    folder = F.when(k % 5 == 0, 901).when(k % 5 == 1, 5000).otherwise(100 + k % 25)
    moves = star.read(spark, sf, "events").select(k.alias("item_id"), folder.alias("folder_id"))
    return edits.file_into(star.library(spark, sf), moves, star.NOW)[0].select("id", "folder_id", "reviewed_at")


@query("folders_created", """
    select (select max(id) from folder) + row_number() over (order by c_custkey) id, case when c_custkey % 4 > 0 then 100 + c_nationkey end parent_id, trim('  Year ' || c_custkey || ' ') as name,
      'user' kind, 0 sort_order, 1700000000000 created_at, 1700000000000 modified_at from customer union all select id, parent_id, name, kind, sort_order, null, null from folder""")
def folders_created(spark, sf):
    """A folder for every customer, some of them roots, beside those that are there."""
    k = F.col("c_custkey")
    commands = star.read(spark, sf, "customer").select(
        k.alias("ord"), F.when(k % 4 > 0, 100 + F.col("c_nationkey")).cast("bigint").alias("parent_id"),
        F.concat(F.lit("  Year "), k.cast("string"), F.lit(" ")).alias("name"), F.lit(None).cast("string").alias("kind"))
    lib = star.library(spark, sf)
    made = edits.create_folders(lib, commands, star.NOW).join(lib["folder"].select("id", F.lit(True).alias("old")), "id", "left")
    return made.select("id", "parent_id", "name", "kind", "sort_order", F.when(F.col("old").isNull(), F.col("created_at")).alias("created_at"),
                       F.when(F.col("old").isNull(), F.col("modified_at")).alias("modified_at"))


@query("folder_deletes", """
    with used as (select distinct folder_id from item),
    ids as (select id from folder union select 7000 + o_orderkey % 10 from orders)
    select i.id, case when f.id is null then 'folder not found' when kind <> 'user' then 'cannot delete system folder kind=' || kind
      when i.id in (select parent_id from folder where parent_id is not null) then 'folder has child folders'
      when i.id in (select folder_id from used) then 'folder is not empty' end reason
    from ids i left join folder f using (id)
    where f.id is null or kind <> 'user' or i.id in (select parent_id from folder where parent_id is not null) or i.id in (select folder_id from used)""")
def folder_deletes(spark, sf):
    """Reasons why folders stay."""
    lib = star.library(spark, sf)
    ids = lib["folder"].select("id").unionByName(
        star.read(spark, sf, "orders").select((7000 + F.col("o_orderkey") % 10).alias("id")))
    return edits.delete_folders(lib, ids)[1]


@query("folder_updates", """
    select id, case when parent_id = 1 then trim(name) || '!' else name end as name, case when parent_id = 1 then 2 else parent_id end parent_id, sort_order from folder""")
def folder_updates(spark, sf):
    lib = star.library(spark, sf)
    changes = lib["folder"].filter("parent_id = 1").select(
        "id", F.concat(F.lit("  "), F.col("name"), F.lit("! ")).alias("name"), F.lit(2).cast("bigint").alias("parent_id"))
    return edits.update_folders(lib, changes, star.NOW)[0].select("id", "name", "parent_id", "sort_order")


@query("added_pages", """
    select p.item_id, coalesce(m, 0) + row_number() over (partition by p.item_id order by turn desc) seq, 'new/' || turn || '.jpg' file_relpath
    from (select conv_id as item_id, turn from conversations union all select conv_id + 1000000, turn from conversations) p
    left join (select item_id, max(seq) m from page group by 1) x on x.item_id = p.item_id""")
def added_pages(spark, sf):
    """Appended after the last page; an item without pages starts at 1."""
    lib = star.library(spark, sf)
    chat = star.read(spark, sf, "conversations")
    some = chat.select(F.col("conv_id").alias("item_id"), "turn").unionByName(
        chat.select((F.col("conv_id") + 1000000).alias("item_id"), "turn"))
    commands = some.select("item_id", (-F.col("turn")).alias("ord"), F.concat(F.lit("new/"), "turn", F.lit(".jpg")).alias("file_relpath"))
    pages = edits.add_pages(lib, commands, star.NOW)
    return pages.filter("file_relpath LIKE 'new/%'").select("item_id", "seq", "file_relpath")


@query("reordered_pages", """
    select id, item_id, case when item_id < 20000000000000 and item_id % 3 = 0 then row_number() over (partition by item_id order by seq desc) else seq end seq from page""")
def reordered_pages(spark, sf):
    """Reversed for every third item; orders that name too few pages are refused."""
    lib = star.library(spark, sf)
    page = lib["page"].filter("item_id < 20000000000000").select("item_id", F.col("id").alias("page_id"), (-F.col("seq")).alias("ord"), "seq")
    orders = page.filter("item_id % 3 = 0 OR (item_id % 3 = 1 AND seq > 1)").drop("seq")
    return edits.reorder_pages(lib, orders)[0].select("id", "item_id", "seq")


@query("rotated_pages", "select id, case when id % 5 < 4 then id % 5 * 90 else rotation end rotation from page")
def rotated_pages(spark, sf):
    lib = star.library(spark, sf)
    commands = lib["page"].select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 < 4, F.col("id") % 5 * 90).otherwise(45).cast("int").alias("rotation"))
    return edits.rotate_pages(lib, commands)[0].select("id", "rotation")


@query("cited_page_guard", """
    select distinct p.id page_id, 'this page is the cited image for split children' reason
    from (select *, count(*) over (partition by item_id) pages from page) p
      join (select *, case when id % 3 = 0 then (select min(x.id) from page x where x.item_id = origin_item_id) else origin_page_id end cited from split_group) g
        on g.origin_item_id = p.item_id join item c on c.split_group_id = g.id and c.split_role = 'child'
    where g.cited = p.id or (g.cited is null and p.pages = 1)""")
def cited_page_guard(spark, sf):
    """All pages asked to go; the cited ones stay, those that every third group pins among them."""
    lib = star.library(spark, sf)
    first = lib["page"].groupBy(F.col("item_id").alias("origin_item_id")).agg(F.min("id").alias("first"))
    pinned = lib["split_group"].join(first, "origin_item_id", "left").withColumn(
        "origin_page_id", F.when(F.col("id") % 3 == 0, F.col("first")).otherwise(F.col("origin_page_id")))
    lib = with_tables(lib, split_group=shaped(pinned, "split_group"))
    return edits.delete_pages(lib, lib["page"].select(F.col("id").alias("page_id")))[1]


def _ocr_results(spark, sf):
    e = star.read(spark, sf, "events")
    return e.select(
        (F.col("event_id") * 2).alias("page_id"), (F.col("event_id") % 3).cast("int").alias("generation"),
        F.concat(F.lit("read "), F.col("event_id").cast("string")).alias("text"),
        F.lit(None).cast("array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>,confidence:double>>").alias("words"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("confidence"), F.lit("engine").alias("engine"))


@query("ocr_results_applied", """
    select p.id, case when e.event_id is not null then 'done' else ocr_status end ocr_status, case when e.event_id is not null then 'read ' || event_id else ocr_text end ocr_text
    from page p left join (select * from events where event_id % 3 = 1) e on e.event_id * 2 = p.id""")
def ocr_results_applied(spark, sf):
    """Only results of the page's own generation."""
    return edits.apply_ocr_results(star.library(spark, sf), _ocr_results(spark, sf))[0].select("id", "ocr_status", "ocr_text")


@query("ocr_results_stale", """
    select event_id * 2 page_id, event_id % 3 generation, case when p.id is null then 'page not found' else 'stale generation: result=' || (event_id % 3) || ', page=1' end reason
    from events left join page p on p.id = event_id * 2 where p.id is null or event_id % 3 <> 1""")
def ocr_results_stale(spark, sf):
    return edits.apply_ocr_results(star.library(spark, sf), _ocr_results(spark, sf))[1]


@query("ocr_invalidated", """
    select id, case when ocr_status = 'failed' then 'pending' else ocr_status end ocr_status, ocr_generation + case when ocr_status = 'failed' then 1 else 0 end ocr_generation,
      ocr_text is null cleared from page""")
def ocr_invalidated(spark, sf):
    lib = star.library(spark, sf)
    ids = lib["page"].filter("ocr_status = 'failed'").select(F.col("id").alias("page_id"))
    return edits.invalidate_ocr(lib, ids).select("id", "ocr_status", "ocr_generation", F.col("ocr_text").isNull().alias("cleared"))


@query("ocr_status_set", """
    select id, case when id % 10 = 1 then 'running' when id % 10 = 3 then 'queued' else ocr_status end ocr_status, ocr_generation, ocr_text is null no_text from page""")
def ocr_status_set(spark, sf):
    """States set by commands, some twice, some for pages that do not exist; nothing else of a page changes."""
    lib = star.library(spark, sf)
    ids = lib["page"].select(F.col("id").alias("page_id"))
    commands = ids.filter("page_id % 10 = 1").withColumn("status", F.lit("running")).unionByName(
        ids.filter("page_id % 10 = 1").withColumn("status", F.lit("queued"))).unionByName(ids.filter("page_id % 10 = 3").withColumn("status", F.lit("queued")))
    unknown = ids.select((-F.col("page_id")).alias("page_id"), F.lit("done").alias("status"))
    return edits.set_ocr_status(lib, commands.unionByName(unknown)).select("id", "ocr_status", "ocr_generation", F.col("ocr_text").isNull().alias("no_text"))


@query("ocr_requeue", "select p.id page_id, ocr_generation generation from page p join item i on i.id = p.item_id where i.type = 'receipt'")
def ocr_requeue(spark, sf):
    lib = star.library(spark, sf)
    return edits.requeue_list(lib, lib["item"].filter("type = 'receipt'").select(F.col("id").alias("item_id")))


def _fields(spark, sf):
    lib = star.library(spark, sf)
    defs = spark.createDataFrame([(1, "receipt", "click", 1), (2, "receipt", "purchase", 2), (3, "all", "view", 3)],
                                 "id bigint, scope string, key string, sort_order int")
    lib = with_tables(lib, custom_field_def=shaped(defs, "custom_field_def"))
    commands = star.read(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"),
        F.get_json_object("props", "$.k").alias("value"))
    table, rejected = edits.set_custom_fields(lib, commands)
    return with_tables(lib, custom_field_value=table), rejected


@query("custom_field_values", """
    select user_id item_id, case event_type when 'click' then 1 when 'purchase' then 2 else 3 end def_id, arg_max(json_extract_string(props, '$.k'), event_id) as "value"
    from events where event_type in ('click', 'purchase', 'view') group by 1, 2""")
def custom_field_values(spark, sf):
    """Upsert on (item, definition), last write wins."""
    return _fields(spark, sf)[0]["custom_field_value"]


@query("custom_field_rejects", "select user_id item_id, event_type as key, 'unknown custom field key: ' || event_type reason from events where event_type not in ('click', 'purchase', 'view')")
def custom_field_rejects(spark, sf):
    return _fields(spark, sf)[1]


@query("custom_field_maps", """
    select user_id item_id, string_agg(event_type || '=' || v, ',' order by event_type) fields from (
      select user_id, event_type, arg_max(json_extract_string(props, '$.k'), event_id) v from events where event_type in ('click', 'purchase', 'view') group by 1, 2) group by 1""")
def custom_field_maps(spark, sf):
    lib, _ = _fields(spark, sf)
    ids = lib["custom_field_value"].select("item_id")
    entries = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return edits.custom_fields(lib, ids).select("item_id", F.array_join(F.sort_array(entries), ",").alias("fields"))


def _merges(spark, sf):
    """Neighbouring receipts with chat pages are combined in pairs; documents in tens by source."""
    lib = star.library(spark, sf)
    chat = star.read(spark, sf, "conversations").select(F.col("conv_id").alias("item_id")).distinct()
    pairs = chat.select(F.call_function("div", F.col("item_id"), F.lit(2)).alias("merge_no"), "item_id", F.col("item_id").alias("ord"))
    docs = star.read(spark, sf, "documents").select(
        (1_000_000_000 + F.call_function("div", F.col("doc_id"), F.lit(10))).alias("merge_no"),
        (star.DOCUMENT_BASE + F.col("doc_id")).alias("item_id"), F.col("doc_id").alias("ord"))
    return lib, pairs.unionByName(docs)


MERGE_SQL = """
    with c as (select distinct conv_id // 2 merge_no, conv_id item_id, conv_id ord from conversations
      union all select 1000000000 + doc_id // 10, 20000000000000 + doc_id, doc_id from documents),
    s as (select c.*, i.id, i.trashed_at, i.split_group_id from c left join item i on i.id = c.item_id),
    v as (select merge_no, count(*) n, min(case when id is null then item_id end) u, min(case when trashed_at is not null then item_id end) t, min(case when split_group_id is not null then item_id end) sp, arg_min(item_id, ord) result from s group by 1),
    r as (select merge_no, result, case when n < 2 then 'combine requires at least 2 items' when u is not null then 'item ' || u || ' not found'
        when t is not null then 'cannot combine trashed item ' || t when sp is not null then 'cannot combine into an item that is part of a split' end reason from v)"""


@query("combine_refusals", MERGE_SQL + " select merge_no, reason from r where reason is not null")
def combine_refusals(spark, sf):
    lib, commands = _merges(spark, sf)
    return merges.combine_items(lib, commands, star.NOW)[1]


@query("combined_pages", MERGE_SQL + """
    select p.id, coalesce(g.result, p.item_id) item_id, case when g.result is not null then row_number() over (partition by g.merge_no order by g.ord, p.seq, p.id) else p.seq end seq
    from page p left join (select c.item_id, c.ord, r.merge_no, r.result from c join r using (merge_no) where reason is null) g on g.item_id = p.item_id""")
def combined_pages(spark, sf):
    """Pages renumbered under the first item of each combine."""
    lib, commands = _merges(spark, sf)
    return merges.combine_items(lib, commands, star.NOW)[0]["page"].select("id", "item_id", "seq")


@query("separated_again", "select id, item_id, seq from page")
def separated_again(spark, sf):
    """M8: combining and separating every group gives the original pages back."""
    lib, commands = _merges(spark, sf)
    lib, _ = merges.combine_items(lib, commands, star.NOW)
    results = lib["merge_group"].select(F.col("result_item_id").alias("item_id"))
    return merges.separate_items(lib, results, star.NOW)[0]["page"].select("id", "item_id", "seq")


@query("separated_documents", "select item_id, title, doc_date, notes from document_data")
def separated_documents(spark, sf):
    """M8: side rows come back from the journal unchanged."""
    lib, commands = _merges(spark, sf)
    lib, _ = merges.combine_items(lib, commands, star.NOW)
    results = lib["merge_group"].select(F.col("result_item_id").alias("item_id"))
    return merges.separate_items(lib, results, star.NOW)[0]["document_data"].select("item_id", "title", "doc_date", "notes")
