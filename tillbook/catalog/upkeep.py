"""Archive, trash, citations, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import audit, maintain
from tillbook.schemas import shaped, with_tables
from tillbook.sources import star

CUTOFF = "1997-01-01"
ARCHIVE_SQL = f"""
    with cand as (
      select i.id, i.split_group_id, coalesce(case when type = 'receipt' then r.txn_date when type = 'document' then d.doc_date end, cast(make_timestamp(i.created_at * 1000) as date)) biz
      from item i left join receipt_data r on r.item_id = i.id left join document_data d on d.item_id = i.id where trashed_at is null),
    sel as (select id, split_group_id from cand where biz < date '{CUTOFF}'),
    closed as (select id from sel union select id from item where split_group_id in (select split_group_id from sel))"""


@query("archive_candidates", ARCHIVE_SQL + f" select id item_id, split_group_id, biz business_date from cand where biz < date '{CUTOFF}'")
def archive_candidates(spark, sf):
    return maintain.archive_candidates(star.library(spark, sf), CUTOFF)


@query("archive_selection", ARCHIVE_SQL + " select id item_id from closed")
def archive_selection(spark, sf):
    """M9/U4: whole split groups only."""
    return maintain.archive_selection(star.library(spark, sf), CUTOFF)


def _archived(spark, sf):
    import uuid

    from tillbook.session import shared_dir

    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    return maintain.archive(star.library(spark, sf), CUTOFF, path, star.NOW), path


@query("archive_listing", ARCHIVE_SQL + """
    select i.id item_id, type, txn_date, total_minor, split_role, i.split_group_id from item i left join receipt_data r on r.item_id = i.id where i.id in (select id from closed)""")
def archive_listing(spark, sf):
    """Written, then listed from the archive."""
    return maintain.list_archive(spark, _archived(spark, sf)[1])


@query("live_after_archive", ARCHIVE_SQL + """
    select type, count(*) item_count, (select count(*) from receipt_tax_line where item_id not in (select id from closed)) tax_lines, (select count(*) from closed) items_moved
    from item where id not in (select id from closed) group by 1""")
def live_after_archive(spark, sf):
    lib, _ = _archived(spark, sf)
    lines = lib["receipt_tax_line"].agg(F.count("*").alias("n"))
    moved = lib["archive_log"].agg(F.max("items_moved").alias("n"))
    return lib["item"].groupBy("type").agg(F.count("*").alias("item_count")).withColumns(
        {"tax_lines": lines.scalar(), "items_moved": moved.scalar()})


PURGE_SQL = """
    with blocked as (select o.id from item o where o.split_role = 'origin' and o.trashed_at is not null and exists (
        select 1 from item c where c.split_group_id = o.split_group_id and c.split_role = 'child' and c.trashed_at is null)),
    gone as (select id from item where trashed_at is not null and id not in (select id from blocked))"""


@query("empty_trash_rest", PURGE_SQL + " select i.id, i.type from item i where id not in (select id from gone)")
def empty_trash_rest(spark, sf):
    """What remains once the trash is emptied."""
    return maintain.empty_trash(star.library(spark, sf))[0]["item"].select("id", "type")


@query("empty_trash_released", PURGE_SQL + """,
    path as (select item_id, file_relpath p from page union select item_id, thumb_relpath from page where thumb_relpath is not null)
    select distinct p relpath from path where item_id in (select id from gone) and p not in (select p from path where item_id not in (select id from gone))""")
def empty_trash_released(spark, sf):
    return maintain.empty_trash(star.library(spark, sf))[1]


@query("purge_order", "select id item_id, split_role, case split_role when 'child' then 0 when 'origin' then 1 else 2 end bucket from item where trashed_at is not null order by 3, 1")
def purge_order(spark, sf):
    return maintain.purge_order(star.library(spark, sf))


@query("path_citations", """
    select p relpath, count(*) citations from (select file_relpath p from page union all select thumb_relpath from page where thumb_relpath is not null and thumb_relpath <> file_relpath) group by 1""")
def path_citations(spark, sf):
    """A11, over all pages, trashed ones included."""
    return maintain.citations(star.library(spark, sf)["page"])


@query("content_path_citations", "select 'blobs/' || sha256(text) relpath, count(*) citations from documents group by 1")
def content_path_citations(spark, sf):
    """A11 over content-addressed paths: identical texts share one."""
    pages = star.read(spark, sf, "documents").select(
        F.concat(F.lit("blobs/"), F.sha2("text", 256)).alias("file_relpath"), F.lit(None).cast("string").alias("thumb_relpath"))
    return maintain.citations(pages)


@query("integrity_report", """
    with r as (select count(*) filter (where child_count > 0 and drift_minor <> 0) d, count(*) filter (where child_count > 0 and tax_drift_minor <> 0) t from v_recon)
    select 'foreign keys' as name, n = 0 ok, case when n = 0 then 'clean' else n || ' violation(s)' end detail
      from (select count(*) n from page where item_id not in (select id from item))
    union all select 'split totals reconcile', d = 0, case when d = 0 then 'no drift' else d || ' split group(s) drift' end from r
    union all select 'split tax reconciles', t = 0, case when t = 0 then 'no drift' else t || ' group(s) tax drift' end from r
    union all select 'split currencies consistent', true, 'consistent' from r
    union all select 'media paths are relative', true, 'all relative' from r""")
def integrity_report(spark, sf):
    """Q5"""
    return audit.integrity_report(star.library(spark, sf))


def _damaged(spark, sf):
    """The library with rows broken by rule, so that every audit has something to find."""
    lib = star.library(spark, sf)
    i = F.col("id")
    item = lib["item"].withColumns({
        "split_role": F.when(i % 97 == 1, F.lit(None)).otherwise(F.col("split_role")),
        "superseded_at": F.when(i % 89 == 2, F.lit(None)).otherwise(F.col("superseded_at")),
        "type": F.when(i % 1001 == 3, "memo").otherwise(F.col("type")),
        "folder_id": F.when(i % 501 == 4, F.lit(901)).otherwise(F.col("folder_id"))})
    receipt = lib["receipt_data"].withColumn("currency", F.when(F.col("item_id") % 301 == 5, "eur").otherwise(F.col("currency")))
    page = lib["page"].withColumns({
        "rotation": F.when(i % 44 == 6, 45).otherwise(F.col("rotation")),
        "ocr_conf": F.when(i % 66 == 8, 1.5).otherwise(F.col("ocr_conf"))})
    event = star.read(spark, sf, "events")
    k = F.col("event_id")
    job = event.select(
        k.cast("string").alias("id"), F.when(k % 53 == 1, "dream").otherwise("import").alias("kind"),
        F.when(k % 59 == 2, F.lit(None)).otherwise("done").alias("status"))
    field = event.filter(k % 10 == 0).select(
        k.alias("id"), F.when(k % 30 == 0, "planet").otherwise("all").alias("scope"), F.when(k % 70 == 0, "blob").otherwise("text").alias("datatype"))
    backup = event.filter(k % 10 == 1).select(k.alias("id"), F.when(k % 3 == 0, "hourly").otherwise("manual").alias("kind"))
    return with_tables(
        lib, item=item, receipt_data=receipt, page=page, job=shaped(job, "job"), custom_field_def=shaped(field, "custom_field_def"),
        backup_log=shaped(backup, "backup_log"))


DAMAGED = """
    with di as (select id, folder_id_0 as f0, case when id % 97 = 1 then null else split_role end role, split_group_id g, case when id % 89 = 2 then null else superseded_at end sup,
        case when id % 1001 = 3 then 'memo' else type end ty, case when id % 501 = 4 then 901 else folder_id_0 end folder_id from (select *, folder_id folder_id_0 from item)),
    dr as (select item_id, case when item_id % 301 = 5 then 'eur' else currency end currency from receipt_data),
    dp as (select id, case when id % 44 = 6 then 45 else rotation end rotation, case when id % 66 = 8 then 1.5 else ocr_conf end conf from page)"""


@query("row_checks", DAMAGED + """
    select 'split group and role go together' as "check", cast(id as varchar) as key, '' detail from di where (g is null) <> (role is null)
    union all select 'origin is superseded', cast(id as varchar), '' from di where role = 'origin' and sup is null
    union all select 'item.type allowed', cast(id as varchar), '' from di where ty = 'memo'
    union all select 'currency code', cast(item_id as varchar), '' from dr where currency = 'eur'
    union all select 'page.rotation allowed', cast(id as varchar), '' from dp where rotation = 45
    union all select 'confidence range', cast(id as varchar), '' from dp where conf > 1
    union all select 'job.kind allowed', cast(event_id as varchar), '' from events where event_id % 53 = 1
    union all select 'job.status allowed', cast(event_id as varchar), '' from events where event_id % 59 = 2
    union all select 'custom_field_def.scope allowed', cast(event_id as varchar), '' from events where event_id % 10 = 0 and event_id % 30 = 0
    union all select 'custom_field_def.datatype allowed', cast(event_id as varchar), '' from events where event_id % 10 = 0 and event_id % 70 = 0
    union all select 'backup_log.kind allowed', cast(event_id as varchar), '' from events where event_id % 10 = 1 and event_id % 3 = 0""")
def row_checks(spark, sf):
    """Q1"""
    return audit.row_checks(_damaged(spark, sf))


@query("split_transitions", DAMAGED + """
    select 'origin unwound while children exist' as "check", cast(i.id as varchar) as key, '' detail from item i join di d using (id) where i.split_role = 'origin' and (d.role is null or d.sup is null)
      and i.split_group_id in (select split_group_id from item where split_role = 'child')
    union all select 'child left its group', cast(i.id as varchar), '' from item i join di d using (id) where i.split_role = 'child' and d.role is null""")
def split_transitions(spark, sf):
    """Q2: before and after the damage."""
    return audit.split_transitions(star.library(spark, sf)["item"], _damaged(spark, sf)["item"])


@query("purge_guard", """
    with gone as (select id from item where split_role is not null and id % 3 = 0)
    select 'purge guard' as "check", cast(o.id as varchar) as key, 'split children survive' detail from item o where o.split_role = 'origin' and o.id in (select id from gone)
      and o.split_group_id in (select split_group_id from item where split_role = 'child' and id not in (select id from gone))""")
def purge_guard(spark, sf):
    """Q3"""
    lib = star.library(spark, sf)
    return audit.purge_violations(lib, lib["item"].filter("split_role IS NOT NULL AND id % 3 = 0").select(F.col("id").alias("item_id")))


@query("foreign_key_audit", """
    with keep as (select id from item where id % 10 <> 0)
    select 'receipt_data.item_id -> item' as "check", cast(item_id as varchar) as key, cast(item_id as varchar) detail from receipt_data where item_id not in (select id from keep)
    union all select 'receipt_tax_line.item_id -> item', cast(id as varchar), cast(item_id as varchar) from receipt_tax_line where item_id not in (select id from keep)
    union all select 'document_data.item_id -> item', cast(item_id as varchar), cast(item_id as varchar) from document_data where item_id not in (select id from keep)
    union all select 'contact_data.item_id -> item', cast(item_id as varchar), cast(item_id as varchar) from contact_data where item_id not in (select id from keep)
    union all select 'page.item_id -> item', cast(id as varchar), cast(item_id as varchar) from page where item_id not in (select id from keep)
    union all select 'split_group.origin_item_id -> item', cast(id as varchar), cast(origin_item_id as varchar) from split_group where origin_item_id not in (select id from keep)
    union all select 'item_search_src.id -> item', cast(id as varchar), cast(id as varchar) from item_search_src where id not in (select id from keep)
    union all select 'item_source_file.item_id -> item', cast(item_id as varchar), cast(item_id as varchar) from item_source_file where item_id not in (select id from keep)""")
def foreign_key_audit(spark, sf):
    """Q5: every tenth item removed leaves orphans in the other tables."""
    lib = star.library(spark, sf)
    return audit.foreign_key_violations(with_tables(lib, item=lib["item"].filter("id % 10 <> 0")))


@query("combine_key_audit", """
    select 'merge_group_member.merge_group_id -> merge_group' as "check", cast(event_id as varchar) as key, cast(event_id // 10 as varchar) detail from events where event_id % 10 = 3 and event_id // 10 % 4 = 0
    union all select 'merge_group_member.page_id -> page', cast(event_id as varchar), cast(-event_id as varchar) from events where event_id % 10 = 3 and event_id % 7 = 0
    union all select 'custom_field_value.item_id -> item', cast(-event_id as varchar), cast(-event_id as varchar) from events where event_id % 10 = 5
    union all select 'split_group.origin_page_id -> page', cast(id as varchar), '-1' from split_group where id % 5 = 0""")
def combine_key_audit(spark, sf):
    """Q5: journal rows without their combine or page, field values without their item, groups that cite a missing page."""
    lib = star.library(spark, sf)
    k = F.col("event_id")
    event = star.read(spark, sf, "events").filter(k % 10 == 3)
    number = F.call_function("div", k, F.lit(10))
    first = F.lit(lib["page"].agg(F.min("id")).first()[0])
    member = event.select(
        k.alias("id"), number.alias("merge_group_id"), F.when(k % 7 == 0, -k).otherwise(first).alias("page_id"))
    item = F.lit(lib["item"].agg(F.min("id")).first()[0])
    group = event.filter(number % 4 != 0).select(number.alias("id"), item.alias("result_item_id"))
    field = star.read(spark, sf, "events").filter(k % 10 == 5)
    value = field.select((-k).alias("item_id"), k.alias("def_id"))
    groups = lib["split_group"].withColumn("origin_page_id", F.when(F.col("id") % 5 == 0, F.lit(-1).cast("bigint")))
    broken = with_tables(
        lib, merge_group=shaped(group, "merge_group"), merge_group_member=shaped(member, "merge_group_member"), split_group=groups,
        custom_field_value=shaped(value, "custom_field_value"), custom_field_def=shaped(field.select(k.alias("id")), "custom_field_def"))
    return audit.foreign_key_violations(broken)


@query("purged_combines", """
    with gone as (select id from item where trashed_at is not null and not (split_role = 'origin' and exists (
        select 1 from item c where c.split_group_id = item.split_group_id and c.split_role = 'child' and c.trashed_at is null)))
    select 'group' kind, p.id from page p where id % 6 = 1 and item_id not in (select id from gone)
    union all select 'member', p.id from page p where id % 6 = 1 and item_id not in (select id from gone)""")
def purged_combines(spark, sf):
    """Combines of purged items go, with the journal rows of their pages."""
    lib = star.library(spark, sf)
    sixth = lib["page"].filter("id % 6 = 1")
    group = sixth.select("id", F.col("item_id").alias("result_item_id"))
    member = sixth.select("id", F.col("id").alias("merge_group_id"), F.col("id").alias("page_id"))
    rest = maintain.empty_trash(with_tables(lib, merge_group=shaped(group, "merge_group"), merge_group_member=shaped(member, "merge_group_member")))[0]
    return rest["merge_group"].select(F.lit("group").alias("kind"), "id").unionByName(
        rest["merge_group_member"].select(F.lit("member").alias("kind"), "id"))


@query("trash_folder_audit", DAMAGED + """ select 'item in trash folder' as "check", cast(id as varchar) as key, '901' detail from di where folder_id = 901""")
def trash_folder_audit(spark, sf):
    """Q7"""
    return audit.items_in_trash_folder(_damaged(spark, sf))


@query("child_currency_audit", DAMAGED + """
    select 'child currency' as "check", cast(i.id as varchar) as key, dr.currency || ' is not ' || g.currency detail
    from di i join split_group g on g.id = i.g join dr on dr.item_id = i.id where i.role = 'child' and dr.currency <> g.currency""")
def child_currency_audit(spark, sf):
    """Q8"""
    return audit.child_currency_violations(_damaged(spark, sf))


@query("merge_split_audit", """
    select 'combined and split' as "check", cast(id as varchar) as key, split_role detail from item where split_group_id is not null and id < 10000000000000 and id % 2 = 0""")
def merge_split_audit(spark, sf):
    """Q6: even receipts journaled as combine results although some are split."""
    lib = star.library(spark, sf)
    group = lib["item"].filter("id < 10000000000000 AND id % 2 = 0").select(F.col("id"), F.col("id").alias("result_item_id"))
    return audit.merge_split_overlaps(with_tables(lib, merge_group=group))


@query("content_hash_audit", """
    select 'images/' || sha256(case when doc_id % 10 = 0 then text || '!' else text end) || '.txt' as path, doc_id % 10 <> 0 and doc_id % 7 <> 0 ok,
      case when doc_id % 7 = 0 then 'missing' when doc_id % 10 = 0 then 'hash mismatch' end reason from documents""")
def content_hash_audit(spark, sf):
    """Q10: names against bytes; some bytes are missing, some changed."""
    d = star.read(spark, sf, "documents")
    k = F.col("doc_id")
    named = F.when(k % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    files = d.select(
        F.concat(F.lit("images/"), F.sha2(named, 256), F.lit(".txt")).alias("path"), F.when(k % 7 != 0, F.col("text").cast("binary")).alias("content"))
    return audit.content_hash_check(files)


@query("system_folder_audit", """
    select 'one system folder per kind' as "check", 'inbox' as key, cast(count(*) + 1 as varchar) detail from region""")
def system_folder_audit(spark, sf):
    """Q11: region roots turned into inboxes."""
    lib = star.library(spark, sf)
    folder = lib["folder"].withColumn("kind", F.when(F.col("parent_id").isNull() & (F.col("kind") == "user"), "inbox").otherwise(F.col("kind")))
    return audit.system_folder_violations(with_tables(lib, folder=folder))
