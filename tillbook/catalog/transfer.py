"""Imports, listings, vCards, exports, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import export, ingest, maintain
from tillbook.operators.export import ExportRequest
from tillbook.operators.search import SearchQuery
from tillbook.plans.scale import number_rows
from tillbook.schemas import empty
from tillbook.session import shared_dir
from tillbook.sources import files as f
from tillbook.sources import star

EXTS = ["jpg", "JPEG", "pdf", "vcf", "png", "docx", "txt"]
PATH_SQL = """'in/' || source || '/' || case when doc_id % 31 = 0 then '.cache/' else '' end || 'f' || doc_id ||
    case when doc_id % 29 = 0 then '' else '.' || ['jpg','JPEG','pdf','vcf','png','docx','txt'][doc_id % 7 + 1] end"""


def _files(spark, sf):
    """Every document as a file of some type; its text is the content."""
    k = F.col("doc_id")
    path = F.concat(
        F.lit("in/"), "source", F.lit("/"), F.when(k % 31 == 0, ".cache/").otherwise(""), F.lit("f"), k.cast("string"),
        F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("."), star.pick(EXTS, k % 7))))
    return star.read(spark, sf, "documents").select(
        "doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"),
        F.when(k % 23 == 0, "corrupt or unreadable image").alias("failed"))


@query("importable_files", f"""
    with p as (select {PATH_SQL} path, doc_id from documents)
    select path, doc_id from p where doc_id % 31 <> 0 and doc_id % 29 <> 0 and doc_id % 7 <= 4 order by path""")
def importable_files(spark, sf):
    """S2"""
    return f.importable(_files(spark, sf).select("path", "doc_id"), "in")


@query("unsupported_files", "select count(*) filter (where doc_id % 31 <> 0 and (doc_id % 29 = 0 or doc_id % 7 > 4)) skipped_unsupported from documents")
def unsupported_files(spark, sf):
    return f.unsupported_count(_files(spark, sf), "in")


def _import(spark, sf):
    """Half of the documents are in the library already; all of them arrive as files."""
    lib = star.library(spark, sf)
    lib["item_source_file"] = lib["item_source_file"].filter("item_id % 2 = 0")
    return ingest.import_batch(lib, _files(spark, sf), star.NOW)


IMPORT = f"""
    with fl as (select doc_id, {PATH_SQL} path, sha256(text) sha256, case when doc_id % 29 = 0 then '(none)' else lower(['jpg','JPEG','pdf','vcf','png','docx','txt'][doc_id % 7 + 1]) end ext from documents),
    good as (select * from fl where ext not in ('(none)', 'docx', 'txt') and doc_id % 23 <> 0),
    known as (select sha256(text) sha256, min(20000000000000 + doc_id) existing from documents where doc_id % 2 = 0 group by 1),
    first as (select sha256, min(path) path from good group by 1),
    fresh as (select path, sha256, (select max(id) from item) + row_number() over (order by path) item_id from first where sha256 not in (select sha256 from known))"""


@query("import_created", IMPORT + " select path, item_id, sha256 from fresh")
def import_created(spark, sf):
    """New content only, one item per content."""
    return _import(spark, sf)[1].select("path", "item_id", "sha256")


@query("import_duplicates", IMPORT + """
    select g.path, coalesce(k.existing, fr.item_id) existing_item_id from good g left join known k using (sha256) left join fresh fr using (sha256)
    where k.existing is not null or fr.path <> g.path""")
def import_duplicates(spark, sf):
    """Found in the library, or earlier in the batch."""
    return _import(spark, sf)[2]


@query("import_rejected", IMPORT + """
    select path, case when ext in ('(none)', 'docx', 'txt') then 'unsupported file type: .' || ext else 'corrupt or unreadable image' end reason from fl
    where ext in ('(none)', 'docx', 'txt') or doc_id % 23 = 0""")
def import_rejected(spark, sf):
    return _import(spark, sf)[3]


@query("import_pages", IMPORT + """
    select item_id, 1 seq, 'images/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.' || case when lower(regexp_extract(path, '[^.]*$')) = 'jpeg' then 'jpg' else lower(regexp_extract(path, '[^.]*$')) end file_relpath
    from fresh where not ends_with(path, '.vcf')""")
def import_pages(spark, sf):
    """Pages of the new items at content-addressed paths."""
    lib, created, _, _ = _import(spark, sf)
    return lib["page"].join(created.select("item_id"), "item_id", "left_semi").select("item_id", "seq", "file_relpath")


def _import_whole(spark, sf, split_pages: bool):
    """All documents as files: card files with no, one or two cards, PDFs of one to four pages, one page in 41 unreadable."""
    k = F.col("doc_id")
    docs = _files(spark, sf)
    card = lambda i: F.concat(F.lit("BEGIN:VCARD\nFN:Ann "), F.chr(F.lit(65 + i)), k.cast("string"), F.lit("\nEMAIL:a"), k.cast("string"), F.lit("@example.com\nEND:VCARD\n"))
    texts = docs.filter("doc_id % 7 = 3").select(
        "path", F.when(k % 3 == 0, "nothing\n").when(k % 3 == 1, card(0)).otherwise(F.concat(card(0), card(1))).alias("text"))
    cards = f.contacts_of(f.parse_vcards(texts))
    pages = docs.filter("doc_id % 7 = 2").select("path", "sha256", k, F.explode(F.sequence(F.lit(1), (k % 4 + 1).cast("int"))).alias("page_no"))
    pages = pages.select("path", "page_no", F.sha2(F.concat("sha256", F.col("page_no").cast("string")), 256).alias("sha256"), (k % 41 == 0).alias("failed"))
    return ingest.import_batch(
        star.library(spark, sf), docs, star.NOW, skip_duplicates=False, cards=cards, pages=pages, split_pages=split_pages)


WHOLE = f"""
    with fl as (select doc_id, {PATH_SQL} path, sha256(text) sha256, case when doc_id % 29 = 0 then '(none)' else lower(['jpg','JPEG','pdf','vcf','png','docx','txt'][doc_id % 7 + 1]) end ext from documents),
    good as (select * from fl where ext not in ('(none)', 'docx', 'txt') and doc_id % 23 <> 0 and not (ext = 'vcf' and doc_id % 3 = 0) and not (ext = 'pdf' and doc_id % 41 = 0)),
    card as (select *, unnest(range(doc_id % 3)) as card_no from good where ext = 'vcf'),
    leaf as (select *, unnest(range(1, doc_id % 4 + 2)) as page_no from good where ext = 'pdf')"""


@query("imported_contacts", WHOLE + """
    select path, 'Ann' first_name, chr((65 + card_no)::int) || doc_id last_name, '["a' || doc_id || '@example.com"]' emails_json, split_part(path, '/', -1) original_name from card""")
def imported_contacts(spark, sf):
    """One contact for each card, with its side row and its source."""
    lib, created, _, _ = _import_whole(spark, sf, False)
    contact = lib["contact_data"].select("item_id", "first_name", "last_name", "emails_json")
    source = lib["item_source_file"].select("item_id", "original_name")
    return created.select("path", "item_id").join(contact, "item_id").join(source, "item_id").drop("item_id")


@query("imported_pages", WHOLE + """
    select path, 0 part, page_no seq, sha256(sha256 || page_no) content_hash from leaf
    union all select path, 0, 1, sha256 from good where ext not in ('pdf', 'vcf')""")
def imported_pages(spark, sf):
    """Multi-page files as items of pages 1..n."""
    lib, created, _, _ = _import_whole(spark, sf, False)
    return lib["page"].select("item_id", "seq", "content_hash").join(created.select("path", "part", "item_id"), "item_id").drop("item_id")


@query("imported_single_pages", WHOLE + """
    select path, page_no part, 1 seq, sha256(sha256 || page_no) content_hash from leaf
    union all select path, 0, 1, sha256 from good where ext not in ('pdf', 'vcf')""")
def imported_single_pages(spark, sf):
    """An item for every page."""
    lib, created, _, _ = _import_whole(spark, sf, True)
    return lib["page"].select("item_id", "seq", "content_hash").join(created.select("path", "part", "item_id"), "item_id").drop("item_id")


@query("import_faults", WHOLE + """
    select path, case when ext in ('(none)', 'docx', 'txt') then 'unsupported file type: .' || ext when doc_id % 23 = 0 then 'corrupt or unreadable image'
      when ext = 'vcf' then 'no vCard entries found' else 'a page could not be read' end reason from fl where doc_id not in (select doc_id from good)""")
def import_faults(spark, sf):
    """Unsupported, unreadable, without cards, with an unreadable page."""
    return _import_whole(spark, sf, False)[3]


@query("stored_blobs", f"""
    select sha256, 'images/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.' || case when e = 'jpeg' then 'jpg' else e end relpath
    from (select sha256(text) sha256, min(case when doc_id % 29 = 0 then '' else lower(['jpg','JPEG','pdf','vcf','png','docx','txt'][doc_id % 7 + 1]) end) e from documents group by 1)""")
def stored_blobs(spark, sf):
    """Identical bytes once."""
    return ingest.stored_blobs(_files(spark, sf))


@query("source_upsert", "select 20000000000000 + doc_id item_id, case when doc_id % 3 = 0 then 'new' || doc_id else sha256(text) end source_sha256 from documents union all select 20000000000000 + o_orderkey + 1000000000, 'extra' from orders")
def source_upsert(spark, sf):
    """Replaced and added rows."""
    lib = star.library(spark, sf)
    changed = lib["item_source_file"].withColumn("d", F.col("item_id") - star.DOCUMENT_BASE).filter("d % 3 = 0").withColumn(
        "source_sha256", F.concat(F.lit("new"), F.col("d").cast("string"))).drop("d")
    more = star.read(spark, sf, "orders").select(
        (star.DOCUMENT_BASE + F.col("o_orderkey") + 1000000000).alias("item_id"), F.lit("extra").alias("source_sha256"))
    return ingest.upsert_sources(lib, changed.unionByName(more, allowMissingColumns=True)).select("item_id", "source_sha256")


@query("combined_hashes", "select conv_id batch_id, sha256(string_agg(sha256(text), '' order by turn)) combined_sha256, count(*) n_pages from conversations group by 1")
def combined_hashes(spark, sf):
    """S6"""
    pages = star.read(spark, sf, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("seq"), F.sha2("text", 256).alias("sha256"))
    return ingest.combined_hashes(pages)


def _grouped(spark, sf):
    """Conversations as groups of page files, every fifth scanned twice; some hold an unreadable page, some a PDF, and a
    seventh is in the library already."""
    c = star.read(spark, sf, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    pages = c.select(
        k.alias("batch_id"), (t * 10).alias("seq"),
        F.concat(F.lit("scan/"), k.cast("string"), F.lit("-"), t.cast("string"), F.when((k % 17 == 3) & (t == 1), ".pdf").when(t % 3 == 2, ".JPEG").otherwise(".png")).alias("path"),
        F.sha2("text", 256).alias("sha256"), F.when((k % 13 == 2) & (t % 2 == 1), "corrupt or unreadable image").alias("failed"))
    again = pages.filter("batch_id % 5 = 0").withColumns({"batch_id": F.col("batch_id") + 1_000_000, "seq": F.col("seq") + 3})
    lib = star.library(spark, sf)
    own = ingest.combined_hashes(pages.filter("batch_id % 7 = 0")).select(
        (F.col("batch_id") + 50_000_000_000_000).alias("item_id"), F.col("combined_sha256").alias("source_sha256"))
    lib["item_source_file"] = lib["item_source_file"].unionByName(own, allowMissingColumns=True)
    return ingest.import_page_groups(lib, pages.unionByName(again), star.NOW)


GROUPS = """
    with c as (select conv_id, turn, sha256(text) sha256, 'scan/' || conv_id || '-' || turn || case when conv_id % 17 = 3 and turn = 1 then '.pdf' when turn % 3 = 2 then '.JPEG' else '.png' end path,
        case when conv_id % 17 = 3 and turn = 1 then 'only image pages can be combined, got .pdf' when conv_id % 13 = 2 and turn % 2 = 1 then 'corrupt or unreadable image' end reason from conversations),
    p as (select conv_id batch_id, * from c union all select conv_id + 1000000, * from c where conv_id % 5 = 0),
    bad as (select batch_id, min_by(reason, turn) filter (where reason is not null) reason from p group by 1 having count(reason) > 0),
    keyed as (select batch_id, conv_id, sha256(string_agg(sha256, '' order by turn)) k, count(*) n, min_by(path, turn) head, min_by(sha256, turn) head_sha from p where batch_id not in (select batch_id from bad) group by 1, 2),
    known as (select sha256(string_agg(sha256, '' order by turn)) k, min(50000000000000 + conv_id) existing from c where conv_id % 7 = 0 group by conv_id),
    fresh as (select *, (select max(id) from item) + row_number() over (order by batch_id) item_id from (select * from keyed where k not in (select k from known) qualify row_number() over (partition by k order by batch_id) = 1))"""


@query("grouped_items", GROUPS + """
    select batch_id, item_id, k combined_sha256, n n_pages, 900 folder_id, 'receipt' type, 'USD' currency, split_part(head, '/', -1) original_name,
      'images/' || substr(head_sha, 1, 2) || '/' || substr(head_sha, 3, 2) || '/' || head_sha || case when lower(head) like '%jpeg' then '.jpg' else '.png' end source_relpath from fresh""")
def grouped_items(spark, sf):
    """One item for each new group, with its side rows."""
    lib, created, _, _ = _grouped(spark, sf)
    item = lib["item"].select(F.col("id").alias("item_id"), "folder_id", "type")
    source = lib["item_source_file"].select("item_id", "source_sha256", "source_relpath", "original_name")
    joined = created.join(item, "item_id").join(lib["receipt_data"].select("item_id", "currency"), "item_id").join(source, "item_id")
    return joined.filter("source_sha256 = combined_sha256").drop("source_sha256")


@query("grouped_pages", GROUPS + """
    select f.item_id, row_number() over (partition by f.item_id order by turn) seq, (select max(id) from page) + row_number() over (order by f.item_id, turn) id, sha256 content_hash,
      'images/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || case when lower(path) like '%jpeg' then '.jpg' else '.png' end file_relpath from fresh f join p using (batch_id)""")
def grouped_pages(spark, sf):
    """Pages 1..N of the new items, in one numbering."""
    lib, created, _, _ = _grouped(spark, sf)
    page = lib["page"].select("item_id", "seq", "id", "content_hash", "file_relpath")
    return page.join(created.select("item_id"), "item_id", "left_semi")


@query("grouped_leftovers", GROUPS + """
    select g.batch_id, coalesce(w.existing, f.item_id) existing_item_id, null reason from keyed g left join (select k, min(existing) existing from known group by 1) w using (k) left join fresh f using (k) where f.batch_id is distinct from g.batch_id
    union all select batch_id, null, reason from bad""")
def grouped_leftovers(spark, sf):
    """Groups that the library or an earlier group has, and groups with a page that cannot be taken."""
    _, _, duplicates, rejected = _grouped(spark, sf)
    return duplicates.unionByName(rejected, allowMissingColumns=True)


def _paged(spark, sf):
    c = star.read(spark, sf, "conversations")
    return c.select(F.concat(F.lit("scan"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"), (F.col("turn") + 1).alias("page_no"),
                    F.sha2("text", 256).alias("sha256"), ((F.col("conv_id") * 3 + F.col("turn")) % 17 == 0).alias("failed"))


@query("paged_documents", """
    select 'scan' || conv_id || '.pdf' path, 1 item_no, turn + 1 seq, turn + 1 page_no, sha256(text) sha256 from conversations
    where conv_id not in (select conv_id from conversations where (conv_id * 3 + turn) % 17 = 0)""")
def paged_documents(spark, sf):
    """One item per file, all pages or none."""
    return ingest.paged_documents(_paged(spark, sf), split_pages=False)


@query("paged_documents_split", """
    select 'scan' || conv_id || '.pdf' path, turn + 1 item_no, 1 seq, turn + 1 page_no, sha256(text) sha256 from conversations
    where conv_id not in (select conv_id from conversations where (conv_id * 3 + turn) % 17 = 0)""")
def paged_documents_split(spark, sf):
    return ingest.paged_documents(_paged(spark, sf), split_pages=True)


@query("target_folders", "select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 then 100 + o_orderkey % 25 else 900 end target_id from orders")
def target_folders(spark, sf):
    """S8"""
    k = F.col("o_orderkey")
    req = star.read(spark, sf, "orders").select(k, (k % 2 != 0).alias("to_inbox"), F.when(k % 3 != 0, 100 + k % 25).alias("folder_id"))
    return ingest.target_folder(star.library(spark, sf), req).select("o_orderkey", "target_id")


@query("vcards", """
    select 'c' || c_custkey || '.vcf' path, 0 card_no, case c_custkey % 3 when 2 then c_name else 'First' || c_custkey end first_name,
      case c_custkey % 3 when 2 then null else 'Last;' || c_custkey end last_name, n_name org, 'a' || c_custkey || '@example.com,b@example.com' emails, '12 Long, Street ' || c_custkey || ', ' || n_name addresses,
      'line one' || chr(10) || 'line, two' notes
    from customer join nation on c_nationkey = n_nationkey
    union all select 'c' || c_custkey || '.vcf', 1, 'Solo', 'Card', null, '', '', null from customer""")
def vcards(spark, sf):
    """Folded lines, groups, parameters, escapes, a second card per file."""
    c = star.read(spark, sf, "customer").join(star.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey").cast("string")
    # A semicolon always separates name parts, escaped or not, so the last name is written with a colon.
    name = F.when(F.col("c_custkey") % 3 == 2, F.lit("N:;;;;")).otherwise(F.concat(F.lit("N:Last:"), i, F.lit(";First"), i, F.lit(";;;")))
    text = F.concat_ws(
        "\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), name, F.concat(F.lit("FN:"), "c_name"), F.concat(F.lit("ORG:"), "n_name", F.lit(";Unit")),
        F.concat(F.lit("item1.EMAIL;TYPE=work:a"), i, F.lit("@exam"), F.lit("\r\n ple.com")), F.lit("email:b@example.com"),
        F.concat(F.lit("ADR;TYPE=home:;;12 Long\\, Street "), i, F.lit(";"), "n_name", F.lit(";;;")), F.lit("NOTE:line one\\nline\\, two"), F.lit("END:VCARD"),
        F.lit("BEGIN:VCARD"), F.lit("FN:Solo Card"), F.lit("END:VCARD"), F.lit(""))
    cards = f.parse_vcards(c.select(F.concat(F.lit("c"), i, F.lit(".vcf")).alias("path"), text.alias("text")))
    return cards.select(
        "path", "card_no", "first_name", F.regexp_replace("last_name", ":", ";").alias("last_name"), "org", F.array_join("emails", ",").alias("emails"),
        F.array_join("addresses", ",").alias("addresses"), "notes")


def _sql_list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("seeded_lists", f"""
    select s_suppkey, {_sql_list(v for v, _ in f.SEED_VENDORS)}[s_suppkey % 87 + 1] vendor, {_sql_list(c for _, c in f.SEED_VENDORS)}[s_suppkey % 87 + 1] category,
      {_sql_list(n for n, _ in f.SEED_TAX_CATEGORIES)}[s_suppkey % 27 + 1] tax_category, {_sql_list(r for _, r in f.SEED_TAX_CATEGORIES)}[s_suppkey % 27 + 1] form_ref,
      {_sql_list(f.SEED_PAYMENT_TYPES)}[s_suppkey % 15 + 1] payment_type from supplier""")
def seeded_lists(spark, sf):
    """Every supplier given the seeds of its number; ids follow the order of the lists."""
    base = star.library(spark, sf)
    lib = f.apply_seed({**base, **{t: empty(spark, t) for t in ("vendor", "category", "tax_category", "payment_type")}}, star.NOW)
    category = lib["category"].select(F.col("id").alias("default_category_id"), F.col("name").alias("category"))
    vendor = lib["vendor"].join(category, "default_category_id", "left").select(F.col("id").alias("v"), F.col("name").alias("vendor"), "category")
    tax = lib["tax_category"].select(F.col("id").alias("t"), F.col("name").alias("tax_category"), "form_ref")
    payment = lib["payment_type"].select(F.col("id").alias("p"), F.col("name").alias("payment_type"))
    k = F.col("s_suppkey")
    s = star.read(spark, sf, "supplier").select("s_suppkey", (k % 87 + 1).alias("v"), (k % 27 + 1).alias("t"), (k % 15 + 1).alias("p"))
    return s.join(vendor, "v").join(tax, "t").join(payment, "p").drop("v", "t", "p")


@query("seeded_default_categories", """
    select s_suppkey, ['Materials','Fuel','Medical','Travel'][s_suppkey % 4 + 1] category from supplier""")
def seeded_default_categories(spark, sf):
    """Seed vendors resolved by receipts of every supplier."""
    from tillbook.operators.lists import resolve_vendors

    base = star.library(spark, sf)
    lib = f.apply_seed({**base, **{t: empty(spark, t) for t in ("vendor", "category", "tax_category", "payment_type")}}, star.NOW)
    printed = star.pick(["HOME DEPOT #4821", "chevron", "C.V.S", "Delta Airlines"], F.col("s_suppkey") % 4)
    printed = F.when(F.col("s_suppkey") % 4 == 2, "CVS Store 12").when(F.col("s_suppkey") % 4 == 3, "DeltaAir Lines").otherwise(printed)
    s = star.read(spark, sf, "supplier").select("s_suppkey", printed.alias("name"))
    table, mapping = resolve_vendors(lib, s.select("name"), star.NOW)
    vendor = mapping.join(table.select("id", "default_category_id"), "id").join(
        lib["category"].select(F.col("id").alias("default_category_id"), F.col("name").alias("category")), "default_category_id")
    return s.join(vendor.select("name", "category"), "name").select("s_suppkey", "category")


EXPORT = """
    with e as (select v.*, ve.name vendor, c.name category, tc.name tax_category, pt.name payment_type, pr.name project from v_summable v
      left join vendor ve on ve.id = v.vendor_id left join category c on c.id = v.category_id left join tax_category tc on tc.id = v.tax_category_id
      left join payment_type pt on pt.id = v.payment_type_id left join project pr on pr.id = v.project_id)"""


@query("csv_export", EXPORT + """
    select coalesce(cast(txn_date as varchar), '') txn_date, coalesce(vendor, '') vendor, coalesce(category, '') category, '' description,
      coalesce(case when total_minor < 0 then '-' else '' end || abs(total_minor) // 100 || '.' || lpad(cast(abs(total_minor) % 100 as varchar), 2, '0'), '') total, currency,
      coalesce(case when tax_total_minor < 0 then '-' else '' end || abs(tax_total_minor) // 100 || '.' || lpad(cast(abs(tax_total_minor) % 100 as varchar), 2, '0'), '') tax,
      coalesce(payment_type, '') payment_type, coalesce(project, '') project, external_ref, cast(item_id as varchar) item_id from e""")
def csv_export(spark, sf):
    """Written as CSV and read back."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    export.write_csv(star.library(spark, sf), ExportRequest(), path)
    back = spark.read.option("header", "true").option("quote", '"').option("escape", '"').csv(
        path, schema=", ".join(f"{c} string" for c in export.DEFAULT_COLUMNS))
    return back.na.fill("")


@query("csv_order", EXPORT + """
    select cast(item_id as varchar) item_id, row_number() over (order by currency, txn_date nulls last, item_id) as position from e""")
def csv_order(spark, sf):
    """The place of each row of the written CSV, file by file and line by line."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    export.write_csv(star.library(spark, sf), ExportRequest(None, ["item_id"]), path)
    # Lines as they lie in the files: the first of each file is its heading.
    at = F.col("_metadata.file_name")
    lines = spark.read.text(path).select(F.regexp_extract(at, r"part-(\d+)", 1).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("line"), "value")
    return number_rows(lines.filter("value <> 'item_id'"), ["file", "block", "line"], out="position").select(F.col("value").alias("item_id"), "position")


@query("csv_chosen_columns", EXPORT + """
    select coalesce(vendor, '') vendor, coalesce(case when total_minor < 0 then '-' else '' end || abs(total_minor) // 100 || '.' || lpad(cast(abs(total_minor) % 100 as varchar), 2, '0'), '') total from e
    where folder_id in (select folder_id from subtree_2) and reviewed_at is not null""")
def csv_chosen_columns(spark, sf):
    """Aliases, unknown columns ignored."""
    q = SearchQuery(folder_id=2, include_subfolders=True, reviewed=True)
    return export.csv_rows(star.library(spark, sf), ExportRequest(q, ["Vendor-Name", "nonsense", " amount "]))


@query("report_export", EXPORT + """
    select currency sheet, item_id, cast(total_minor as decimal(20,2)) / 100 total, cast(tax_total_minor as decimal(20,2)) / 100 tax, tax_category from e""")
def report_export(spark, sf):
    """Written per currency and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    export.write_report(star.library(spark, sf), ExportRequest(columns=["item_id", "total", "tax", "tax_category"]), path)
    return spark.read.parquet(f"{path}/rows").select("sheet", "item_id", "total", "tax", "tax_category")


@query("category_totals", EXPORT + """
    select currency, case when grouping(category) = 1 then null else coalesce(category, '(uncategorized)') end category, cast(sum(total_minor) as bigint) total_minor, grouping(category) = 1 is_total
    from (select currency, coalesce(category, '(uncategorized)') category, total_minor from e where total_minor is not null) group by grouping sets ((currency, category), (currency))""")
def category_totals(spark, sf):
    """A5"""
    return export.category_totals(star.library(spark, sf))


@query("export_sums", EXPORT + """ select currency, cast(coalesce(sum(total_minor), 0) as bigint) total_minor, count(*) item_count from e
    where txn_date between date '1996-01-01' and date '1998-12-31' and category_id = 2 group by 1""")
def export_sums(spark, sf):
    """A4"""
    return export.export_sums(star.library(spark, sf), SearchQuery(date_from="1996-01-01", date_to="1998-12-31", category_id=2))


@query("page_manifest", """
    select v.item_id, v.page_id, v.seq, v.file_relpath, v.via_split from v_item_pages v join item i on i.id = v.item_id where i.trashed_at is null""")
def page_manifest(spark, sf):
    """Explicit ids, live ones, pages through splits included."""
    lib = star.library(spark, sf)
    ids = lib["item"].select(F.col("id").alias("item_id"))
    return export.page_manifest(lib, export.export_item_ids(lib, None, ids)).select("item_id", "page_id", "seq", "file_relpath", "via_split")


@query("page_manifest_query", """
    select v.item_id, v.page_id, v.seq, v.file_relpath, v.via_split from v_item_pages v join v_summable s using (item_id) where s.category_id = 2 and s.total_minor >= 5000000""")
def page_manifest_query(spark, sf):
    """The pages of the receipts that a query finds, which are summable ones only."""
    lib = star.library(spark, sf)
    ids = export.export_item_ids(lib, SearchQuery(category_id=2, amount_min=5_000_000))
    return export.page_manifest(lib, ids).select("item_id", "page_id", "seq", "file_relpath", "via_split")


@query("backup_log_rows", """
    select 1 id, 'manual' kind, (select count(*) from item) items, (select count(*) from folder) folders, (select count(*) from page) pages,
      true bytes_agree, true files_agree, true root_agrees, 1700000000000 created_at""")
def backup_log_rows(spark, sf):
    """The row of a snapshot, against its manifest and the files that are there."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    lib, manifest = maintain.snapshot(star.library(spark, sf), path, star.NOW)
    sums = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    stated = lambda key: F.get_json_object("manifest_json", key).cast("bigint")
    return lib["backup_log"].withColumn("s", sums.select(F.struct("n", "b").alias("s")).scalar()).select(
        "id", "kind", stated("$.counts.items").alias("items"), stated("$.counts.folders").alias("folders"), stated("$.counts.pages").alias("pages"),
        ((F.col("size_bytes") == F.col("s.b")) & (stated("$.bytes") == F.col("s.b"))).alias("bytes_agree"), (stated("$.file_count") == F.col("s.n")).alias("files_agree"),
        (F.col("db_sha256") == maintain.root_hash(maintain.file_facts(spark, f"{path}/tables"))).alias("root_agrees"), "created_at")


@query("damaged_files", """
    select 'f' || doc_id relpath, case when doc_id % 10 = 0 then 'missing' else 'changed' end problem from documents where doc_id % 10 = 0 or doc_id % 7 = 0
    union all select 'x' || doc_id, 'unlisted' from documents where doc_id % 11 = 0""")
def damaged_files(spark, sf):
    """Each file that is missing, changed or not in the manifest."""
    k = F.col("doc_id")
    files = star.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), k.cast("string")).alias("relpath"), F.sha2("text", 256).alias("h"))
    actual = files.filter(k % 10 != 0).select("relpath", F.when(k % 7 == 0, "0").otherwise(F.col("h")).alias("have")).unionByName(
        files.filter(k % 11 == 0).select(F.concat(F.lit("x"), k.cast("string")).alias("relpath"), F.col("h").alias("have")))
    return maintain.damaged_files(files.select("relpath", F.col("h").alias("want")), actual)


@query("snapshot_checks", """
    select 'manifest files present' as name, true ok union all select 'manifest hashes match', true
    union all select 'rows of item', true union all select 'rows of folder', true union all select 'rows of page', true
    union all select 'foreign keys', true union all select 'split totals reconcile', count(*) filter (where child_count > 0 and drift_minor <> 0) = 0 from v_recon
    union all select 'split tax reconciles', count(*) filter (where child_count > 0 and tax_drift_minor <> 0) = 0 from v_recon
    union all select 'split currencies consistent', true union all select 'media paths are relative', true""")
def snapshot_checks(spark, sf):
    """Written, hashed, read back, compared."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    maintain.snapshot(star.library(spark, sf), path)
    return maintain.verify_snapshot(spark, path).select("name", "ok")


@query("manifest_comparison", """
    select 'manifest files present' as name, count(*) = 0 ok, case when count(*) = 0 then 'clean' else count(*) || ' file(s)' end detail from documents where doc_id % 10 = 0
    union all select 'manifest hashes match', count(*) = 0, case when count(*) = 0 then 'clean' else count(*) || ' file(s)' end from documents where doc_id % 10 <> 0 and doc_id % 7 = 0""")
def manifest_comparison(spark, sf):
    """Every tenth file lost, every seventh changed."""
    k = F.col("doc_id")
    listed = star.read(spark, sf, "documents").select(k.cast("string").alias("relpath"), F.sha2("text", 256).alias("want"))
    actual = star.read(spark, sf, "documents").filter(k % 10 != 0).select(
        k.cast("string").alias("relpath"), F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("have"))
    return maintain.compare_manifest(listed, actual)
