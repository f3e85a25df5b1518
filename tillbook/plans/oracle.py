"""DuckDB twins of the library tables, used only to check the Spark results.

``with_library(sql)`` prefixes a query with the common table expressions it mentions.
"""

from __future__ import annotations

import re

PRICE = "cast(round(l_extendedprice * 100) as bigint)"
LETTERS = "translate(cast({0} as varchar), '0123456789', 'abcdefghij')"

TABLES: dict[str, str] = {
    "nations": "select n_nationkey, n_name, n_regionkey from nation",
    "folder": """
        select cast(1 + r_regionkey as bigint) id, cast(null as bigint) parent_id, 'user' kind, r_name as name, cast(r_regionkey as int) sort_order from region
        union all select 100 + n_nationkey, 1 + n_regionkey, 'user', n_name, n_nationkey % 3 from nation
        union all select 900, null, 'inbox', 'Inbox', -1
        union all select 901, null, 'trash', 'Trash', 99""",
    "vendor": f"""
        select 1 + s_suppkey as id,
          {LETTERS.format('s_suppkey')} || ' Trading' || ['', ' #12', ' Inc.', ' Store 7'][cast(s_suppkey % 4 as int) + 1] as name,
          {LETTERS.format('s_suppkey')} || ' trading' as normalized_name,
          case when s_suppkey % 3 = 0 then 1 + s_suppkey % 5 end as default_category_id,
          s_suppkey % 2 = 0 as is_seed
        from supplier""",
    "category": "select * from (values (1,'AUTOMOBILE'),(2,'BUILDING'),(3,'FURNITURE'),(4,'HOUSEHOLD'),(5,'MACHINERY')) v(id, name)",
    "tax_category": "select * from (values (1,'Standard'),(2,'Reduced')) v(id, name)",
    "payment_type": "select * from (values (1,'Visa'),(2,'Mastercard'),(3,'Cash'),(4,'Debit Card'),(5,'Check')) v(id, name)",
    "project": "select * from (values (1,'Job-1'),(2,'Job-2'),(3,'Job-3')) v(id, name)",
    "base_tax": f"""
        select item_id * 16 + rate as id, item_id, ['GST','HST','PST','VAT','Sales Tax'][rate % 5 + 1] as label,
          rate * 100 as rate_bp, amount_minor, cast(1 + rate % 2 as bigint) as tax_category_id
        from (select l_orderkey item_id, cast(round(l_tax * 100) as int) rate,
                cast(sum(({PRICE} * (100 - cast(round(l_discount * 100) as bigint)) * cast(round(l_tax * 100) as int) + 5000) // 10000) as bigint) amount_minor
              from lineitem group by 1, 2)""",
    "order_tax": "select item_id, cast(sum(amount_minor) as bigint) tax from base_tax group by 1",
    "order_vendor": "select l_orderkey, min(l_suppkey) supp from lineitem group by 1",
    "extraction": """
        select event_id as item_id, case when event_id % 50 = 0 then '{bad' else
          '{"total":{"value":"' || k || '","confidence":0.' || lpad(cast(k as varchar), 2, '0') || ',"pinned":' ||
          case when event_type = 'purchase' then 'true' else 'false' end || '},"vendor":{"confidence":0.' ||
          lpad(cast(k * 7 % 100 as varchar), 2, '0') || '},"description":{"confidence":0.10}}' end as extraction_json
        from (select event_id, event_type, cast(json_extract_string(props, '$.k') as int) k from events)""",
    "base_item": """
        select o_orderkey as id, case when o_orderkey % 7 = 0 then 900 else 100 + coalesce(c_nationkey, 0) end as folder_id,
          'receipt' as type,
          case when o_orderstatus <> 'O' then epoch_ms(cast(o_orderdate as timestamp)) + 86400000 end as reviewed_at,
          case when o_orderkey % 29 = 0 then epoch_ms(cast(o_orderdate as timestamp)) + 172800000 end as trashed_at,
          epoch_ms(cast(o_orderdate as timestamp)) as created_at
        from orders left join customer on o_custkey = c_custkey
        union all select 20000000000000 + doc_id, 900, 'document', null,
          case when doc_id % 37 = 0 then 1600000000000 + doc_id * 60000 + 86400000 end, 1600000000000 + doc_id * 60000 from documents
        union all select 30000000000000 + c_custkey, 100 + c_nationkey, 'contact', 1600000000000, null, 1600000000000 from customer""",
    "base_receipt": """
        select o_orderkey as item_id,
          case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) end as txn_date,
          1 + supp as vendor_id,
          case when o_orderkey % 13 <> 0 then cast(round(o_totalprice * 100) as bigint) end as total_minor,
          ['USD','CAD','EUR','GBP','AUD'][coalesce(n_regionkey, 0) + 1] as currency,
          cast(substr(o_orderpriority, 1, 1) as bigint) as payment_type_id,
          case when o_orderkey % 19 <> 0 then tax end as tax_total_minor,
          case when o_orderkey % 11 <> 0 then list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) end as category_id,
          case when o_orderkey % 5 <> 0 then 1 + o_orderkey % 2 end as tax_category_id,
          case when o_orderkey % 10 = 0 then 1 + o_orderkey % 3 end as project_id,
          'INV-' || o_orderkey as external_ref, cast(null as varchar) as description, extraction_json
        from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
        left join order_vendor on l_orderkey = o_orderkey
        left join extraction x on x.item_id = o_orderkey left join order_tax t on t.item_id = o_orderkey""",
    "split_part": f"""
        select l_orderkey item_id, {PRICE} w, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
          row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) ord,
          count(*) over (partition by l_orderkey) n, sum({PRICE}) over (partition by l_orderkey) ws
        from lineitem join orders on o_orderkey = l_orderkey
        where o_orderstatus = 'P' and o_orderkey % 29 <> 0 and o_orderkey % 13 <> 0""",
    "origin": """
        select item_id, row_number() over (order by item_id) as group_id, any_value(total_minor) total_minor,
          any_value(coalesce(tax_total_minor, tax)) origin_tax, any_value(tax) line_sum, any_value(currency) currency
        from split_part join base_receipt using (item_id) left join order_tax using (item_id) where n >= 2 group by item_id""",
    "part_share": """
        select *, (select max(id) from base_item) + row_number() over (order by item_id, ord) as child_id,
          total_base + case when row_number() over (partition by item_id order by total_rem desc, ord) <= total_minor - sum(total_base) over (partition by item_id) then 1 else 0 end as total_share,
          tax_base + case when row_number() over (partition by item_id order by tax_rem desc, ord) <= origin_tax - sum(tax_base) over (partition by item_id) then 1 else 0 end as tax_share
        from (select p.item_id, p.ord, p.w, p.ws, group_id, total_minor, origin_tax, line_sum, currency,
                (cast(total_minor as hugeint) * w) // ws total_base, (cast(total_minor as hugeint) * w) % ws total_rem,
                (cast(origin_tax as hugeint) * w) // ws tax_base, (cast(origin_tax as hugeint) * w) % ws tax_rem
              from split_part p join origin using (item_id))""",
    "line_share": """
        select line_id, label, rate_bp, tax_category_id, child_id,
          base + case when row_number() over (partition by line_id order by rem desc, ord) <= amount_minor - sum(base) over (partition by line_id) then 1 else 0 end as amount
        from (select t.id line_id, t.label, t.rate_bp, t.tax_category_id, t.amount_minor, child_id, ord,
                (cast(amount_minor as hugeint) * w) // ws base, (cast(amount_minor as hugeint) * w) % ws rem
              from base_tax t join part_share using (item_id))""",
    "item": """
        select b.id, b.folder_id, b.type, o.group_id as split_group_id, case when o.group_id is not null then 'origin' end as split_role,
          case when o.group_id is not null then 1600000000000 end as superseded_at, b.reviewed_at, b.trashed_at, b.created_at,
          case when o.group_id is not null then 1600000000000 else b.created_at end as modified_at
        from base_item b left join origin o on o.item_id = b.id
        union all select child_id, folder_id, 'receipt', group_id, 'child', null, null,
          case when child_id % 31 = 0 then 1600086400000 end, 1600000000000, 1600000000000
        from part_share s join base_item b on b.id = s.item_id""",
    "receipt_data": """
        select item_id, txn_date, vendor_id, total_minor, currency, payment_type_id, tax_total_minor, category_id, tax_category_id,
          project_id, external_ref, description, extraction_json from base_receipt
        union all select child_id, txn_date, vendor_id, cast(total_share as bigint), r.currency, payment_type_id,
          cast(case when line_sum = origin_tax then line_tax else tax_share end as bigint), category_id, tax_category_id, project_id, external_ref, description, null
        from part_share s join base_receipt r using (item_id)
        left join (select child_id, sum(amount) line_tax from line_share group by 1) using (child_id)""",
    "receipt_tax_line": """
        select id, item_id, label, rate_bp, amount_minor, tax_category_id from base_tax
        union all select (select max(id) from base_tax) + row_number() over (order by child_id, line_id), child_id, label, rate_bp, cast(amount as bigint), tax_category_id from line_share""",
    "split_group": """
        select group_id as id, o.item_id as origin_item_id, case when n = 1 then pid end as origin_page_id, total_minor as origin_total_minor,
          cast(origin_tax as bigint) as origin_tax_minor, currency, 1600000000000 as created_at
        from origin o left join (select item_id, count(*) n, min(id) pid from page group by 1) using (item_id)""",
    "document_data": "select 20000000000000 + doc_id item_id, source title, case when doc_id % 2 = 0 then cast(date '2020-01-01' + cast(doc_id % 1000 as int) as date) end doc_date, lang notes from documents",
    "contact_data": f"""select 30000000000000 + c_custkey item_id, 'Customer' first_name, {LETTERS.format('c_custkey')} last_name, n_name org, c_mktsegment title,
          '["c' || c_custkey || '@example.com"]' emails_json from customer join nation on c_nationkey = n_nationkey""",
    "page": """
        select (conv_id * 2147483648 + turn) * 2 + 1 as id, conv_id as item_id, turn + 1 as seq,
          'images/' || conv_id || '-' || turn || '.jpg' file_relpath,
          case when turn % 3 <> 0 then 'thumbs/' || conv_id || '-' || turn || '.jpg' end thumb_relpath,
          sha256(text) content_hash, 0 as rotation,
          case (conv_id + turn) % 11 when 0 then 'failed' when 1 then 'pending' else 'done' end ocr_status,
          case when (conv_id + turn) % 11 > 1 then text end ocr_text,
          case when (conv_id + turn) % 11 > 1 then (turn % 10) / 10.0 end ocr_conf, 1 as ocr_generation
        from conversations
        union all select doc_id * 2, 20000000000000 + doc_id, 1, 'images/d' || doc_id || '.png', null, sha256(text), 0, 'done', text, 0.9, 1 from documents""",
    "item_source_file": "select 20000000000000 + doc_id item_id, sha256(text) source_sha256, 'inbox/' || source || '/' || doc_id || '.txt' source_relpath, doc_id || '.txt' original_name from documents",
    "rule": """
        select id, case when id % 9 = 0 then 'id' when id % 9 = 3 then 'norm' else 'name' end as kind, normalized_name, 1 + id % 5 as category_id,
          100 as priority, id % 4 <> 0 as enabled from vendor where id % 3 = 0""",
    "item_search_src": """
        select r.item_id id, v.name vendor, description, cast(null as varchar) notes, cast(null as varchar) title, cast(null as varchar) org
        from receipt_data r left join vendor v on v.id = r.vendor_id
        union all select item_id, null, null, notes, title, null from document_data
        union all select item_id, null, null, null, title, org from contact_data""",
    "v_summable": """
        select r.*, i.folder_id, i.split_group_id, i.reviewed_at, i.created_at from receipt_data r join item i on i.id = r.item_id
        where i.trashed_at is null and i.superseded_at is null and i.type = 'receipt'""",
    "v_item_pages": """
        select p.item_id, p.id page_id, seq, file_relpath, thumb_relpath, content_hash, false via_split from page p join item i on i.id = p.item_id
        union all select c.id, p.id, seq, file_relpath, thumb_relpath, content_hash, true
        from item c join split_group g on g.id = c.split_group_id and c.split_role = 'child'
        join page p on p.item_id = g.origin_item_id and (g.origin_page_id is null or p.id = g.origin_page_id)""",
    "v_tax": "select t.id tax_line_id, t.item_id, v.folder_id, v.currency, t.label, t.rate_bp, t.tax_category_id, t.amount_minor from receipt_tax_line t join v_summable v on v.item_id = t.item_id",
    "v_recon": """
        select g.id split_group_id, g.origin_item_id, g.origin_total_minor, g.origin_tax_minor, g.currency, count(c.id) child_count,
          cast(coalesce(sum(r.total_minor), 0) as bigint) children_total_minor,
          cast(coalesce(sum(r.total_minor), 0) - g.origin_total_minor as bigint) drift_minor,
          cast(coalesce(sum(r.tax_total_minor), 0) as bigint) children_tax_minor,
          cast(coalesce(sum(r.tax_total_minor), 0) - coalesce(g.origin_tax_minor, 0) as bigint) tax_drift_minor,
          cast(coalesce(sum(case when r.currency <> g.currency then 1 else 0 end), 0) as bigint) currency_mismatch_count
        from split_group g left join item c on c.split_group_id = g.id and c.split_role = 'child' and c.trashed_at is null
        left join receipt_data r on r.item_id = c.id
        group by g.id, g.origin_item_id, g.origin_total_minor, g.origin_tax_minor, g.currency""",
    "v_missing": """
        select item_id, folder_id, vendor_id is null missing_vendor, txn_date is null missing_date, total_minor is null missing_total,
          category_id is null missing_category, tax_category_id is null missing_tax_category from v_summable
        where vendor_id is null or txn_date is null or total_minor is null or category_id is null or tax_category_id is null""",
    "page_rollup": """
        select item_id, count(*) filter (where ocr_status = 'failed') ocr_failed, count(*) filter (where ocr_status in ('pending','queued','running')) ocr_pending,
          count(*) filter (where ocr_status = 'done') ocr_done, count(*) n_pages, min(ocr_conf) ocr_min_conf from page group by 1""",
    "thumbs": """
        select item_id, thumb from (select item_id, coalesce(thumb_relpath, file_relpath) thumb, row_number() over (partition by item_id order by seq, page_id) rn from v_item_pages) where rn = 1""",
    "flagged": """
        select *, case when known = 0 then 'none' when ocr_failed > 0 then 'failed' when ocr_pending > 0 then 'pending' else 'done' end ocr_status,
          manual as needs_manual_entry, manual or missing_data as needs_review
        from (
          select i.id as item_id, i.folder_id, i.type, i.split_role, i.superseded_at, i.reviewed_at, i.trashed_at, i.created_at, i.modified_at,
            r.item_id is not null has_receipt, r.txn_date, r.vendor_id, r.total_minor, r.currency, r.payment_type_id, r.tax_total_minor, r.category_id,
            r.tax_category_id, r.project_id, r.external_ref, r.description, r.extraction_json,
            p.ocr_failed, p.ocr_pending, p.ocr_done, p.n_pages, p.ocr_min_conf, coalesce(p.ocr_failed + p.ocr_pending + p.ocr_done, 0) known,
            m.item_id is not null in_missing_view, m.missing_vendor, m.missing_date, m.missing_total, m.missing_category, m.missing_tax_category,
            coalesce(m.missing_vendor or m.missing_date or m.missing_total, false) missing_data,
            coalesce(p.ocr_failed > 0, false) or coalesce(p.ocr_min_conf < 0.3, false) or (i.type = 'receipt' and p.item_id is not null and r.total_minor is null) manual,
            concat_ws(',', case when json_valid(extraction_json) and cast(json_extract(extraction_json, '$.total.confidence') as double) < 0.5 then 'total' end,
              case when json_valid(extraction_json) and cast(json_extract(extraction_json, '$.vendor.confidence') as double) < 0.5 then 'vendor' end) low_confidence_fields
          from item i left join receipt_data r on r.item_id = i.id left join page_rollup p on p.item_id = i.id left join v_missing m on m.item_id = i.id)""",
    "grid": """
        select f.*, v.name vendor_name, c.name category_name, p.name payment_type_name, t.thumb thumb_relpath, t.item_id is not null has_images,
          case when type <> 'receipt' then '' when in_missing_view then concat_ws(',', case when missing_vendor then 'vendor' end, case when missing_date then 'txnDate' end, case when missing_total then 'total' end)
            when has_receipt then concat_ws(',', case when v.name is null then 'vendor' end, case when txn_date is null then 'txnDate' end, case when total_minor is null then 'total' end, case when c.name is null then 'category' end)
            else '' end missing_fields
        from flagged f left join vendor v on v.id = f.vendor_id left join category c on c.id = f.category_id left join payment_type p on p.id = f.payment_type_id
        left join thumbs t on t.item_id = f.item_id""",
    "subtree_2": "select id as folder_id from folder where id = 2 or parent_id = 2",
}


def with_library(sql: str) -> str:
    """Prefix the definitions a query uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in TABLES.items():
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text, re.IGNORECASE):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} as materialized ({TABLES[name].strip()})" for name in needed)
    stripped = sql.strip()
    if stripped.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {stripped[len('with recursive '):]}"
    if stripped.lower().startswith("with "):
        return f"with {ctes}, {stripped[len('with '):]}"
    return f"with {ctes} {stripped}"
