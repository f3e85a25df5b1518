"""Canonical views and table scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import canonical
from tillbook.sources import star


@query("totals_by_currency", """
    select currency, count(*) item_count, cast(sum(coalesce(total_minor, 0)) as bigint) total_minor,
      cast(sum(coalesce(tax_total_minor, 0)) as bigint) tax_minor, count(*) filter (where total_minor is null) missing_amount_count
    from v_summable group by currency""")
def totals_by_currency(spark, sf):
    from tillbook.operators.listing import totals_by_currency

    return totals_by_currency(star.library(spark, sf))


@query("table_scan_items", "select id, folder_id, type, split_group_id, split_role, superseded_at, reviewed_at, trashed_at, created_at, modified_at from item")
def table_scan_items(spark, sf):
    return star.library(spark, sf)["item"]


@query("table_scan_receipts", "select * from receipt_data")
def table_scan_receipts(spark, sf):
    return star.library(spark, sf)["receipt_data"]


@query("table_scan_tax_lines", "select id, item_id, label, rate_bp, amount_minor, tax_category_id from receipt_tax_line")
def table_scan_tax_lines(spark, sf):
    return star.library(spark, sf)["receipt_tax_line"]


@query("summable_receipts", """
    select item_id, folder_id, txn_date, vendor_id, total_minor, currency, tax_total_minor, category_id, tax_category_id,
      project_id, split_group_id, reviewed_at, created_at from v_summable""")
def summable_receipts(spark, sf):
    return canonical.summable_receipts(star.library(spark, sf))


@query("item_pages", "select item_id, page_id, seq, file_relpath, thumb_relpath, content_hash, via_split from v_item_pages")
def item_pages(spark, sf):
    return canonical.item_pages(star.library(spark, sf)).drop("rotation")


@query("page_links", """
    select id item_id, id owner_id, cast(null as bigint) page_id, false via_split from item
    union all select i.id, g.origin_item_id, g.origin_page_id, true from item i join split_group g on g.id = i.split_group_id where i.split_role = 'child'""")
def page_links(spark, sf):
    """V2 unexpanded: one row per item and one per split child, whatever the pages of an origin."""
    return canonical.page_links(star.library(spark, sf))


@query("summable_tax", "select tax_line_id, item_id, folder_id, currency, label, rate_bp, tax_category_id, amount_minor from v_tax")
def summable_tax(spark, sf):
    return canonical.summable_tax(star.library(spark, sf))


@query("folder_totals", """
    select folder_id, currency, count(*) item_count, cast(sum(coalesce(total_minor, 0)) as bigint) total_minor,
      cast(sum(coalesce(tax_total_minor, 0)) as bigint) tax_minor, count(*) filter (where total_minor is null) missing_amount_count,
      count(*) filter (where reviewed_at is null) unreviewed_count
    from v_summable group by folder_id, currency""")
def folder_totals(spark, sf):
    return canonical.folder_totals(star.library(spark, sf))


@query("split_reconciliation", "select * from v_recon")
def split_reconciliation(spark, sf):
    return canonical.split_reconciliation(star.library(spark, sf))


@query("searchable_pages", "select p.id page_id, p.item_id, i.folder_id, i.type from page p join item i on i.id = p.item_id where i.trashed_at is null")
def searchable_pages(spark, sf):
    return canonical.searchable_pages(star.library(spark, sf))


@query("missing_key_data", "select * from v_missing")
def missing_key_data(spark, sf):
    return canonical.missing_key_data(star.library(spark, sf))


@query("search_source", "select id, vendor, description, notes, title, org from item_search_src")
def search_source(spark, sf):
    return canonical.search_source(star.library(spark, sf))


@query("tax_by_label", """
    select currency, label, tax_category_id, cast(sum(amount_minor) as bigint) amount_minor, count(*) line_count
    from v_tax group by 1, 2, 3""")
def tax_by_label(spark, sf):
    """Tax is summed only through V3, per currency."""
    return (
        canonical.summable_tax(star.library(spark, sf))
        .groupBy("currency", "label", "tax_category_id")
        .agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("line_count"))
    )
