"""Exports: receipts as CSV or per-currency report, page manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.money import minor_to_decimal, minor_to_text
from tillbook.operators.canonical import item_pages, summable_receipts
from tillbook.operators.listing import in_folder
from tillbook.operators.search import SearchQuery
from tillbook.schemas import Library

# Column order, aliases, headings.
DEFAULT_COLUMNS = [
    "txn_date", "vendor", "category", "description", "total", "currency", "tax", "payment_type", "project", "external_ref", "item_id",
]
REPORT_COLUMNS = [*DEFAULT_COLUMNS, "tax_category", "folder_id"]
ALIASES = {
    "amount": "total", "total_minor": "total", "tax_total": "tax", "tax_total_minor": "tax",
    "vendor_name": "vendor", "category_name": "category",
}
HEADINGS = {
    "item_id": "Item ID", "txn_date": "Date", "vendor": "Vendor", "category": "Category", "tax_category": "Tax Category",
    "description": "Description", "total": "Total", "currency": "Currency", "tax": "Tax", "payment_type": "Payment",
    "project": "Project", "external_ref": "Reference", "folder_id": "Folder ID",
}
UNCATEGORIZED = "(uncategorized)"


@dataclass(frozen=True)
class ExportRequest:
    query: SearchQuery | None = None
    columns: list[str] | None = None


def export_filter(lib: Library, query: SearchQuery | None, item_ids: DataFrame | None = None) -> DataFrame:
    """Summable receipts that satisfy the request."""
    rows = summable_receipts(lib)
    if item_ids is not None:
        rows = rows.join(item_ids.select("item_id").distinct(), "item_id", "left_semi")
    if query is None:
        return rows
    c = F.col
    rows = in_folder(lib, rows, query.folder_id, query.include_subfolders)
    for value, test in (
        (query.vendor_id, lambda v: c("vendor_id") == v),
        (query.category_id, lambda v: c("category_id") == v),
        (query.tax_category_id, lambda v: c("tax_category_id") == v),
        (query.project_id, lambda v: c("project_id") == v),
        (query.date_from, lambda v: c("txn_date") >= F.lit(v).cast("date")),
        (query.date_to, lambda v: c("txn_date") <= F.lit(v).cast("date")),
        (query.amount_min, lambda v: c("total_minor") >= v),
        (query.amount_max, lambda v: c("total_minor") <= v),
        (query.reviewed, lambda v: c("reviewed_at").isNotNull() == F.lit(v)),
    ):
        if value is not None:
            rows = rows.filter(test(value))
    return rows


def export_rows(lib: Library, query: SearchQuery | None = None, item_ids: DataFrame | None = None) -> DataFrame:
    """One row per receipt with names instead of ids; money still in minor units."""
    rows = export_filter(lib, query, item_ids)
    more = lib["receipt_data"].select("item_id", "payment_type_id", "description", "external_ref")
    rows = rows.join(more, "item_id")
    for table, key, name in (
        ("vendor", "vendor_id", "vendor"),
        ("category", "category_id", "category"),
        ("tax_category", "tax_category_id", "tax_category"),
        ("payment_type", "payment_type_id", "payment_type"),
        ("project", "project_id", "project"),
    ):
        rows = rows.join(lib[table].select(F.col("id").alias(key), F.col("name").alias(name)), key, "left")
    return rows.select(
        "item_id", "folder_id", "txn_date", "vendor", "category", "tax_category", "description", "total_minor", "currency",
        "tax_total_minor", "payment_type", "project", "external_ref",
    )


def export_order() -> list[Column]:
    """X2"""
    return [F.col("currency").asc(), F.col("txn_date").asc_nulls_last(), F.col("item_id").asc()]


def resolve_columns(requested: list[str] | None, allowed: list[str], aliases: dict[str, str]) -> list[str]:
    """Known names and aliases in the order asked; nothing left means the default list."""
    keys = [c.strip().lower().replace("-", "_") for c in requested or []]
    picked = [k if k in allowed else aliases.get(k) for k in keys]
    return [k for k in picked if k] or list(DEFAULT_COLUMNS)


def csv_rows(lib: Library, request: ExportRequest) -> DataFrame:
    """Text cells of the CSV, ordered; missing values are empty."""
    cells = {"total": minor_to_text(F.col("total_minor")), "tax": minor_to_text(F.col("tax_total_minor"))}
    columns = resolve_columns(request.columns, DEFAULT_COLUMNS, ALIASES)
    rows = export_rows(lib, request.query).orderBy(*export_order())
    return rows.select(*[F.coalesce(cells.get(c, F.col(c)).cast("string"), F.lit("")).alias(c) for c in columns])


def write_csv(lib: Library, request: ExportRequest, path: str) -> None:
    """One header per file; the range-sorted order runs through the part files."""
    csv_rows(lib, request).write.mode("errorifexists").option("header", "true").option("quote", '"').option(
        "escape", '"').option("emptyValue", "").csv(path)


def report_rows(lib: Library, request: ExportRequest) -> DataFrame:
    """Typed cells; money as exact decimals made from integers at the end."""
    cells = {"total": minor_to_decimal(F.col("total_minor")), "tax": minor_to_decimal(F.col("tax_total_minor"))}
    columns = resolve_columns(request.columns, REPORT_COLUMNS, {})
    rows = export_rows(lib, request.query)
    return rows.select(F.col("currency").alias("sheet"), *[cells.get(c, F.col(c)).alias(c) for c in columns])


def category_totals(lib: Library, query: SearchQuery | None = None) -> DataFrame:
    """A5: totals per currency and category with the grand total per currency, in one pass."""
    rows = export_rows(lib, query).filter("total_minor IS NOT NULL").select(
        "currency", F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"), "total_minor")
    return rows.groupingSets([["currency", "category"], ["currency"]], "currency", "category").agg(
        F.sum("total_minor").alias("total_minor"), F.grouping("category").alias("is_total")
    ).select("currency", "category", "total_minor", (F.col("is_total") == 1).alias("is_total"))


def write_report(lib: Library, request: ExportRequest, path: str) -> None:
    """Rows in one folder per currency, category totals beside them."""
    rows = report_rows(lib, request)
    rows.repartitionByRange("sheet", *[c for c in ("txn_date", "item_id") if c in rows.columns]).write.mode(
        "errorifexists").partitionBy("sheet").parquet(f"{path}/rows")
    totals = category_totals(lib, request.query)
    totals.withColumn("total", minor_to_decimal(F.col("total_minor"))).write.mode("errorifexists").parquet(f"{path}/category_totals")


def export_sums(lib: Library, query: SearchQuery | None = None) -> DataFrame:
    """A4"""
    return export_filter(lib, query).groupBy("currency").agg(
        F.coalesce(F.sum("total_minor"), F.lit(0)).alias("total_minor"), F.count("*").alias("item_count"))


def export_item_ids(lib: Library, query: SearchQuery | None = None, item_ids: DataFrame | None = None) -> DataFrame:
    """Explicit ids allow any live item; a query means summable receipts only."""
    if item_ids is not None and query is None:
        live = lib["item"].filter("trashed_at IS NULL").select(F.col("id").alias("item_id"))
        return live.join(item_ids.select("item_id").distinct(), "item_id", "left_semi")
    return export_filter(lib, query, item_ids).select("item_id")


def page_manifest(lib: Library, item_ids: DataFrame) -> DataFrame:
    """Pages to embed, via split included, by item and page order."""
    size = lib["page"].select(F.col("id").alias("page_id"), "width", "height", "ocr_text")
    pages = item_pages(lib, item_ids)
    return pages.join(size, "page_id").orderBy("item_id", "seq", "page_id")
