"""Explicit schemas of the library tables; nothing is inferred on read."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "cabinet": "id bigint, display_name string, profile_json string, base_currency string, settings_json string, created_at bigint, modified_at bigint",
    "folder": "id bigint, parent_id bigint, kind string, name string, template string, period_end date, comments string, labels_json string, sort_order int, created_at bigint, modified_at bigint",
    "vendor": "id bigint, name string, normalized_name string, default_category_id bigint, is_seed boolean, created_at bigint",
    "category": "id bigint, name string, parent_id bigint, is_seed boolean, created_at bigint",
    "tax_category": "id bigint, name string, form_ref string, is_seed boolean, created_at bigint",
    "payment_type": "id bigint, name string, is_seed boolean, created_at bigint",
    "project": "id bigint, name string, client string, code string, is_seed boolean, created_at bigint",
    "item": "id bigint, folder_id bigint, type string, split_group_id bigint, split_role string, superseded_at bigint, reviewed_at bigint, trashed_at bigint, created_at bigint, modified_at bigint",
    "receipt_data": "item_id bigint, txn_date date, vendor_id bigint, total_minor bigint, currency string, payment_type_id bigint, tax_total_minor bigint, category_id bigint, tax_category_id bigint, project_id bigint, external_ref string, description string, extraction_json string",
    "receipt_tax_line": "id bigint, item_id bigint, label string, rate_bp int, amount_minor bigint, tax_category_id bigint",
    "document_data": "item_id bigint, title string, doc_date date, doc_type string, notes string",
    "contact_data": "item_id bigint, first_name string, last_name string, org string, title string, emails_json string, phones_json string, addresses_json string, url string, notes string",
    "page": "id bigint, item_id bigint, seq bigint, file_relpath string, thumb_relpath string, content_hash string, width int, height int, rotation int, ocr_status string, ocr_text string, ocr_conf double, ocr_engine string, ocr_words array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>,confidence:double>>, ocr_generation int, created_at bigint",
    "split_group": "id bigint, origin_item_id bigint, origin_page_id bigint, origin_total_minor bigint, origin_tax_minor bigint, currency string, created_at bigint",
    "merge_group": "id bigint, result_item_id bigint, created_at bigint",
    "merge_group_member": "id bigint, merge_group_id bigint, page_id bigint, pre_merge_item_id bigint, pre_merge_seq bigint, pre_merge_type string, snapshot_json string",
    "custom_field_def": "id bigint, scope string, key string, label string, datatype string, list_name string, required boolean, sort_order int",
    "custom_field_value": "item_id bigint, def_id bigint, value string",
    "rule": "id bigint, kind string, match_json string, action_json string, priority int, source string, hit_count bigint, enabled boolean, created_at bigint",
    "job": "id string, kind string, status string, total_units bigint, done_units bigint, failed_units bigint, detail_json string, error string, created_at bigint, updated_at bigint",
    "backup_log": "id bigint, kind string, path string, db_sha256 string, manifest_json string, size_bytes bigint, created_at bigint",
    "archive_log": "id bigint, path string, cutoff_date date, items_moved bigint, created_at bigint",
    "item_search_src": "id bigint, vendor string, description string, notes string, title string, org string",
    "item_source_file": "item_id bigint, source_sha256 string, source_relpath string, original_name string, created_at bigint",
}

# Tables whose rows belong to one item, with the column that names it.
ITEM_CHILDREN: dict[str, str] = {
    "receipt_data": "item_id",
    "receipt_tax_line": "item_id",
    "document_data": "item_id",
    "contact_data": "item_id",
    "page": "item_id",
    "custom_field_value": "item_id",
    "item_search_src": "id",
    "item_source_file": "item_id",
}

ALLOWED_VALUES: dict[tuple[str, str], list] = {
    ("item", "type"): ["receipt", "document", "contact"],
    ("item", "split_role"): ["origin", "child"],
    ("folder", "kind"): ["user", "inbox", "trash"],
    ("page", "rotation"): [0, 90, 180, 270],
    ("page", "ocr_status"): ["pending", "queued", "running", "done", "failed", "cancelled"],
    ("rule", "source"): ["seed", "user", "learned"],
    ("job", "kind"): ["import", "ocr", "export", "backup", "restore", "archive"],
    ("job", "status"): ["queued", "running", "done", "failed", "cancelled", "partial"],
    ("custom_field_def", "scope"): ["receipt", "document", "contact", "folder", "all"],
    ("custom_field_def", "datatype"): ["text", "number", "money", "date", "bool", "list"],
    ("backup_log", "kind"): ["manual", "scheduled"],
}

Library = dict[str, DataFrame]


@cache
def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def shaped(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order and type; absent ones are null, others are dropped."""
    return df.to(schema_of(table))


def with_tables(lib: Library, **changed: DataFrame) -> Library:
    """A new library version; the old one stays usable."""
    return {**lib, **changed}
