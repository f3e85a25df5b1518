"""Category rules (R3, W9), the rules step of the pipeline (R4), rule upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.checks import json_fields
from tillbook.functions.names import rule_norm
from tillbook.schemas import Library, shaped, with_tables

MATCH = "struct<vendorId:bigint,vendorNormalized:string,vendorName:string>"
ACTION = "struct<categoryId:bigint,category_id:bigint>"
RULE_CONFIDENCE = 0.9
DEFAULT_PRIORITY = 100


def best_rules(lib: Library) -> tuple[DataFrame, DataFrame]:
    """The first rule by (priority, id) per vendor id, and per normalised name.

    A rule may name its vendor in three ways and any of them matches, so the first rule
    of a candidate is the smaller of the two it finds here.  Each side has unique keys:
    the joins below never fan out, whatever the number of rules per vendor.
    """
    rules = (
        lib["rule"]
        .filter("enabled AND kind = 'vendor_to_category'")
        .withColumn("m", F.from_json("match_json", MATCH))
        .withColumn("a", F.from_json("action_json", ACTION))
        .withColumn("category_id", F.coalesce("a.categoryId", "a.category_id"))
        .filter("category_id IS NOT NULL")
        .withColumn("pick", F.struct("priority", F.col("id").alias("rule_id"), "category_id"))
    )
    by_id = rules.filter("m.vendorId IS NOT NULL").groupBy(F.col("m.vendorId").alias("vendor_id")).agg(
        F.min("pick").alias("by_id")
    )
    names = F.array_distinct(F.array_compact(F.array(F.col("m.vendorNormalized"), rule_norm(F.col("m.vendorName")))))
    by_name = (
        rules.withColumn("vendor_key", F.explode(names))
        .filter("vendor_key <> ''")
        .groupBy("vendor_key")
        .agg(F.min("pick").alias("by_name"))
    )
    return by_id, by_name


def apply_rules(lib: Library, candidates: DataFrame) -> DataFrame:
    """Proposed category per candidate, with the rule it came from.

    Candidates: item_id, vendor_id, vendor_name, category_id, category_pinned and, if known,
    vendor_normalized.  Without a matching rule the vendor's default category is proposed.
    """
    by_id, by_name = best_rules(lib)
    key = rule_norm(F.col("vendor_name"))
    if "vendor_normalized" in candidates.columns:
        key = F.coalesce("vendor_normalized", key)
    default = lib["vendor"].select(F.col("id").alias("vendor_id"), "default_category_id")
    open_rows = candidates.filter("category_id IS NULL AND NOT coalesce(category_pinned, false)").drop("category_id")
    return (
        open_rows.withColumn("vendor_key", F.when(key != "", key))
        .join(by_id, "vendor_id", "left")
        .join(by_name, "vendor_key", "left")
        .join(default, "vendor_id", "left")
        .withColumn("pick", F.least("by_id", "by_name"))
        .select(
            "item_id",
            F.coalesce("pick.category_id", "default_category_id").alias("category_id"),
            F.col("pick.rule_id").alias("rule_id"),
        )
        .filter("category_id IS NOT NULL")
    )


def put_fields(current: Column, changed: Column) -> Column:
    """Extraction record with some fields replaced; both are maps."""
    kept = F.map_filter(current, lambda name, _: ~F.map_contains_key(changed, name))
    return F.to_json(F.map_concat(kept, changed))


def receipt_candidates(lib: Library) -> DataFrame:
    vendor = lib["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    pinned = json_fields(F.col("extraction_json"))
    is_pinned = lambda f: F.coalesce(F.try_element_at(pinned, F.lit(f))["pinned"], F.lit(False))
    return (
        lib["receipt_data"]
        .join(vendor, "vendor_id", "left")
        .select(
            "item_id",
            "vendor_id",
            "vendor_name",
            "category_id",
            (is_pinned("category") | is_pinned("categoryId")).alias("category_pinned"),
        )
    )


def fill_categories(lib: Library) -> tuple[Library, DataFrame]:
    """Empty categories filled, provenance unpinned at 0.9, rule hits counted."""
    from tillbook.functions.checks import FIELD_RECORD

    proposals = apply_rules(lib, receipt_candidates(lib))
    names = lib["category"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    proposals = proposals.join(names, "category_id")
    new = proposals.select("item_id", F.col("category_id").alias("_cat"), "category_name")
    entry = F.create_map(
        F.lit("category"),
        F.struct(
            F.col("category_name").alias("value"),
            F.lit(RULE_CONFIDENCE).alias("confidence"),
            F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("bbox"),
            F.lit(None).cast("bigint").alias("pageId"),
            F.lit(False).alias("pinned"),
        ),
    ).cast(FIELD_RECORD)
    receipts = (
        lib["receipt_data"]
        .join(new, "item_id", "left")
        .withColumn(
            "extraction_json",
            F.when(F.col("_cat").isNotNull(), put_fields(json_fields(F.col("extraction_json")), entry)).otherwise(
                F.col("extraction_json")
            ),
        )
        .withColumn("category_id", F.coalesce("category_id", "_cat"))
    )
    hits = proposals.filter("rule_id IS NOT NULL").groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("_hits"))
    rules = lib["rule"].join(hits, "id", "left").withColumn(
        "hit_count", F.col("hit_count") + F.coalesce("_hits", F.lit(0))
    )
    return (
        with_tables(lib, receipt_data=shaped(receipts, "receipt_data"), rule=shaped(rules, "rule")),
        proposals.select("item_id", "category_id", "rule_id"),
    )


def list_rules(lib: Library) -> DataFrame:
    """Rules in the order they are tried."""
    return lib["rule"].orderBy("priority", "id")


def upsert_rules(lib: Library, changes: DataFrame, now: int) -> DataFrame:
    """Rules replaced by id; new ones get priority 100 unless they name one."""
    fresh = shaped(changes, "rule").withColumns(
        {
            "priority": F.coalesce("priority", F.lit(DEFAULT_PRIORITY)),
            "source": F.coalesce("source", F.lit("user")),
            "hit_count": F.coalesce("hit_count", F.lit(0).cast("bigint")),
            "enabled": F.coalesce("enabled", F.lit(True)),
            "created_at": F.coalesce("created_at", F.lit(now)),
        }
    )
    return lib["rule"].join(fresh, "id", "left_anti").unionByName(fresh)
