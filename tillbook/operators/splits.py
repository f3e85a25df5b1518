"""Split a receipt into parts that sum exactly (M5), dissolve (M6), split assertions (Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.functions.money import parse_money_text, trimmed
from tillbook.operators.alloc import allocate
from tillbook.operators.canonical import split_reconciliation
from tillbook.operators.lists import upsert_names
from tillbook.plans import scale
from tillbook.plans.scale import next_id, number_rows, rank_rows
from tillbook.schemas import Library, shaped, with_tables
from tillbook.session import packed, setting

# Parts of a split, one row each: which item, in which order, how much.
PART_COLUMNS = ["item_id", "ord", "amount_text", "weight", "category_name", "tax_category_name", "project_name", "description"]


def first_reason(*checks: tuple[Column, str | Column]) -> Column:
    """The first violated check, or null."""
    return F.coalesce(*[F.when(bad, F.lit(why) if isinstance(why, str) else why) for bad, why in checks])


# Weights are exact to a millionth below this.
MOST_WEIGHT = 1e12


def judged_splits(lib: Library, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5, preconditions: (parts with parsed amounts, one row per receipt with its reason or null)."""
    have = set(parts.columns)
    parts = parts.select(
        *[
            F.col(c) if c in have else F.lit(None).cast("double" if c == "weight" else "string").alias(c)
            for c in PART_COLUMNS
        ]
    )
    amount = parse_money_text(F.col("amount_text"))
    has_amount = F.coalesce(trimmed(F.col("amount_text")) != "", F.lit(False))
    has_weight = F.col("weight").isNotNull()
    parts = parts.withColumns({"_minor": amount["minor"], "_bad": amount["error"], "_a": has_amount, "_w": has_weight})

    modes = parts.groupBy("item_id").agg(
        F.count("*").alias("n"),
        F.count_if("_a").alias("n_amount"),
        F.count_if("_w").alias("n_weight"),
        F.count_if(F.col("_a") & F.col("_w")).alias("n_both"),
        F.min("_bad").alias("bad_amount"),
        F.sum("_minor").alias("sum_minor"),
        F.sum(F.abs("_minor")).alias("sum_abs"),
        F.sum(F.round("weight", 6)).alias("sum_weight"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
    )
    item = lib["item"].select(
        F.col("id").alias("item_id"), "folder_id", "type", "split_group_id", "split_role", "superseded_at", "trashed_at"
    )
    money = lib["receipt_data"].withColumn("_receipt", F.lit(True))
    tax_sum = lib["receipt_tax_line"].groupBy("item_id").agg(
        F.sum("amount_minor").alias("_line_sum"), F.count("*").alias("_lines"), F.count("id").alias("_keyed")
    )
    grouped = lib["split_group"].select(F.col("origin_item_id").alias("item_id"), F.lit(True).alias("_grouped")).distinct()
    merged = lib["merge_group"].select(F.col("result_item_id").alias("item_id"), F.lit(True).alias("_merged")).distinct()
    state = (
        modes.join(item, "item_id", "left")
        .join(money, "item_id", "left")
        .join(tax_sum, "item_id", "left")
        .join(grouped, "item_id", "left")
        .join(merged, "item_id", "left")
        .withColumn("_origin_tax", F.coalesce("tax_total_minor", "_line_sum"))
    )
    n, n_amount, n_weight = F.col("n"), F.col("n_amount"), F.col("n_weight")
    by_amount = n_amount > 0
    reason = first_reason(
        (n < 2, "split requires at least 2 parts"),
        (F.col("n_both") > 0, "a part cannot carry both an amount and a weight"),
        (by_amount & (n_weight > 0), "parts must be all amounts or all weights, not mixed"),
        (by_amount & (n_amount < n), "every part must include an amount in amount mode"),
        ((n_weight > 0) & (n_weight < n), "every part must include a weight in weight mode"),
        (F.col("bad_amount").isNotNull(), F.col("bad_amount")),
        (F.col("type").isNull(), "item not found"),
        (F.col("trashed_at").isNotNull(), "cannot split a trashed item"),
        (F.col("type") != "receipt", "only receipts can be split"),
        (F.col("split_role").isNotNull() | F.col("split_group_id").isNotNull(), "item is already part of a split"),
        (F.col("superseded_at").isNotNull(), "cannot split a superseded item"),
        (F.col("_grouped").isNotNull(), "item already has a split group"),
        (F.col("_receipt").isNull(), "receipt has no data row"),
        (F.col("total_minor").isNull(), "cannot split a receipt with no total"),
        ((n_weight > 0) & (F.col("min_weight") < 0), "weights must not be negative"),
        # NaN is larger than any number.
        ((n_weight > 0) & (F.col("max_weight") >= MOST_WEIGHT), "a weight is too large"),
        ((n_weight > 0) & (F.col("sum_weight") <= 0), "weights must sum to more than zero"),
        (
            by_amount & (F.col("sum_minor") != F.col("total_minor")),
            F.format_string("part amounts sum to %d but origin total is %d", "sum_minor", "total_minor"),
        ),
        (by_amount & F.col("_origin_tax").isNotNull() & (F.col("sum_abs") == 0), "weights must sum to more than zero"),
        (F.col("_merged").isNotNull(), "separate this combined item before splitting it"),
    )
    return parts, state.withColumns({"reason": reason, "by_amount": by_amount})


def split_refusals(lib: Library, parts: DataFrame) -> DataFrame:
    """Receipts that cannot be split as asked: (item_id, reason)."""
    return judged_splits(lib, parts)[1].filter("reason IS NOT NULL").select("item_id", "reason")


def split_receipts(lib: Library, parts: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """M5 for many receipts at once: (new library, rejected(item_id, reason)).

    A receipt is split whole or rejected whole.
    """
    parts, judged = judged_splits(lib, parts)
    # A part takes over all of a receipt but what was read from its page.
    taken_over = [c for c in lib["receipt_data"].columns if c not in ("item_id", "extraction_json")]
    # Judged receipts lie by item, so that repeated ones are counted without another shuffle.
    copies = F.count_if(F.col("reason").isNull()).over(Window.partitionBy("item_id"))
    judged = packed(
        judged.select(
            "item_id", "reason", "folder_id", "by_amount", "_origin_tax", "_line_sum", "_lines", "_keyed", "n", copies.alias("_copies"), *taken_over,
        ),
        "judged",
        by="item_id",
    )
    rejected = judged.filter("reason IS NOT NULL").select("item_id", "reason")
    accepted = judged.filter("reason IS NULL")
    # Children and tax lines are numbered in the order of their receipts: a receipt's begin behind those of all before it.
    lines_made = F.when(F.col("_lines").isNotNull(), F.col("n") * F.col("_keyed")).when(
        F.col("_origin_tax").isNotNull(), F.col("n") * F.col("_copies")
    ).otherwise(0)
    per_item = accepted.groupBy("item_id").agg(
        F.count("*").alias("_groups"), F.sum("n").alias("_n"), F.sum(lines_made).alias("_made")
    )
    most_parts, most_lines = (v or 0 for v in per_item.agg(F.max("_n"), F.max("_made")).first())
    # Only these few numbers of an item are put in order; its receipts, children and lines stay in the item's bucket.
    numbered = number_rows(
        per_item, ["item_id"], out="_item_no", totals={"_groups_before": "_groups", "_parts_before": "_n", "_lines_before": "_made"}
    ).drop("_item_no", "_groups", "_n", "_made")
    alike = Window.partitionBy("item_id").orderBy("folder_id", "_origin_tax", *taken_over)
    groups = packed(
        accepted.withColumn("_nth", F.row_number().over(alike)).join(numbered, "item_id").select(
            "item_id", (F.lit(next_id(lib["split_group"])) + F.col("_groups_before") + F.col("_nth")).alias("group_id"),
            "folder_id", "by_amount", "_origin_tax", "_line_sum", "_lines", "_parts_before", "_lines_before", *taken_over,
        ),
        "split-groups",
        by="item_id",
    )
    # The parts of a receipt too large for a task are not put into one bucket.
    by_item = "item_id" if max(most_parts, most_lines) <= scale.LARGEST_GROUP else None
    # Line shares win when they add up to the recorded tax, else the tax itself is allocated.
    by_lines = F.coalesce(F.col("_lines").isNotNull() & (F.col("_line_sum") == F.col("_origin_tax")), F.lit(False))
    named = groups.select(
        "item_id", "group_id", "by_amount", "total_minor", "_origin_tax", by_lines.alias("_by_lines"), F.col("_lines").isNotNull().alias("_has_lines"),
        "_parts_before", "_lines_before",
    )
    child = parts.drop("_bad", "_a", "_w").withColumnRenamed("description", "part_description").join(named, "item_id")
    # Repeated parts of repeated receipts: one of each for every group in turn.
    same_part = Window.partitionBy("item_id", "group_id", "ord").orderBy(F.lit(0))
    child = child.withColumn("_copy", F.row_number().over(same_part))
    child = rank_rows(child, ["item_id"], ["ord", "_copy", "group_id"], out="_nth", largest=most_parts).withColumns(
        {
            "child_id": F.lit(next_id(lib["item"])) + F.col("_parts_before") + F.col("_nth"),
            # Whole numbers: amounts as they are, weights in millionths; one receipt has either.
            "_share_weight": F.when(F.col("by_amount"), F.abs("_minor").cast("decimal(20,0)"))
            .when(F.col("weight").isNotNull(), F.round(F.col("weight") * 1_000_000).cast("decimal(20,0)"))
            .otherwise(F.lit(1).cast("decimal(20,0)")),
        }
    )

    def share_of(rows: DataFrame, keys: list[str], order: str, total: str, out: str) -> DataFrame:
        return allocate(rows, keys, [order], total, out, weight="_share_weight", largest=most_parts)

    child = share_of(child, ["item_id"], "ord", "total_minor", "_money")
    child = share_of(child, ["item_id"], "ord", "_origin_tax", "_tax")
    child = child.withColumn("_total", F.when(F.col("by_amount"), F.col("_minor")).otherwise(F.col("_money")))
    child = packed(
        child.select(
            "item_id", "child_id", "group_id", "_share_weight", "_total", "_tax", "_by_lines", "_has_lines", "part_description",
            "_lines_before", "category_name", "tax_category_name", "project_name",
        ),
        "children",
        by=by_item,
    )

    # Every tax line is allocated over the parts by the same weights; children are numbered in the order of their parts.
    origin_lines = lib["receipt_tax_line"].select(
        "item_id", F.col("id").alias("line_id"), "label", "rate_bp", "tax_category_id", "amount_minor"
    )
    line_shares = share_of(
        origin_lines.join(child.select("item_id", "child_id", "_share_weight", "_lines_before"), "item_id"),
        ["item_id", "line_id"],
        "child_id",
        "amount_minor",
        "_amount",
    )
    last_line = F.lit(next_id(lib["receipt_tax_line"]))
    line_shares = rank_rows(line_shares, ["item_id"], ["child_id", "line_id"], out="_nth", largest=most_lines)
    line_shares = packed(
        line_shares.select(
            (last_line + F.col("_lines_before") + F.col("_nth")).alias("id"),
            F.col("child_id").alias("item_id"), "label", "rate_bp", F.col("_amount").alias("amount_minor"), "tax_category_id",
            F.col("item_id").alias("origin_id"),
        ),
        "line-shares",
        by=by_item and "origin_id",
    )
    line_tax = line_shares.groupBy(F.col("origin_id").alias("item_id"), F.col("item_id").alias("child_id")).agg(
        F.sum("amount_minor").alias("_line_tax")
    )

    lib, names = _list_overrides(lib, parts, now)
    receipt = groups.select("item_id", "folder_id", *[c for c in taken_over if c not in ("total_minor", "tax_total_minor")])
    # The tax meets the narrow children before they are widened by their receipts.
    taxed = child.drop("_share_weight").join(line_tax, ["item_id", "child_id"], "left").withColumn(
        "tax_total_minor", F.when(F.col("_by_lines"), F.col("_line_tax")).otherwise(F.col("_tax"))
    )
    wide = taxed.drop("_by_lines", "_line_tax").join(receipt, "item_id")
    for column, (mapping, target) in names.items():
        wide = wide.join(
            mapping.select(F.col("name").alias("_n"), F.col("id").alias(f"_{target}")),
            trimmed(F.col(column)) == F.col("_n"),
            "left",
        ).drop("_n")
        wide = wide.withColumn(
            target, F.when(F.col(column).isNull(), F.col(target)).otherwise(F.col(f"_{target}"))
        )
    # Both sides lie by item: what is enough for sums by more columns is enough for this join.
    with setting(wide.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        wide = packed(wide, "split-parts", by=by_item)

    new_items = wide.select(
        F.col("child_id").alias("id"),
        "folder_id",
        F.lit("receipt").alias("type"),
        F.col("group_id").alias("split_group_id"),
        F.lit("child").alias("split_role"),
        F.lit(now).alias("created_at"),
        F.lit(now).alias("modified_at"),
    )
    new_receipts = wide.select(
        F.col("child_id").alias("item_id"),
        "txn_date",
        "vendor_id",
        F.col("_total").alias("total_minor"),
        "currency",
        "payment_type_id",
        "tax_total_minor",
        "category_id",
        "tax_category_id",
        "project_id",
        "external_ref",
        F.coalesce("part_description", "description").alias("description"),
    )
    # A receipt has lines of its own or this one per part, so the numbers of both kinds leave no gaps.
    synthetic = rank_rows(
        wide.filter("NOT _has_lines AND _tax IS NOT NULL"), ["item_id"], ["child_id"], out="_nth", largest=most_lines
    ).select(
        (last_line + F.col("_lines_before") + F.col("_nth")).alias("id"),
        F.col("child_id").alias("item_id"),
        F.lit("Tax").alias("label"),
        F.lit(None).cast("int").alias("rate_bp"),
        F.col("_tax").alias("amount_minor"),
        "tax_category_id",
    )
    new_lines = line_shares.drop("origin_id").unionByName(packed(synthetic, "tax-shares"))
    single_page = (
        lib["page"].groupBy("item_id").agg(F.count("*").alias("_pages"), F.min("id").alias("_page")).filter("_pages = 1")
    )
    new_groups = groups.join(single_page, "item_id", "left").select(
        F.col("group_id").alias("id"),
        F.col("item_id").alias("origin_item_id"),
        F.col("_page").alias("origin_page_id"),
        F.col("total_minor").alias("origin_total_minor"),
        F.col("_origin_tax").alias("origin_tax_minor"),
        "currency",
        F.lit(now).alias("created_at"),
    )
    origins = groups.select(F.col("item_id").alias("id"), F.col("group_id").alias("_group"))
    items = lib["item"].join(origins, "id", "left")
    is_origin = F.col("_group").isNotNull()
    items = items.withColumns(
        {
            "split_group_id": F.coalesce("_group", "split_group_id"),
            "split_role": F.when(is_origin, "origin").otherwise(F.col("split_role")),
            "superseded_at": F.when(is_origin, F.lit(now)).otherwise(F.col("superseded_at")),
            "modified_at": F.when(is_origin, F.lit(now)).otherwise(F.col("modified_at")),
        }
    ).drop("_group")
    return (
        with_tables(
            lib,
            item=items.unionByName(shaped(new_items, "item")),
            receipt_data=lib["receipt_data"].unionByName(shaped(new_receipts, "receipt_data")),
            receipt_tax_line=lib["receipt_tax_line"].unionByName(shaped(new_lines, "receipt_tax_line")),
            split_group=lib["split_group"].unionByName(shaped(new_groups, "split_group")),
        ),
        rejected,
    )


def _list_overrides(lib: Library, parts: DataFrame, now: int) -> tuple[Library, dict]:
    """Lists extended by the names the parts use; a list nobody overrides stays untouched."""
    names = {}
    for table, column, target in (
        ("category", "category_name", "category_id"),
        ("tax_category", "tax_category_name", "tax_category_id"),
        ("project", "project_name", "project_id"),
    ):
        used = parts.filter(F.col(column).isNotNull()).select(F.col(column).alias("name"))
        if used.isEmpty():
            continue
        changed, mapping = upsert_names(lib, table, used, now)
        lib = with_tables(lib, **{table: changed})
        names[column] = (mapping, target)
    return lib, names


def dissolve_splits(lib: Library, group_ids: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """M6: children and group rows go, the origin counts again.  ``group_ids``: split_group_id."""
    wanted = group_ids.select("split_group_id").distinct()
    known = lib["split_group"].select(F.col("id").alias("split_group_id"), "origin_item_id")
    rejected = wanted.join(known, "split_group_id", "left_anti").withColumn("reason", F.lit("split group not found"))
    groups = wanted.join(known, "split_group_id")
    children = (
        lib["item"]
        .filter("split_role = 'child'")
        .join(wanted, "split_group_id", "left_semi")
        .select(F.col("id").alias("item_id"))
    )
    lib = drop_items(lib, children)
    origins = groups.select(F.col("origin_item_id").alias("id"), F.lit(True).alias("_freed"))
    items = lib["item"].join(origins, "id", "left")
    keep = {c: F.when(F.col("_freed").isNull(), F.col(c)) for c in ("split_group_id", "split_role", "superseded_at")}
    items = items.withColumns(
        {**keep, "modified_at": F.when(F.col("_freed"), F.lit(now)).otherwise(F.col("modified_at"))}
    ).drop("_freed")
    remaining = lib["split_group"].join(wanted.withColumnRenamed("split_group_id", "id"), "id", "left_anti")
    return with_tables(lib, item=items, split_group=remaining), rejected


def drop_items(lib: Library, ids: DataFrame) -> Library:
    """Delete items and every row that belongs to them, combines included.  ``ids`` has a column ``item_id``."""
    from tillbook.schemas import ITEM_CHILDREN

    changed = {"item": lib["item"].join(ids.withColumnRenamed("item_id", "id"), "id", "left_anti")}
    for table, key in ITEM_CHILDREN.items():
        if table in lib:
            changed[table] = lib[table].join(ids.withColumnRenamed("item_id", key), key, "left_anti")
    if "merge_group" in lib:
        result = ids.withColumnRenamed("item_id", "result_item_id")
        changed["merge_group"] = lib["merge_group"].join(result, "result_item_id", "left_anti")
        # A journal row goes with its combine, and with its page.
        combines = lib["merge_group"].join(result, "result_item_id", "left_semi").select(F.col("id").alias("merge_group_id"))
        pages = lib["page"].join(ids, "item_id", "left_semi").select(F.col("id").alias("page_id"))
        changed["merge_group_member"] = (
            lib["merge_group_member"].join(combines, "merge_group_id", "left_anti").join(pages, "page_id", "left_anti")
        )
    return with_tables(lib, **changed)


def split_assertions(lib: Library) -> DataFrame:
    """Q9: what is wrong with each split group, as messages."""
    r = split_reconciliation(lib)
    return r.select(
        "split_group_id",
        F.concat_ws(
            "; ",
            F.when(
                F.col("drift_minor") != 0,
                F.format_string(
                    "drift %d (children %d, origin %d)", "drift_minor", "children_total_minor", "origin_total_minor"
                ),
            ),
            F.when(F.col("tax_drift_minor") != 0, F.format_string("tax drift %d", "tax_drift_minor")),
            F.when(
                F.col("currency_mismatch_count") > 0,
                F.format_string("%d currency mismatches", "currency_mismatch_count"),
            ),
        ).alias("message"),
    ).filter("message <> ''")
