"""Combine items into one (M7, W5) and take them apart again (M8).

The journal keeps one snapshot row per absorbed row (item, receipt, tax line …) instead of
one large document per item, so an item with very many lines stays many small rows.  The
snapshot of a page member holds the item and its side row; tax lines and custom fields are
journaled as further members without a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.operators.splits import first_reason
from tillbook.plans.scale import next_id, number_rows, rank_rows
from tillbook.schemas import Library, TABLES, schema_of, shaped, with_tables
from tillbook.session import checkpointed

SIDE_TABLES = ["receipt_data", "document_data", "contact_data"]
LIST_TABLES = ["receipt_tax_line", "custom_field_value"]


def _as_json(df: DataFrame, key: str) -> Column:
    return F.to_json(F.struct(*[c for c in df.columns if c != key]))


def item_snapshots(lib: Library, ids: DataFrame) -> DataFrame:
    """One JSON row per item: the item and its side row."""
    item = lib["item"].withColumnRenamed("id", "item_id").join(ids, "item_id", "left_semi")
    out = item.select(
        "item_id", F.to_json(F.struct("folder_id", "type", "reviewed_at", "trashed_at", "created_at")).alias("item")
    )
    for table in SIDE_TABLES:
        side = lib[table].join(ids, "item_id", "left_semi")
        out = out.join(side.select("item_id", _as_json(side, "item_id").alias(table)), "item_id", "left")
    return out.select("item_id", F.to_json(F.struct("item", *SIDE_TABLES)).alias("snapshot_json"))


def combine_items(lib: Library, commands: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """M7: commands (merge_no, ord, item_id); the first item of a merge keeps all pages.

    Returns (library, rejected(merge_no, reason)).
    """
    item = lib["item"].select(
        F.col("id").alias("item_id"), "type", "trashed_at", "split_group_id", F.lit(True).alias("_known")
    )
    prior = lib["merge_group"].select(F.col("result_item_id").alias("item_id"), F.lit(True).alias("_prior")).distinct()
    pages = lib["page"].groupBy("item_id").agg(F.count("*").alias("_pages"))
    # An item may take part in one merge of a batch only; the lowest merge number has it.
    taken = commands.groupBy("item_id").agg(F.min("merge_no").alias("_owner"))
    state = (
        commands.join(item, "item_id", "left")
        .join(prior, "item_id", "left")
        .join(pages, "item_id", "left")
        .join(taken, "item_id")
    )
    first_bad = lambda bad: F.min(F.when(bad, F.col("item_id")))
    verdict = state.groupBy("merge_no").agg(
        F.count("*").alias("n"),
        F.count_distinct("item_id").alias("n_items"),
        first_bad(F.col("_known").isNull()).alias("unknown"),
        first_bad(F.col("trashed_at").isNotNull()).alias("trashed"),
        first_bad(F.col("split_group_id").isNotNull()).alias("split"),
        first_bad(F.col("_prior").isNotNull()).alias("prior"),
        first_bad(F.col("_owner") < F.col("merge_no")).alias("elsewhere"),
        F.sum(F.coalesce("_pages", F.lit(0))).alias("n_pages"),
        F.min_by("item_id", "ord").alias("result_item_id"),
    ).withColumn(
        "reason",
        first_reason(
            (F.col("n") < 2, "combine requires at least 2 items"),
            (F.col("n_items") < F.col("n"), "combine item ids must be unique"),
            (F.col("unknown").isNotNull(), F.format_string("item %d not found", "unknown")),
            (F.col("trashed").isNotNull(), F.format_string("cannot combine trashed item %d", "trashed")),
            (F.col("split").isNotNull(), "cannot combine into an item that is part of a split"),
            (F.col("prior").isNotNull(), F.format_string("item %d is already a combine result", "prior")),
            (F.col("elsewhere").isNotNull(), F.format_string("item %d is part of another combine", "elsewhere")),
            (F.col("n_pages") == 0, "combine requires at least one page across the items"),
        ),
    )
    verdict = checkpointed(verdict)
    rejected = verdict.filter("reason IS NOT NULL").select("merge_no", "reason")
    good = verdict.filter("reason IS NULL").select("merge_no", "result_item_id")
    groups = number_rows(good, ["merge_no"], out="id", start=next_id(lib["merge_group"]))
    members = checkpointed(
        commands.join(groups.withColumnRenamed("id", "merge_group_id"), "merge_no").select(
            "merge_group_id", "result_item_id", "ord", "item_id"
        )
    )

    # Pages in item order, then page order, numbered 1..N under the result.
    moved = lib["page"].select(F.col("id").alias("page_id"), "item_id", "seq").join(members, "item_id")
    moved = rank_rows(moved, ["merge_group_id"], ["ord", "seq", "page_id"], out="new_seq")
    snapshots = item_snapshots(lib, members.select("item_id"))
    types = item.select("item_id", F.col("type").alias("pre_merge_type"))
    journal = moved.select(
        "merge_group_id", "page_id", F.col("item_id").alias("pre_merge_item_id"), F.col("seq").alias("pre_merge_seq"), "ord"
    )
    # As in the reference, an item without pages leaves no journal and stays in the trash.
    paged = members.join(moved.select("item_id").distinct(), "item_id", "left_semi")
    journal = (
        journal.join(snapshots.withColumnRenamed("item_id", "pre_merge_item_id"), "pre_merge_item_id")
        .join(types.withColumnRenamed("item_id", "pre_merge_item_id"), "pre_merge_item_id")
    )
    for table in LIST_TABLES:
        rows = lib[table].join(paged.select("item_id", "merge_group_id", "ord"), "item_id")
        body = F.to_json(F.struct(*[c for c in schema_of(table).names if c != "item_id"]))
        journal = journal.unionByName(
            rows.select(
                "merge_group_id", F.lit(None).cast("bigint").alias("page_id"), F.col("item_id").alias("pre_merge_item_id"),
                F.lit(-1).cast("bigint").alias("pre_merge_seq"), "ord", body.alias("snapshot_json"),
                F.lit(table).alias("pre_merge_type")),
        )
    journal = number_rows(
        journal, ["merge_group_id", "ord", "pre_merge_item_id", "pre_merge_seq", "page_id", "snapshot_json"],
        out="id", start=next_id(lib["merge_group_member"]))

    new_place = moved.select(F.col("page_id").alias("id"), F.col("result_item_id").alias("_item"), F.col("new_seq").cast("bigint").alias("_seq"))
    page = lib["page"].join(new_place, "id", "left").withColumns(
        {"item_id": F.coalesce("_item", "item_id"), "seq": F.coalesce("_seq", "seq")})
    touched = members.select(F.col("item_id").alias("id"), (F.col("item_id") != F.col("result_item_id")).alias("_absorbed"))
    items = lib["item"].join(touched, "id", "left").withColumns(
        {
            "trashed_at": F.when(F.col("_absorbed"), F.lit(now)).otherwise(F.col("trashed_at")),
            "modified_at": F.when(F.col("_absorbed").isNotNull(), F.lit(now)).otherwise(F.col("modified_at")),
        }
    )
    return (
        with_tables(
            lib,
            item=shaped(items, "item"),
            page=shaped(page, "page"),
            merge_group=lib["merge_group"].unionByName(
                shaped(groups.select("id", "result_item_id", F.lit(now).alias("created_at")), "merge_group")),
            merge_group_member=lib["merge_group_member"].unionByName(shaped(journal, "merge_group_member")),
        ),
        rejected,
    )


def separate_items(lib: Library, ids: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """M8: undo a combine from its journal.  ``ids``: item_id of combine results."""
    group = lib["merge_group"].select(F.col("id").alias("merge_group_id"), F.col("result_item_id").alias("item_id"))
    split = lib["item"].filter("split_group_id IS NOT NULL").select(F.col("id").alias("item_id"), F.lit(True).alias("_split"))
    judged = ids.select("item_id").distinct().join(group, "item_id", "left").join(split, "item_id", "left").withColumn(
        "reason",
        first_reason(
            (F.col("merge_group_id").isNull(), F.format_string("item %d is not a combine result", "item_id")),
            (F.col("_split").isNotNull(), "cannot separate a combined item that has since been split"),
        ),
    )
    rejected = judged.filter("reason IS NOT NULL").select("item_id", "reason")
    groups = judged.filter("reason IS NULL").select("merge_group_id")
    members = lib["merge_group_member"].join(groups, "merge_group_id", "left_semi")
    whole = members.filter(~F.col("pre_merge_type").isin(*LIST_TABLES))
    snap_type = "struct<item:string," + ",".join(f"{t}:string" for t in SIDE_TABLES) + ">"
    snaps = checkpointed(
        whole.groupBy(F.col("pre_merge_item_id").alias("item_id"))
        .agg(F.min("snapshot_json").alias("snapshot_json"))
        .withColumn("s", F.from_json("snapshot_json", snap_type))
    )

    item_type = "struct<folder_id:bigint,type:string,reviewed_at:bigint,trashed_at:bigint,created_at:bigint>"
    back = snaps.select("item_id", F.from_json("s.item", item_type).alias("i")).select(
        F.col("item_id").alias("id"), "i.folder_id", "i.type", "i.reviewed_at",
        F.lit(now).alias("created_at"), F.lit(now).alias("modified_at"))
    old = lib["item"].select("id", F.col("created_at").alias("_created"))
    back = back.join(old, "id", "left").withColumn("created_at", F.coalesce("_created", "created_at"))
    changed = {"item": lib["item"].join(back, "id", "left_anti").unionByName(shaped(back, "item"))}

    ids_back = snaps.select("item_id")
    for table in SIDE_TABLES:
        rows = snaps.filter(F.col(f"s.{table}").isNotNull()).select(
            "item_id", F.from_json(f"s.{table}", _without_item_id(table)).alias("r")).select("item_id", "r.*")
        changed[table] = lib[table].join(ids_back, "item_id", "left_anti").unionByName(shaped(rows, table))
    for table in LIST_TABLES:
        rows = members.filter(F.col("pre_merge_type") == table).select(
            F.col("pre_merge_item_id").alias("item_id"), F.from_json("snapshot_json", _without_item_id(table)).alias("r")
        ).select("item_id", "r.*")
        changed[table] = lib[table].join(ids_back, "item_id", "left_anti").unionByName(shaped(rows, table))

    place = whole.filter("page_id IS NOT NULL").select(
        F.col("page_id").alias("id"), F.col("pre_merge_item_id").alias("_item"), F.col("pre_merge_seq").alias("_seq"))
    page = lib["page"].join(place, "id", "left").withColumns(
        {"item_id": F.coalesce("_item", "item_id"), "seq": F.coalesce("_seq", "seq")})
    changed["page"] = shaped(page, "page")
    changed["merge_group"] = lib["merge_group"].join(groups.withColumnRenamed("merge_group_id", "id"), "id", "left_anti")
    changed["merge_group_member"] = lib["merge_group_member"].join(groups, "merge_group_id", "left_anti")
    return with_tables(lib, **changed), rejected


def _without_item_id(table: str) -> str:
    return ", ".join(part.strip() for part in TABLES[table].split(",") if not part.strip().startswith("item_id "))
