"""Lookup lists: ordered names (P17), upserts of simple lists (R2) and vendors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.names import normalize_vendor
from tillbook.functions.money import trimmed
from tillbook.plans.scale import rank_rows
from tillbook.schemas import Library, shaped, with_tables
from tillbook.session import checkpointed

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(name):
    """Case folding of the reference's lists: ASCII letters only."""
    return F.translate(name, ASCII_UPPER, ASCII_LOWER)


def list_values(lib: Library, table: str) -> DataFrame:
    """Names of a list, case-insensitive order."""
    return lib[table].select("id", "name").orderBy(ascii_fold(F.col("name")), "id")


def _spaceless(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def _entries(lib: Library, tables: Sequence[str]) -> DataFrame:
    """(list, id, name, normalized_name, is_seed) of the rows of several lists."""
    parts = [
        lib[t].select(
            F.lit(t).alias("list"), "id", "name",
            (F.col("normalized_name") if t == "vendor" else F.lit(None).cast("string")).alias("normalized_name"), "is_seed",
        )
        for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def _keys(name: Column, norm: Column) -> Column:
    """Under what keys an entry is known, best first: (rank, kind, key)."""
    key = lambda rank, kind, value: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("key"))
    loose = _spaceless(norm)
    return F.when(
        F.col("list") == "vendor",
        F.array(key(1, "normalized", norm), key(2, "name", name), key(3, "loose", F.when(loose != "", loose))),
    ).otherwise(F.array(key(1, "name", ascii_fold(name))))


def resolve_names(lib: Library, wanted: DataFrame, now: int, tables: Sequence[str]) -> tuple[Library, DataFrame]:
    """R1 and R2 for several lists in one pass: names to ids, the missing ones created.

    ``wanted``: (list, name). Returns the library with the lists extended, and (list, name, id, created, matched_by).
    All names are shuffled once, tagged by their list, meet the keys of all entries in one join, and new ones are
    numbered together: the numbers of a list start behind its own largest id.
    """
    entries = _entries(lib, tables)
    known = (
        entries.select("list", "id", "is_seed", F.explode(_keys(F.col("name"), F.col("normalized_name"))).alias("k"))
        .select("list", "k.kind", "k.key", "id", "is_seed").filter("key IS NOT NULL")
        .groupBy("list", "kind", "key")
        # By the spaceless key seeded vendors come first, then the lowest id.
        .agg(F.min(F.struct((~F.col("is_seed") & (F.col("kind") == "loose")).alias("late"), "id"))["id"].alias("id"))
    )
    names = wanted.select("list", trimmed(F.col("name")).alias("name")).filter("name <> ''").distinct()
    names = names.withColumn("norm", F.when(F.col("list") == "vendor", normalize_vendor(F.col("name"))))
    tried = names.select("list", "name", "norm", F.explode(_keys(F.col("name"), F.col("norm"))).alias("k"))
    hit = F.when(F.col("id").isNotNull(), F.struct("rank", "id", "kind"))
    matched = checkpointed(
        tried.select("list", "name", "norm", "k.*").join(known, ["list", "kind", "key"], "left")
        .groupBy("list", "name", "norm").agg(F.min(hit).alias("hit"))
        .withColumn("loose", _spaceless(F.col("norm")))
        .withColumn(
            "key",
            F.when(F.col("list") != "vendor", ascii_fold(F.col("name")))
            .when(F.col("loose") != "", F.col("loose")).otherwise(F.col("name")),
        )
        .select("list", "name", "norm", "key", "hit")
    )
    # Spellings of one key become one entry: the smallest spelling.
    missing = matched.filter("hit IS NULL").groupBy("list", "key").agg(F.min(F.struct("name", "norm")).alias("first"))
    last = entries.groupBy("list").agg(F.max("id").alias("last"))
    fresh = checkpointed(
        rank_rows(missing, ["list"], ["key"], out="no").join(last, "list", "left")
        .withColumn("new_id", F.coalesce("last", F.lit(0)) + F.col("no"))
        .select("list", "key", "first", "new_id")
    )
    made = fresh.select(
        "list", F.col("new_id").alias("id"), "first.name", F.col("first.norm").alias("normalized_name"),
        F.lit(False).alias("is_seed"), F.lit(now).alias("created_at"),
    )
    changed = {t: lib[t].unionByName(shaped(made.filter(F.col("list") == t), t)) for t in tables}
    mapping = matched.join(fresh.select("list", "key", "new_id"), ["list", "key"], "left").select(
        "list", "name",
        F.coalesce("hit.id", "new_id").alias("id"),
        F.col("hit").isNull().alias("created"),
        F.coalesce("hit.kind", F.lit("new")).alias("matched_by"),
    )
    return with_tables(lib, **changed), mapping


def upsert_names(lib: Library, table: str, wanted: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """R2: resolve names to ids, creating the missing ones.

    ``wanted`` has a column ``name``.  Returns (new list table, mapping name → id, created).
    Spellings that differ only in ASCII case become one new entry: the smallest spelling.
    """
    out, mapping = resolve_names(lib, wanted.select(F.lit(table).alias("list"), "name"), now, [table])
    return out[table], mapping.select("name", "id", "created")


def resolve_vendors(lib: Library, wanted: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Vendor by normalised name, then exact name, then spaceless key, else a new vendor.

    ``wanted`` has a column ``name``.  New names that share a normalised form, or failing
    that a spaceless key, become one vendor: within a batch the result is what processing
    the names in order would give for either pass.
    """
    out, mapping = resolve_names(lib, wanted.select(F.lit("vendor").alias("list"), "name"), now, ["vendor"])
    return out["vendor"], mapping.drop("list")
