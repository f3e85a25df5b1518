"""Archive, trash, snapshots and citations."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.functions.dates import civil_day
from tillbook.operators.splits import drop_items
from tillbook.plans.scale import next_id, number_rows
from tillbook.session import checkpointed
from tillbook.schemas import ITEM_CHILDREN, Library, TABLES, schema_of, shaped, with_tables

ARCHIVED_TABLES = ["item", "receipt_data", "document_data", "contact_data", "receipt_tax_line", "page", "split_group"]


# --- archive -------------------------------------------------------------------------


def archive_candidates(lib: Library, cutoff: str) -> DataFrame:
    """M9: live items whose business date lies strictly before the cut-off."""
    receipt = lib["receipt_data"].select("item_id", "txn_date")
    document = lib["document_data"].select("item_id", "doc_date")
    live = lib["item"].filter("trashed_at IS NULL").select(F.col("id").alias("item_id"), "type", "split_group_id", "created_at")
    day = F.coalesce(
        F.when(F.col("type") == "receipt", F.col("txn_date")).when(F.col("type") == "document", F.col("doc_date")),
        civil_day(F.col("created_at")),
    )
    return (
        live.join(receipt, "item_id", "left")
        .join(document, "item_id", "left")
        .withColumn("business_date", day)
        .filter(F.col("business_date") < F.lit(cutoff).cast("date"))
        .select("item_id", "split_group_id", "business_date")
    )


def close_over_splits(lib: Library, ids: DataFrame) -> DataFrame:
    """U4: the set plus every member of each split group it touches."""
    groups = ids.filter("split_group_id IS NOT NULL").select("split_group_id").distinct()
    members = lib["item"].join(groups, "split_group_id", "left_semi").select(F.col("id").alias("item_id"))
    return ids.select("item_id").unionByName(members).distinct()


def archive_selection(lib: Library, cutoff: str) -> DataFrame:
    return close_over_splits(lib, archive_candidates(lib, cutoff))


def archive(lib: Library, cutoff: str, path: str, now: int) -> Library:
    """Write the selected items with all their rows, take them out, log the run."""
    ids = archive_selection(lib, cutoff)
    # The selection is written first; what is removed is exactly what was written.
    items = lib["item"].join(ids.withColumnRenamed("item_id", "id"), "id", "left_semi")
    items.write.mode("errorifexists").parquet(f"{path}/item")
    spark = items.sparkSession
    written = spark.read.schema(schema_of("item")).parquet(f"{path}/item")
    gone = written.select(F.col("id").alias("item_id"))
    for table in ARCHIVED_TABLES[1:-1]:
        lib[table].join(gone, ITEM_CHILDREN[table], "left_semi").write.parquet(f"{path}/{table}")
    groups = written.filter("split_group_id IS NOT NULL").select(F.col("split_group_id").alias("id")).distinct()
    lib["split_group"].join(groups, "id", "left_semi").write.parquet(f"{path}/split_group")
    log = written.agg(F.count("*").alias("items_moved")).withColumns(
        {
            "id": F.lit(next_id(lib["archive_log"]) + 1),
            "path": F.lit(path),
            "cutoff_date": F.lit(cutoff).cast("date"),
            "created_at": F.lit(now),
        }
    )
    rest = drop_items(lib, gone)
    return with_tables(
        rest,
        split_group=lib["split_group"].join(groups, "id", "left_anti"),
        archive_log=lib["archive_log"].unionByName(shaped(log, "archive_log")),
    )


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Items of an archive with their receipt date and total."""
    item = spark.read.schema(schema_of("item")).parquet(f"{path}/item")
    receipt = spark.read.schema(schema_of("receipt_data")).parquet(f"{path}/receipt_data")
    return item.withColumnRenamed("id", "item_id").join(receipt, "item_id", "left").select(
        "item_id", "type", "txn_date", "total_minor", "split_role", "split_group_id"
    )


# --- trash and files -----------------------------------------------------------------


def citations(pages: DataFrame) -> DataFrame:
    """How many page rows cite a path, as file or thumbnail, trashed items included."""
    # A page that names one path twice cites it once.
    paths = F.array_distinct(F.array_compact(F.array("file_relpath", "thumb_relpath")))
    return pages.select(F.explode(paths).alias("relpath")).groupBy("relpath").agg(F.count("*").alias("citations"))


def uncited_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that no page cites any more."""
    return citations(before).select("relpath").join(citations(after), "relpath", "left_anti")


def purge_order(lib: Library) -> DataFrame:
    """Children, origins, others; then by id.  For the log: the deletion itself is a set."""
    rank = F.when(F.col("split_role") == "child", 0).when(F.col("split_role") == "origin", 1).otherwise(2)
    trashed = lib["item"].filter("trashed_at IS NOT NULL")
    return trashed.select(F.col("id").alias("item_id"), "split_role", rank.alias("bucket")).orderBy("bucket", "item_id")


def blocked_purges(lib: Library) -> DataFrame:
    """Q3: trashed origins that still have a child outside the trash."""
    survivors = lib["item"].filter("split_role = 'child' AND trashed_at IS NULL").select("split_group_id").distinct()
    origins = lib["item"].filter("split_role = 'origin' AND trashed_at IS NOT NULL").select(
        F.col("id").alias("item_id"), "split_group_id")
    return origins.join(survivors, "split_group_id", "left_semi").select(
        "item_id", F.lit("purge the split children first").alias("reason"))


def empty_trash(lib: Library) -> tuple[Library, DataFrame, DataFrame]:
    """Trashed items go for good; returns (library, released paths, blocked items)."""
    blocked = blocked_purges(lib)
    trashed = lib["item"].filter("trashed_at IS NOT NULL").select(F.col("id").alias("item_id"))
    gone = trashed.join(blocked, "item_id", "left_anti")
    rest = drop_items(lib, gone)
    groups = lib["split_group"].join(gone.withColumnRenamed("item_id", "origin_item_id"), "origin_item_id", "left_anti")
    rest = with_tables(rest, split_group=groups)
    touched = lib["page"].join(gone, "item_id", "left_semi")
    released = citations(touched).select("relpath").join(citations(rest["page"]), "relpath", "left_anti")
    return rest, released, blocked


# --- snapshots -----------------------------------------------------------------------


# Rows that a file of a snapshot has at most: a file is the block that is hashed, and that damage is told by.
ROWS_PER_FILE = 250_000
# Hashes that are hashed together.
FAN = 1024


def save_tables(lib: Library, path: str) -> None:
    for table in TABLES:
        if table in lib:
            lib[table].write.mode("errorifexists").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/{table}")


def load_tables(spark: SparkSession, path: str, tables: list[str] | None = None) -> Library:
    """Tables read with their declared schema."""
    return {t: spark.read.schema(schema_of(t)).parquet(f"{path}/{t}") for t in (tables or TABLES)}


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Path below the root, size and hash of every data file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # What stands before the folder's name differs by file system; the name itself is no pattern.
    folder = path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    relative = F.expr("substring(path, instr(path, folder) + length(folder))")
    files = files.withColumn("folder", F.lit(folder))
    return files.select(relative.alias("relpath"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter(
        ~F.element_at(F.split("relpath", "/"), -1).rlike(r"^[._]"))


def root_hash(files: DataFrame) -> str:
    """One hash over files (relpath, sha256): FAN hashes in the order of the paths give one, until a single one is left."""
    leaf = F.sha2(F.concat("relpath", F.lit("\n"), "sha256"), 256).alias("hash")
    level = checkpointed(number_rows(files.select("relpath", leaf), ["relpath"], out="no").select("no", "hash"))
    while True:
        together = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "hash"))), lambda e: e["hash"]), "")
        groups = level.groupBy(F.call_function("div", F.col("no") - 1, F.lit(FAN)).alias("_g")).agg(together.alias("_t"))
        level = checkpointed(groups.select((F.col("_g") + 1).alias("no"), F.sha2("_t", 256).alias("hash")))
        rows = level.limit(2).collect()
        if len(rows) < 2:
            return rows[0]["hash"] if rows else hashlib.sha256(b"").hexdigest()


def snapshot(lib: Library, path: str, now: int = 0, kind: str = "manual") -> tuple[Library, DataFrame]:
    """Tables written with a manifest of every file (path, sha256, bytes).

    Returns (library with a row of backup_log, manifest).  The row has the root hash of all files, their number and bytes,
    and the counts of items, folders and pages; the snapshot itself does not hold it.
    """
    save_tables(lib, f"{path}/tables")
    spark = lib["item"].sparkSession
    file_facts(spark, f"{path}/tables").write.mode("errorifexists").parquet(f"{path}/manifest")
    counts = None
    for table in ("item", "folder", "page"):
        one = lib[table].agg(F.lit(table).alias("table"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    counts.write.mode("errorifexists").parquet(f"{path}/counts")
    manifest, counts = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/counts")
    of = lambda table: F.coalesce(F.max(F.when(F.col("table") == table, F.col("rows"))), F.lit(0))
    found = counts.agg(F.struct(of("item").alias("items"), of("folder").alias("folders"), of("page").alias("pages")).alias("counts")).scalar()
    row = manifest.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("counts", found).select(
        F.lit(next_id(lib["backup_log"]) + 1).cast("bigint").alias("id"), F.lit(kind).alias("kind"), F.lit(path).alias("path"),
        F.lit(root_hash(manifest)).alias("db_sha256"),
        F.to_json(F.struct(F.lit(1).alias("version"), "file_count", "bytes", "counts")).alias("manifest_json"),
        F.col("bytes").alias("size_bytes"), F.lit(now).cast("bigint").alias("created_at"))
    return with_tables(lib, backup_log=lib["backup_log"].unionByName(shaped(row, "backup_log"))), manifest


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Manifest against the files that are there, then row counts, then the integrity report.

    All checks are listed always; those of tables whose files are missing or changed were not run, and are not ok.
    """
    from tillbook.operators.audit import INTEGRITY_CHECKS, integrity_report

    listed = spark.read.parquet(f"{path}/manifest").select("relpath", F.col("sha256").alias("want"))
    actual = file_facts(spark, f"{path}/tables").select("relpath", F.col("sha256").alias("have"))
    files = checkpointed(compare_manifest(listed, actual))
    if not files.filter("NOT ok").isEmpty():
        names = [f"rows of {t}" for t in ("item", "folder", "page")] + list(INTEGRITY_CHECKS)
        return files.unionByName(
            spark.createDataFrame([(n, False, "not run: damaged files") for n in names], "name string, ok boolean, detail string")
        )
    lib = load_tables(spark, f"{path}/tables")
    stated = spark.read.parquet(f"{path}/counts")
    found = None
    for table in ("item", "folder", "page"):
        one = lib[table].agg(F.lit(table).alias("table"), F.count("*").alias("found"))
        found = one if found is None else found.unionByName(one)
    rows = stated.join(found, "table", "full").select(
        F.concat(F.lit("rows of "), F.col("table")).alias("name"),
        F.coalesce(F.col("rows") == F.col("found"), F.lit(False)).alias("ok"),
        F.format_string("%d stated, %d found", "rows", "found").alias("detail"),
    )
    return files.unionByName(rows).unionByName(integrity_report(lib))


def damaged_files(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """(relpath, problem): missing, changed or unlisted files.  listed: relpath, want; actual: relpath, have."""
    both = listed.join(actual, "relpath", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("have"), "changed")
    return both.select("relpath", problem.alias("problem")).filter("problem IS NOT NULL")


def compare_manifest(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing and changed files, as two check rows.  listed: relpath, want; actual: relpath, have."""
    both = listed.join(actual, "relpath", "full")
    totals = both.agg(
        F.count_if(F.col("have").isNull()).alias("missing"),
        F.count_if(F.col("want").isNotNull() & F.col("have").isNotNull() & (F.col("want") != F.col("have"))).alias("changed"),
    )
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("name"),
                        (F.col(c) == 0).alias("ok"),
                        F.when(F.col(c) == 0, "clean").otherwise(F.format_string("%d file(s)", c)).alias("detail"),
                    )
                    for name, c in (("manifest files present", "missing"), ("manifest hashes match", "changed"))
                ]
            )
        )
    )


def restore(spark: SparkSession, path: str) -> tuple[Library, DataFrame]:
    """The library of a snapshot with the checks it passed."""
    return load_tables(spark, f"{path}/tables"), verify_snapshot(spark, path)
