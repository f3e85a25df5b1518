"""Import of file batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.plans.scale import next_id, number_rows
from tillbook.schemas import Library, shaped, with_tables
from tillbook.session import checkpointed
from tillbook.sources.files import base_name, extension, kind_of


def stored_path(sha: Column, ext: Column) -> Column:
    """Content-addressed path; jpeg is stored as jpg."""
    ext = F.when(ext == "jpeg", "jpg").otherwise(ext)
    return F.concat_ws("/", F.lit("images"), F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit("."), ext))


def stored_blobs(files: DataFrame) -> DataFrame:
    """Identical bytes are stored once.  files: path, sha256 → sha256, stored path.

    A copied file that makes up much of a batch collapses in the partial aggregation.
    """
    return files.groupBy("sha256").agg(F.min(extension(F.col("path"))).alias("_ext")).select(
        "sha256", stored_path(F.col("sha256"), F.col("_ext")).alias("relpath"))


def target_folder(lib: Library, requests: DataFrame) -> DataFrame:
    """The inbox, unless a folder is named and the inbox is declined.  requests: to_inbox, folder_id.

    Without an inbox the result of rows that need it is null with a reason.
    """
    inbox = lib["folder"].filter("kind = 'inbox'").agg(F.min("id")).scalar()
    named = (F.col("to_inbox") == F.lit(False)) & F.col("folder_id").isNotNull()
    target = F.when(named, F.col("folder_id")).otherwise(inbox)
    return requests.withColumns(
        {"target_id": target, "reason": F.when(target.isNull(), "Inbox folder missing (folder.kind=inbox)")}
    )


def known_sources(lib: Library) -> DataFrame:
    """The first item of every source hash already in the library."""
    return lib["item_source_file"].groupBy(F.col("source_sha256").alias("sha256")).agg(F.min("item_id").alias("existing_item_id"))


@dataclass(frozen=True)
class Imported:
    """What a batch of files gives, as rows of the library tables; the library itself is not read for it."""

    created: DataFrame  # path, part, item_id, sha256
    tables: dict[str, DataFrame]  # new rows of item, page, receipt_data, contact_data, item_source_file
    duplicates: DataFrame  # path, existing_item_id
    rejected: DataFrame  # path, reason


def import_rows(
    files: DataFrame,
    known: DataFrame,
    now: int,
    folder: Column,
    first_item: int,
    first_page: int,
    skip_duplicates: bool = True,
    cards: DataFrame | None = None,
    pages: DataFrame | None = None,
    split_pages: bool = False,
) -> Imported:
    """Files (path, sha256, and failed: reason or null) into rows of items, pages, contacts and sources.

    ``known``: (sha256, existing_item_id) of the hashes that the library has, at least of those among the files.  Items
    and pages are numbered behind ``first_item`` and ``first_page``.  ``cards``: contact rows of card files (path,
    card_no, and columns of contact_data); a card file without any is rejected.  ``pages``: pages of multi-page files
    (path, page_no, sha256, failed); a file with a failed page is rejected whole, and ``split_pages`` makes an item of
    each page.  Without them a card file is one bare contact and every other file one page.

    ``part`` is the number of the card or page that became the item, else 0.  Duplicates are found by the hash of the
    original bytes, among the known and earlier in the batch (by path); a file of several items is found by its first.
    """
    kind = kind_of(F.col("path"))
    ext = extension(F.col("path"))
    if "failed" not in files.columns:
        files = files.withColumn("failed", F.lit(None).cast("string"))
    reason = F.when(kind.isNull(), F.concat(F.lit("unsupported file type: ."), F.when(ext == "", "(none)").otherwise(ext))).otherwise(
        F.col("failed"))
    judged = files.select("path", "sha256", kind.alias("kind"), reason.alias("reason"))
    if cards is not None:
        judged = judged.join(cards.select("path", F.lit(True).alias("_cards")).distinct(), "path", "left").withColumn(
            "reason", F.coalesce("reason", F.when((F.col("kind") == "card") & F.col("_cards").isNull(), "no vCard entries found"))
        ).drop("_cards")
    if pages is not None:
        broken = pages.filter("failed").select("path", F.lit(True).alias("_broken")).distinct()
        judged = judged.join(broken, "path", "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_broken"), "a page could not be read"))).drop("_broken")
    rejected = judged.filter("reason IS NOT NULL").select("path", "reason")
    good = judged.filter("reason IS NULL")
    if skip_duplicates:
        # Partial aggregation first: a hash shared by a third of the batch is one row per task.
        first = good.groupBy("sha256").agg(F.min_by(F.struct("path", "kind"), "path").alias("f"))
        heads = first.join(known, "sha256", "left")
        new = heads.filter("existing_item_id IS NULL").select("f.path", "f.kind", "sha256")
    else:
        new = good.select("path", "kind", "sha256")
    new = new.withColumn("part", F.lit(0))
    for parts, number in ((cards, "card_no"), (pages if split_pages else None, "page_no")):
        if parts is not None:
            numbers = parts.select("path", F.col(number).cast("int").alias("_part"))
            new = new.join(numbers, "path", "left").withColumn("part", F.coalesce("_part", "part")).drop("_part")
    created = checkpointed(number_rows(new, ["path", "part"], out="item_id", start=first_item))
    if skip_duplicates:
        own = created.groupBy("sha256").agg(F.min("item_id").alias("owner"), F.min("path").alias("_first"))
        owners = own.unionByName(
            heads.filter("existing_item_id IS NOT NULL").select("sha256", F.col("existing_item_id").alias("owner")), allowMissingColumns=True)
        duplicates = good.join(owners, "sha256").filter("_first IS NULL OR path <> _first").select(
            "path", F.col("owner").alias("existing_item_id"))
    else:
        duplicates = good.select("path", F.lit(None).cast("bigint").alias("existing_item_id")).limit(0)

    items = created.select(
        F.col("item_id").alias("id"), folder.alias("folder_id"),
        F.when(F.col("kind") == "card", "contact").otherwise("receipt").alias("type"),
        F.lit(now).alias("created_at"), F.lit(now).alias("modified_at"))
    scans = created.filter("kind <> 'card'")
    contacts = created.filter("kind = 'card'").select("path", F.col("part").alias("card_no"), "item_id")
    if cards is not None:
        contacts = contacts.join(cards, ["path", "card_no"], "left")
    path = stored_path(F.col("sha256"), extension(F.col("path")))
    leaves = scans.select("item_id", F.lit(1).cast("bigint").alias("seq"), path.alias("file_relpath"), F.col("sha256").alias("content_hash"))
    if pages is not None:
        numbered = paged_documents(pages, split_pages).select(
            "path", F.when(F.lit(split_pages), F.col("item_no")).otherwise(F.lit(0)).cast("int").alias("part"), "seq",
            stored_path(F.col("sha256"), F.lit("png")).alias("file_relpath"), F.col("sha256").alias("content_hash"))
        paged = scans.select("path", "part", "item_id").join(numbered, ["path", "part"]).drop("path", "part")
        leaves = leaves.join(paged.select("item_id"), "item_id", "left_anti").unionByName(paged)
    added = number_rows(leaves, ["item_id", "seq"], out="id", start=first_page).withColumns(_fresh_page(now))
    receipts = scans.select("item_id", F.lit("USD").alias("currency"))
    sources = created.select(
        "item_id", F.col("sha256").alias("source_sha256"), path.alias("source_relpath"), base_name(F.col("path")).alias("original_name"),
        F.lit(now).alias("created_at"))
    rows = {"item": items, "page": added, "receipt_data": receipts, "contact_data": contacts, "item_source_file": sources}
    return Imported(
        created.select("path", "part", "item_id", "sha256"), {t: shaped(r, t) for t, r in rows.items()}, duplicates, rejected)


def _fresh_page(now: int) -> dict[str, Column]:
    return {"rotation": F.lit(0), "ocr_status": F.lit("pending"), "ocr_generation": F.lit(0), "created_at": F.lit(now)}


def inbox_of(lib: Library, folder_id: int | None = None) -> Column:
    """The folder named, else the inbox."""
    return F.lit(folder_id).cast("bigint") if folder_id is not None else lib["folder"].filter("kind = 'inbox'").agg(F.min("id")).scalar()


def import_batch(
    lib: Library, files: DataFrame, now: int, folder_id: int | None = None, **options
) -> tuple[Library, DataFrame, DataFrame, DataFrame]:
    """``import_rows`` into a library, whose source rows are the known hashes; ``options`` as there.

    Returns (library, created(path, part, item_id, sha256), duplicates(path, existing_item_id), rejected(path, reason)).
    """
    got = import_rows(
        files, known_sources(lib), now, inbox_of(lib, folder_id), next_id(lib["item"]), next_id(lib["page"]), **options)
    return _with_rows(lib, got.tables), got.created, got.duplicates, got.rejected


def _with_rows(lib: Library, rows: dict[str, DataFrame]) -> Library:
    added = {t: upsert_sources(lib, r) if t == "item_source_file" else lib[t].unionByName(r) for t, r in rows.items()}
    return with_tables(lib, **added)


def import_page_groups(
    lib: Library, pages: DataFrame, now: int, folder_id: int | None = None, skip_duplicates: bool = True
) -> tuple[Library, DataFrame, DataFrame, DataFrame]:
    """Groups of page files (batch_id, seq, path, sha256, and failed: reason or null), each group one item or none.

    The key of a group is the hash of its page hashes in order; a group whose key the library has, or an earlier group
    of the batch, is a duplicate of that item.  A group with a page that failed or is no image is rejected whole, for
    the reason of its first such page.  Pages are numbered 1..N in the order of seq (then hash), however seq counts.

    Returns (library, created(batch_id, item_id, combined_sha256, n_pages), duplicates(batch_id, existing_item_id),
    rejected(batch_id, reason)).
    """
    if "failed" not in pages.columns:
        pages = pages.withColumn("failed", F.lit(None).cast("string"))
    ext = extension(F.col("path"))
    kind = kind_of(F.col("path"))
    reason = F.when(
        kind.isNull() | (kind != "image"), F.concat(F.lit("only image pages can be combined, got ."), F.when(ext == "", "(none)").otherwise(ext))
    ).otherwise(F.col("failed"))
    judged = pages.select("batch_id", "seq", "path", "sha256", reason.alias("reason"))
    rejected = judged.filter("reason IS NOT NULL").groupBy("batch_id").agg(F.min_by("reason", F.struct("seq", "sha256", "path")).alias("reason"))
    good = judged.join(rejected, "batch_id", "left_anti").drop("reason")
    keys = combined_hashes(good)
    first = keys.groupBy("combined_sha256").agg(F.min("batch_id").alias("batch_id"), F.min("n_pages").alias("n_pages"))
    known = known_sources(lib).withColumnRenamed("sha256", "combined_sha256")
    if skip_duplicates:
        heads = first.join(known, "combined_sha256", "left")
        new = heads.filter("existing_item_id IS NULL").drop("existing_item_id")
    else:
        new = keys
    created = checkpointed(number_rows(new, ["batch_id"], out="item_id", start=next_id(lib["item"]))).select(
        "batch_id", "item_id", "combined_sha256", "n_pages")
    if skip_duplicates:
        own = created.select("combined_sha256", F.col("item_id").alias("existing_item_id"))
        owners = own.unionByName(heads.filter("existing_item_id IS NOT NULL").select("combined_sha256", "existing_item_id"))
        duplicates = keys.join(owners, "combined_sha256").join(created.select("batch_id"), "batch_id", "left_anti").select("batch_id", "existing_item_id")
    else:
        duplicates = keys.select("batch_id", F.lit(None).cast("bigint").alias("existing_item_id")).limit(0)

    items = created.select(
        F.col("item_id").alias("id"), inbox_of(lib, folder_id).alias("folder_id"), F.lit("receipt").alias("type"),
        F.lit(now).alias("created_at"), F.lit(now).alias("modified_at"))
    leaves = good.join(created.select("batch_id", "item_id"), "batch_id")
    stored = stored_path(F.col("sha256"), ext)
    # One numbering of all pages: a page's place in its item is its number behind the item's first.
    start = next_id(lib["page"])
    numbered = checkpointed(number_rows(leaves, ["item_id", "seq", "sha256", "path"], out="id", start=start))
    starts = numbered.groupBy("item_id").agg(F.min("id").alias("_first"), F.min_by(F.struct("sha256", "path"), "id").alias("head"))
    added = numbered.drop("seq").join(starts.select("item_id", "_first"), "item_id").select(
        "id", "item_id", (F.col("id") - F.col("_first") + 1).alias("seq"), stored.alias("file_relpath"), F.col("sha256").alias("content_hash")
    ).withColumns(_fresh_page(now))
    sources = created.join(starts, "item_id").select(
        "item_id", F.col("combined_sha256").alias("source_sha256"), stored_path(F.col("head.sha256"), extension(F.col("head.path"))).alias("source_relpath"),
        base_name(F.col("head.path")).alias("original_name"), F.lit(now).alias("created_at"))
    rows = {
        "item": items, "page": added, "receipt_data": created.select("item_id", F.lit("USD").alias("currency")), "item_source_file": sources}
    return _with_rows(lib, {t: shaped(r, t) for t, r in rows.items()}), created, duplicates, rejected


def upsert_sources(lib: Library, rows: DataFrame) -> DataFrame:
    """One source row per item; the new one replaces hash, path and name."""
    fresh = shaped(rows, "item_source_file").groupBy("item_id").agg(
        F.max_by(F.struct("source_sha256", "source_relpath", "original_name", "created_at"), F.struct("created_at", "source_sha256")).alias("r")
    ).select("item_id", "r.*")
    return lib["item_source_file"].join(fresh, "item_id", "left_anti").unionByName(fresh)


def combined_hashes(pages: DataFrame) -> DataFrame:
    """batch_id, seq, sha256 → combined key and page count per batch.

    The key is defined as the hash of the page hashes in order, so a batch has to be read in
    sequence; it is streamed through the digest in sorted order and never held as a list.
    """

    def digest(frames):
        import hashlib

        import pandas as pd

        current, state, count = None, None, 0
        for frame in frames:
            done = []
            for batch, sha in zip(frame["batch_id"], frame["sha256"]):
                if state is None or batch != current:
                    if state is not None:
                        done.append((current, state.hexdigest(), count))
                    current, state, count = batch, hashlib.sha256(), 0
                state.update(sha.encode())
                count += 1
            if done:
                yield pd.DataFrame(done, columns=["batch_id", "combined_sha256", "n_pages"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest(), count)], columns=["batch_id", "combined_sha256", "n_pages"])

    key = dict(pages.dtypes)["batch_id"]
    ordered = pages.select("batch_id", "seq", "sha256").repartition("batch_id").sortWithinPartitions("batch_id", "seq", "sha256")
    return ordered.mapInPandas(digest, f"batch_id {key}, combined_sha256 string, n_pages bigint")


def paged_documents(pages: DataFrame, split_pages: bool) -> DataFrame:
    """Pages of multi-page files (path, page_no, sha256, failed) → item keys.

    One item per file with pages 1..n, or one per page; a file with any failed page is left
    out whole.  The item key is (path) or (path, page_no).
    """
    broken = pages.filter("failed").select("path").distinct()
    good = pages.join(broken, "path", "left_anti")
    if split_pages:
        return good.select("path", F.col("page_no").alias("item_no"), F.lit(1).cast("bigint").alias("seq"), "page_no", "sha256")
    return good.select("path", F.lit(1).cast("bigint").alias("item_no"), F.col("page_no").cast("bigint").alias("seq"), "page_no", "sha256")
