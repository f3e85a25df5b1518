"""The star-schema tables read as a library: receipts, vendors, pages, contacts, documents.

``base_library`` is a lazy mapping over the Parquet files; ``library`` adds the split
receipts, written once to the shared folder because their ids come from a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.functions.names import normalize_vendor
from tillbook.operators.canonical import search_source
from tillbook.operators.splits import split_receipts
from tillbook.schemas import Library, empty, shaped
from tillbook.session import packed

NOW = 1_700_000_000_000
DAY = 86_400_000
SPLIT_AT = 1_600_000_000_000
CHILD_BASE = 10_000_000_000_000
DOCUMENT_BASE = 20_000_000_000_000
CONTACT_BASE = 30_000_000_000_000
INBOX, TRASH = 900, 901

CURRENCIES = ["USD", "CAD", "EUR", "GBP", "AUD"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PAYMENTS = ["Visa", "Mastercard", "Cash", "Debit Card", "Check"]
TAX_CATEGORIES = ["Standard", "Reduced"]
PROJECTS = ["Job-1", "Job-2", "Job-3"]
TAX_LABELS = ["GST", "HST", "PST", "VAT", "Sales Tax"]
NAME_TAILS = ["", " #12", " Inc.", " Store 7"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt_out(df: DataFrame) -> DataFrame:
    """One shuffle before a compute-heavy map, so that its work is spread however the source is cut into files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return dealt_out(read(spark, sf_dir, table))


def fixed_list(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows written here as a table whose small size the optimiser knows, so that joins with it never shuffle the other side."""
    kinds = [part.split() for part in schema.split(", ")]
    row = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(values, kinds)]) for values in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*row)))


def pick(values: list[str], index) -> F.Column:
    """Zero-based choice from a short fixed list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def letters(number) -> F.Column:
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def minor(price) -> F.Column:
    return F.round(price * 100).cast("bigint")


def millis(ts) -> F.Column:
    return F.unix_millis(ts.cast("timestamp"))


def vendor_name(key) -> F.Column:
    return F.concat(letters(key), F.lit(" Trading"), pick(NAME_TAILS, key % 4))


_bases: dict[tuple[str, str], Library] = {}


def base_library(spark: SparkSession, sf_dir: str) -> Library:
    """The lazy mapping; planned once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases:
        _bases[key] = mapped_tables(spark, sf_dir)
    return dict(_bases[key])


def mapped_tables(spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame, str, str], DataFrame] = lambda df, name, by: df) -> Library:
    """``kept`` is asked for what several tables are made of, with the column they meet by: orders with their customers, and
    lines by order and tax rate."""
    t = {name: read(spark, sf_dir, name) for name in (
        "region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "conversations"
    )}
    lib: Library = {}
    at = F.lit(SPLIT_AT)
    roots = t["region"].select((1 + F.col("r_regionkey")).alias("id"), F.lit("user").alias("kind"),
                               F.col("r_name").alias("name"), F.col("r_regionkey").alias("sort_order"))
    leaves = t["nation"].select((100 + F.col("n_nationkey")).alias("id"), (1 + F.col("n_regionkey")).alias("parent_id"),
                                F.lit("user").alias("kind"), F.col("n_name").alias("name"),
                                (F.col("n_nationkey") % 3).alias("sort_order"))
    system = fixed_list(spark, [(INBOX, "inbox", "Inbox", -1), (TRASH, "trash", "Trash", 99)],
                        "id bigint, kind string, name string, sort_order int")
    folders = [shaped(f.withColumns({"created_at": at, "modified_at": at}), "folder") for f in (roots, leaves, system)]
    lib["folder"] = folders[0].unionByName(folders[1]).unionByName(folders[2])

    supplier = t["supplier"].select("s_suppkey", vendor_name(F.col("s_suppkey")).alias("name"))
    lib["vendor"] = shaped(
        supplier.select(
            (1 + F.col("s_suppkey")).alias("id"), "name", normalize_vendor(F.col("name")).alias("normalized_name"),
            F.when(F.col("s_suppkey") % 3 == 0, 1 + F.col("s_suppkey") % 5).alias("default_category_id"),
            (F.col("s_suppkey") % 2 == 0).alias("is_seed"), at.alias("created_at"),
        ), "vendor")
    for table, names in (("category", SEGMENTS), ("tax_category", TAX_CATEGORIES),
                         ("payment_type", PAYMENTS), ("project", PROJECTS)):
        rows = [(i + 1, n, True, SPLIT_AT) for i, n in enumerate(names)]
        lib[table] = shaped(fixed_list(spark, rows, "id bigint, name string, is_seed boolean, created_at bigint"), table)
    lib["cabinet"] = shaped(fixed_list(spark, [(1, "Library", "USD")], "id bigint, display_name string, base_currency string"), "cabinet")

    # Receipts: one per order.
    nation = F.broadcast(t["nation"].select("n_nationkey", "n_name", "n_regionkey"))
    customer = t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rate = F.round(F.col("l_tax") * 100).cast("int")
    raw_tax = minor(F.col("l_extendedprice")) * (100 - F.round(F.col("l_discount") * 100).cast("bigint")) * rate
    taxed = t["lineitem"].select(F.col("l_orderkey").alias("item_id"), rate.alias("rate"), "l_suppkey",
                                 F.call_function("div", raw_tax + 5000, F.lit(10000)).alias("amount"))
    by_rate = kept(
        taxed.groupBy("item_id", "rate").agg(F.sum("amount").alias("amount_minor"), F.min("l_suppkey").alias("supp")), "base-taxed", "item_id")
    lib["receipt_tax_line"] = shaped(
        by_rate.select((F.col("item_id") * 16 + F.col("rate")).alias("id"), "item_id",
                       pick(TAX_LABELS, F.col("rate") % 5).alias("label"), (F.col("rate") * 100).alias("rate_bp"),
                       "amount_minor", (1 + F.col("rate") % 2).alias("tax_category_id")), "receipt_tax_line")
    per_order = by_rate.groupBy("item_id").agg(F.min("supp").alias("supp"), F.sum("amount_minor").alias("tax"))
    order = kept(t["orders"].join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority", "c_nationkey", "c_mktsegment", "n_regionkey"), "base-orders", "o_orderkey")
    key = F.col("o_orderkey")
    created = millis(F.col("o_orderdate"))
    receipts = order.select(
        key.alias("id"),
        F.when(key % 7 == 0, INBOX).otherwise(100 + F.coalesce("c_nationkey", F.lit(0))).alias("folder_id"),
        F.lit("receipt").alias("type"),
        F.when(F.col("o_orderstatus") != "O", created + DAY).alias("reviewed_at"),
        F.when(key % 29 == 0, created + 2 * DAY).alias("trashed_at"),
        created.alias("created_at"), created.alias("modified_at"),
    )
    event = t["events"].select(
        F.col("event_id").alias("item_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type",
    )
    conf = lambda n: F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"))
    record = F.concat(
        F.lit('{"total":{"value":"'), F.col("k").cast("string"), F.lit('","confidence":'), conf(F.col("k")),
        F.lit(',"pinned":'), F.when(F.col("event_type") == "purchase", "true").otherwise("false"),
        F.lit('},"vendor":{"confidence":'), conf(F.col("k") * 7 % 100),
        F.lit('},"description":{"confidence":0.10}}'),
    )
    event = event.select("item_id", F.when(F.col("item_id") % 50 == 0, "{bad").otherwise(record).alias("extraction_json"))
    lib["receipt_data"] = shaped(
        order.withColumn("item_id", key).join(event, "item_id", "left").join(per_order, "item_id", "left").select(
            "item_id",
            F.when(key % 17 != 0, F.col("o_orderdate").cast("date")).alias("txn_date"),
            (1 + F.col("supp")).alias("vendor_id"),
            F.when(key % 13 != 0, minor(F.col("o_totalprice"))).alias("total_minor"),
            pick(CURRENCIES, F.coalesce("n_regionkey", F.lit(0))).alias("currency"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("payment_type_id"),
            F.when(key % 19 != 0, F.col("tax")).alias("tax_total_minor"),
            F.when(key % 11 != 0, F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))).alias("category_id"),
            F.when(key % 5 != 0, 1 + key % 2).alias("tax_category_id"),
            F.when(key % 10 == 0, 1 + key % 3).alias("project_id"),
            F.concat(F.lit("INV-"), key.cast("string")).alias("external_ref"),
            "extraction_json",
        ), "receipt_data")

    # Documents and contacts.
    doc = t["documents"]
    doc_id = DOCUMENT_BASE + F.col("doc_id")
    doc_created = F.lit(SPLIT_AT) + F.col("doc_id") * 60000
    documents = doc.select(
        doc_id.alias("id"), F.lit(INBOX).alias("folder_id"), F.lit("document").alias("type"),
        F.when(F.col("doc_id") % 37 == 0, doc_created + DAY).alias("trashed_at"),
        doc_created.alias("created_at"), doc_created.alias("modified_at"))
    lib["document_data"] = shaped(doc.select(
        doc_id.alias("item_id"), F.col("source").alias("title"), F.col("lang").alias("notes"),
        F.when(F.col("doc_id") % 2 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))).alias("doc_date"),
    ), "document_data")
    contact_id = CONTACT_BASE + F.col("c_custkey")
    contacts = customer.select(
        contact_id.alias("id"), (100 + F.col("c_nationkey")).alias("folder_id"), F.lit("contact").alias("type"),
        at.alias("reviewed_at"), at.alias("created_at"), at.alias("modified_at"))
    lib["contact_data"] = shaped(customer.select(
        contact_id.alias("item_id"), F.lit("Customer").alias("first_name"), letters(F.col("c_custkey")).alias("last_name"),
        F.col("n_name").alias("org"), F.col("c_mktsegment").alias("title"),
        F.concat(F.lit('["c'), F.col("c_custkey").cast("string"), F.lit('@example.com"]')).alias("emails_json"),
    ), "contact_data")
    lib["item"] = (
        shaped(receipts, "item").unionByName(shaped(documents, "item")).unionByName(shaped(contacts, "item"))
    )

    # Pages: chat turns hang on the receipt with the same number; each document has one page.
    chat = t["conversations"]
    turn = F.col("turn")
    state = (F.col("conv_id") + turn) % 11
    done = state > 1
    chat_pages = chat.select(
        ((F.col("conv_id") * F.lit(1 << 31) + turn) * 2 + 1).alias("id"), F.col("conv_id").alias("item_id"), (turn + 1).alias("seq"),
        F.concat_ws("", F.lit("images/"), F.col("conv_id"), F.lit("-"), turn, F.lit(".jpg")).alias("file_relpath"),
        F.when(turn % 3 != 0, F.concat_ws("", F.lit("thumbs/"), F.col("conv_id"), F.lit("-"), turn, F.lit(".jpg"))).alias("thumb_relpath"),
        F.sha2("text", 256).alias("content_hash"), F.lit(1000).alias("width"), F.lit(1400).alias("height"), F.lit(0).alias("rotation"),
        F.when(state == 0, "failed").when(state == 1, "pending").otherwise("done").alias("ocr_status"),
        F.when(done, F.col("text")).alias("ocr_text"),
        F.when(done, turn % 10 / F.lit(10.0)).alias("ocr_conf"),
        F.lit("fixture").alias("ocr_engine"), F.lit(1).alias("ocr_generation"), at.alias("created_at"))
    doc_pages = doc.select(
        (F.col("doc_id") * 2).alias("id"), doc_id.alias("item_id"), F.lit(1).alias("seq"),
        F.concat_ws("", F.lit("images/d"), F.col("doc_id"), F.lit(".png")).alias("file_relpath"),
        F.sha2("text", 256).alias("content_hash"), F.lit(0).alias("rotation"), F.lit("done").alias("ocr_status"),
        F.col("text").alias("ocr_text"), F.lit(0.9).alias("ocr_conf"), F.lit("fixture").alias("ocr_engine"),
        F.lit(1).alias("ocr_generation"), at.alias("created_at"))
    lib["page"] = shaped(chat_pages, "page").unionByName(shaped(doc_pages, "page"))
    lib["item_source_file"] = shaped(doc.select(
        doc_id.alias("item_id"), F.sha2("text", 256).alias("source_sha256"),
        F.concat_ws("", F.lit("inbox/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("source_relpath"),
        F.concat_ws("", F.col("doc_id"), F.lit(".txt")).alias("original_name"), at.alias("created_at")), "item_source_file")

    lib["rule"] = vendor_rules(lib)
    for table in ("split_group", "merge_group", "merge_group_member", "custom_field_def", "custom_field_value",
                  "job", "backup_log", "archive_log"):
        lib[table] = empty(spark, table)
    lib["item_search_src"] = search_source(lib)
    return lib


def vendor_rules(lib: Library) -> DataFrame:
    """A rule per third vendor, matched by id, normalised name or display name in turn."""
    v = lib["vendor"]
    k = F.col("id")
    match = (
        F.when(k % 9 == 0, F.concat(F.lit('{"vendorId":'), k.cast("string"), F.lit("}")))
        .when(k % 9 == 3, F.concat(F.lit('{"vendorNormalized":"'), F.col("normalized_name"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"vendorName":"'), F.upper("normalized_name"), F.lit('!"}')))
    )
    return shaped(v.filter(k % 3 == 0).select(
        k.alias("id"), F.lit("vendor_to_category").alias("kind"), match.alias("match_json"),
        F.concat(F.lit('{"categoryId":'), (1 + k % 5).cast("string"), F.lit("}")).alias("action_json"),
        F.lit(100).alias("priority"), F.lit("user").alias("source"), F.lit(0).alias("hit_count"),
        (k % 4 != 0).alias("enabled"), F.lit(SPLIT_AT).alias("created_at")), "rule")


def split_parts(spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Lines of every order with status P as parts of a split, weighted by price; ``kept`` as in ``mapped_tables``."""
    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    some = order.filter("o_orderstatus = 'P' AND o_orderkey % 29 <> 0 AND o_orderkey % 13 <> 0").select(
        F.col("o_orderkey").alias("l_orderkey"))
    parts = kept(line.join(some, "l_orderkey", "left_semi").select(
        F.col("l_orderkey").alias("item_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ord")), "base-parts", "item_id")
    return parts.withColumn("weight", minor(F.col("ord.l_extendedprice")).cast("decimal(20,6)"))


_libraries: dict[tuple[str, str], Library] = {}


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The library with split receipts; split tables are written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _libraries:
        base = mapped_tables(spark, sf_dir, packed)
        base["receipt_data"] = packed(base["receipt_data"], "base-receipt_data", "item_id")  # read many times below
        lib, _ = split_receipts(base, split_parts(spark, sf_dir, packed), SPLIT_AT)
        # Some first children are in the trash, so their groups show drift.
        item = lib["item"]
        lib["item"] = item.withColumn(
            "trashed_at",
            F.when((F.col("split_role") == "child") & (F.col("id") % 31 == 0), F.lit(SPLIT_AT + DAY)).otherwise(F.col("trashed_at")),
        )
        # The other tables that splits extend are unions of what is written already.
        for table in ("item", "split_group"):
            lib[table] = packed(lib[table], table)
        lib["item_search_src"] = search_source(lib)
        _libraries[key] = lib
    return dict(_libraries[key])
