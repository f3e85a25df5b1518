"""Listings of files (S2), vCards (S9), seed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillbook.functions.money import trimmed
from tillbook.functions.names import normalize_vendor
from tillbook.plans.scale import next_id, number_rows
from tillbook.schemas import Library, shaped, with_tables

# What can be imported, what is ignored, how deep folders go.
IMAGE_TYPES = ["jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp"]
DOCUMENT_TYPES = ["pdf"]
CARD_TYPES = ["vcf", "vcard"]
LISTED_TYPES = [*IMAGE_TYPES, "pdf", "vcf"]
IGNORED_NAMES = ["desktop.ini", "thumbs.db"]
MAX_DEPTH = 25


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def kind_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_TYPES), "image").when(ext.isin(*DOCUMENT_TYPES), "document").when(ext.isin(*CARD_TYPES), "card")


def judged_listing(files: DataFrame, root: str = "") -> DataFrame:
    """Path → listed / unsupported / ignored, by name and depth below the root."""
    relative = F.regexp_replace(F.substring(F.col("path"), len(root) + 1, 1 << 30), "^/+", "")
    parts = F.split(relative, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == "") | F.lower(p).isin(*IGNORED_NAMES))
    return files.withColumn(
        "status",
        F.when(hidden | (F.size(parts) - 1 > MAX_DEPTH), "ignored")
        .when(extension(F.col("path")).isin(*LISTED_TYPES), "listed")
        .otherwise("unsupported"),
    )


def importable(files: DataFrame, root: str = "") -> DataFrame:
    """The files worth importing, in path order."""
    return judged_listing(files, root).filter("status = 'listed'").drop("status").orderBy("path")


def unsupported_count(files: DataFrame, root: str = "") -> DataFrame:
    return judged_listing(files, root).agg(F.count_if(F.col("status") == "unsupported").alias("skipped_unsupported"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and modification time below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size, time, bytes: the input of an import."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")


# --- vCards --------------------------------------------------------------------------


def _unescaped(value: Column) -> Column:
    out = F.regexp_replace(value, r"(?i)\\n", "\n")
    for escaped, plain in ((r"\,", ","), (r"\;", ";"), ("\\\\", "\\")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def _or_null(value: Column) -> Column:
    return F.nullif(trimmed(value), F.lit(""))


def parse_vcards(texts: DataFrame) -> DataFrame:
    """Cards of .vcf texts (path, text) → one row per card (path, card_no, …).

    A text is unfolded and cut into cards in its row; the lines of a card stay one array, so
    every property is an expression over it.
    """
    unfolded = F.regexp_replace(F.regexp_replace(F.col("text"), r"\r?\n[ \t]", ""), "\r", "\n")
    cards = F.regexp_extract_all(
        F.concat(F.lit("\n"), unfolded, F.lit("\n")), F.lit(r"(?si)\nBEGIN:VCARD[ \t]*\n(.*?)\nEND:VCARD(?=[ \t]*\n)"), F.lit(1))
    rows = texts.select("path", F.posexplode(cards).alias("card_no", "body"))

    def prop(line: Column) -> Column:
        left = F.substring_index(line, ":", 1)
        name = F.upper(F.substring_index(F.substring_index(left, ";", 1), ".", -1))
        value = _unescaped(trimmed(F.regexp_replace(line, r"^[^:]*:", "")))
        return F.struct(name.alias("name"), value.alias("value"))

    lines = F.filter(F.split("body", "\n"), lambda l: l.contains(":") & ~l.startswith(" "))
    rows = rows.withColumn("props", F.transform(lines, lambda l: prop(F.rtrim(l))))

    def values(name: str) -> Column:
        return F.transform(F.filter("props", lambda p: p["name"] == name), lambda p: p["value"])

    def last(name: str) -> Column:
        # A repeated property: the later line counts.
        return F.try_element_at(values(name), F.lit(-1))

    def filled(items: Column) -> Column:
        return F.filter(items, lambda v: v != "")

    parts = F.split(last("N"), ";")
    address = lambda a: F.array_join(F.filter(F.transform(F.split(a, ";"), trimmed), lambda b: b != ""), ", ")
    rows = rows.select(
        "path",
        "card_no",
        _or_null(F.get(parts, F.lit(1))).alias("_first"),
        _or_null(F.get(parts, F.lit(0))).alias("_last"),
        _or_null(last("FN")).alias("fn"),
        _or_null(F.substring_index(last("ORG"), ";", 1)).alias("org"),
        _or_null(last("TITLE")).alias("title"),
        filled(values("EMAIL")).alias("emails"),
        filled(values("TEL")).alias("phones"),
        filled(F.transform(values("ADR"), address)).alias("addresses"),
        F.get(filled(values("URL")), F.lit(0)).alias("url"),
        _or_null(last("NOTE")).alias("notes"),
    )
    nameless = F.col("_first").isNull() & F.col("_last").isNull() & F.col("fn").isNotNull()
    words = F.split("fn", r"\s+")
    many = F.size(words) > 1
    return rows.select(
        "path",
        "card_no",
        F.when(nameless & many, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
        .when(nameless, F.col("fn"))
        .otherwise(F.col("_first"))
        .alias("first_name"),
        F.when(nameless & many, F.element_at(words, -1)).when(~nameless, F.col("_last")).alias("last_name"),
        "fn", "org", "title", "emails", "phones", "addresses", "url", "notes",
    )


def contacts_of(cards: DataFrame) -> DataFrame:
    """Cards as contact rows: lists as JSON text."""
    return cards.withColumns(
        {"emails_json": F.to_json("emails"), "phones_json": F.to_json("phones"), "addresses_json": F.to_json("addresses")}
    )


# --- seed lists ----------------------------------------------------------------------

# Fixed values that must match: the starter lists of a new library, in the order in which they are numbered.
SEED_CATEGORIES = [
    "Office Supplies", "Materials", "Fuel", "Travel", "Meals & Entertainment", "Software & Subscriptions",
    "Professional Services", "Utilities", "Insurance", "Equipment", "Shipping & Postage", "Advertising & Marketing",
    "Vehicle Expenses", "Repairs & Maintenance", "Rent & Lease", "Payroll & Benefits", "Bank Fees", "Taxes & Licenses",
    "Training & Education", "Telecommunications", "Medical", "Charitable Contributions", "Personal (Non-deductible)",
    "Uncategorized",
]
# (name, form reference)
SEED_TAX_CATEGORIES = [
    ("Cost of Goods Sold", "Schedule C L4"),
    ("Advertising", "Schedule C L8"),
    ("Car and Truck Expenses", "Schedule C L9"),
    ("Commissions and Fees", "Schedule C L10"),
    ("Contract Labor", "Schedule C L11"),
    ("Depletion", "Schedule C L12"),
    ("Depreciation", "Schedule C L13"),
    ("Employee Benefit Programs", "Schedule C L14"),
    ("Insurance (other than health)", "Schedule C L15"),
    ("Interest — Mortgage", "Schedule C L16a"),
    ("Interest — Other", "Schedule C L16b"),
    ("Legal and Professional Services", "Schedule C L17"),
    ("Office Expense", "Schedule C L18"),
    ("Pension and Profit-Sharing", "Schedule C L19"),
    ("Rent — Vehicles / Machinery", "Schedule C L20a"),
    ("Rent — Other Business Property", "Schedule C L20b"),
    ("Repairs and Maintenance", "Schedule C L21"),
    ("Supplies", "Schedule C L22"),
    ("Taxes and Licenses", "Schedule C L23"),
    ("Travel", "Schedule C L24a"),
    ("Meals", "Schedule C L24b"),
    ("Utilities", "Schedule C L25"),
    ("Wages", "Schedule C L26"),
    ("Other Expenses", "Schedule C L27a"),
    ("Non-deductible", None),
    ("Capital Expenditure", None),
    ("Sales Tax Paid", None),
]
SEED_PAYMENT_TYPES = [
    "Cash", "Check", "Visa", "Mastercard", "American Express", "Discover", "Debit Card", "ACH / Bank Transfer", "PayPal",
    "Venmo", "Apple Pay", "Google Pay", "Wire Transfer", "Store Credit", "Other",
]
# (name, default category)
SEED_VENDORS = [
    ("Staples", "Office Supplies"),
    ("Office Depot", "Office Supplies"),
    ("OfficeMax", "Office Supplies"),
    ("Amazon", "Office Supplies"),
    ("Amazon Web Services", "Software & Subscriptions"),
    ("Walmart", "Materials"),
    ("Target", "Materials"),
    ("Costco", "Materials"),
    ("Sam's Club", "Materials"),
    ("Home Depot", "Materials"),
    ("Lowe's", "Materials"),
    ("Ace Hardware", "Materials"),
    ("Menards", "Materials"),
    ("Harbor Freight", "Equipment"),
    ("Grainger", "Materials"),
    ("Fastenal", "Materials"),
    ("Shell", "Fuel"),
    ("Exxon", "Fuel"),
    ("ExxonMobil", "Fuel"),
    ("Chevron", "Fuel"),
    ("BP", "Fuel"),
    ("Mobil", "Fuel"),
    ("Sunoco", "Fuel"),
    ("Valero", "Fuel"),
    ("Marathon", "Fuel"),
    ("Wawa", "Fuel"),
    ("Sheetz", "Fuel"),
    ("QuikTrip", "Fuel"),
    ("RaceTrac", "Fuel"),
    ("UPS", "Shipping & Postage"),
    ("FedEx", "Shipping & Postage"),
    ("USPS", "Shipping & Postage"),
    ("DHL", "Shipping & Postage"),
    ("Verizon", "Telecommunications"),
    ("AT&T", "Telecommunications"),
    ("T-Mobile", "Telecommunications"),
    ("Comcast", "Telecommunications"),
    ("Spectrum", "Telecommunications"),
    ("Microsoft", "Software & Subscriptions"),
    ("Adobe", "Software & Subscriptions"),
    ("Google", "Software & Subscriptions"),
    ("Apple", "Software & Subscriptions"),
    ("Dropbox", "Software & Subscriptions"),
    ("Slack", "Software & Subscriptions"),
    ("Zoom", "Software & Subscriptions"),
    ("GitHub", "Software & Subscriptions"),
    ("Notion", "Software & Subscriptions"),
    ("Intuit", "Software & Subscriptions"),
    ("QuickBooks", "Software & Subscriptions"),
    ("Uber", "Travel"),
    ("Lyft", "Travel"),
    ("Delta Air Lines", "Travel"),
    ("United Airlines", "Travel"),
    ("American Airlines", "Travel"),
    ("Southwest Airlines", "Travel"),
    ("Hilton", "Travel"),
    ("Marriott", "Travel"),
    ("Airbnb", "Travel"),
    ("Enterprise Rent-A-Car", "Travel"),
    ("Hertz", "Travel"),
    ("Starbucks", "Meals & Entertainment"),
    ("McDonald's", "Meals & Entertainment"),
    ("Chipotle", "Meals & Entertainment"),
    ("Panera Bread", "Meals & Entertainment"),
    ("Dunkin'", "Meals & Entertainment"),
    ("Subway", "Meals & Entertainment"),
    ("PG&E", "Utilities"),
    ("Con Edison", "Utilities"),
    ("Duke Energy", "Utilities"),
    ("Chase", "Bank Fees"),
    ("Bank of America", "Bank Fees"),
    ("Wells Fargo", "Bank Fees"),
    ("Stripe", "Bank Fees"),
    ("PayPal", "Bank Fees"),
    ("AutoZone", "Vehicle Expenses"),
    ("O'Reilly Auto Parts", "Vehicle Expenses"),
    ("Jiffy Lube", "Vehicle Expenses"),
    ("Best Buy", "Equipment"),
    ("Apple Store", "Equipment"),
    ("CVS", "Medical"),
    ("Walgreens", "Medical"),
    ("LinkedIn", "Advertising & Marketing"),
    ("Facebook Ads", "Advertising & Marketing"),
    ("Google Ads", "Advertising & Marketing"),
    ("Indeed", "Professional Services"),
    ("Fiverr", "Professional Services"),
    ("Upwork", "Professional Services"),
]


def _seeded(lib: Library, table: str, rows: list[tuple], columns: str, now: int) -> DataFrame:
    spark = lib[table].sparkSession
    seeds = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {columns}")
    fresh = seeds.join(lib[table].select("name"), "name", "left_anti")
    fresh = number_rows(fresh, ["ord"], out="id", start=next_id(lib[table]))
    fresh = fresh.withColumns({"is_seed": F.lit(True), "created_at": F.lit(now)})
    return lib[table].unionByName(shaped(fresh, table))


def apply_seed(lib: Library, now: int) -> Library:
    """Starter lists, only into a library without vendors and categories; name conflicts are kept."""
    if not (lib["vendor"].isEmpty() and lib["category"].isEmpty()):
        return lib
    category = _seeded(lib, "category", [(n,) for n in SEED_CATEGORIES], "name string", now)
    tax = _seeded(lib, "tax_category", SEED_TAX_CATEGORIES, "name string, form_ref string", now)
    payment = _seeded(lib, "payment_type", [(n,) for n in SEED_PAYMENT_TYPES], "name string", now)
    spark = category.sparkSession
    pairs = [(i, name, category_name) for i, (name, category_name) in enumerate(SEED_VENDORS)]
    vendors = spark.createDataFrame(pairs, "ord int, name string, category string").join(
        category.select(F.col("name").alias("category"), F.col("id").alias("default_category_id")), "category", "left")
    vendors = number_rows(vendors, ["ord"], out="id", start=next_id(lib["vendor"])).withColumns(
        {"normalized_name": normalize_vendor(F.col("name")), "is_seed": F.lit(True), "created_at": F.lit(now)})
    return with_tables(lib, category=category, tax_category=tax, payment_type=payment, vendor=shaped(vendors, "vendor"))


