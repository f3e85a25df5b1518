"""Receipt fields from page text.

One page is one row, and a whole extraction is a narrow projection: ``reading`` takes the lines of a page apart
in plain Python, a batch of pages at a time.  Only the vendor list is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tillbook.functions.checks import FIELD_RECORD, json_fields
from tillbook.functions.names import ocr_normalize
from tillbook.operators.lines import BOX, with_lines
from tillbook.operators.reading import TOP_LINES, read_batches
from tillbook.plans.marks import marked_pieces, marks
from tillbook.schemas import Library
from tillbook.session import stored

FOUND = f"struct<value:string,confidence:double,bbox:{BOX}>"


# --- vendors -------------------------------------------------------------------------

GRAM = 8
# Places of a needle shorter than that.
SPREAD = 32
# Characters that a gram travels with, itself among them.
REACH = 64


def known_vendor_matches(pages: DataFrame, vendors: DataFrame) -> DataFrame:
    """E5: (page_id, vendor) – the longest known name found in the first lines.

    A name is found if its folded first word (four letters or more), else its whole folded
    form, occurs in the folded text.  That makes one needle per name, and only the best name
    of a needle can win; needles meet texts by an equi-join on the needle's first characters,
    not by comparing every page with every vendor.  ``vendors``: id, name.
    """
    folded = ocr_normalize(F.col("name"))
    first = F.substring_index(folded, " ", 1)
    needles = (
        vendors.withColumn("needle", F.when(F.length(first) >= 4, first).otherwise(folded))
        # A name without ASCII letters or digits folds to nothing; it is looked up literally.
        .withColumn("literal", F.col("needle") == "")
        .withColumn("needle", F.when(F.col("literal"), F.lower("name")).otherwise(F.col("needle")))
        .filter("needle <> ''")
        .groupBy("needle", "literal")
        .agg(F.max(F.struct(F.length("name").alias("size"), (-F.col("id")).alias("earlier"), "name")).alias("best"))
        .withColumn("gram", F.substring("needle", 1, GRAM))
        .withColumn("glen", F.length("gram"))
    )
    # At most GRAM different lengths for folded and for literal needles, and a bitmap: this is all that reaches the driver.
    lengths: dict[bool, list[int]] = {}
    longest = 0
    for literal, length, size in needles.groupBy("literal", "glen").agg(F.max(F.length("needle"))).collect():
        lengths.setdefault(literal, []).append(length)
        longest = max(longest, size)
    if not lengths:
        return pages.select("page_id", F.lit(None).cast("string").alias("vendor")).limit(0)
    blob = F.array_join(F.transform(F.slice("lines", F.lit(1), F.lit(TOP_LINES)), lambda l: l["text"]), " ")
    # A text is folded for folded needles and lower-cased for literal ones; a form that no needle has is not made.
    forms = {False: ocr_normalize(blob), True: F.lower(blob)}
    texts = stored(
        pages.select(
            "page_id",
            F.explode(F.array(*[F.struct(F.lit(k).alias("literal"), forms[k].alias("hay")) for k in sorted(lengths)])).alias("t"),
        ).select("page_id", "t.literal", "t.hay"),
        "tops",
    )

    # Only grams that some needle may have leave a page. Those of few characters stand on nearly every page: their needles
    # lie in SPREAD places, and a page asks in one.
    found = marked_pieces(F.col("literal"), F.col("hay"), lengths, marks(needles, "gram"), REACH)
    short = F.length("gram") < GRAM
    spread = F.when(short, F.pmod(F.xxhash64("page_id"), F.lit(SPREAD))).otherwise(F.lit(0))
    places = F.when(short, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    grams = (
        texts.select("page_id", "literal", F.explode(found).alias("p"))
        .select("page_id", "literal", F.col("p.piece").alias("gram"), "p.rest")
        .withColumn("place", spread.cast("int"))
    )
    asked = needles.select("literal", "gram", "needle", "best", F.explode(places).alias("place"))
    met = grams.join(asked, ["literal", "gram", "place"])
    # A gram travels with what follows it, but not with the text: only a needle longer than both is looked up in that.
    here = F.concat("gram", "rest")
    sure = met.filter((F.length("needle") <= REACH) & here.startswith(F.col("needle"))).select("page_id", "best")
    if longest > REACH:
        begun = met.filter((F.length("needle") > REACH) & F.col("needle").startswith(here)).select("page_id", "literal", "needle", "best")
        checked = begun.join(texts, ["page_id", "literal"]).filter(F.col("hay").contains(F.col("needle"))).select("page_id", "best")
        sure = sure.unionByName(checked)
    return sure.groupBy("page_id").agg(F.max("best")["name"].alias("vendor"))


# --- the record ----------------------------------------------------------------------


def parse_receipts(pages: DataFrame, vendors: DataFrame | None = None, date_order: Column | str = "MDY") -> DataFrame:
    """One row per page with a map field → (value, confidence, bbox); absent = not found.

    Pages: page_id (unique), ocr_text, optionally ocr_words.  Money values are minor units;
    taxTotal is ``{"totalMinor":…, "lines":[{"label":…,"amountMinor":…}]}``.
    """
    if vendors is None:
        named = pages.withColumn("vendor", F.lit(None).cast("string"))
    else:
        # As many parts as a shuffle has, so that the reading behind the join is spread whatever the bytes.
        spread = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
        named = spread.join(known_vendor_matches(with_lines(pages).select("page_id", "lines"), vendors), "page_id", "left")
    # Lines are made anew behind the join: they are wider than the text.
    lined = with_lines(named)
    order = F.lit(date_order) if isinstance(date_order, str) else date_order
    keep = [c for c in pages.columns if c not in ("ocr_words",)]
    read = lined.select(*keep, F.col("ocr_text").alias("_text"), F.col("lines").alias("_lines"), F.col("vendor").alias("_vendor"), order.alias("_order"))
    schema = StructType([*read.select(*keep).schema.fields, StructField("fields", DataType.fromDDL(f"map<string,{FOUND}>"))])
    return read.mapInArrow(read_batches, schema)


def fields_long(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per found field."""
    # Outer, so that no filter on the map is pushed below it and computes everything twice.
    rows = parsed.select(*keys, F.explode_outer("fields").alias("field", "f")).filter("field IS NOT NULL")
    return rows.select(*keys, "field", "f.*")


def extract_items(lib: Library, date_order: str = "MDY") -> DataFrame:
    """Proposals per receipt from its finished pages; the surest page wins, the earlier on ties.

    The page is recorded only for single-page items.  Pages are written once: they are read for the fields, for the
    vendors' names and for their number.
    """
    receipts = lib["item"].filter("type = 'receipt'").select(F.col("id").alias("item_id"))
    pages = (
        lib["page"]
        .filter("ocr_status = 'done' AND ocr_text IS NOT NULL")
        .join(receipts, "item_id", "left_semi")
        .select(F.col("id").alias("page_id"), "item_id", "seq", "ocr_text", "ocr_words")
    )
    pages = stored(pages, "pages")
    count = pages.groupBy("item_id").agg(F.count("*").alias("_pages"))
    long = fields_long(parse_receipts(pages, lib["vendor"].select("id", "name"), date_order), "page_id", "item_id", "seq")
    best = long.groupBy("item_id", "field").agg(
        F.max_by(F.struct("value", "confidence", "bbox", "page_id"), F.struct("confidence", (-F.col("seq")).alias("s"))).alias("p")
    )
    return best.join(count, "item_id").select(
        "item_id", "field", "p.value", "p.confidence", "p.bbox", F.when(F.col("_pages") == 1, F.col("p.page_id")).alias("page_id")
    )


# Field → receipt column that must be empty for a fill.
TARGET_COLUMNS = {
    "vendor": "vendor_id",
    "txnDate": "txn_date",
    "total": "total_minor",
    "taxTotal": "tax_total_minor",
    "paymentType": "payment_type_id",
    "externalRef": "external_ref",
    "description": "description",
}


def fill_empty(lib: Library, proposed: DataFrame, force: bool = False) -> DataFrame:
    """What happens to each proposal: filled, or skipped as pinned or already set."""
    state = lib["receipt_data"].select(
        "item_id",
        json_fields(F.col("extraction_json")).alias("_now"),
        F.create_map(
            *[x for field, column in TARGET_COLUMNS.items() for x in (F.lit(field), F.col(column).isNotNull())]
        ).alias("_set"),
    )
    pinned = F.coalesce(F.try_element_at("_now", F.col("field"))["pinned"], F.lit(False))
    taken = F.coalesce(F.try_element_at("_set", F.col("field")), F.lit(False))
    action = F.lit("filled") if force else F.when(pinned, "pinned").when(taken, "already set").otherwise("filled")
    return proposed.join(state, "item_id", "left").withColumn("action", action).drop("_now", "_set")


def write_fills(lib: Library, outcome: DataFrame, now: int) -> tuple[Library, DataFrame]:
    """Write the filled fields as edits, then record their provenance unpinned."""
    from tillbook.functions.money import minor_to_text
    from tillbook.operators.edits import patch_items
    from tillbook.operators.rules import put_fields
    from tillbook.schemas import shaped, with_tables

    filled = outcome.filter("action = 'filled'")
    minor = F.when(F.col("field") == "taxTotal", F.get_json_object("value", "$.totalMinor")).otherwise(F.col("value")).try_cast("bigint")
    text = F.when(F.col("field").isin("total", "taxTotal"), minor_to_text(minor)).otherwise(F.col("value"))
    names = {"vendor": "vendorName", "total": "totalText", "taxTotal": "taxTotalText", "paymentType": "paymentTypeName"}
    target = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("field")), F.col("field")
    )
    edits = filled.select("item_id", F.lit(1).alias("seq"), target.alias("field"), text.alias("value"))
    lib, errors, _ = patch_items(lib, edits, now)
    # Provenance of the fill replaces the pin the edit left; at most one entry per field.
    proof = filled.join(errors.select("item_id").distinct(), "item_id", "left_anti").groupBy("item_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "field",
                    F.struct(
                        "value", "confidence", "bbox", F.col("page_id").alias("pageId"), F.lit(False).alias("pinned")
                    ),
                )
            )
        ).cast(FIELD_RECORD).alias("_proof")
    )
    receipts = lib["receipt_data"].join(proof, "item_id", "left").withColumn(
        "extraction_json",
        F.when(F.col("_proof").isNotNull(), put_fields(json_fields(F.col("extraction_json")), F.col("_proof"))).otherwise(
            F.col("extraction_json")
        ),
    )
    return with_tables(lib, receipt_data=shaped(receipts, "receipt_data")), errors


def run_pipeline(lib: Library, now: int, date_order: str = "MDY") -> tuple[Library, DataFrame]:
    """Stored pages → fields → empty columns → categories from rules (R4).  Returns the outcome rows."""
    from tillbook.operators.rules import fill_categories
    from tillbook.session import checkpointed

    outcome = checkpointed(fill_empty(lib, extract_items(lib, date_order)))
    lib, _ = write_fills(lib, outcome, now)
    lib, _ = fill_categories(lib)
    return lib, outcome


# --- scoring -------------------------------------------------------------------------


def _agrees(name: str, want: Column, have: Column) -> Column:
    """Vendors agree by their first six letters, payments by containment, the rest exactly."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    if name == "vendor":
        return letters(have).contains(F.substring(letters(want), 1, 6))
    if name == "paymentType":
        return F.upper(have).contains(F.upper(want))
    return want == have


def verdicts(extracted: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Hit, miss or wrong for every record and field.  Nothing to find and nothing found is a hit."""
    got = extracted.select(key, *[F.col(f).cast("string").alias(f"g_{f}") for f in fields])
    pairs = truth.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).join(got, key, "left")

    def verdict(f: str) -> Column:
        want, have = F.col(f), F.col(f"g_{f}")
        return (
            F.when(want.isNull(), F.when(have.isNull(), "hit").otherwise("wrong"))
            .when(have.isNull(), "miss")
            .when(_agrees(f, want, have), "hit")
            .otherwise("wrong")
        )

    return pairs.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), verdict(f).alias("verdict")) for f in fields])).alias("p")).select(
        key, "p.*")


def scorecard(extracted: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Counts per field."""
    return verdicts(extracted, truth, key, fields).groupBy("field").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("hit", "miss", "wrong")]
    )


def fully_correct(extracted: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records with every field right."""
    per_record = verdicts(extracted, truth, key, fields).groupBy(key).agg(F.min(F.col("verdict") == "hit").alias("right"))
    return per_record.agg(F.count_if("right").alias("fully_correct"), F.count("*").alias("records"))
