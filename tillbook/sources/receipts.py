"""Receipt texts printed from orders and their lines, with the truth they were printed from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.functions.money import minor_to_text
from tillbook.sources.star import TAX_LABELS, dealt_out, minor, pick, read, vendor_name


def receipt_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: what is printed on its receipt.

    Lines are summed by return flag and tax rate first, so a receipt has a bounded number of
    printed lines even if one order owns a large share of all lines.
    """
    line = read(spark, sf_dir, "lineitem")
    rate = F.round(F.col("l_tax") * 100).cast("int")
    price = minor(F.col("l_extendedprice"))
    raw = price * (100 - F.round(F.col("l_discount") * 100).cast("bigint")) * rate
    small = line.groupBy("l_orderkey", rate.alias("rate"), F.col("l_returnflag").alias("flag")).agg(
        F.sum(price).alias("net"),
        F.sum(F.call_function("div", raw + 5000, F.lit(10000))).alias("tax"),
        F.min("l_suppkey").alias("supp"),
    )
    # From here on everything is by order: one shuffle of the combined lines serves all sums and joins.
    small = small.repartition("l_orderkey")
    per_rate = small.groupBy("l_orderkey", "rate").agg(F.sum("tax").alias("tax"), F.sum("net").alias("net"), F.min("supp").alias("supp"))
    taxes = per_rate.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("rate", "tax"))).alias("taxes"),
        F.sum("net").alias("net"), F.sum("tax").alias("tax"), F.min("supp").alias("supp"))
    flags = small.groupBy("l_orderkey", "flag").agg(F.sum("net").alias("net")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("flag", "net"))).alias("items"))
    order = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.col("o_orderdate").cast("date").alias("txn_date"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("pay"))
    return (
        order.join(taxes.withColumnRenamed("l_orderkey", "page_id"), "page_id")
        .join(flags.withColumnRenamed("l_orderkey", "page_id"), "page_id")
        .select(
            "page_id", "txn_date", "items", "taxes",
            vendor_name(F.col("supp")).alias("vendor"),
            F.col("net").alias("subtotal_minor"), F.col("tax").alias("tax_minor"), (F.col("net") + F.col("tax")).alias("total_minor"),
            "pay",
        )
    )


def receipt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, ocr_text: five date styles, thousands commas on every third receipt."""
    f = receipt_facts(spark, sf_dir)
    key = F.col("page_id")
    date = (
        F.when(key % 5 == 0, F.date_format("txn_date", "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format("txn_date", "dd MMM yyyy"))
        .when(key % 5 == 2, F.concat(F.lit("Date: "), F.date_format("txn_date", "MM/dd/yyyy")))
        .when(key % 5 == 3, F.date_format("txn_date", "MMMM d, yyyy"))
        .otherwise(F.concat(F.lit("DATED "), F.date_format("txn_date", "M-d-yy")))
    )

    def amount(m):
        whole = F.format_number(F.call_function("div", m, F.lit(100)), 0)
        return F.when(key % 3 == 0, F.concat(F.lit("$"), whole, F.lit("."), F.lpad((m % 100).cast("string"), 2, "0"))).otherwise(minor_to_text(m))

    method = pick(["Visa ************4821", "MASTERCARD", "Cash", "Debit", "Check"], F.col("pay"))
    item_lines = F.transform("items", lambda i: F.concat(F.lit("Goods "), i["flag"], F.lit("   "), amount(i["net"])))
    tax_lines = F.transform(
        "taxes",
        lambda t: F.concat(pick(TAX_LABELS, t["rate"] % 5), F.lit(" "), t["rate"].cast("string"), F.lit("% "), amount(t["tax"])))
    total = F.when(key % 7 == 0, F.concat(F.lit("TOTAL\n"), amount(F.col("total_minor")))).when(
        key % 7 == 1, F.concat(F.lit("T0TAL "), amount(F.col("total_minor")))).otherwise(
        F.concat(F.lit("TOTAL "), amount(F.col("total_minor"))))
    text = F.concat_ws(
        "\n", "vendor", date, F.concat(F.lit("Invoice # INV-"), key.cast("string")), item_lines,
        F.concat(F.lit("SUBTOTAL "), amount(F.col("subtotal_minor"))), tax_lines, total, method)
    return dealt_out(f.select(key, text.alias("ocr_text")))


# Printed forms of payment methods, and of total labels, in the order in which receipts take turns with them.
PRINTED_METHODS = [
    "AMEX ****1001", "American Express", "MC ****1111", "Master Card", "VISA", "Discover", "INTERAC", "Girocard", "EC-Karte",
    "Maestro", "iDEAL", "BACS", "Apple Pay", "Google Pay", "PayPal", "Debit", "Credit Card", "Terms: NET 30", "Terms: net",
    "On account", "Cash tendered", "Paid by check",
]
PRINTED_TOTALS = ["GRAND TOTAL", "AMOUNT DUE", "BALANCE DUE", "TOTAL DUE", "GESAMT", "TOTAAL", "ZU ZAHLEN", "TOTAL"]


def hard_receipt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, ocr_text: receipts with tips, fees, discounts, taxes that disagree with the sums, foreign labels, every
    payment method and every total label.  An order's number decides what its receipt looks like."""
    key = F.col("page_id")
    extra, shape = 100 + key % 900, key % 8
    money = lambda label, m: F.concat(F.lit(f"{label} "), minor_to_text(m))
    net, tax = F.col("subtotal_minor"), F.col("tax_minor")
    total = net + tax + F.when(shape.isin(0, 1), extra).when(shape == 2, -extra).when(shape == 5, 100).otherwise(0)
    middle = (
        F.when(shape == 0, F.concat_ws("\n", money("SUBTOTAL", net), money("TAX", tax), money("TIP", extra)))
        .when(shape == 1, F.concat_ws("\n", money("SUBTOTAL", net), money("GST 5%", tax), money("DELIVERY FEE", extra)))
        .when(shape == 2, F.concat_ws("\n", money("SUBTOTAL", net), money("DISCOUNT", extra), money("VAT 20%", tax)))
        .when(shape == 3, F.concat_ws("\n", money("SUBTOTAL", net), money("HST 13%", tax * 10 + 50_000)))
        .when(shape == 4, F.concat_ws("\n", money("NETTO", net), money("MwSt 19%", tax)))
        .when(shape == 5, F.concat_ws("\n", money("SUBTOTAL", net), F.concat(F.lit("COUPON -"), minor_to_text(extra)),
                                      money("SERVICE CHARGE", extra + 100), money("TVQ", tax)))
        .when(shape == 6, F.concat_ws("\n", money("GST 5%", tax), money("PST 7%", F.call_function("div", total * 99, F.lit(100)))))
    )
    label = F.when(shape == 4, "SUMME").otherwise(pick(PRINTED_TOTALS, F.call_function("div", key, F.lit(8)) % len(PRINTED_TOTALS)))
    date = (
        F.when(key % 3 == 0, F.date_format("txn_date", "yyyy-MM-dd")).when(key % 3 == 1, F.date_format("txn_date", "dd MMM yyyy"))
        .otherwise(F.concat(F.lit("Date: "), F.date_format("txn_date", "MM/dd/yyyy")))
    )
    text = F.concat_ws("\n", "vendor", date, middle, F.concat(label, F.lit(" "), minor_to_text(total)), pick(PRINTED_METHODS, key % len(PRINTED_METHODS)))
    return dealt_out(receipt_facts(spark, sf_dir).select(key, text.alias("ocr_text")))


def receipt_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = pick(["VISA ****4821", "MASTERCARD", "CASH", "DEBIT", "CHECK"], F.col("pay"))
    return receipt_facts(spark, sf_dir).select(
        "page_id", F.col("total_minor").alias("total"), F.col("txn_date").alias("txnDate"), "vendor",
        F.col("tax_minor").alias("taxTotal"), methods.alias("paymentType"))


