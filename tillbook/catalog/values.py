"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.functions import checks, dates, money, names
from tillbook.sources import star

CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _orders(spark, sf):
    return star.read(spark, sf, "orders").withColumn("cents", star.minor(F.col("o_totalprice"))).withColumn("k", F.col("o_orderkey"))


def _plain():
    return money.minor_to_text(F.col("cents"))


@query("money_typed", f"""
    select o_orderkey, case o_orderkey % 6 when 0 then {CENTS} when 1 then -{CENTS} when 2 then {CENTS} when 3 then {CENTS} // 100 * 100 end "minor",
      case o_orderkey % 6 when 4 then 'invalid amount: ' || printf('%d.%02d', {CENTS} // 100, {CENTS} % 100) || '5' end error from orders""")
def money_typed(spark, sf):
    """plain, accounting negative, thousands, whole, too many decimals, blank."""
    k, t = F.col("k"), _plain()
    grouped = F.concat(F.format_number(money.whole_units(F.col("cents")), 0), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    text = (F.when(k % 6 == 0, F.concat(F.lit(" $ "), t)).when(k % 6 == 1, F.concat(F.lit("("), t, F.lit(")")))
            .when(k % 6 == 2, F.concat(F.lit("+€"), grouped)).when(k % 6 == 3, F.substring_index(t, ".", 1))
            .when(k % 6 == 4, F.concat(t, F.lit("5"))).otherwise("  "))
    r = money.parse_money_text(text)
    return _orders(spark, sf).select("o_orderkey", r["minor"].alias("minor"), r["error"].alias("error"))


@query("money_from_ocr", f"""
    select o_orderkey, case o_orderkey % 7 when 0 then {CENTS} when 1 then {CENTS} when 2 then -{CENTS} when 3 then {CENTS} when 4 then {CENTS} // 100 * 100 when 5 then case when {CENTS} // 100 >= 100 then {CENTS} // 100 else {CENTS} // 100 * 100 end when 6 then {CENTS} end "minor",
      case o_orderkey % 7 when 4 then 0.6 when 5 then case when {CENTS} // 100 >= 100 then 0.5 else 0.45 end when 3 then case when {CENTS} >= 100000 then 0.95 else 0.85 end else 0.95 end confidence from orders""")
def money_from_ocr(spark, sf):
    """US and European separators, trailing minus, misread dollar sign, bare integers."""
    k, t, c = F.col("k"), _plain(), F.col("cents")
    whole = money.whole_units(c)
    grouped = F.concat(F.format_number(whole, 0), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    european = F.translate(grouped, ",.", ".,")
    text = (F.when(k % 7 == 0, F.concat(F.lit("USD "), grouped)).when(k % 7 == 1, F.concat(F.lit("S"), t)).when(k % 7 == 2, F.concat(t, F.lit("-")))
            .when(k % 7 == 3, european).when(k % 7 == 4, whole.cast("string")).when(k % 7 == 5, whole.cast("string")).otherwise(F.concat(F.lit("£"), t)))
    orders = _orders(spark, sf)
    r = F.when(k % 7 == 4, money.parse_money_ocr(text, labelled=True)).otherwise(money.parse_money_ocr(text))
    return orders.select("o_orderkey", r["minor"].alias("minor"), r["confidence"].alias("confidence"))


@query("money_in_text", f"""
    select o_orderkey, case when o_orderkey % 3 = 1 then -{CENTS} else {CENTS} end "minor" from orders""")
def money_in_text(spark, sf):
    """the surest amount among counts and quantities."""
    k, t = F.col("k"), _plain()
    text = F.when(k % 3 == 0, F.concat(F.lit("3 x item no 17 at "), t)).when(k % 3 == 1, F.concat(F.lit("Refund: -"), t)).otherwise(
        F.concat(t, F.lit(" for 2 of 5")))
    return _orders(spark, sf).select("o_orderkey", money.find_money(text)["minor"].alias("minor"))


@query("dates_parsed", """
    with o as (select o_orderkey, cast(o_orderdate as date) d, day(o_orderdate) dd, month(o_orderdate) mm, o_orderkey % 5 k from orders)
    select o_orderkey, case when k = 3 and dd <= 12 then make_date(year(d), dd, mm) else d end civil,
      case when k = 0 then 0.98 when k in (1, 4) then 0.95 when dd > 12 then 0.92 when dd = mm then 0.9 else 0.55 end confidence,
      k in (2, 3) and dd <= 12 and dd <> mm ambiguous from o""")
def dates_parsed(spark, sf):
    """ISO, named, month first, day first read in a month-first locale."""
    k, d = F.col("k") % 5, F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.date_format(d, "d MMM yyyy")).when(k == 2, F.date_format(d, "MM/dd/yyyy"))
            .when(k == 3, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy")))
    r = dates.parse_date(text)
    return _orders(spark, sf).select("o_orderkey", r["civil"].alias("civil"), r["confidence"].alias("confidence"), r["ambiguous"].alias("ambiguous"))


@query("dates_in_text", """
    with o as (select o_orderkey, cast(o_orderdate as date) d, day(o_orderdate) dd, month(o_orderdate) mm, o_orderkey % 4 k from orders)
    select o_orderkey, d civil from o""")
def dates_in_text(spark, sf):
    """the surest date of a line; day-first by locale."""
    k, d = F.col("k") % 4, F.col("o_orderdate")
    named, iso, dmy = F.date_format(d, "d MMM yyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy")
    text = (F.when(k == 0, F.concat(F.lit("due 01/02/2003 paid "), iso, F.lit(" ref 77"))).when(k == 1, F.concat(F.lit("Sold on "), named, F.lit(", thanks")))
            .when(k == 2, F.concat(F.lit("Datum: "), dmy)).otherwise(F.concat(F.lit("31/31/2001 then "), named)))
    order = dates.date_order(F.when(k == 2, "de-DE").otherwise("en-US"))
    return _orders(spark, sf).select("o_orderkey", dates.find_date(text, order)["civil"].alias("civil"))


@query("vendor_names", """
    select s_suppkey, translate(cast(s_suppkey as varchar), '0123456789', 'abcdefghij') || case s_suppkey % 4 when 1 then ' best 76' else ' trading post' end normalized,
      translate(cast(s_suppkey as varchar), '0123456789', 'abcdefghij') || case s_suppkey % 4 when 1 then 'best76' else 'tradingpost' end match_key,
      lower(case s_suppkey % 4 when 0 then '{0}Trading Post Inc' when 1 then '{0}Best 76 LLC' when 2 then '{0}TradingPost Store No 55' else '{0}Trading Post 4821' end) rule_key from supplier"""
    .replace("'{0}", "translate(cast(s_suppkey as varchar), '0123456789', 'abcdefghij') || ' "))
def vendor_names(spark, sf):
    """F7-F9"""
    s = star.read(spark, sf, "supplier")
    k, code = F.col("s_suppkey") % 4, star.letters(F.col("s_suppkey"))
    tail = (F.when(k == 0, " Trading, Post. Inc.").when(k == 1, " Best 76 (LLC)").when(k == 2, " Trading-Post Store No. 55").otherwise(" TRADING POST 4821"))
    name = F.concat(code, tail)
    # "Store No. 55": the inner marker goes with its number, the outer word stays; strip it here to compare.
    normal = F.regexp_replace(names.normalize_vendor(name), " store$", "")
    return s.select("s_suppkey", normal.alias("normalized"), F.replace(normal, F.lit(" "), F.lit("")).alias("match_key"), names.rule_norm(name).alias("rule_key"))


@query("ocr_folded", r"""
    select doc_id, trim(regexp_replace(translate(lower(text), '015$', 'oiss'), '[^a-z0-9]+', ' ', 'g')) folded from documents""")
def ocr_folded(spark, sf):
    """F10"""
    return star.read(spark, sf, "documents").select("doc_id", names.ocr_normalize(F.col("text")).alias("folded"))


@query("vendor_in_text", """
    select p_partkey, true hit from part""")
def vendor_in_text(spark, sf):
    """literal, misread and first-word matches."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("at "), F.upper("p_name"))).when(k == 1, F.translate(F.col("p_name"), "oi", "01")).otherwise(
        F.concat(F.lit("x"), F.substring_index("p_name", " ", 1), F.lit("y")))
    known = F.when(k == 2, F.concat(F.substring_index("p_name", " ", 1), F.lit("ware other"))).otherwise(F.col("p_name"))
    text = F.when(k == 2, F.concat(F.lit("the "), F.substring_index("p_name", " ", 1), F.lit("ware"))).otherwise(text)
    return star.read(spark, sf, "part").select("p_partkey", names.vendor_matches(known, text).alias("hit"))


FOLDED = "trim(regexp_replace(translate(lower({0}), '015$', 'oiss'), '[^a-z0-9]+', ' ', 'g'))"


@query("vendor_in_other_text", f"""
    with t as (select p_partkey, p_name known, case p_partkey % 6 when 0 then 'at ' || upper(p_name) || ' today' when 1 then translate(p_name, 'oi', '01') when 2 then 'the ' || split_part(p_name, ' ', 1)
        when 3 then 'at ' || substr(p_name, 1, 3) when 4 then reverse(p_name) else p_brand || ' ' || p_size end text from part),
    f as (select *, {FOLDED.format('known')} k, {FOLDED.format('text')} h from t)
    select p_partkey, contains(lower(text), lower(known)) or contains(h, k) or (length(split_part(k, ' ', 1)) >= 4 and contains(h, split_part(k, ' ', 1))) hit from f""")
def vendor_in_other_text(spark, sf):
    """texts that hold a vendor, some of it, or nothing of it."""
    k = F.col("p_partkey") % 6
    name = F.col("p_name")
    text = (F.when(k == 0, F.concat(F.lit("at "), F.upper(name), F.lit(" today"))).when(k == 1, F.translate(name, "oi", "01"))
            .when(k == 2, F.concat(F.lit("the "), F.substring_index(name, " ", 1))).when(k == 3, F.concat(F.lit("at "), F.substring(name, 1, 3)))
            .when(k == 4, F.reverse(name)).otherwise(F.concat_ws(" ", "p_brand", "p_size")))
    return star.read(spark, sf, "part").select("p_partkey", names.vendor_matches(name, text).alias("hit"))


@query("vendor_plausibility", r"""
    with d as (select doc_id, regexp_replace(split_part(text, chr(10), 1), '^[\s]+|[\s]+$', '', 'g') line from documents),
    t as (select *, list_filter(regexp_split_to_array(line, '[\s]+'), lambda x: x <> '') toks, length(regexp_replace(line, '[^\p{L}]', '', 'g')) letters, length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) alnum from d)
    select doc_id, length(line) between 2 and 60 and letters >= 3 and coalesce(alnum / nullif(length(line), 0) >= 0.6, false) and len(toks) <= 8
      and not (len(toks) >= 4 and len(list_filter(toks, lambda x: length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) <= 1)) / len(toks) > 0.35)
      and not (len(toks) = 1 and length(line) > 24) plausible from t""")
def vendor_plausibility(spark, sf):
    """F12 on the first line of every document."""
    line = money.trimmed(F.substring_index("text", "\n", 1))
    return star.read(spark, sf, "documents").select("doc_id", names.looks_like_vendor(line).alias("plausible"))


@query("tax_labels", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, ['TAX','TAX','GST','GST','QST','QST','VAT','VAT','HST'][cast(round(l_tax * 100) as int) + 1] label from lineitem")
def tax_labels(spark, sf):
    """F13"""
    raw = star.pick(["tax", "Sales  Tax", "gst", "TPS", "tvq", "QST", "MwSt", "m.w.st", "hst"], F.round(F.col("l_tax") * 100))
    return star.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", names.tax_label(raw).alias("label"))


@query("money_display", f"""
    with m as (select o_orderkey, case when o_orderkey % 5 = 4 then null when o_orderkey % 2 = 1 then -{CENTS} else {CENTS} end m, ['USD','EUR','CAD','CHF','JPY'][o_orderkey % 5 + 1] c from orders)
    select o_orderkey, case when m < 0 then '-' else '' end || abs(m) // 100 || '.' || lpad(cast(abs(m) % 100 as varchar), 2, '0') plain,
      case when m is null then '—' else case when m < 0 then '-' else '' end || case c when 'USD' then '$' when 'EUR' then '€' when 'CAD' then 'CA$' else 'CHF ' end || format('{{:,}}', abs(m) // 100) || '.' || lpad(cast(abs(m) % 100 as varchar), 2, '0') end shown from m""")
def money_display(spark, sf):
    """F14/F15"""
    k = F.col("k")
    m = F.when(k % 5 == 4, F.lit(None)).when(k % 2 == 1, -F.col("cents")).otherwise(F.col("cents")).cast("bigint")
    code = star.pick(["USD", "EUR", "CAD", "CHF", "JPY"], k % 5)
    return _orders(spark, sf).select("o_orderkey", money.minor_to_text(m).alias("plain"), money.format_money(m, code).alias("shown"))


@query("civil_days", "select event_id, cast(ts as date) as day from events")
def civil_days(spark, sf):
    """F20"""
    return star.read(spark, sf, "events").select("event_id", dates.civil_day(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day"))


@query("path_checks", r"""
    with p as (select page_id, case page_id % 5 when 0 then url when 1 then '/' || page_id || '.jpg' when 2 then 'C:\' || page_id when 3 then 'a/../' || page_id else 'root/in/' || page_id end path from pages)
    select page_id, not (starts_with(path, '/') or regexp_matches(path, '^[A-Za-z]:[\\/]') or contains(path, '..')) relative,
      starts_with(path, 'root/in/') inside from p""")
def path_checks(spark, sf):
    """F21"""
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = (F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/"), i, F.lit(".jpg"))).when(k == 2, F.concat(F.lit("C:\\"), i))
            .when(k == 3, F.concat(F.lit("a/../"), i)).otherwise(F.concat(F.lit("root/in/"), i)))
    return star.read(spark, sf, "pages").select("page_id", checks.is_relative_path(path).alias("relative"), checks.is_inside(F.lit("root/in/"), path).alias("inside"))


@query("pdf_text_cleaned", "select doc_id, replace(replace(text, 'fi', 'fi'), chr(10), ' ') clean from documents")
def pdf_text_cleaned(spark, sf):
    """ligatures, soft hyphens, no-break spaces and full-width letters undone."""
    t = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("\n"), F.lit("\u00a0"))
    t = F.replace(F.translate(t, "abcXYZ", "ａｂｃＸＹＺ"), F.lit("e"), F.lit("e\u00ad"))
    return star.read(spark, sf, "documents").select("doc_id", names.clean_pdf_text(t).alias("clean"))


@query("domain_checks", f"""
    select o_orderkey, o_orderkey % 3 <> 0 currency_ok, o_orderkey % 2 = 0 civil_ok, {CENTS} % 100 = 0 whole_ok from orders""")
def domain_checks(spark, sf):
    """F25"""
    k = F.col("k")
    code = F.when(k % 3 == 0, "us").otherwise("USD")
    civil = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    return _orders(spark, sf).select(
        "o_orderkey", checks.is_currency(code).alias("currency_ok"), checks.is_civil_text(civil).alias("civil_ok"),
        checks.is_whole_minor(F.col("cents").cast("decimal(18,2)") / 100).alias("whole_ok"))
