"""Allocation, splits, lookups, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import query
from tillbook.operators import lists, rules, splits
from tillbook.operators.alloc import allocate
from tillbook.plans.oracle import LETTERS, PRICE
from tillbook.sources import star

ORD = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def _lines(spark, sf):
    order = star.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (star.minor(F.col("o_totalprice")) * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)).alias("total"))
    line = star.read(spark, sf, "lineitem").withColumn("w", star.minor(F.col("l_extendedprice")))
    return line.select("l_orderkey", "w", *ORD.split(", ")).join(order, "l_orderkey")


ORDER_TOTAL = "cast(round(o_totalprice * 100) as bigint) * case when o_orderkey % 2 = 0 then -1 else 1 end"


@query("allocate_equal", f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, sign(t) * (abs(t) // n + case when rn <= abs(t) % n then 1 else 0 end) as "share"
    from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {ORDER_TOTAL} t, count(*) over (partition by l_orderkey) n,
            row_number() over (partition by l_orderkey order by {ORD}) rn from lineitem join orders on o_orderkey = l_orderkey)""")
def allocate_equal(spark, sf):
    """Order totals over their lines, remainders to the first lines; half are refunds."""
    out = allocate(_lines(spark, sf), ["l_orderkey"], ORD.split(", "), "total")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


@query("allocate_weighted", f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(sign(t) * (base + case when row_number() over (partition by l_orderkey order by rem desc, {ORD}) <= abs(t) - sum(base) over (partition by l_orderkey) then 1 else 0 end) as bigint) as "share"
    from (select *, cast(abs(t) as hugeint) * w // ws base, cast(abs(t) as hugeint) * w % ws rem
      from (select {ORD}, l_orderkey, {PRICE} w, {ORDER_TOTAL} t, sum({PRICE}) over (partition by l_orderkey) ws from lineitem join orders on o_orderkey = l_orderkey))""")
def allocate_weighted(spark, sf):
    """The same totals by line price, leftovers to the largest fractions."""
    out = allocate(_lines(spark, sf), ["l_orderkey"], ORD.split(", "), "total", weight="w")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


@query("split_refusals", """
    with p as (select l_orderkey item_id, l_linenumber from lineitem),
    m as (select item_id, count(*) n, count(*) filter (where item_id % 4 = 1 or (item_id % 4 = 2 and l_linenumber % 2 = 0)) a,
            count(*) filter (where item_id % 4 = 0 or (item_id % 4 = 2 and l_linenumber % 2 = 1)) w,
            sum(case when item_id % 4 = 1 or (item_id % 4 = 2 and l_linenumber % 2 = 0) then 150 end) s from p group by 1)
    select item_id, reason from (
      select item_id, case when n < 2 then 'split requires at least 2 parts' when a > 0 and w > 0 then 'parts must be all amounts or all weights, not mixed'
        when i.id is null then 'item not found'
        when trashed_at is not null then 'cannot split a trashed item' when split_role is not null then 'item is already part of a split'
        when total_minor is null then 'cannot split a receipt with no total'
        when a > 0 and s <> total_minor then 'part amounts sum to ' || s || ' but origin total is ' || total_minor end reason
      from m left join item i on i.id = item_id left join receipt_data using (item_id)) where reason is not null""")
def split_refusals(spark, sf):
    """M5: every precondition, over all orders, against the library that already has splits."""
    line = star.read(spark, sf, "lineitem")
    key, no = F.col("l_orderkey"), F.col("l_linenumber")
    by_amount = (key % 4 == 1) | ((key % 4 == 2) & (no % 2 == 0))
    by_weight = (key % 4 == 0) | ((key % 4 == 2) & (no % 2 == 1))
    parts = line.select(
        key.alias("item_id"), F.struct(*ORD.split(", ")).alias("ord"),
        F.when(by_amount, "$1.50").alias("amount_text"), F.when(by_weight, F.lit(1.0)).alias("weight"))
    return splits.split_refusals(star.library(spark, sf), parts)


@query("split_assertions", """
    select split_group_id, concat_ws('; ', case when drift_minor <> 0 then 'drift ' || drift_minor || ' (children ' || children_total_minor || ', origin ' || origin_total_minor || ')' end,
      case when tax_drift_minor <> 0 then 'tax drift ' || tax_drift_minor end) message
    from v_recon where drift_minor <> 0 or tax_drift_minor <> 0 or currency_mismatch_count > 0""")
def split_assertions(spark, sf):
    return splits.split_assertions(star.library(spark, sf))


@query("split_children", "select id as item_id, split_group_id, total_minor, tax_total_minor, currency from item join receipt_data on item_id = id where split_role = 'child'")
def split_children(spark, sf):
    lib = star.library(spark, sf)
    kids = lib["item"].filter("split_role = 'child'").select(F.col("id").alias("item_id"), "split_group_id")
    return kids.join(lib["receipt_data"], "item_id").select("item_id", "split_group_id", "total_minor", "tax_total_minor", "currency")


@query("dissolved_totals", """
    select currency, count(*) item_count, cast(sum(coalesce(total_minor, 0)) as bigint) total_minor from (
      select i.id, total_minor, currency from item i join receipt_data on item_id = i.id where type = 'receipt' and trashed_at is null
        and (superseded_at is null or split_group_id % 2 = 0) and not (coalesce(split_role, '') = 'child' and split_group_id % 2 = 0)) group by 1""")
def dissolved_totals(spark, sf):
    """M6: every second split dissolved; totals come from the freed origins."""
    from tillbook.operators.canonical import summable_receipts

    lib = star.library(spark, sf)
    groups = lib["split_group"].filter("id % 2 = 0").select(F.col("id").alias("split_group_id"))
    lib, _ = splits.dissolve_splits(lib, groups, star.NOW)
    return summable_receipts(lib).groupBy("currency").agg(
        F.count("*").alias("item_count"), F.sum(F.coalesce("total_minor", F.lit(0))).alias("total_minor"))


@query("vendor_resolution", f"""
    with n as (select distinct case o_orderkey % 4 when 0 then upper(v.normalized_name) || ' Store 9'
                 when 1 then replace(v.normalized_name, ' ', '') when 2 then 'new ' || {LETTERS.format('o_orderkey % 50')} || '-shop' else v.name end name,
                 case o_orderkey % 4 when 0 then v.id when 1 then v.id when 3 then v.id end id, o_orderkey % 4 k
               from orders join vendor v on v.id = 1 + o_orderkey % (select count(*) from supplier))
    select name, coalesce(n.id, (select max(id) from vendor) + dense_rank() over (partition by n.id is null order by replace(replace(name, ' ', ''), '-', ''))) id,
      n.id is null created,
      case when k = 2 then 'new' when k = 1 then 'loose' else 'normalized' end matched_by
    from n""")
def vendor_resolution(spark, sf):
    """Vendor names in four spellings resolved against the list."""
    lib = star.library(spark, sf)
    n = star.read(spark, sf, "supplier").agg(F.count("*").alias("n"))
    k = F.col("o_orderkey")
    order = star.read(spark, sf, "orders").select(k, (1 + k % n.scalar()).alias("id"))
    named = order.join(lib["vendor"].select("id", "name", "normalized_name"), "id")
    spelled = (
        F.when(k % 4 == 0, F.concat(F.upper("normalized_name"), F.lit(" Store 9")))
        .when(k % 4 == 1, F.replace("normalized_name", F.lit(" "), F.lit("")))
        .when(k % 4 == 2, F.concat(F.lit("new "), star.letters(k % 50), F.lit("-shop")))
        .otherwise(F.col("name"))
    )
    return lists.resolve_vendors(lib, named.select(spelled.alias("name")), star.NOW)[1]


@query("simple_list_upsert", """
    with n as (select distinct case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then upper(p_type) else ['automobile','Building','FURNITURE'][cast(p_partkey % 3 as int) + 1] end name from part),
    k as (select name, lower(name) key from n)
    select k.name, coalesce(c.id, 5 + dense_rank() over (partition by c.id is null order by key)) id, c.id is null created
    from k left join category c on lower(c.name) = key""")
def simple_list_upsert(spark, sf):
    """R2: category names matched without regard to case, new ones created."""
    part = star.read(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.upper("p_type")).otherwise(
        star.pick(["automobile", "Building", "FURNITURE"], k % 3))
    return lists.upsert_names(star.library(spark, sf), "category", part.select(name.alias("name")), star.NOW)[1]


RULE_SQL = """
    with best as (select id, category_id, kind, case when kind = 'id' then id end vendor_id,
        case when kind = 'norm' then normalized_name when kind = 'name' then normalized_name end key from rule where enabled),
    cand as (select item_id, r.vendor_id, v.name, v.default_category_id,
        trim(regexp_replace(regexp_replace(lower(v.name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) key
      from receipt_data r left join vendor v on v.id = r.vendor_id where category_id is null),
    hit as (select item_id, min(b.id) rule_id from cand c join best b on b.vendor_id = c.vendor_id or b.key = c.key group by 1)
    select c.item_id, cast(coalesce(r.category_id, c.default_category_id) as bigint) category_id, r.id rule_id
    from cand c left join hit h using (item_id) left join rule r on r.id = h.rule_id where coalesce(r.category_id, c.default_category_id) is not null"""


@query("rule_proposals", RULE_SQL)
def rule_proposals(spark, sf):
    """The first matching rule, else the vendor's default category."""
    lib = star.library(spark, sf)
    return rules.apply_rules(lib, rules.receipt_candidates(lib))


@query("rule_hits", f"select rule_id id, count(*) hit_count from ({RULE_SQL}) where rule_id is not null group by 1")
def rule_hits(spark, sf):
    """Hit counters after filling categories."""
    lib, _ = rules.fill_categories(star.library(spark, sf))
    return lib["rule"].filter("hit_count > 0").select("id", "hit_count")


@query("rule_order", "select id, 100 as priority from rule where id % 5 <> 0 union all select id, 7 from rule where id % 5 = 0 union all select 1000000000 + r_regionkey, 100 from region")
def rule_order(spark, sf):
    """Rules after an upsert, in the order they are tried."""
    lib = star.library(spark, sf)
    changed = lib["rule"].filter("id % 5 = 0").withColumn("priority", F.lit(7))
    new = star.read(spark, sf, "region").select(
        (1000000000 + F.col("r_regionkey")).alias("id"), F.lit("vendor_to_category").alias("kind"),
        F.lit("{}").alias("match_json"), F.lit("{}").alias("action_json"))
    changes = changed.unionByName(new, allowMissingColumns=True)
    table = rules.upsert_rules(lib, changes, star.NOW)
    return rules.list_rules({"rule": table}).select("id", "priority")
