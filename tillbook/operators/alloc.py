"""Exact allocation of integer totals over parts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.plans import scale


def allocate(
    parts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    total: str,
    out: str = "share",
    weight: str | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Largest-remainder shares: exact sum, remainders by fraction, then by order.

    Equal shares are the case of equal weights.  ``weight`` is integer, or decimal of which six places count, and not
    negative; scaled to whole numbers it has up to 20 digits, and totals have up to 18, so that products are exact.
    Groups whose weights sum to zero get null shares (the caller rejects them).  ``largest`` as in ``rank_rows``: groups
    that fit into a task are summed and ranked in one shuffle, else sums are joined back.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else F.col(weight)
    if weight is not None and not re.fullmatch(r"bigint|int|decimal\(\d+,0\)", dict(parts.dtypes)[weight]):
        w = w * 1_000_000
    w = w.cast("decimal(20,0)")
    size = F.abs(F.col(total)).cast("decimal(18,0)")

    weighted = parts.withColumn("_w", w)
    product = size * F.col("_w")
    positive = F.col("_ws") > 0
    parted = {
        "_base": F.when(positive, F.call_function("div", product, F.col("_ws"))),
        "_rem": F.when(positive, product % F.col("_ws")),
    }
    if largest is None:
        largest = scale.largest_group(weighted, keys)
    if largest <= scale.LARGEST_GROUP:
        group = Window.partitionBy(*keys)
        shares = weighted.dropna(subset=keys).withColumn("_ws", F.sum("_w").over(group)).withColumns(parted)
        shares = shares.withColumn("_given", F.sum("_base").over(group))
    else:
        sums = weighted.groupBy(*keys).agg(F.sum("_w").alias("_ws"))
        shares = weighted.join(sums, keys).withColumns(parted)
        shares = shares.join(shares.groupBy(*keys).agg(F.sum("_base").alias("_given")), keys)
    ranked = scale.rank_rows(shares, keys, [F.col("_rem").desc(), *order], out="_turn", largest=largest)
    share = F.col("_base") + F.when(F.col("_turn") <= F.abs(F.col(total)) - F.col("_given"), 1).otherwise(0)
    sign: Column = F.when(F.col(total) < 0, -1).otherwise(1)
    return ranked.withColumn(out, (share * sign).cast("bigint")).drop("_w", "_ws", "_base", "_rem", "_given", "_turn")
