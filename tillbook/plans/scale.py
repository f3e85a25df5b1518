"""Numbering, ranking and joining that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.session import stored

_POSITION_BITS = 33
# Rows of one group that a single task may sort; larger groups are cut by ranges.
LARGEST_GROUP = 100_000


def number_rows(
    df: DataFrame, order: Sequence[Column | str], out: str = "row_no", start: int = 0, totals: dict[str, str] | None = None
) -> DataFrame:
    """Dense numbers ``start+1 .. start+n`` in a total order, without a single-task sort.

    Rows are range-partitioned on the whole order key, so a hot leading key is cut by the
    later keys.  The placement is written before it is counted: counts and rows then
    come from the same partitions even if executors are lost.
    ``totals`` (new column: summed column) adds the sums over all rows before a row in that order.
    """
    order = list(order)
    placed = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    totals = totals or {}
    part = F.shiftright("_place", _POSITION_BITS)
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One row per partition: the running sum over them is small by construction.
    parts_before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_n_{name}") for name, c in totals.items()])
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(parts_before), F.lit(0)).alias("_before"),
            *[F.coalesce(F.sum(f"_n_{name}").over(parts_before), F.lit(0)).alias(f"_before_{name}") for name in totals],
        )
    )
    rows_before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        placed.withColumn("_part", part)
        .withColumn("_position", position)
        .join(F.broadcast(before), "_part")
        .withColumn(out, F.lit(start) + F.col("_before") + F.col("_position") + F.lit(1))
    )
    sums = {name: F.col(f"_before_{name}") + F.coalesce(F.sum(c).over(rows_before), F.lit(0)) for name, c in totals.items()}
    if sums:
        numbered = numbered.withColumns(sums)
    return numbered.drop("_part", "_place", "_position", "_before", *[f"_before_{name}" for name in totals])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rank", largest: int | None = None
) -> DataFrame:
    """Dense numbers 1.. within each group.  Groups of at most ``LARGEST_GROUP`` rows are sorted within tasks, by one
    shuffle on the keys.  If any group is larger, a row's number is its place among all rows behind that of its group's
    first: a group larger than a task is cut by the range partitioning like any other stretch of rows.

    ``order`` must tell all rows of a group apart; of rows that it does not, either may come first.  ``largest`` is the
    size of the largest group where the caller knows a bound; else it is counted.
    """
    keys = list(keys)
    if (largest_group(df, keys) if largest is None else largest) <= LARGEST_GROUP:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    numbered = number_rows(df, [*keys, *order], out="_row_no")
    first = numbered.groupBy(*keys).agg(F.min("_row_no").alias("_first"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    return (
        numbered.alias("r")
        .join(first.alias("g"), same)
        .select("r.*", (F.col("_row_no") - F.col("_first") + 1).alias(out))
        .drop("_row_no")
    )


def next_id(df: DataFrame, column: str = "id") -> int:
    """Largest id in use (0 for an empty table); one number reaches the driver."""
    return df.agg(F.max(column)).first()[0] or 0
