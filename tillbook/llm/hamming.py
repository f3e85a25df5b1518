"""Exact top-k search among binary codes by incremental multi-index hashing.

A code of ``width`` bits is cut into segments of ``segment`` bits, each an index of its own. In round s every segment
of a query is looked up under all values at Hamming distance exactly s. A code at distance d has a segment at distance
d / segments or less, so after round s all codes up to distance segments * (s + 1) - 1 have been met and verified. A
query ends when its kth neighbour lies within that; the last round meets every code. What lies beyond the kth neighbour
of the rounds before is left out as it is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.llm.common import settled

WIDTH, SEGMENT, K = 64, 16, 10


def sign_code(vector: Column, width: int = WIDTH) -> Column:
    """A 64-bit code: bit i is set where component i is above 0 (missing and null components: not set).

    A vector with more components than ``width`` is an error, as its code could not tell it from others.
    """
    if not 0 < width <= 64:
        raise ValueError("a code has 1 to 64 bits")
    bits = F.transform(
        F.slice(vector, 1, width), lambda x, i: F.when(x > 0, _bit(i)).otherwise(F.lit(0).cast("long"))
    )
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > width, F.raise_error(F.lit(f"a vector has more than {width} components"))).otherwise(code)


def _bit(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]), i + 1)


def _segments(code: Column, width: int, segment: int) -> list[Column]:
    count = -(-width // segment)
    return [F.shiftrightunsigned(code, j * segment).bitwiseAND(F.lit((1 << segment) - 1)).cast("int") for j in range(count)]


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = K, width: int = WIDTH, segment: int = SEGMENT, row_id: str = "id", code: str = "code"
) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row of ``queries`` its ``k`` nearest of ``rows``.

    Both have an id and a 64-bit code; neighbours of equal distance go by the smaller id, and a query that is a row is
    its own neighbour. Rows and queries with a null id or code take no part; with fewer than ``k`` rows all are given.
    Rows of one code are searched as one code with its ``k`` smallest ids, so repeated codes cost nothing more, and
    queries of one code are searched once. Per round only whether a query is still open reaches the driver.
    """
    if segment > 24:
        raise ValueError("segments of more than 24 bits have too many values")
    count = -(-width // segment)
    by_id = Window.partitionBy("code").orderBy("id")
    plain = rows.select(F.col(row_id).alias("id"), F.col(code).alias("code")).dropna()
    codes = settled(
        plain.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k)
        .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")),
        "codes",
    )
    asked = queries.select(F.col(row_id).alias("query_id"), F.col(code).alias("query")).dropna()
    open_queries = settled(asked.select("query").distinct().withColumn("bound", F.lit(width)), "queries")
    index = codes.select("code", "ids", F.posexplode(F.array(*_segments(F.col("code"), width, segment))).alias("j", "value"))
    index = settled(index, "index")
    best, tasks = None, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for s in range(segment + 1):
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << segment) - 1)), lambda m: F.bit_count(m) == s)
        # Each query becomes as many probes as there are masks: its size now says nothing about theirs.
        probes = open_queries.repartition(tasks, "query").select(
            "query", "bound", F.posexplode(F.array(*_segments(F.col("query"), width, segment))).alias("j", "own")
        ).select("query", "bound", "j", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
        # A pair counts where its nearest segment is met first: no earlier segment is as near, no later one nearer.
        apart = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_segments(F.col("query"), width, segment), _segments(F.col("code"), width, segment))]
        first = F.lit(True)
        for i, d in enumerate(apart):
            first = first & F.when(F.col("j") > i, d > s).when(F.col("j") < i, d >= s).otherwise(F.lit(True))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        met = (
            probes.join(index.hint("merge"), ["j", "value"])
            .filter(distance <= F.col("bound"))
            .filter(first)
            .select("query", "code", "ids", distance.alias("distance"))
        )
        every = met if best is None else best.unionByName(met)
        nearest = Window.partitionBy("query").orderBy("distance", F.col("ids")[0])
        best = settled(
            every.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).drop("n"), "best"
        )
        covered = count * (s + 1) - 1
        if s < segment:
            known = best.groupBy("query").agg(
                F.sum(F.when(F.col("distance") <= covered, F.size("ids")).otherwise(0)).alias("sure"),
                F.when(F.count("*") >= k, F.max("distance")).alias("kth"),
            )
            open_queries = settled(
                open_queries.join(known, "query", "left")
                .filter(F.coalesce("sure", F.lit(0)) < k)
                .select("query", F.coalesce("kth", "bound").alias("bound")),
                "queries",
            )
            if open_queries.isEmpty():
                break
    ranked = (
        best.select("query", "distance", F.explode("ids").alias("neighbour_id"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id")))
        .filter(F.col("rank") <= k)
    )
    return asked.join(ranked, "query").select("query_id", "rank", "neighbour_id", "distance")
