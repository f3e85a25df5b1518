"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral gives the source's share of the words; a
share stops at ``cap`` times the source's size, and what is over is shared again by weight. A source is read as its
documents in a keyed order, over and over; the cumulative words of that stream, inverted through the integral of the
schedule, give each copy of a document its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.llm.common import WORD, text_of, unused
from tillbook.plans.scale import number_rows
from tillbook.session import stored

# Weights by the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
# A source with tilt s is drawn with (1 - s + 2 s t) times its weight at time t, so the integral over 0..1 is its weight.
TILTS = (0.5, 0.0, -0.5)
CAP = 3
SEED = "mix"


def word_count(column: Column | str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS, cap: int = CAP
) -> DataFrame:
    """``target`` (double), ``tilt`` and ``place`` per source; ``sources`` has ``source`` and ``source_size``.

    Sources go by code point, null last. Each round sends two numbers to the driver: what is left for the sources
    below their stop, and their weight; rounds end when no source passes its stop, at most one round per source.
    Without words every target is 0.
    """
    order = [F.col("source").isNull(), F.col("source")]
    numbered = number_rows(sources, order, out="place", start=-1)
    pick = lambda values: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.col("place") % len(values) + 1).cast("int")
    )
    held = stored(
        numbered.withColumns(
            {
                "weight": pick([int(w) for w in weights]).cast("double"),
                "tilt": pick([float(t) for t in tilts]),
                "stop": (F.col("source_size") * cap).cast("double"),
            }
        ),
        "sources",
    )
    level, capped = 0.0, F.lit(False)
    while True:
        row = held.agg(
            F.sum("source_size").cast("double").alias("total"),
            F.coalesce(F.sum(F.when(capped, F.col("stop"))), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        new = (row["total"] - row["spent"]) / row["weight"]
        if new <= level:
            break
        level = new
        capped = F.col("weight") * F.lit(level) > F.col("stop")
    return held.select(
        "source", "source_size", "tilt", "place", F.least(F.col("weight") * F.lit(level), F.col("stop")).alias("target")
    )


def training_time(share: Column, tilt: Column) -> Column:
    """The time at which a source with this tilt has given ``share`` (0..1) of its words."""
    rise = F.lit(1.0) - tilt
    return F.when(tilt == 0, share).otherwise(
        (F.sqrt(rise * rise + F.lit(4.0) * tilt * share) - rise) / (F.lit(2.0) * tilt)
    )


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    tilts: Sequence[float] = TILTS,
    cap: int = CAP,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, text_key, size, source_size, target, copies, taken, position.

    ``size`` counts words (null or empty text: 0). A copy is taken when the middle of its words lies before the
    source's target, so a source misses its target by half a document at most, or, where rows repeat, by half of the
    rows that are alike in id, source and text: those count as one block and get the same copies. ``position`` is
    that of the first copy (null without copies). A document without words takes no words, whatever its copies.
    An empty table gives no rows. Only ids, sources and counts are shuffled; running sums are cut by ranges of
    (source, keyed order), so a hot source is spread over tasks.
    """
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.xxhash64(F.col(text)).alias("text_key"),
            word_count(text).alias("size"),
        ),
        "sizes",
    )
    key = ["doc_id", "source", "text_key", "size"]
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    blocks = (
        rows.groupBy(*key)
        .agg(F.count("*").alias("alike"))
        .withColumns({"turn": turn, "block": F.col("size") * F.col("alike"), "unsourced": F.col("source").isNull()})
    )
    order = ["unsourced", "source", "turn", "doc_id", "size", "text_key"]
    placed = stored(
        blocks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "turns",
    )
    sums = placed.groupBy("source", "part").agg(F.sum("block").alias("part_size"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("part_size").over(by_part), F.lit(0))).drop("part_size")
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, tilts, cap)
    within = Window.partitionBy("source", "part").orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("before", F.coalesce(F.sum("block").over(within), F.lit(0))).alias("p")
    offsets = ahead.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")))
    middle = (F.col("before") + F.col("ahead")).cast("double") + F.col("block") / F.lit(2.0)
    size = F.col("source_size").cast("double")
    copies = (
        F.when(F.col("source_size") == 0, F.lit(1))
        .otherwise(F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / size)))
        .cast("int")
    )
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle / F.col("target"))).otherwise(F.lit(0.0))
    planned = (
        before.join(
            offsets.select(
                F.col("a.source").alias("of"), F.col("part").alias("of_part"), "ahead", "source_size", "target", "tilt"
            ),
            F.col("p.source").eqNullSafe(F.col("of")) & (F.col("p.part") == F.col("of_part")),
        )
        .withColumns({"middle": middle, "copies": copies})
        .select(
            *[F.col(f"p.{k}").alias(f"k_{k}") for k in key],
            "source_size",
            "target",
            "tilt",
            "middle",
            "copies",
            F.when(F.col("copies") > 0, training_time(share, F.col("tilt"))).alias("position"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    return rows.join(planned, same).select(
        *key, "source_size", "target", "tilt", "middle", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        "position",
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents in training order: each row of ``docs`` once per copy taken, with the columns of ``docs``.

    Rows that are alike in id, source and text keep their number. Columns of any other name pass through.
    """
    plan = plan_mix(docs, doc_id=doc_id, text=text, source=source, **how)
    blocks = plan.select("doc_id", "source", "text_key", "copies", "middle", "source_size", "target", "tilt").distinct()
    names = unused(docs, "m_id", "m_source", "m_key", "m_copies", "m_middle", "m_size", "m_target", "m_tilt", "m_pass", "m_at")
    n = {k: F.col(v) for k, v in names.items()}
    blocks = blocks.toDF(*[names[k] for k in ("m_id", "m_source", "m_key", "m_copies", "m_middle", "m_size", "m_target", "m_tilt")])
    copies = blocks.filter(n["m_copies"] > 0).withColumn(
        names["m_pass"], F.explode(F.sequence(F.lit(0), n["m_copies"] - 1))
    )
    share = F.when(
        n["m_target"] > 0, F.least(F.lit(1.0), (n["m_pass"] * n["m_size"] + n["m_middle"]) / n["m_target"])
    ).otherwise(F.lit(0.0))
    copies = copies.withColumn(names["m_at"], training_time(share, n["m_tilt"]))
    joined = docs.join(
        copies,
        docs[doc_id].eqNullSafe(n["m_id"])
        & docs[source].eqNullSafe(n["m_source"])
        & F.xxhash64(docs[text]).eqNullSafe(n["m_key"]),
    )
    return joined.orderBy(n["m_at"], docs[doc_id], n["m_pass"]).select(*[docs[c] for c in docs.columns])
