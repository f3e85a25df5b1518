"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a word n-gram is the minimiser of its window, which the content alone decides, so equal
passages keep suffixes at equal places. Suffixes whose n-gram occurs once are dropped. The rest are sorted twice over
the whole corpus, by the words that follow and by the words before them, and each is compared with its neighbours; a
match is extended left and right from the suffix, and counts from ``least`` words on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillbook.llm.common import hashed_words, settled, shingles, text_blocks

LEAST = 50
GRAM = 10


def minimisers(grams: np.ndarray, per_row: np.ndarray, window: int) -> np.ndarray:
    """Flat places of the leftmost smallest of every run of ``window`` grams within a row."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    best, span = np.arange(n), 1
    while span < window:
        step = min(span, window - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    row = np.repeat(np.arange(len(per_row)), per_row)
    whole = row[: n - window + 1] == row[window - 1 :]
    return np.unique(best[whole])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, starts, _ = hashed_words(data, offsets)
    return words, np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)


def _suffix_places(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(gram, k1, k2, at) of the kept suffixes of ``texts`` (k1, k2, text); texts below ``least`` words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in text_blocks(batch.column(2)):
                words, count = _words(data, offsets)
                grams, per_row = shingles(words, count, gram)
                places = minimisers(grams, per_row, least - gram + 1)
                row = np.repeat(np.arange(len(per_row)), per_row)[places]
                first = np.cumsum(per_row) - per_row
                taken = pa.array(at + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[places].view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken),
                        pa.array((places - first[row]).astype(np.int32)),
                    ],
                    names=["gram", "k1", "k2", "at"],
                )

    return texts.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, at int")


def _contexts(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The words around the suffixes listed in ``places``: ``after`` from the suffix on, ``before`` backwards from it.

    A word is 32 bits of its hash, never 0; 0 stands beyond the text.
    """
    back = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            for at, end, data, offsets in text_blocks(batch.column(2), 1 << 18):
                words, count = _words(data, offsets)
                short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                own = listed.slice(at, end - at)
                places = own.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(end - at), own.value_lengths().to_numpy())
                begin = np.cumsum(count) - count
                # Each row's words between runs of zeros, so that looking beyond a text finds zeros.
                shift = back + least
                padded = np.zeros(len(short) + (end - at + 1) * shift, np.uint32)
                padded[np.arange(len(short)) + (np.repeat(np.arange(end - at), count) + 1) * shift] = short
                for k in range(0, len(places), 4096):
                    p, r = places[k : k + 4096], row[k : k + 4096]
                    middle = begin[r] + p + (r + 1) * shift
                    after = padded[middle[:, None] + np.arange(least)].astype(">u4")
                    before = padded[middle[:, None] - 1 - np.arange(back)].astype(">u4")
                    grams, _ = shingles(words, count, gram)
                    per_row = np.where(count >= gram, count - gram + 1, (count > 0).astype(np.int64))
                    taken = pa.array(at + r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams[(np.cumsum(per_row) - per_row)[r] + p].view(np.int64)),
                            pa.array([x.tobytes() for x in after], pa.binary()),
                            pa.array([x.tobytes() for x in before], pa.binary()),
                            batch.column(0).take(taken), batch.column(1).take(taken), pa.array(p.astype(np.int32)),
                        ],
                        names=["gram", "after", "before", "k1", "k2", "at"],
                    )

    return texts.select("k1", "k2", "text", "places").mapInArrow(
        run, "gram long, after binary, before binary, k1 long, k2 long, at int"
    )


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words from the front in which rows of ``a`` and ``b`` agree, none of them beyond a text."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1))


def _matches(rows: list[tuple], least: int) -> list[tuple]:
    """(k1, k2, start, end) for both sides of each pair of neighbours in ``rows`` that match long enough."""
    if len(rows) < 2:
        return []
    gram = np.array([r[0] for r in rows])
    after = np.frombuffer(b"".join(r[1] for r in rows), ">u4").reshape(len(rows), -1)
    before = np.frombuffer(b"".join(r[2] for r in rows), ">u4").reshape(len(rows), -1)
    right, left = _common(after[1:], after[:-1]), _common(before[1:], before[:-1])
    out = []
    for i in np.flatnonzero((gram[1:] == gram[:-1]) & (right + left >= least)).tolist():
        for _, _, _, k1, k2, at in rows[i : i + 2]:
            out.append((k1, k2, at - int(left[i]), at + int(right[i])))
    return out


_SPANS = "edge int, gram long, after binary, before binary, k1 long, k2 long, at int, start int, end int"


def _spans(contexts: DataFrame, order: list[str], least: int) -> DataFrame:
    """(k1, k2, start, end) from neighbours in this order; the order is total, and cut into ranges wherever it is."""
    names = ["gram", "after", "before", "k1", "k2", "at"]

    def batch_of(found: list[tuple], edges: list[tuple[int, tuple]]) -> pa.RecordBatch:
        rows = [(None, None, None, None, k1, k2, None, s, e) for k1, k2, s, e in found]
        rows += [(edge, *row, None, None) for edge, row in edges]
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["edge", *names, "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            if not rows:
                continue
            first = first or rows[0]
            found = _matches([last, *rows] if last else rows, least)
            last = rows[-1]
            yield batch_of(found, [])
        if first:
            yield batch_of([], [(0, first), (1, last)])

    made = settled(
        contexts.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SPANS), "spans"
    )

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        yield batch_of(_matches([r[1:] for r in rows], least), [])

    # The first and last suffix of every range: two rows for each partition, so one task can hold them.
    edges = made.filter("edge is not null").select("edge", *names).coalesce(1).sortWithinPartitions(*order, "edge")
    return made.filter("edge is null").unionByName(edges.mapInArrow(join_edges, _SPANS)).select("k1", "k2", "start", "end")


def repeated_passages(
    docs: DataFrame, least: int = LEAST, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the parts of each row of ``docs`` that occur elsewhere, too.

    Words are runs of anything but space and tab..carriage return, compared with A-Z lower-cased; ``end_word`` is
    exclusive. Parts that touch or overlap are one. A part counts when it agrees with a neighbouring suffix in
    ``least`` words or more, in another text or elsewhere in the same one; texts of several rows are repeated as a
    whole. Passages of 2 * least - gram words and more are always found, shorter ones unless each of their suffixes
    has, in both orders, neighbours with more in common on one side and less in all. Null, empty and short texts have
    no such parts; rows with a null id are told apart by their text only.
    """
    body = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("k1"),
        F.xxhash64(F.lit(1), F.col(text)).alias("k2"),
    ).filter(F.col("text").isNotNull())
    copies = settled(
        body.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("one")), "texts"
    )
    places = settled(_suffix_places(body, least, gram).distinct(), "suffixes")
    # Written first: a join of two shuffled tables is one whose hot keys Spark can split.
    several = settled(places.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated")
    listed = (
        places.join(several, "gram").groupBy("k1", "k2").agg(F.array_sort(F.collect_list("at")).alias("places"))
        .join(copies.drop("n"), ["k1", "k2"])
    )
    wanted = listed.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "places", "one")
    texts = body.join(
        wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("one"))
    )
    contexts = settled(_contexts(texts, least, gram), "contexts")
    tail = ["k1", "k2", "at"]
    spans = _spans(contexts, ["gram", "after", "before", *tail], least).unionByName(
        _spans(contexts, ["gram", "before", "after", *tail], least)
    )
    whole = (
        body.join(copies.filter("n > 1").select("k1", "k2", "one"), ["k1", "k2"])
        .filter(F.col("doc_id").eqNullSafe(F.col("one")))
        .select("k1", "k2", F.lit(0).alias("start"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("end"))
        .filter(F.col("end") >= least)
    )
    every = spans.unionByName(whole).distinct()
    # Spans of one text: no more than it has words.
    by_text = Window.partitionBy("k1", "k2").orderBy("start", "end")
    reached = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        every.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
        .withColumn("part", F.sum("new").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k1", "k2", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    )
    return body.select("doc_id", "k1", "k2").join(merged, ["k1", "k2"]).select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words")
    )
