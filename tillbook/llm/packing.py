"""Best-fit packing of token sequences by swap-based local search.

Pieces are dealt to groups of a fixed size; a group starts from best fit and then moves pieces, exchanges one for one
and two for one between bins that are not full, always raising the sum of squared fills, until bins empty. Bins that
stay underfull are dealt anew to fewer groups, round after round, as long as that empties bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillbook.llm.common import settled
from tillbook.llm.tokens import END, token_arrays

CAPACITY = 1024
# Pieces that one task searches together.
GROUP = 16_384


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first piece may be shorter."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def document_pieces(
    docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    vocabulary: str | None = None, end: int | None = END, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; null text counts as empty.

    A document always has its end id, so an empty one is one piece of length 1; with ``end`` None it has none.
    Rows are tokenised one at a time: memory follows the longest text.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            texts = (t.as_py() for t in batch.column(1))
            for i, ids in enumerate(token_arrays(texts, vocabulary, end)):
                raw = ids.tobytes()
                for k, (start, length) in enumerate(cut(len(ids), capacity) if len(ids) else []):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(part)))
                    parts.append(part)
            place, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            columns = [
                batch.column(0).take(pa.array(place, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length, longest first, each into the fullest bin that has room."""
    bins = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at, count = capacity, count, count + 1
        bins[i] = at
        left = room - length
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Bins after moves and exchanges between underfull bins; stops when none raises the sum of squared fills."""
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    items = np.flatnonzero(fill[bins] < capacity)
    size, home = lengths[items].astype(np.int64), bins[items]

    def exchange(give: list[int], low: int) -> bool:
        """Put ``give`` of bin ``low`` elsewhere: into a bin with room, or for one smaller item of a fuller bin."""
        total = int(size[give].sum())
        if len(give) == 1:
            room = np.where(
                (fill + total <= capacity) & (fill > fill[low] - total) & (fill > 0) & (np.arange(len(fill)) != low), fill, -1
            )
            best = int(room.argmax())
            if room[best] >= 0:
                home[give] = best
                fill[best] += total
                fill[low] -= total
                return True
        gain = total - size
        other = fill[home]
        gain = np.where((home != low) & (gain > 0) & (gain <= capacity - other) & (other + gain > fill[low]), gain, 0)
        best = int((gain * (capacity + 1) + np.where(gain > 0, other, 0)).argmax())
        if not gain[best]:
            return False
        high = home[best]
        home[give] = high
        home[best] = low
        fill[high] += gain[best]
        fill[low] -= gain[best]
        return True

    def relieve(low: int) -> bool:
        mine = np.flatnonzero(home == low)
        _, first = np.unique(size[mine], return_index=True)
        singles = mine[first][::-1].tolist()
        if any(exchange([i], low) for i in singles):
            return True
        pairs: dict[int, list[int]] = {}
        kept = mine[np.argsort(-size[mine], kind="stable")].tolist()
        seen: dict[int, int] = {}
        twice = []
        for i in kept:  # at most two of each size matter
            n = seen[int(size[i])] = seen.get(int(size[i]), 0) + 1
            if n <= 2:
                twice.append(i)
        for k, i in enumerate(twice):
            for j in twice[k + 1 :]:
                pairs.setdefault(int(size[i] + size[j]), [i, j])
        return any(exchange(pair, low) for _, pair in sorted(pairs.items(), reverse=True))

    changed = True
    while changed:
        changed = False
        for low in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[low] < capacity and relieve(low):
                changed = True
    bins[items] = home
    return bins


def pack(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(item, bin, offset) for every row (item long, unique; length 1..capacity) of ``lengths``.

    Bins are numbered by their smallest item, and filled from 0 without gaps in the order of items. Full-length items
    are bins of their own. Which bins come out is a function of the items and lengths alone.
    """

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", ignore_index=True)
        sizes = frame["length"].to_numpy(np.int64)
        if frame["bin"].isna().any():
            bins = best_fit(sizes, capacity)
        else:
            bins = pd.factorize(frame["bin"], sort=True)[0].astype(np.int64)
        bins = local_search(sizes, bins, capacity)
        return pd.DataFrame(
            {
                "item": frame["item"],
                "length": sizes,
                "bin": frame["item"].groupby(bins).transform("min"),
                "fill": np.bincount(bins, sizes).astype(np.int64)[bins],
            }
        )

    schema = "item long, length long, bin long, fill long"
    items = lengths.select("item", F.col("length").cast("long").alias("length"))
    done = [items.filter(F.col("length") == capacity).select("item", "length", F.col("item").alias("bin"))]
    todo = items.filter(F.col("length") < capacity).withColumn("bin", F.lit(None).cast("long"))
    dealt_by, bins = F.col("item"), None
    for turn in range(1 << 16):
        n = todo.count()
        if not n:
            break
        groups = -(-n // group)
        found = settled(
            todo.groupBy(F.pmod(F.xxhash64(dealt_by, F.lit(turn)), F.lit(groups)).alias("dealt")).applyInPandas(search, schema),
            "packed",
        )
        done.append(found.filter(F.col("fill") == capacity).select("item", "length", "bin"))
        todo = found.filter(F.col("fill") < capacity).select("item", "length", "bin")
        row = found.agg(F.count_distinct("bin").alias("bins"), F.sum((F.col("fill") == capacity).cast("long")).alias("full")).first()
        before, bins = bins, row["bins"]
        if groups == 1 or (before is not None and bins == before):
            break
        bins -= found.filter(F.col("fill") == capacity).agg(F.count_distinct("bin")).first()[0]
        dealt_by = F.col("bin")
    if n:
        done.append(todo)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    ahead = Window.partitionBy("bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("item", "bin", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, **how) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset. Rows repeated in ``docs`` are packed as often as they occur."""
    pieces = settled(
        document_pieces(docs, capacity, **how).withColumn("item", F.monotonically_increasing_id()), "pieces"
    )
    places = pack(pieces.select("item", "length"), capacity, group)
    return pieces.join(places.withColumnRenamed("bin", "sequence_id"), "item").drop("item")
