"""Vector code compression: codebooks by member-resident Lloyd rounds, then codes by one narrow pass.

Every part of a vector lives with its owner, the group (position, entry, salt). Owners sum their resident members, and
the sums of an entry's owners make its next value. Then residents look at the new entries of their position: those that
keep theirs are written where they are, and only parts that change entry go through the next shuffle, to new owners.
Salts split the members of an entry by count, so an entry that draws every part of its position still has owners of
bounded size. Codebooks are ``parts * entries`` short integer vectors whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillbook.llm.common import lean, lists, settled

# Members that an owner has on average at most.
MEMBERS = 1 << 18
# Vectors that a task compares at a time.
BLOCK = 4096


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``vectors`` that are kept, and their components as floor(scale * x), one row each.

    Null and empty vectors and those with a null or non-finite component are left out; the rest must be of one length.
    """
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values
    lengths = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat.to_numpy(zero_copy_only=False)))])
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    length = int(lengths[rows[0]])
    if (lengths[rows] != length).any():
        raise ValueError("vectors are of different lengths")
    at = offsets[rows][:, None] + np.arange(length)
    scaled = np.floor(scale * flat.to_numpy(zero_copy_only=False)[at])
    # Squared distances and their sums over a vector stay within 64 bits.
    if length * (2 * np.abs(scaled).max() + 1) ** 2 >= 2.0**62:
        raise ValueError(f"components beyond {np.abs(scaled).max()} leave no room for exact distances")
    return rows, scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row of ``x`` (lowest index of ties) and the squared distance, both exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if x.shape[1] * (2 * most + 1) ** 2 < 1 << 52:  # whole numbers that doubles hold exactly
        x, book = x.astype(np.float64), book.astype(np.float64)
    entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        some = x[at : at + BLOCK]
        all_of = (some * some).sum(1)[:, None] - 2 * (some @ book.T) + (book * book).sum(1)[None, :]
        entry[at : at + BLOCK] = all_of.argmin(1)
        distance[at : at + BLOCK] = all_of[np.arange(len(some)), entry[at : at + BLOCK]]
    return entry, distance


def _seeds(vectors: DataFrame, entries: int, scale: int) -> np.ndarray:
    """Integer vectors of the ``entries`` smallest kept ids; an id that repeats counts once, with its least vector."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows, x = integers(batch.column(1), scale)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            for k, i in enumerate(ids):
                if i is not None:
                    best[i] = min(best.get(i, found := x[k].tolist()), found)
            best = {i: best[i] for i in sorted(best)[:entries]}
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), kind), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["vec_id", "x"]
            )

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("x", T.ArrayType(T.LongType()))])
    found = (
        vectors.select("vec_id", "embedding").mapInArrow(least, schema)
        .groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()
    )
    return np.array([r["x"] for r in found], np.int64)


def _placed(vectors: DataFrame, books: np.ndarray, salts: int, scale: int) -> DataFrame:
    """Every part at its first owner: (position, entry, salt, x)."""
    parts = len(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            _, x = integers(batch.column(0), scale)
            for position in range(parts if len(x) else 0):
                own = x.reshape(len(x), parts, -1)[:, position]
                entry, _ = nearest(own, books[position])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), position, np.int16)), pa.array(entry.astype(np.int16)),
                        pa.array(((seen + np.arange(len(x))) % salts).astype(np.int32)),
                        lists(pa.array(own.ravel()), np.full(len(x), own.shape[1])),
                    ],
                    names=["position", "entry", "salt", "x"],
                )
            seen += len(x)

    placed = vectors.select("embedding").mapInArrow(place, "position short, entry short, salt int, x array<long>")
    return settled(placed.repartition("position", "entry", "salt"), "residents")


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The mean of each entry's resident members, rounded down; entries without any stay. One row per entry is read."""
    size = books.shape[2]
    sums = members.groupBy("position", "entry").agg(
        F.count("*").alias("n"), *[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(size)]
    )
    books = books.copy()
    for r in sums.collect():
        books[r["position"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(size)]
    return books


def _migrated(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members at the owners of their nearest entry; only those whose entry changes are shuffled."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(0).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(len(position), -1)
            entry = np.zeros(len(position), np.int16)
            for p in np.unique(position):
                entry[position == p] = nearest(x[position == p], books[p])[0]
            moved = entry != batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(entry), batch.column(2), batch.column(3), pa.array(moved)],
                names=["position", "entry", "salt", "x", "moved"],
            )

    looked = settled(members.mapInArrow(look, "position short, entry short, salt int, x array<long>, moved boolean"), "looked")
    arrived = settled(looked.filter("moved").drop("moved").repartition("position", "entry", "salt"), "arrived")
    return looked.filter("not moved").drop("moved").unionByName(arrived)


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray | None:
    """Codebooks (part, entry, component) of the vectors in ``embedding``; None where no vector is kept."""
    seeds = _seeds(vectors, entries, scale)
    if not len(seeds):
        return None
    if seeds.shape[1] % parts:
        raise ValueError(f"vectors of {seeds.shape[1]} components cannot be cut into {parts} equal parts")
    books = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    members = _placed(vectors, books, 1 + vectors.count() // MEMBERS, scale)
    for k in range(rounds):
        if k:
            members = _migrated(members, books)
        books = _updated(members, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector, without a shuffle."""
    parts = len(books)
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(2), scale)
            if not len(rows):
                continue
            words, error = np.full(len(rows), "", f"<U{2 * parts}"), np.zeros(len(rows), np.int64)
            for p in range(parts):
                entry, distance = nearest(x.reshape(len(x), parts, -1)[:, p], books[p])
                words, error = np.char.add(words, digits[entry]), error + distance
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(words.tolist(), pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    held = vectors.schema
    schema = T.StructType(
        [
            T.StructField("vec_id", held["vec_id"].dataType), T.StructField("label", held["label"].dataType),
            T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
        ]
    )
    return vectors.select("vec_id", "label", "embedding").mapInArrow(code, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Components become floor(scale * x). Null and empty vectors and those with a null or non-finite component give no
    row; vectors of different lengths, of a length that ``parts`` does not divide, and components too large for exact
    64-bit distances are errors. Repeated rows each give a row and each weigh in the means; as a seed an id counts once,
    with the least of its vectors, and a null id never does. Fewer ids than ``entries`` make smaller codebooks. Of
    entries at one distance the lowest counts. ``label_error`` sums the errors of equal labels, those without one
    together. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so between 1 and 256 entries")
    vectors = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    spark = table.sparkSession
    with lean(spark):
        books = train(vectors, parts, entries, rounds, scale)
    if books is None:
        columns = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return vectors.filter(F.lit(False)).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    coded = settled(encode(vectors, books, scale), "codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
