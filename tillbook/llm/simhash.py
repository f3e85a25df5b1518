"""SimHash near-dedup: fingerprints of word shingles, linked through Burkhard-Keller trees of bounded size.

A fingerprint is cut into ``radius + 2`` runs of bits. Of two that differ in at most ``radius`` bits, two runs at least
are equal, so every pair that links meets in the shard of some two runs and their values. A shard's distinct
fingerprints form a tree whose children hang on integer Hamming distances to their parent; a search follows only edges
within the radius of the distance at hand. A shard with more than TREE members has several trees, told apart by a salt;
each of them is sent to all query blocks of its shard by an equi-join on the shard. So a broadcast reaches just the
tasks that may have a neighbour, no tree exceeds its bound, and the driver never holds a fingerprint.

A search gives one link per member and component of its task, not all pairs; components are found from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillbook.llm.common import lists, settled
from tillbook.llm.graph import components

SEED = 42
# Members of a tree on average at most.
TREE = 4096
# Pairs of a query and a node that a search has open at a time, about.
OPEN = 1 << 20
# Hashes whose bits are counted at a time.
HASHES = 1 << 15
# An edge is named by its parent and its distance, which is 64 at most.
_EDGES = 65


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of every ``n``-word shingle, repeats included, of a text with A-Z lower-cased; all words as one if fewer."""
    import xxhash

    words = text.lower().split()  # both of bytes: ASCII letters, space and tab to carriage return
    if not words:
        return []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(line, SEED)]
    return [xxhash.xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip([0, *ends], ends[n - 1 :])]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Of each hash its 64 bits, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def majorities(texts: list[bytes | None], n: int) -> np.ndarray:
    """Fingerprint of each text: bits set in over half of its hashes; zero without words. Long texts are summed in blocks."""
    set_in, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    ends, rows = [], []

    def count() -> None:
        if held:
            starts = np.array([0, *ends[:-1]])
            # Unsigned bytes sum up in wide numbers.
            set_in[rows] += np.add.reduceat(_bits(np.array(held, np.uint64)), starts, axis=0, dtype=np.int64)
        held.clear(), ends.clear(), rows.clear()

    for k, text in enumerate(texts):
        hashes = shingle_hashes(text or b"", n)
        total[k] = len(hashes)
        for at in range(0, len(hashes), HASHES):
            held.extend(hashes[at : at + HASHES])
            ends.append(len(held))
            rows.append(k)
            if len(held) >= HASHES:
                count()
    count()
    return np.packbits(2 * set_in > total[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4) -> DataFrame:
    """(doc_id, code) of every row; ``code`` holds the 64 bits as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = majorities(batch.column(1).cast(pa.large_binary()).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("code", T.LongType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, schema)


def runs(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each of the ``radius + 2`` runs that 64 bits are cut into."""
    ends = [64 * k // (radius + 2) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _run(code, lowest: int, bits: int):
    return F.shiftrightunsigned(code, lowest).bitwiseAND(F.lit((1 << bits) - 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees over consecutive stretches of ``codes``; the first code of a stretch is its root.

    Returns the edges as parent * 65 + distance, ascending, and the child at the end of each. All trees grow a step at
    a time: codes that wait at a node are split by their distance to it, and the first of each distance is its child.
    """
    ends = np.cumsum(sizes)
    at = np.repeat(ends - sizes, sizes)
    waiting = np.flatnonzero(at != np.arange(len(codes)))
    edges, children = [], []
    while len(waiting):
        edge = at[waiting] * _EDGES + distances(codes[waiting], codes[at[waiting]])
        order = np.argsort(edge, kind="stable")
        edge, waiting = edge[order], waiting[order]
        first = np.ones(len(edge), bool)
        first[1:] = edge[1:] != edge[:-1]
        child = waiting[first]
        edges.append(edge[first])
        children.append(child)
        at[waiting] = child[np.cumsum(first) - 1]
        waiting = waiting[~first]
    edge = np.concatenate([np.zeros(0, np.int64), *edges])
    child = np.concatenate([np.zeros(0, np.int64), *children])
    order = np.argsort(edge)
    return edge[order], child[order]


def search(
    asked: np.ndarray, root: np.ndarray, codes: np.ndarray, edge: np.ndarray, child: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all nodes within ``radius`` of each code of ``asked`` in the tree under its ``root``."""
    query, node = np.arange(len(asked)), root
    found: tuple[list, list] = ([], [])
    while len(query):
        d = distances(asked[query], codes[node])
        hit = d <= radius
        found[0].append(query[hit])
        found[1].append(node[hit])
        low = np.searchsorted(edge, node * _EDGES + np.maximum(d - radius, 0), "left")
        high = np.searchsorted(edge, node * _EDGES + np.minimum(d + radius, 64), "right")
        n = high - low
        query = np.repeat(query, n)
        node = child[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(query))]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found[0]]), np.concatenate([none, *found[1]])


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (smallest member of each component) after linking a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            next_label = label[label]
            if (next_label == label).all():
                break
            label = next_label


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and the length of each list."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, salt, salts, codes) with the tree of each row's codes; nodes are places in the row."""
    for batch in batches:
        codes, sizes = _values(batch.column(3))
        edge, child = grow(codes.view(np.uint64), sizes)
        first = np.cumsum(sizes) - sizes
        edges_of = np.maximum(sizes - 1, 0)
        base = np.repeat(first, edges_of)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, lists(pa.array(edge - base * _EDGES), edges_of), lists(pa.array(child - base), edges_of)],
            names=["shard", "salt", "salts", "codes", "edge", "child"],
        )


def _links(radius: int):
    """From rows (codes, edge, child, asked) to (a, b): each code that links, with one of its component in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = _values(batch.column(0))
            asked, per_row = _values(batch.column(3))
            first = np.cumsum(sizes) - sizes
            base = np.repeat(first, np.maximum(sizes - 1, 0))
            edge = _values(batch.column(1))[0] + base * _EDGES
            child = _values(batch.column(2))[0] + base
            named, place = np.unique(np.concatenate([codes, asked]), return_inverse=True)
            label = np.arange(len(named))
            root, cost = np.repeat(first, per_row), np.cumsum(np.repeat(sizes, per_row))
            at = 0
            while at < len(asked):
                end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + OPEN, "right")))
                query, node = search(
                    asked[at:end].view(np.uint64), root[at:end], codes.view(np.uint64), edge, child, radius
                )
                label = joined(label, place[len(codes) + at + query], place[node])
                at = end
            linked = np.flatnonzero(label != np.arange(len(label)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(named[label[linked]]), pa.array(named[linked])], names=["a", "b"])

    return run


def linked(codes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the distinct numbers ``code``; their components are those of all pairs within ``radius``."""
    cut = runs(radius)
    # Two runs and their values, hashed: shards that fall together cost a little time only.
    shards = [
        F.xxhash64(F.lit(i), F.lit(j), _run(F.col("code"), *cut[i]), _run(F.col("code"), *cut[j]))
        for i, j in combinations(range(len(cut)), 2)
    ]
    members = settled(codes.select(F.explode(F.array(*shards)).alias("shard"), "code"), "members")
    shared = settled(members.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
    salted = members.join(shared, "shard").withColumn("salts", F.ceil(F.col("n") / TREE).cast("int"))
    blocks = salted.withColumn("salt", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int")).groupBy("shard", "salt").agg(
        F.first("salts").alias("salts"), F.collect_list("code").alias("codes")
    )
    schema = "shard long, salt int, salts int, codes array<long>, edge array<long>, child array<long>"
    trees = settled(blocks.select("shard", "salt", "salts", "codes").mapInArrow(_grown, schema), "trees")
    alone = trees.filter("salts = 1").select("codes", "edge", "child", F.col("codes").alias("asked"))
    many = trees.filter("salts > 1")
    queries = many.select(F.col("shard"), F.col("salt").alias("of"), F.col("codes").alias("asked"))
    sent = many.join(queries, "shard").filter("of >= salt").select("codes", "edge", "child", "asked")
    found = alone.mapInArrow(_links(radius), "a long, b long").unionByName(sent.mapInArrow(_links(radius), "a long, b long"))
    return found.distinct()


def near_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, radius: int = 4
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of anything but space and tab..carriage return, with A-Z lower-cased; shingles are ``n`` words joined
    by a space, repeats included, or all words as one if there are fewer. Null, empty and blank texts have fingerprint
    zero and link like any other. Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest doc_id that links reach. Repeated rows have one fingerprint and so one component; rows with a null id take
    part without naming the component, which is null where no other row is in it. Whole texts count however long they
    are; other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    if not 0 <= radius <= 30:
        raise ValueError("the radius leaves no runs of bits to share")
    signed = settled(fingerprints(docs, doc_id, text, n), "signed")
    nodes = settled(signed.groupBy("code").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(settled(linked(nodes.select("code"), radius), "linked"))
    grouped = settled(
        nodes.join(roots.select(F.col("node").alias("code"), "root"), "code", "left").select(
            "code", "first_id", F.coalesce("root", "code").alias("root")
        ),
        "grouped",
    )
    smallest = settled(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    by_code = settled(grouped.join(smallest, "root").select("code", "component_id"), "by_code")
    return signed.join(by_code, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
