"""N-gram Jaccard join with token-combination prefixes.

A document is its set of word shingles. All shingles have one global order: rare class first, by hash within a class.
The class comes from a count of all shingles of the corpus in a fixed number of buckets. A set that links to another
can miss at most ``n - need(n)`` of its shingles there, so the prefix of a set is extended until its shingles must
give one common signature more than can be missing: a rare shingle is a signature alone, shingles of class k sign in
combinations of k. Combinations stay within ranges of the hash that get narrower as sets grow, so a prefix of length
p has a number of them in proportion to p.

Sets that share a signature are candidates, unless their sizes or the parities of their hashed shingles already bound
the similarity from above too low. They are first verified against one of each bucket; then whatever pairs of
a bucket are not connected yet are verified, which loses no link and spares all pairs within groups of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillbook.llm.common import BLOCK_BYTES, distinct_per_row, hashed_words, lists, mix, settled, shingles, text_blocks, unused
from tillbook.llm.graph import components

# log2 of the buckets that shingles are counted in: the counts are at most 8 MB however large the corpus is. In a larger
# corpus a bucket holds more shingles, and "frequent" starts at a higher count: that costs time, never links.
COUNT_BITS = 19
# A shingle is frequent when its bucket counts more than the mean by this many standard deviations and a few besides.
DEVIATIONS, FLOOR = 8.0, 24
# From this many times that bound on, combinations have three shingles instead of two.
VERY = 16
# Bits of a set's parity sketch at least; larger sets have a power of two that is no less than their size. Two sets
# differ in at least as many shingles as their sketches do in bits.
SKETCH_BITS = 2048
# Parts that a set plays in a pair, with the bit that says so.
ROLES = {"both": 3, "smaller": 1, "larger": 2}
# log2 of the bits that tell which texts take part in a verification (1 MB).
MARK_BITS = 23


def need(n: np.ndarray | int, percent: int):
    """Fewest shingles that a set of ``n`` has in common with any set it links to."""
    return -(-n * percent // 100)


def level(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def _edges(most: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] + max(1, edges[-1] // 20))
    return np.array(edges)


# First sizes of the bands of sizes; a band spans 5 %.
_EDGES = _edges()


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, np.maximum(n, 1), "right") - 1


def least_common(n: np.ndarray, partner: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common shingles of linked sets of ``n`` and ``partner``."""
    return -(-(n + partner) * percent // (100 + percent))


def _range_bits(at_level: np.ndarray) -> np.ndarray:
    return np.maximum(at_level - 2, 0)


def _unsure(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes at which combinations alone might not reach the cover that a prefix needs."""
    return n - 3 * (1 << _range_bits(level(n))) < n - need(n, percent) + 1


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, and how many."""
    words, starts, _ = hashed_words(data, offsets)
    return distinct_per_row(*shingles(words, words_per_row(starts, offsets), n))


def words_per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)


def sketches(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the shingles in each place of a set's sketch, as 64-bit numbers, and how many of them each set has.

    Half of a sketch upon the other, by exclusive or, is the sketch of half as many bits.
    """
    bits = np.maximum(SKETCH_BITS, 1 << (level(np.maximum(counts, 2) - 1) + 1))
    ends = np.cumsum(bits)
    row = np.repeat(np.arange(len(counts)), counts)
    place = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % bits[row].astype(np.uint64)
    odd = np.bincount((ends - bits)[row] + place.astype(np.int64), minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), bits // 64


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the longer one folded; sets near enough in size are one fold apart at most."""

    def fold(x: Column, to: Column) -> Column:
        folded = F.transform(F.sequence(F.lit(1), to), lambda i: F.element_at(x, i).bitwiseXOR(F.element_at(x, i + to)))
        return F.when(F.size(x) > to, folded).otherwise(x)

    to = F.least(F.size(a), F.size(b))
    bits = F.zip_with(fold(F.col(a), to), fold(F.col(b), to), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def set_keys(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two numbers."""
    row = np.repeat(np.arange(len(counts)), counts)
    keys = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(counts), np.uint64)
        np.add.at(total, row, mix(tokens ^ np.uint64(salt)))
        keys.append(mix(total + counts.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def bucket_counts(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many shingles of all documents, repeated ones too, fall in each of 2**COUNT_BITS buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                words, starts, _ = hashed_words(data, offsets)
                tokens, _ = shingles(words, words_per_row(starts, offsets), n)
                total += np.bincount((tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        bucket = np.flatnonzero(total)
        for at in range(0, len(bucket), 1 << 16):
            some = bucket[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = (
        docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def classes(counts: np.ndarray) -> np.ndarray:
    """Class of each bucket: 1 rare, 2 frequent, 3 very frequent."""
    mean = float(np.median(counts)) if counts.any() else 0.0
    bound = mean + DEVIATIONS * np.sqrt(mean) + FLOOR
    return (1 + (counts > bound) + (counts > VERY * bound)).astype(np.uint8)


def _combined(tokens: np.ndarray, picked: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    out = salt[picked[0]]
    for at in picked:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + tokens[at])
    return out


def signatures(
    tokens: np.ndarray, counts: np.ndarray, of_class: np.ndarray, percent: int
) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Signatures of the sets of a block, with the row of each (a row may repeat one), and how many rare shingles rows have.

    ``both``: single shingles; ``smaller``: combinations of a set as the smaller one of a pair, which may miss few
    shingles, in the band of its own size; ``larger``: those of a set as the larger one, in every band where a smaller
    partner may be. A pair that links shares one of ``both`` or one of ``smaller`` and ``larger``.
    """
    sizes = counts.astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cls = of_class[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    order = np.lexsort((tokens, cls, row))
    tokens, cls, row = tokens[order], cls[order], row[order]
    rank = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wanted = sizes - need(sizes, percent) + 1
    largest = sizes * 100 // percent
    smallest = need(sizes, percent)
    alone = (largest == sizes) & (smallest == sizes)  # no other set is near enough in size
    unsure = _unsure(sizes, percent)
    # Sets that can link to one of an unsure size also sign by single shingles in the order of the hash.
    top = int(largest.max()) + 1 if len(sizes) else 1
    before = np.concatenate([[0], np.cumsum(_unsure(np.arange(top + 1), percent))])
    plain = before[np.minimum(largest, top) + 1] - before[np.minimum(smallest, top)] > 0
    out, rows = [], []

    take = ~alone[row] & plain[row]
    if take.any():
        by_hash = np.lexsort((tokens[take], row[take]))
        t, r = tokens[take][by_hash], row[take][by_hash]
        held = np.bincount(r, minlength=len(sizes))
        place = np.arange(len(t)) - np.repeat(np.cumsum(held) - held, held)
        first = place < wanted[r]
        out.append(mix(t[first] + np.uint64(0xD1B54A32D192ED03)))
        rows.append(r[first])

    rare = np.bincount(row[cls == 1], minlength=len(sizes))
    take = ~alone[row] & ~unsure[row] & (cls == 1) & (rank < wanted[row])
    out.append(tokens[take])
    rows.append(row[take])
    found = {"both": (out, rows)}

    def combine(some: np.ndarray, at_band: np.ndarray, cover: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Combinations of the prefixes that reach ``cover``, for the sets ``some``, tagged with a band of sizes."""
        out, rows = [], []
        take = some[row] & (cls > 1)
        if not take.any():
            return out, rows
        t, c, r = tokens[take], cls[take], row[take]
        bits = _range_bits(level(_EDGES[at_band]))[r].astype(np.uint64)
        span = np.where(bits > 0, t >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0))
        new = np.ones(len(t), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (span[1:] != span[:-1])
        run = np.cumsum(new) - 1
        place = np.arange(len(t)) - np.flatnonzero(new)[run]
        gain = (place >= c - 1).astype(np.int64)
        total = np.cumsum(gain)
        held = np.bincount(r, minlength=len(sizes))
        base = np.concatenate([[0], total])[(np.cumsum(held) - held)[r]]
        within = rare[r] + total - gain - base < cover[r]
        t, c, r, run = t[within], c[within], r[within], run[within]
        salt = mix(at_band[r].astype(np.uint64) * np.uint64(8) + c.astype(np.uint64))
        n = len(t)
        width = int(np.bincount(run).max()) if n else 0
        for d in range(1, width):
            i = np.flatnonzero((run[: n - d] == run[d:]) & (c[: n - d] == 2))
            out.append(_combined(t, [i, i + d], salt))
            rows.append(r[i])
            for e in range(d + 1, width):
                i = np.flatnonzero((run[: n - e] == run[e:]) & (c[: n - e] == 3))
                if len(i):
                    out.append(_combined(t, [i, i + d, i + e], salt))
                    rows.append(r[i])
        return out, rows

    own = band(sizes)
    usable = ~alone & ~unsure
    cover = sizes - least_common(sizes, sizes, percent) + 1
    found["smaller"] = combine(usable & (rare < cover), own, cover)
    larger: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for down in range(int((own - band(smallest)).max()) + 1 if len(sizes) else 0):
        at_band = np.maximum(own - down, 0)
        cover = sizes - least_common(sizes, np.maximum(_EDGES[at_band], smallest), percent) + 1
        made = combine(usable & (own - down >= band(smallest)) & (rare < cover), at_band, cover)
        larger[0].extend(made[0])
        larger[1].extend(made[1])
    found["larger"] = larger
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return {k: (np.concatenate([none[0], *o]), np.concatenate([none[1], *r])) for k, (o, r) in found.items()}, rare


def signed_sets(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """(doc_id, text_key, k1, k2, size, rare, sketch, both, smaller, larger) of every document."""
    of_class = docs.sparkSession.sparkContext.broadcast(classes(bucket_counts(docs, text, n)))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            *[T.StructField(k, T.LongType()) for k in ("text_key", "k1", "k2", "size", "rare")],
            *[T.StructField(k, T.ArrayType(T.LongType())) for k in ("sketch", *ROLES)],
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(1), BLOCK_BYTES):
                tokens, counts = sets_of(data, offsets, n)
                k1, k2 = set_keys(tokens, counts)
                signs, rare = signatures(tokens, counts, of_class.value, percent)
                sketch, sketch_sizes = sketches(tokens, counts)
                made = [distinct_per_row_of(*signs[role], end - at) for role in ROLES]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at), pa.array(k1), pa.array(k2),
                        pa.array(counts.astype(np.int64)), pa.array(rare.astype(np.int64)),
                        lists(pa.array(sketch), sketch_sizes),
                        *[lists(pa.array(x.view(np.int64)), per_row) for x, per_row in made],
                    ],
                    names=schema.names,
                )

    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")
    ).mapInArrow(sign, schema)


def distinct_per_row_of(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    return distinct_per_row(values[order], np.bincount(rows, minlength=n))


def _marks(keys: DataFrame) -> np.ndarray:
    """Bits of the keys ``text_key`` that take part; 2**MARK_BITS bits whatever their number."""
    place = F.col("text_key").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = (
        keys.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, cast(text_key & 31 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    marks = np.zeros(1 << (MARK_BITS - 5), np.uint32)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return marks


def verified(docs: DataFrame, text: str, n: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs that link, as (a, b); the sets are made again from the texts that take part.

    ``pairs`` name nodes a, b, their sets a1, a2, b1, b2, and a text of each, a_text, b_text.
    """
    keys = pairs.select(F.explode(F.array("a_text", "b_text")).alias("text_key"))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(keys))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()  # a task gives each set once, however many copies it reads
        for batch in batches:
            bit = batch.column(1).to_numpy() & ((1 << MARK_BITS) - 1)
            hit = (marks.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)
            for _, _, data, offsets in text_blocks(batch.column(0).take(pa.array(np.flatnonzero(hit)))):
                tokens, counts = sets_of(data, offsets, n)
                k1, k2 = set_keys(tokens, counts)
                rows = []
                for i in np.flatnonzero(counts > 0).tolist():
                    name = (int(k1[i]), int(k2[i]))
                    if name not in given:
                        given.add(name)
                        rows.append(i)
                if rows:
                    ends = np.cumsum(counts)
                    kept = np.concatenate([tokens[ends[i] - counts[i] : ends[i]] for i in rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[rows]), pa.array(k2[rows]), lists(pa.array(kept.view(np.int64)), counts[rows])],
                        names=["k1", "k2", "tokens"],
                    )

    found = docs.select(text, F.xxhash64(text)).mapInArrow(sets, "k1 long, k2 long, tokens array<long>")
    left = found.toDF("a1", "a2", "a_tokens")
    right = found.toDF("b1", "b2", "b_tokens")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return (
        pairs.join(left, ["a1", "a2"])
        .join(right, ["b1", "b2"])
        .select("a", "b", both.alias("common"), (F.size("a_tokens") + F.size("b_tokens")).alias("together"))
        .filter(F.col("common") * 100 >= (F.col("together") - F.col("common")) * percent)
        .select("a", "b")
        .distinct()
    )


def rooted_rows(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """(doc_id, text_key, size, root, component_id) of every row; the last two are null for rows without shingles."""
    held = settled(signed_sets(docs, doc_id, text, n, percent), "signed")
    nodes = settled(
        held.filter("size > 0").groupBy("k1", "k2").agg(
            F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "rare", "text_key", "sketch", *ROLES)]
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    parts = [
        nodes.select(F.explode(role).alias("sign"), "node", "rare", F.col("size").cast("int"), F.lit(bit).alias("role"))
        for role, bit in ROLES.items()
    ]
    signed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # The set with the fewest rare shingles is the likeliest centre of its bucket.
    smaller = F.col("role").bitwiseAND(1) == 1
    shared = signed.groupBy("sign").agg(
        F.min("node").alias("low"), F.max("node").alias("high"),
        F.min_by(F.when(smaller, F.col("node")), F.when(smaller, F.col("rare"))).alias("pivot"),
    ).filter("low <> high and pivot is not null")
    # Written first: a join of two shuffled tables is one whose hot keys Spark can split.
    shared = settled(shared.select("sign", "pivot"), "shared")
    members = settled(signed.drop("rare").join(shared, "sign"), "members")
    sizes = nodes.select("node", F.col("size").cast("int"))
    names = nodes.select("node", "k1", "k2", "text_key", "sketch")

    def near(a: str, b: str) -> Column:
        return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes that may link by their sizes and sketches, with the names of their sets."""
        a = names.toDF("a", "a1", "a2", "a_text", "a_sketch")
        b = names.toDF("b", "b1", "b2", "b_text", "b_sketch")
        # Sets that link have (total + differing) * percent <= 100 * (total - differing) for the shingles that differ.
        possible = _differing("a_sketch", "b_sketch") * (100 + percent) <= F.col("total") * (100 - percent)
        sized = (
            pairs.distinct().join(sizes.toDF("a", "a_size"), "a").join(sizes.toDF("b", "b_size"), "b")
            .filter(near("a_size", "b_size")).select("a", "b", (F.col("a_size") + F.col("b_size")).alias("total"))
        )
        return sized.join(a, "a").join(b, "b").filter(possible).drop("total", "a_sketch", "b_sketch")

    first = settled(candidates(members.filter("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))), "pairs")
    linked = settled(verified(docs, text, n, percent, first), "linked")
    roots = components(linked)

    rooted = settled(
        members.join(roots, "node", "left").select("sign", "node", "role", "size", F.coalesce("root", "node").alias("root")), "rooted"
    )
    apart = rooted.groupBy("sign").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    open_members = settled(rooted.join(settled(apart.select("sign"), "apart"), "sign"), "open")
    side = lambda name, bit: open_members.filter(F.col("role").bitwiseAND(bit) == bit).select(
        "sign", F.col("node").alias(name), F.col("root").alias(f"{name}_root"), F.col("size").alias(f"{name}_size")
    )
    pairs = (
        side("x", 1).join(side("y", 2), "sign")
        .filter(F.col("x_root") != F.col("y_root"))
        .filter(near("x_size", "y_size"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    second = settled(candidates(pairs).join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = settled(verified(docs, text, n, percent, second), "linked")
        if not more.isEmpty():
            linked = linked.unionByName(more)
            roots = components(linked)

    grouped = settled(
        nodes.select("node", "k1", "k2", "first_id").join(roots, "node", "left").select(
            F.col("k1").alias("s1"), F.col("k2").alias("s2"), "first_id", F.coalesce("root", "node").alias("root")
        ),
        "grouped",
    )
    smallest = settled(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    by_set = grouped.join(smallest, "root").select("s1", "s2", "root", "component_id")
    return held.select("doc_id", "text_key", "k1", "k2", "size").join(
        by_set, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & (F.col("size") > 0), "left"
    ).select("doc_id", "text_key", "size", "root", "component_id")


def near_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of anything but space and tab..carriage return, with A-Z lower-cased. A set is the distinct n-word
    shingles, or all words as one if there are fewer; null, empty and blank texts have none, link with nothing and are
    components of their own. Sets link when 100 * common >= percent * union. ``component_id`` is the smallest doc_id
    that links reach; rows with equal sets are linked, rows with a null id take part without naming the component.
    """
    rows = rooted_rows(docs, doc_id, text, n, percent)
    return rows.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest id, and of the texts under it the one with the
    smallest hash.

    A row with a null id stays where its component has no other. Rows without words are in no component; of those with
    one id and one text one stays. So no two rows of the result have both the same id and the same text, whatever other
    columns they have; which of several such rows stays is not defined.
    """
    rows = rooted_rows(docs, doc_id, text, n, percent)
    alike = rows.groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "rows")
    kept = settled(
        alike.filter("root is not null").groupBy("root").agg(F.min(first).alias("row")).select("row.doc_id", "row.text_key", "row.rows")
        .unionByName(alike.filter("root is null").select("doc_id", "text_key", "rows"))
        .select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text"), "rows"),
        "kept",
    )
    names = unused(docs, "text_key")
    keyed = docs.withColumn(names["text_key"], F.xxhash64(text))
    is_kept = keyed[doc_id].eqNullSafe(F.col("kept_id")) & (F.col(names["text_key"]) == F.col("kept_text"))
    once = keyed.join(kept.filter("rows = 1"), is_kept, "left_semi")
    # Rows alike combine before they are shuffled, however many there are.
    repeated = keyed.join(kept.filter("rows > 1"), is_kept, "left_semi").dropDuplicates([doc_id, names["text_key"]])
    return once.unionByName(repeated).drop(names["text_key"])
