"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and how their ids go together.

Tokens of both sides are byte ranges of one text, so a side is its array of token ends. At the current index shift the
arrays are compared slice against slice; slices that are equal double in length, so that a stretch of one-to-one tokens
is jumped in few steps. Where a slice differs, the place is found in it, the irregular group there is resolved token by
token up to the next common end, and the shift is what the group leaves between the two indexes.

Corpus-wide counts of id pairs are summed per task before they are shuffled. Documents get the counts back in two ways:
the HEAVY pairs of most documents, whose table has a fixed bound, are sent to all tasks, and the rest, none of which is
hot, meets its counts in an equi-join.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import lean, lists, settled
from tillbook.llm.tokens import vocabulary_path

# The first holds the vocabulary of byte_bpe_50k.json as ranks: the same ids at a quarter of the time.
A_FILE, B_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
# Pairs whose counts all tasks get: 17 bytes each, 4 MB.
HEAVY = 1 << 18
# Bytes of text that are encoded at a time.
BLOCK_BYTES = 1 << 18
# Tokens of a first probe.
PROBE = 8
# Irregular groups that a worker remembers, about, and the most tokens of one.
KNOWN, LONGEST = 1 << 16, 16


class Ranks:
    """A file of byte-pair ranks; no string is special. Its tokens are pieces of the text's own bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A model file of pieces: U+2581 stands for a space, <0xHH> for a byte. The model itself adds the first space."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("\u2581", " ").encode()
            for i, piece in enumerate(map(self._model.id_to_piece, range(self._model.get_piece_size())))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Sides:
    """Both vocabularies of a task."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = Ranks(vocabulary_path(a_file)), Pieces(vocabulary_path(b_file))
        # Decimal ids as the notation joins them, and irregular groups met before.
        self.a_noted = [f"{k}|" for k in range(len(self.a.bytes))]
        self.b_noted = [str(k) for k in range(len(self.b.bytes))]
        self.known: dict[tuple, tuple[str, list[int], list[int]]] = {}
        self._sizes = [list(map(len, side.bytes)) for side in (self.a, self.b)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
        """(A ids, B ids, A ends, B ends) of each text; none of those that are empty or not given back byte for byte."""
        filled = [t or "" for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        a_sizes, b_sizes = self._sizes
        for text, a_ids, b_ids in zip(filled, self.a.encode(filled), self.b.encode(filled)):
            whole = b" " + text.encode()
            a = list(accumulate(map(a_sizes.__getitem__, a_ids)))
            if not text or a[-1] != len(whole) or b"".join(map(self.b.bytes.__getitem__, b_ids)) != whole:
                yield [], [], [], []
            else:
                yield a_ids, b_ids, a, list(accumulate(map(b_sizes.__getitem__, b_ids)))


@lru_cache(maxsize=2)
def opened(a_file: str, b_file: str) -> Sides:
    """Opened once per Python worker."""
    return Sides(a_file, b_file)


def irregular(x: list[int], y: list[int], sides: Sides) -> tuple[str, list[int], list[int]]:
    """Notation of a group, and the A and B ids of its tokens whose bytes overlap."""
    left, right = [], []
    i, j = 0, 0
    a = list(accumulate(len(sides.a.bytes[k]) for k in x))
    b = list(accumulate(len(sides.b.bytes[k]) for k in y))
    while True:
        left.append(x[i])
        right.append(y[j])
        if a[i] < b[j]:
            i += 1
        elif a[i] > b[j]:
            j += 1
        else:
            return f"{','.join(map(str, x))}|{','.join(map(str, y))}", left, right


def aligned(
    a_ids: list[int], b_ids: list[int], a: list[int], b: list[int], sides: Sides
) -> tuple[int, str, list[int], list[int]]:
    """(groups, their notation, A ids and B ids of all links) of a text's tokens, whose ends ``a`` and ``b`` end alike."""
    noted: list[str] = []
    left: list[int] = []
    right: list[int] = []
    of_a, of_b, known = sides.a_noted.__getitem__, sides.b_noted.__getitem__, sides.known
    i, shift, last, b_last = 0, 0, len(a), len(b)
    while i < last:
        start, probe = i, PROBE
        while i < last:  # jump as long as slices at this shift are equal
            j = i + shift
            some = min(probe, last - i, b_last - j)
            if a[i : i + some] == b[j : j + some]:
                i += some
                probe *= 2
                continue
            while some > PROBE:  # a long slice that differs: by halves to where it does
                half = some // 2
                if a[i : i + half] == b[i + shift : i + shift + half]:
                    i += half
                    some -= half
                else:
                    some = half
            for x, y in zip(a[i : i + some], b[i + shift : i + shift + some]):
                if x != y:
                    break
                i += 1
            break
        if i > start:  # groups of a single token each
            x, y = a_ids[start:i], b_ids[start + shift : i + shift]
            left += x
            right += y
            noted += map(add, map(of_a, x), map(of_b, y))
        if i < last:  # an irregular group up to the next common end, which leaves another shift
            p, q = i, i + shift
            x, y = a[p], b[q]
            while x != y:
                if x < y:
                    p += 1
                    x = a[p]
                else:
                    q += 1
                    y = b[q]
            mine, theirs = a_ids[i : p + 1], b_ids[i + shift : q + 1]
            name = (*mine, -1, *theirs)
            found = known.get(name)
            if found is None:
                found = irregular(mine, theirs, sides)
                if len(name) <= LONGEST:
                    known[name] = found
            noted.append(found[0])
            left += found[1]
            right += found[2]
            i, shift = p + 1, q - p
    return len(noted), ";".join(noted), left, right


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about BLOCK_BYTES; a longer text is one of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def alignments(docs: DataFrame, doc_id: str, text: str, a_file: str, b_file: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row.

    ``pairs`` are the distinct linked ids as ``a * 2**24 + b``, ascending, ``times`` how often the row links them.
    """
    kept = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"row long, doc_id {kept}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = opened(a_file, b_file)
        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(2).to_pylist()):
                found = []
                # Nothing below makes cycles; the collector would walk all that is remembered again and again.
                gc.disable()
                for a_ids, b_ids, a, b in sides.encode(texts):
                    groups, noted, left, right = aligned(a_ids, b_ids, a, b, sides)
                    links = (np.frombuffer(array("q", left), np.int64) << 24) + np.frombuffer(array("q", right), np.int64)
                    name = hashlib.sha256(noted.encode()).hexdigest() if a_ids else ""
                    found.append((len(a_ids), len(b_ids), groups, len(links), name, *np.unique(links, return_counts=True)))
                gc.enable()
                numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
                sizes = np.array([len(f[5]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *numbers,
                        pa.array([f[4] for f in found], pa.string()),
                        lists(pa.array(np.concatenate([f[5] for f in found])), sizes),
                        lists(pa.array(np.concatenate([f[6] for f in found]).astype(np.int32)), sizes),
                    ],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                at += len(texts)

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    ).mapInArrow(run, schema)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best): rows that hold each pair linked, and whether no pair of the same A id is in more of them."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    counted = settled(
        held.select("pairs").mapInArrow(combine, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counted"
    )
    a = F.shiftright("pair", 24)
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return settled(
        counted.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts"
    )


def _with_heavy(held: DataFrame, counts: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the sums over the heaviest pairs, and the pairs that are left; then the counts of those."""
    top = counts.orderBy(F.desc("n"), "pair").limit(heavy).orderBy("pair").toArrow()
    sent = held.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        if len(top) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    )

    names = held.columns[:7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_of, best_of = sent.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (7, 8))
            sizes = np.diff(batch.column(7).offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            if len(known):
                place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                hit = known[place] == pairs
            else:
                place, hit = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            held_n = np.where(hit, n_of[place], 0) * times if len(known) else place
            held_best = np.where(hit & best_of[place], times, 0) if len(known) else place
            ends = np.cumsum(sizes)
            sums, best = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (held_n, held_best))
            left = np.bincount(row[~hit], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:7], pa.array(best), pa.array(sums),
                    lists(pa.array(pairs[~hit]), left), lists(pa.array(times[~hit]), left),
                ],
                names=[*names, "n_best", "count_sum", "pairs", "times"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[:7])
    found = settled(
        held.mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<long>, times array<int>"), "heavy"
    )
    if len(top) < heavy:
        return found, None
    last = top.column("n").to_numpy().min()
    return found, counts.filter(F.col("n") <= F.lit(int(last)))  # those of the last count may be in both; a row asks for one


def align_tokenizers(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE,
    heavy: int = HEAVY,
) -> DataFrame:
    """One row per row of ``docs``: its tokens by two vocabularies, cut into groups of the same bytes, and their links.

    A encodes a space and the text, B the text, to which its model adds that space; strings of special tokens are plain
    text. ``n_a``, ``n_b``: tokens; ``n_groups``: groups between byte offsets where tokens of both end; ``n_links``:
    pairs of an A and a B token whose bytes overlap; ``groups_sha256``: hash of the groups written as
    ``a1,a2|b1;a3|b2,b3``. The count of an id pair is the number of rows that hold it linked; ``count_sum`` sums it over
    the links of the row, ``n_best`` are the links whose count is the highest of their A id, ties included.

    Null and empty texts, and those that one of the vocabularies does not give back byte for byte, have no tokens: zeros
    and an empty string. Repeated rows count as often as they come and each give a row; null ids stay null. A text is
    encoded whole however long it is. Other columns are not read, so their names cannot clash. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    with lean(spark):
        held = settled(alignments(docs, doc_id, text, a_file, b_file), "aligned")
        counts = pair_counts(held)
        found, rest = _with_heavy(held, counts, heavy)
    if rest is None:
        return found.drop("row", "pairs", "times")
    zipped = F.explode(F.arrays_zip("pairs", "times"))
    light = found.select("row", zipped.alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = (
        light.join(rest, "pair").groupBy("row")
        .agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"))
    )
    return found.join(sums, "row", "left").select(
        *found.columns[1:7],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
