"""Which pieces of a text may be wanted ones, told by a bitmap of fixed size in place of a list of any size.

Each wanted piece sets two bits. A piece without both is not wanted; one with both is still to be looked up. More wanted
pieces set more bits and let more others through, but never hold a wanted one back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

BITS = 24  # 2 MB
# Characters that numpy works on at a time inside a task; a longer text is a stretch of its own.
STRETCH = 1 << 20

# What is defined here travels to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _bits(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for pieces of ``length`` characters."""
    x = hashes + np.uint64(length)
    low, high = np.uint64(64 - BITS), np.uint64(33)
    first = (x * np.uint64(0x9E3779B97F4A7C15)) >> low
    second = ((x ^ (x >> high)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> low
    return first, second


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashed(codes: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of ``length`` characters, from those of one character less."""
    return hashes[:-1] * np.uint64(0xBF58476D1CE4E5B9) + codes[length - 1 :]


def _places(pieces: pa.Array) -> pa.Array:
    out = []
    for piece in pieces.to_pylist():
        codes = _codes(piece)
        hashes = codes
        for length in range(2, len(codes) + 1):
            hashes = _hashed(codes, hashes, length)
        out.append([int(b[0]) for b in _bits(hashes[:1], len(codes))])
    return pa.array(out, pa.list_(pa.int64()))


def marks(wanted: DataFrame, piece: str) -> np.ndarray:
    """The bitmap of all values, none empty or null, of a column; at most its own size reaches the driver."""
    place = F.arrow_udf(_places, "array<bigint>")(piece)
    words = wanted.select(F.explode(place).alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint64)


def marked_pieces(form: Column, text: Column, lengths: Mapping[bool, Sequence[int]], bitmap: np.ndarray, reach: int) -> Column:
    """Of each text the distinct marked pieces, of the lengths that its form asks for: array of (piece, rest).

    ``rest`` is what follows a piece of the greatest length, up to ``reach`` characters in all, and empty behind others.
    """
    sizes = {form: sorted(some) for form, some in lengths.items()}
    longest = max(max(some) for some in sizes.values())

    def stretches(told: list, given: list) -> Iterator[tuple[bool, list[int]]]:
        """Rows of one form with about STRETCH characters in all."""
        for form in sizes:
            rows, size = [], 0
            for k, text in enumerate(given):
                if told[k] == form and text:
                    rows.append(k)
                    size += len(text)
                    if size >= STRETCH:
                        yield form, rows
                        rows, size = [], 0
            if rows:
                yield form, rows

    def look(forms: pa.Array, texts: pa.Array) -> pa.Array:
        found: list[set] = [set() for _ in range(len(texts))]
        given = texts.to_pylist()
        for form, rows in stretches(forms.to_pylist(), given):
            some = sizes[form]
            whole = "".join([given[k] for k in rows])
            ends = np.cumsum([len(given[k]) for k in rows])
            codes = _codes(whole)
            hashes = codes
            for length in range(1, some[-1] + 1):
                if length > 1:
                    hashes = _hashed(codes, hashes, length)
                if length > len(codes):
                    break
                if length not in some:
                    continue
                first, second = _bits(hashes, length)
                at = np.flatnonzero((bitmap[first >> np.uint64(6)] >> (first & np.uint64(63))) & np.uint64(1))
                second = second[at]
                at = at[((bitmap[second >> np.uint64(6)] >> (second & np.uint64(63))) & np.uint64(1)).astype(bool)]
                row = np.searchsorted(ends, at, "right")
                inside = at + length <= ends[row]
                for r, i, end in zip(row[inside].tolist(), at[inside].tolist(), ends[row[inside]].tolist()):
                    rest = whole[i + length : min(i + reach, end)] if length == longest else ""
                    found[rows[r]].add((whole[i : i + length], rest))
        counts = np.cumsum([0, *map(len, found)])
        flat = [p for some in found for p in some]
        pieces = pa.StructArray.from_arrays(
            [pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], ["piece", "rest"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pieces)

    return F.arrow_udf(look, "array<struct<piece:string,rest:string>>")(form, text)
