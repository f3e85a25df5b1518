"""Reading the tables, and word hashes of whole Arrow columns with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillbook.session import stored

# Word separators of every word-based operator: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that numpy works on at a time inside a task; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column | str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """For each wanted working name, one that clashes with no column of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        free = name
        while free.lower() in taken:
            free = f"_{free}"
        out[name] = free
        taken.add(free.lower())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows within the bytes) for runs of rows of about ``size`` bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def hashed_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word of a block, and nothing else; words never cross rows.

    ``fold`` lower-cases A-Z first. Rows are found again by searching the starts in ``offsets``.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    ink = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[offsets < len(data)]] = True
    first[-1] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(ink[:-1], out=before[1:])
    starts = np.flatnonzero(ink & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(ink[1:], out=after[:-1])
    ends = np.flatnonzero(ink & (after | first[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, _MULTIPLIER | np.uint64(1), np.uint64), dtype=np.uint64)
    inked = np.flatnonzero(ink)
    place = np.arange(len(inked)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = _FOLD[data[inked]] if fold else data[inked]
    sums = np.add.reduceat(_BYTE[letters] * powers[place], np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64)), starts, ends


def shingles(words: np.ndarray, per_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and how many each row has; a row with fewer words gives one of all its words."""
    counts = np.where(per_row >= n, per_row - n + 1, (per_row > 0).astype(np.int64))
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), counts
    row = np.repeat(np.arange(len(per_row)), counts)
    first = (np.cumsum(per_row) - per_row)[row] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    left = per_row[row]
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        word = padded[first + k]
        out = np.where(k < left, mix(out * _MULTIPLIER + word + np.uint64(k + 1)), out)
    return out, counts


def distinct_per_row(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and how many."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes)
    # Few rows fit a type that a stable sort takes by radix.
    kind = np.uint16 if len(counts) < 1 << 16 else np.int64
    order = order[np.argsort(row[order].astype(kind), kind="stable")]
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], np.bincount(row[keep], minlength=len(counts))


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def per_batch(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A ``mapInArrow`` function from one that works on a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return run


# What jobs run with here: shuffled files go as soon as a job has ended, and tasks get texts in small batches.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """SETTINGS for the jobs that run inside, and the session's own ones again afterwards."""
    kept = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored`` under lean settings."""
    with lean(df.sparkSession):
        return stored(df, name)
