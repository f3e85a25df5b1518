"""Training-order materialisation: a keyed permutation gives every sequence a slot, and slots go to fixed-stride shards.

Documents are tokenised in the order in which the table is read, each with its end id, and the stream is cut into
sequences of ``length`` ids. A Feistel network over the next even power of two, walked along its cycle until it falls
below the number of sequences, is a permutation of them. Each shard holds a range of slots as records of one fixed
stride, so a reader finds any slot by arithmetic, reads on sequentially, and resumes at any slot.

Shards are written by Spark's own text sink, which keeps task commits: a record is the raw bytes of its ids and a line
end. A record's bytes may hold line ends of their own; readers go by the stride.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tillbook.llm.common import lean, mix
from tillbook.llm.tokens import END, token_arrays
from tillbook.session import shared_dir

LENGTH = 1024
SLOTS_PER_SHARD = 4096
# Shards are made in so many turns, which bounds the shuffled tokens on disk to this part of all of them.
TURNS = 4
_STAGES = 6


@dataclass(frozen=True)
class Layout:
    """All that a reader needs: ids are unsigned 16-bit little-endian; the last sequence is padded with the end id."""

    path: str
    key: int
    length: int
    sequences: int
    tokens: int
    slots_per_shard: int
    shards_per_turn: int

    @property
    def stride(self) -> int:
        return 2 * self.length + 1

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte) of a slot."""
        return slot // self.slots_per_shard, slot % self.slots_per_shard * self.stride


def _half(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _network(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    keys = mix(np.arange(1, _STAGES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % (1 << 64)))
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return (left << np.uint64(half)) | right


def permuted(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Slot of each sequence number below ``n`` (``back``: the other way)."""
    half, out = _half(n), x.astype(np.uint64)
    out = _network(out, half, key, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, key, back)
    return out.astype(np.int64)


def _tokenised(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None, path: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("part", T.IntegerType()),
            *[T.StructField(k, T.LongType()) for k in ("ahead", "n")],
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, starts, sizes = [], [], []
            for ids in token_arrays((t.as_py() for t in batch.column(1)), vocabulary, END):
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("records hold ids of 16 bits, and the vocabulary has larger ones")
                raw.append(ids.astype("<u2").tobytes())
                starts.append(ahead)
                sizes.append(len(ids))
                ahead += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([part] * len(raw), pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(raw, pa.binary()),
                ],
                names=schema.names,
            )

    made = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    with lean(docs.sparkSession):
        made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _fragments(stream: DataFrame, layout: Layout, first: int, end: int) -> DataFrame:
    """(shard, slot, at, ids): what each document gives to sequences whose slots are in shards first..end-1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column(0).to_numpy()
            n = batch.column(1).to_numpy()
            low, high = start // layout.length, (start + np.maximum(n, 1) - 1) // layout.length
            count = np.where(n > 0, high - low + 1, 0)
            doc = np.repeat(np.arange(len(start)), count)
            sequence = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            if not len(doc):
                continue
            slot = permuted(sequence, layout.sequences, layout.key)
            shard = slot // layout.slots_per_shard
            kept = np.flatnonzero((shard >= first) & (shard < end))
            begin = np.maximum(sequence * layout.length, start[doc])
            stop = np.minimum((sequence + 1) * layout.length, (start + n)[doc])
            raw = batch.column(2)
            last, body, parts = -1, b"", []
            for i in kept.tolist():
                if doc[i] != last:
                    last, body = doc[i], raw[int(doc[i])].as_py()
                parts.append(body[2 * (begin[i] - start[last]) : 2 * (stop[i] - start[last])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[kept].astype(np.int32)), pa.array(slot[kept]),
                    pa.array((begin - sequence * layout.length)[kept].astype(np.int32)), pa.array(parts, pa.binary()),
                ],
                names=["shard", "slot", "at", "ids"],
            )

    return stream.select("start", "n", "ids").mapInArrow(run, "shard int, slot long, at int, ids binary")


def _records(fragments: DataFrame, layout: Layout) -> DataFrame:
    """Whole records of a partition that is sorted by slot and place; a slot may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, slot, parts = 2 * layout.length, None, []
        padding = np.array([END], "<u2").tobytes()

        def record() -> bytes:
            joined = b"".join(parts)
            return joined + padding * ((size - len(joined)) // 2)

        for batch in batches:
            done = []
            for s, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != slot:
                    if parts:
                        done.append(record())
                    slot, parts = s, []
                parts.append(part.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([record()], pa.binary())], names=["value"])

    return fragments.select("slot", "ids").mapInArrow(run, "value binary")


def write_shards(
    docs: DataFrame, path: str, key: int = 0, length: int = LENGTH, slots_per_shard: int = SLOTS_PER_SHARD,
    turns: int = TURNS, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
) -> Layout:
    """Write the shards below ``path`` and return their layout, which is also written there as ``layout.json`` text.

    Null text is empty and gives its end id alone. An empty table gives no shards. Shard s is the file of partition
    ``s % shards_per_turn`` in folder ``turn=<s // shards_per_turn>``.
    """
    spark = docs.sparkSession
    rows = _tokenised(docs, doc_id, text, vocabulary, f"{path}/tokens")
    # One row per task of the tokenising: small by construction.
    parts = rows.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    sequences = -(-total // length)
    shards = -(-sequences // slots_per_shard)
    per_turn = max(1, -(-shards // turns))
    layout = Layout(path, key, length, sequences, total, slots_per_shard, per_turn)
    stream = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("ahead"))
    with lean(spark):  # a turn's shuffled tokens go when it has ended
        for turn, first in enumerate(range(0, shards, per_turn)):
            dealt = _fragments(stream, layout, first, first + per_turn).repartitionById(per_turn, F.col("shard") - first)
            records = _records(dealt.sortWithinPartitions("slot", "at"), layout)
            records.select(F.col("value").cast("string")).write.text(f"{path}/shards/turn={turn}")
    spark.createDataFrame([(json.dumps(asdict(layout)),)], "value string").coalesce(1).write.text(f"{path}/layout.json")
    return layout


def read_slots(spark: SparkSession, layout: Layout, first: int = 0) -> DataFrame:
    """(slot, shard, offset, sequence, length, ids_crc32, ids) from slot ``first`` on, from the files alone."""
    if not layout.sequences:
        return spark.createDataFrame([], "slot long, shard int, offset long, sequence long, length int, ids_crc32 long, ids binary")
    files = spark.read.format("binaryFile").load(f"{layout.path}/shards/turn=*/part-*").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = layout.sequences - 1
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                turn, part = map(int, re.search(r"turn=(\d+)/part-(\d+)", path).groups())
                shard = turn * layout.shards_per_turn + part
                body = content.as_py()
                base, count = shard * layout.slots_per_shard, len(body) // layout.stride
                slots = np.arange(max(base, first), base + count)
                sequence = permuted(slots, layout.sequences, layout.key, back=True)
                tokens = np.where(sequence == last, layout.tokens - last * layout.length, layout.length)
                at = (slots - base) * layout.stride
                for k in range(0, len(slots), 1024):
                    raws = [body[a : a + 2 * n] for a, n in zip(at[k : k + 1024].tolist(), tokens[k : k + 1024].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(slots[k : k + 1024]), pa.array([shard] * len(raws), pa.int32()), pa.array(at[k : k + 1024]),
                            pa.array(sequence[k : k + 1024]), pa.array(tokens[k : k + 1024].astype(np.int32)),
                            pa.array([zlib.crc32(r) for r in raws], pa.int64()), pa.array(raws, pa.binary()),
                        ],
                        names=["slot", "shard", "offset", "sequence", "length", "ids_crc32", "ids"],
                    )

    return files.mapInArrow(
        run, "slot long, shard int, offset long, sequence long, length int, ids_crc32 long, ids binary"
    )


def materialise(docs: DataFrame, key: int = 0, **how) -> DataFrame:
    """The shards of ``docs`` in a new place of the shared folder, read back slot by slot."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex[:12]}"
    return read_slots(spark, write_shards(docs, path, key, **how))
