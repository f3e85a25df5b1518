"""Quality scores by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms are hashed words, word shapes (runs of letters, capitals, digits and each sign, as in ``Aa``, ``A!`` or ``a$``),
pairs of shapes, and marks for repeated words and for the length. The space is the leading eigenvectors of the
labelled sample's term matrix. Its vectors and labels are broadcast; every document takes exact cosines to all of
them, block by block, and the labels of its nearest ones are weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillbook.llm.common import hashed_words, mix, text_blocks, unused

# At most so many labelled rows are fitted, those with the smallest hash of their id; this bounds all that is broadcast.
SAMPLE = 4096
TERMS = 2048
RANK = 64
NEIGHBOURS = 32
# Similarities are raised to this power before they weigh a label.
SHARPNESS = 16
THRESHOLD = 0.3
# Documents whose cosines are held at once in a task.
BLOCK_ROWS = 256

_WORDS, _SHAPES, _PAIRS = 900, 500, 600
_MARKS = TERMS - _WORDS - _SHAPES - _PAIRS

# Bytes by kind of sign: small letter (also any byte beyond ASCII), capital, digit; other signs stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = ord("a")
_KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")


@dataclass
class Space:
    """What is broadcast: term weights, projection, labelled vectors, their labels, the share of label 1."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def term_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense rows (documents x TERMS) of square roots of term shares for one block of bytes."""
    n = len(offsets) - 1
    words, starts, ends = hashed_words(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(row, minlength=n)
    # One byte per run of a kind; a word keeps at least one byte, so words stay aligned.
    kinds = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    shape_offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    shapes, _, _ = hashed_words(kinds[keep], shape_offsets, fold=False)

    def place(hashes: np.ndarray, buckets: int, base: int) -> np.ndarray:
        return (hashes % np.uint64(buckets)).astype(np.int64) + base

    rows, terms = [row, row], [place(words, _WORDS, 0), place(shapes, _SHAPES, _WORDS)]
    if len(words) > 1:
        same_row = row[1:] == row[:-1]
        rows.append(row[1:][same_row])
        terms.append(place(mix(shapes[1:] * np.uint64(3) + shapes[:-1])[same_row], _PAIRS, _WORDS + _SHAPES))
        again = same_row & (words[1:] == words[:-1])
        rows.append(row[1:][again])
        terms.append(np.full(int(again.sum()), TERMS - _MARKS))
        order = np.lexsort((words, row))
        repeat = np.zeros(len(words), bool)
        repeat[1:] = (words[order][1:] == words[order][:-1]) & (row[order][1:] == row[order][:-1])
        rows.append(row[order][repeat])
        terms.append(np.full(int(repeat.sum()), TERMS - _MARKS + 1))
    flat = np.bincount(np.concatenate(rows) * TERMS + np.concatenate(terms), minlength=n * TERMS)
    dense = flat.reshape(n, TERMS).astype(np.float32)
    dense /= np.maximum(count, 1)[:, None]
    filled = count > 0
    length = TERMS - _MARKS + 2 + np.minimum(np.log2(np.maximum(count, 1)).astype(int), _MARKS - 3)
    dense[np.flatnonzero(filled), length[filled]] = 0.05
    return np.sqrt(dense)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, text: str, label: str) -> Space:
    """The space of at most SAMPLE labelled rows. One task fits it, so only what is broadcast reaches the driver."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(0), 1 << 18):
                dense = term_rows(data, offsets)
                r, c = np.nonzero(dense)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=end - at))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(at, end - at),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(c.astype(np.int16))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(dense[r, c])),
                    ],
                    names=["label", "term", "value"],
                )

    def space(rows: pa.Table) -> pa.Table:
        found = space_of(rows)
        flat = {k: [getattr(found, k).ravel()] for k in ("weights", "projection", "vectors", "labels")}
        return pa.table({k: pa.array(v, pa.list_(pa.float32())) for k, v in flat.items()} | {"prior": [found.prior]})

    fitted = (
        labelled.select(F.col(text), F.col(label).cast("int"))
        .mapInArrow(terms, "label int, term array<short>, value array<float>")
        .groupBy()
        .applyInArrow(space, "weights array<float>, projection array<float>, vectors array<float>, labels array<float>, prior double")
        .toArrow()
    )
    if not fitted.num_rows:
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    weights, projection, vectors, labels = (fitted.column(k).combine_chunks().flatten().to_numpy() for k in range(4))
    return Space(
        weights, projection.reshape(TERMS, -1), vectors.reshape(len(labels), -1), labels, fitted.column("prior")[0].as_py()
    )


def space_of(rows: pa.Table) -> Space:
    """The space of (label, term, value) rows; dense terms are weighted and scaled in place, so that few copies are held."""
    n = rows.num_rows
    term, value = (rows.column(k).combine_chunks() for k in ("term", "value"))
    row = np.repeat(np.arange(n), np.diff(term.offsets.to_numpy()))
    dense = np.zeros((n, TERMS), np.float32)
    dense[row, term.flatten().to_numpy()] = value.flatten().to_numpy()
    labels = rows.column("label").to_numpy().astype(np.float32)
    # Rows in an order of their own, so that sums do not depend on how tasks ended.
    order = np.lexsort((labels, *dense[:, ::7].T))
    dense, labels = dense[order], labels[order]
    weights = (np.log((1 + n) / (1 + (dense > 0).sum(axis=0))) + 1).astype(np.float32)
    dense *= weights
    for at in range(0, n, BLOCK_ROWS):
        dense[at : at + BLOCK_ROWS] = unit(dense[at : at + BLOCK_ROWS])
    values, vectors = np.linalg.eigh((dense.T @ dense).astype(np.float64))
    projection = vectors[:, ::-1][:, : min(RANK, n)].astype(np.float32)
    return Space(weights, projection, unit(dense @ projection), labels, float(labels.mean()))


def votes(space: Space, dense: np.ndarray) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors; rows without terms get the share overall."""
    scores = np.full(len(dense), space.prior)
    filled = np.flatnonzero(dense.any(axis=1))
    if not len(space.labels):
        return scores
    k = min(NEIGHBOURS, len(space.labels))
    for at in range(0, len(filled), BLOCK_ROWS):
        rows = filled[at : at + BLOCK_ROWS]
        cosines = unit(unit(dense[rows] * space.weights) @ space.projection) @ space.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0.0).astype(np.float64) ** SHARPNESS + 1e-9
        scores[rows] = (weight * space.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(scores, 0.0, 1.0)


def score(
    docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "label", out: str = "score"
) -> DataFrame:
    """``docs`` with a score in 0..1 added (higher: label 1 likelier), replacing a column of that name.

    ``labelled`` has texts and 0/1 labels and is cut to SAMPLE rows by the caller. Without labelled rows every score
    is 0.5. Null, empty and blank texts get the share of label 1 among the labelled. Equal texts get equal scores.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(labelled, text, label))
    kept = [c for c in docs.columns if c != out]
    body = docs.select(*kept)
    at_text = kept.index(text)
    schema = T.StructType([*body.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in text_blocks(batch.column(at_text), 1 << 19):
                scores += list(_by_rows(shared.value, data, offsets))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores))], names=[*kept, out]
            )

    return body.mapInArrow(run, schema)


def _by_rows(space: Space, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of a block, so many rows at a time that their dense terms stay small however short texts are."""
    for a in range(0, len(offsets) - 1, BLOCK_ROWS):
        own = offsets[a : a + BLOCK_ROWS + 1]
        yield votes(space, term_rows(data[own[0] : own[-1]], own - own[0]))


def training_rows(docs: DataFrame, labels: DataFrame, keep=None, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled (text, label) rows: one text per labelled id, ids by hash; null labels are left out.

    ``keep`` narrows the labelled ids, for instance to those not held out.
    """
    picked = labels.filter(F.col(label).isNotNull())
    if keep is not None:
        picked = picked.filter(keep)
    picked = (
        picked.groupBy("doc_id").agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # ``sample`` rows of an id and a label: the bound that makes this broadcast safe.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id is read as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score, held_out and predicted (score >= THRESHOLD), learnt from the labels that are not held out."""
    scored = score(docs, training_rows(docs, labels, ~held_out()))
    return scored.withColumns(
        {"held_out": held_out(), "predicted": (F.col("score") >= F.lit(THRESHOLD)).cast("int")}
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is 1, with their own columns only."""
    score_column = unused(docs, "quality_score")["quality_score"]
    scored = score(docs, training_rows(docs, labels, ~held_out()), out=score_column)
    return scored.filter(F.col(score_column) >= F.lit(THRESHOLD)).drop(score_column)
