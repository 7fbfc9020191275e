"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are of two kinds: words (hashed to WORD_TERMS buckets) and pairs of
adjacent byte classes, which tell how a text is written: case, symbols,
digits, punctuation, spacing; a share of repeated words is added as terms of
its own.  Log term frequencies by inverse document frequency are projected on
the leading singular vectors of a bounded labelled sample.  That sample's
vectors and labels, at most MAX_LABELLED rows, are sent to all workers; each
document's cosines with all of them are computed exactly, in blocks, and the
NEIGHBOURS nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NON_SPACE, Words, chain, slices, utf8
from .staging import small_batches

#: Labelled rows that the space and the votes come from, at most.
MAX_LABELLED = 4000
DIMENSIONS, NEIGHBOURS = 48, 15
WORD_TERMS = 512
#: Power of the similarity with which a neighbour votes.
SHARPNESS = 4
#: Rows whose terms and cosines are held at once.
BLOCK_ROWS = 1024
#: Steps of repetition told apart.
REPEAT_TERMS = 8

_SYMBOLS = "#*$%&|<>!?.,;:'\"()-_/\\@+="
_CLASSES = 6 + len(_SYMBOLS)


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for v in range(256):
        c = chr(v)
        table[v] = (
            6 + _SYMBOLS.index(c) if c in _SYMBOLS else 1 if "a" <= c <= "z" or v >= 0x80 else 2 if "A" <= c <= "Z" else 3 if c.isdigit() else 4 if c == "\n" else 5 if c in " \t\r" else 0
        )
    return table


BYTE_CLASS = _byte_classes()
PAIR_TERMS = _CLASSES * _CLASSES
TERMS = PAIR_TERMS + WORD_TERMS + REPEAT_TERMS


def term_counts(column: pa.Array) -> np.ndarray:
    """Rows of log(1 + count) of each text's terms, scaled by the text's length to rates of a thousand."""
    data, at = utf8(column)
    rows = len(at) - 1
    words = Words(data, at, NON_SPACE, lower=True)
    doc, hashes = words.doc, words.hash()
    kind = BYTE_CLASS[data]
    owner = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros((rows, TERMS), np.float32)
    if len(kind) > 1:
        inside = owner[1:] == owner[:-1]
        key = owner[1:] * PAIR_TERMS + kind[:-1] * _CLASSES + kind[1:]
        out[:, :PAIR_TERMS] = np.bincount(key[inside], minlength=rows * PAIR_TERMS).reshape(rows, PAIR_TERMS)
    out[:, :PAIR_TERMS] *= 1000.0 / np.maximum(np.diff(at), 1)[:, None]
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORD_TERMS
    counts = np.bincount(doc * WORD_TERMS + bucket, minlength=rows * WORD_TERMS).reshape(rows, WORD_TERMS)
    scale = 1000.0 / np.maximum(words.count, 1)[:, None]
    out[:, PAIR_TERMS : PAIR_TERMS + WORD_TERMS] = counts * scale
    triples = chain(hashes, 3)
    same = doc[2:] == doc[: len(triples)] if len(triples) else np.zeros(0, bool)
    _, first = np.unique(triples[same] + doc[2:][same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True) if same.any() else (None, np.zeros(0, np.int64))
    windows = np.bincount(doc[2:][same], minlength=rows) if same.any() else np.zeros(rows, np.int64)
    fresh = np.bincount(doc[2:][same][first], minlength=rows) if same.any() else np.zeros(rows, np.int64)
    repeated = np.where(windows > 0, 1 - fresh / np.maximum(windows, 1), 0)
    step = np.minimum((repeated * REPEAT_TERMS * 2).astype(int), REPEAT_TERMS - 1)
    out[np.flatnonzero(step), PAIR_TERMS + WORD_TERMS + step[step > 0]] = 300.0
    return np.log1p(out)


class Space:
    """Latent-semantic vectors of a labelled sample, and the votes of the nearest."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if not len(labels):
            return
        seen = (terms > 0).sum(axis=0)
        self.idf = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
        weighed = terms * self.idf
        # the leading singular vectors, from the terms' own products: TERMS x TERMS whatever the sample
        values, vectors = np.linalg.eigh(weighed.T.astype(np.float64) @ weighed)
        self.axes = vectors[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32)
        self.vectors = self._project(terms)

    def _project(self, terms: np.ndarray) -> np.ndarray:
        v = (terms * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the prior where a text has no terms."""
        if not len(self.labels):
            return np.full(len(terms), self.prior)
        out = np.full(len(terms), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(terms), BLOCK_ROWS):
            block = terms[low : low + BLOCK_ROWS]
            cosines = self._project(block) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0).astype(np.float64) ** SHARPNESS
            votes, total = (weight * self.labels[near]).sum(axis=1), weight.sum(axis=1)
            known = (block.sum(axis=1) > 0) & (total > 0)
            out[low : low + BLOCK_ROWS][known] = ((votes + 0.1 * self.prior) / (total + 0.1))[known]
        return out


def fold_of(id, folds: int):
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit_space(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, folds: int, held_out: int, limit: int) -> Space:
    """Fit on at most ``limit`` labelled rows outside the held-out fold, picked by the hash of their id."""
    named = labels.select(F.col(id).alias("l_id"), F.col(label).cast("int").alias("label")).where(F.col("l_id").isNotNull() & F.col("label").isin(0, 1))
    picked = named.where(fold_of(F.col("l_id"), folds) != held_out).groupBy("l_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(limit)
    texts = docs.select(F.col(id).alias("d_id"), F.col(text).cast("string").alias("text"))
    # ``limit`` bounds the broadcast side
    sample = texts.join(F.broadcast(picked), F.col("d_id") == F.col("l_id")).select("l_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2), rows=BLOCK_ROWS):
                part = batch.slice(low, high - low)
                packed = [row.tobytes() for row in term_counts(part.column(2)).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), pa.array(packed, pa.binary())], names=["l_id", "label", "terms"])

    rows = sample.mapInArrow(run, "l_id string, label int, terms binary").orderBy("l_id", "terms").limit(limit).collect()
    terms = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(-1, TERMS)
    return Space(terms, np.array([r["label"] for r in rows], np.int64))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0,
    threshold: float = 0.3, limit: int = MAX_LABELLED,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted for every text.

    Only the text enters a score.  Cases: a null or empty text scores the
    sample's share of label 1; without labels all score 0.5; null labels are
    not learned from; a null id folds as the empty text; repeated rows score
    alike; a very long text is counted whole, as a slice of its own, and one
    task's memory grows with it; an empty table gives no rows; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    space = fit_space(docs, labels, id=id, text=text, label=label, folds=folds, held_out=held_out, limit=limit)
    rows = docs.select(F.col(id).alias("doc_id"), (fold_of(F.col(id), folds) == held_out).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2), rows=BLOCK_ROWS):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(space.score(term_counts(part.column(2))))], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
