"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's terms are its character trigrams, letters as they are and digits alike, marks for words that repeat
one of the few before, hashed to ``TERMS`` numbers.
Weighted counts of a bounded sample of labelled texts are decomposed, and every text is mapped to the ``RANK`` leading directions. The labelled
vectors are broadcast: at most ``LABELLED`` a class, a few megabytes. Every document's cosines with all of them are computed in exact blocks, and the
nearest ``NEIGHBOURS`` vote with the weight of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.shared import keep_hash
from isobar.llm.textarrays import Texts, chunks, range_hashes, runs

TERMS = 4096
#: The last terms are marks of repetition.
MARKS = 4
RANK = 64
#: The most labelled texts of one class that the classifier is fitted on.
LABELLED = 1500
NEIGHBOURS = 25
#: Power of the similarity that weighs a vote.
SHARPNESS = 6
#: A text of so many characters draws its score half from its neighbours and half from the share of label 1 among all.
EVIDENCE = 60
#: Documents whose counts are held at a time.
BLOCK = 256


def term_counts(texts: Texts, lo: int, hi: int, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of terms of the texts lo to hi, as a dense block."""
    a, b = texts.at[lo], texts.at[hi]
    cp = texts.cp[a:b].copy()
    cp[(cp >= 0x30) & (cp <= 0x39)] = 0x30
    n = hi - lo
    out = np.zeros((n, TERMS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(texts.at[lo : hi + 1]))
    if len(cp) > 2:
        code = (cp[:-2] * np.uint32(0x85EBCA6B)) ^ (cp[1:-1] * np.uint32(0xC2B2AE35)) ^ (cp[2:] * np.uint32(0x27D4EB2F))
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        bin_ = (code >> np.uint32(12)) % np.uint32(TERMS - MARKS)
        same = doc[:-2] == doc[2:]
        out = np.bincount(doc[:-2][same] * TERMS + bin_[same], minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    start, h = words
    first, last = np.searchsorted(start, a), np.searchsorted(start, b)
    h, of = h[first:last], texts.doc_of(start[first:last]) - lo
    for k in range(1, MARKS + 1):
        alike = (h[k:] == h[:-k]) & (of[k:] == of[:-k])
        out[:, TERMS - k] = np.bincount(of[k:][alike], minlength=n) * 8
    return out


def blocks(texts: Texts) -> Iterator[tuple[int, int, np.ndarray]]:
    space = (texts.cp == 0x20) | ((texts.cp >= 9) & (texts.cp <= 13))
    start, end = runs(~space, texts.at)
    words = start, range_hashes(texts.cp, start, end)
    for lo in range(0, len(texts), BLOCK):
        hi = min(lo + BLOCK, len(texts))
        yield lo, hi, weigh(term_counts(texts, lo, hi, words))


def weigh(counts: np.ndarray) -> np.ndarray:
    """Square roots of term frequencies: lengths of texts cancel out, and frequent terms weigh less."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_directions(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = max(1, min(rank, *x.shape))
    width = min(rank + 16, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((len(x), width), np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


class Model:
    """Term weights, directions, and the labelled vectors with their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, stands_for: np.ndarray | None = None):
        """``stands_for``: how many labelled texts each of the sample stands for, so that classes keep their shares."""
        self.y = y.astype(np.float32)
        self.stands_for = np.ones(len(y)) if stands_for is None else stands_for
        self.prior = float(np.average(self.y, weights=self.stands_for)) if len(y) else 0.5
        if len(y):
            # Terms are scaled by how they vary between texts, less so where they are rare.
            self.scale = (1 / (x.std(axis=0) + 0.25 * x.std(axis=0).mean() + 1e-6)).astype(np.float32)
            self.mean = x.mean(axis=0)
            z = (x - self.mean) * self.scale
            self.directions = leading_directions(z, RANK)
            self.vectors = unit(z @ self.directions)

    def scores(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), self.prior)
        near = unit(((x - self.mean) * self.scale) @ self.directions) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-3).astype(np.float64) ** SHARPNESS * self.stands_for[at]
        vote = (weight * self.y[at]).sum(axis=1) / weight.sum(axis=1)
        return (length * vote + EVIDENCE * self.prior) / (length + EVIDENCE)


def _features(rows: DataFrame) -> DataFrame:
    """(label, cells, values): the terms of each labelled text that occur."""
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("cells", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                for lo, hi, x in blocks(texts):
                    cells = [np.flatnonzero(r) for r in x]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary()), pa.array([r[c].astype("<f4").tobytes() for r, c in zip(x, cells, strict=True)], pa.binary())], names=schema.fieldNames())

    return rows.select("label", "text").mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED) -> Model:
    """A model of the labelled documents. ``learn`` is a condition on the column ``doc_id`` of labels to learn from.

    Of each class at most ``most`` labels are used, those with the least hash of their id, so the sample is the same in every run and broadcast safely.
    Labels that are null, or whose document is absent, are passed over; of several labels of one document the mean counts, of several texts the least.
    """
    y = labels.where(learn).select(labels[doc_id].alias("id"), labels[label].cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("label"))
    y = y.withColumn("class", F.col("label") >= 0.5).withColumn("h", keep_hash(F.col("id").cast("string"), "quality"))
    counts = {r["class"]: r["n"] for r in y.groupBy("class").agg(F.count("*").alias("n")).collect()}
    sample = None
    for kind, n in sorted(counts.items()):
        # Thinned by hash first, so that only few rows are sorted.
        own = y.where((F.col("class") == kind) & (F.col("h") <= int(min(1.0, 2.0 * most / n + 50 / n) * (1 << 31)))).orderBy("h", "id").limit(most)
        sample = own if sample is None else sample.unionByName(own)
    if sample is None:
        return Model(np.zeros((0, TERMS), np.float32), np.zeros(0))
    docs = documents.select(documents[doc_id].alias("id"), documents[text].cast("string").alias("text"))
    rows = docs.join(F.broadcast(sample.select("id", "label")), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = _features(rows).toArrow()
    cells, values, y_ = found.column("cells").to_pylist(), found.column("values").to_pylist(), found.column("label").to_numpy()
    x = np.zeros((len(cells), TERMS), np.float32)
    for i, (c, v) in enumerate(zip(cells, values, strict=True)):
        x[i, np.frombuffer(c, "<u2")] = np.frombuffer(v, "<f4")
    # The rows arrive in any order; sorted, they make the same model in every run.
    order = np.lexsort((x @ np.linspace(1, 2, TERMS, dtype=np.float32), y_))
    share = {k: max(1.0, n / most) for k, n in counts.items()}
    return Model(x[order], y_[order], np.array([share[v >= 0.5] for v in y_[order].tolist()]))


def score_quality(documents: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the score in column ``out`` (0 to 1, higher: label 1 likelier), which replaces one of that name.

    Scores depend on the text alone. Null and empty texts get the share of label 1 among all labels, 0.5 where nothing is labelled;
    short texts get a score near it.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c != out]
    source = documents.select(*[documents[c].alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in chunks(batch, f"c{at}"):
                score = np.concatenate([m.scores(x, np.diff(texts.at[lo : hi + 1])) for lo, hi, x in blocks(texts)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(score, 0, 1))], names=schema.fieldNames())

    return source.mapInArrow(run, schema).toDF(*names, out)
