"""Language identification: string kernels.

The kernel of two texts is the blended spectrum of n-gram presence: how many n-grams, n from 1 to ``ORDER``, occur in both, over the root of the product of how many
occur in each. N-grams are told apart by their characters, so the kernel is exact; those that no landmark has add to the roots alone. A bounded sample of texts with a language serves as Nyström landmarks and to fit a ridge regression of each language against the rest.
Texts are scored in batches: presence matrix times landmarks, times one matrix of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.shared import keep_hash, small_or_not, written
from isobar.llm.textarrays import Texts, chunks, mix

ORDER = 3
#: Bits of a character in the code of an n-gram; 0 is no character, 1 a blank.
BITS = 21
#: The most texts of one language that are learned from, and landmarks in all.
TEXTS_PER_LANGUAGE = 400
LANDMARKS = 160
RIDGE = 1e-2
#: How steeply a lead over other languages raises the score.
STEEPNESS = 6.0
#: Texts whose presence matrix is held at a time.
BLOCK = 128
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point its lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def presence(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of each text's distinct n-grams, the text of each, in ascending order of texts, and which texts have any letter. What is between words counts as one blank."""
    letters = letter_table()[texts.cp]
    blank = letters == 0
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    symbols, at = letters[keep].astype(np.uint64), place[texts.at]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    codes, of = [], []
    code = np.zeros(len(symbols), np.uint64)
    for n in range(1, ORDER + 1):
        if len(symbols) < n:
            break
        code = (code[: len(symbols) - n + 1] << np.uint64(BITS)) | (symbols[n - 1 :] + np.uint64(1))
        same = doc[: len(code)] == doc[n - 1 :]
        codes.append(code[same])
        of.append(doc[: len(code)][same])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), bool)
    codes, of = np.concatenate(codes), np.concatenate(of)
    name = pa.array(mix(codes) ^ mix(of.astype(np.uint64) + np.uint64(1))).dictionary_encode()
    first = np.zeros(len(name.dictionary), np.int64)
    first[name.indices.to_numpy()[::-1]] = np.arange(len(codes) - 1, -1, -1)
    codes, of = codes[first], of[first]
    order = np.argsort(of, kind="stable")
    return codes[order], of[order], np.bincount(doc[symbols != 0], minlength=len(texts)) > 0


class Model:
    """Landmarks as columns, and weights that take kernels with them to languages."""

    def __init__(self, grams: list[np.ndarray], y: list[str]):
        """``grams``: the codes of the n-grams of each text to learn from."""
        self.languages = sorted(set(y))
        if not y:
            return
        pick = self._landmarks(np.array(y))
        self.grams = np.unique(np.concatenate([grams[i] for i in pick.tolist()]))
        self.landmarks = np.zeros((len(self.grams), len(pick)), np.float32)
        for k, i in enumerate(pick.tolist()):
            self.landmarks[np.searchsorted(self.grams, grams[i]), k] = 1 / np.sqrt(max(len(grams[i]), 1))
        sizes = np.array([len(g) for g in grams])
        kernel = self.kernel(np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes), len(grams)).astype(np.float64)
        inner = kernel[pick]
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = np.hstack([kernel @ root, np.ones((len(grams), 1))])
        # Every language weighs alike, however many of its texts are at hand.
        target = np.where(np.array(y)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        w = np.zeros((z.shape[1], len(self.languages)))
        for k in range(len(self.languages)):
            own = target[:, k] > 0
            weight = np.where(own, 0.5 / own.sum(), 0.5 / max((~own).sum(), 1))
            a = (z * weight[:, None]).T @ z + RIDGE / len(grams) * np.eye(z.shape[1])
            w[:, k] = np.linalg.solve(a, (z * weight[:, None]).T @ target[:, k])
        self.weights = (root @ w[:-1]).astype(np.float32)
        self.bias = w[-1].astype(np.float32)

    def _landmarks(self, y: np.ndarray) -> np.ndarray:
        """The first few texts of each language, as many of each as fit."""
        each = max(1, LANDMARKS // len(self.languages))
        return np.concatenate([np.flatnonzero(y == k)[:each] for k in self.languages])

    def kernel(self, codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The kernels of n texts with the landmarks, from the codes of their distinct n-grams and the text of each, ascending."""
        column = np.minimum(np.searchsorted(self.grams, codes), max(len(self.grams) - 1, 0))
        met = self.grams[column] == codes if len(self.grams) else np.zeros(len(codes), bool)
        out = np.zeros((n, self.landmarks.shape[1]), np.float32)
        bounds = np.searchsorted(of, np.arange(0, n + BLOCK, BLOCK))
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            block = np.zeros((min(BLOCK, n - k * BLOCK), len(self.grams)), np.float32)
            own = met[lo:hi]
            block[of[lo:hi][own] - k * BLOCK, column[lo:hi][own]] = 1
            out[k * BLOCK : k * BLOCK + len(block)] = block @ self.landmarks
        return out / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))[:, None].astype(np.float32)

    def predict(self, codes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The language of each of n texts, by number (of equal outputs the first language), and its share in a softmax of all languages' outputs."""
        out = (self.kernel(codes, of, n) @ self.weights + self.bias).astype(np.float64)
        e = np.exp(STEEPNESS * (out - out.max(axis=1, keepdims=True)))
        return out.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)


def fit(documents: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TEXTS_PER_LANGUAGE) -> Model:
    """A model of the documents that fulfil ``learn`` and have a language.

    Of each language at most ``most`` texts are used, those with the least hash of their id, so the sample is bounded and the same in every run. Rows with a null text or id are passed over.
    """
    rows = documents.where(learn).select(documents[doc_id].cast("string").alias("id"), documents[lang].alias("lang"), documents[text].cast("string").alias("text")).where("id is not null and lang is not null and text is not null").withColumn("h", keep_hash(F.col("id"), "language"))
    limits = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("limit", (F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("n") + 50 / F.col("n")) * (1 << 31)).cast("long"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("grams", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                codes, of, _ = presence(texts)
                cut = np.searchsorted(of, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([np.sort(codes[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=schema.fieldNames())

    thinned = rows.join(small_or_not(written(limits)), "lang").where("h <= limit").select("lang", "h", "text").mapInArrow(run, schema)
    # Of many texts with one hash (repeated ids) the presence decides, so the order is fixed.
    from pyspark.sql import Window

    first = thinned.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "grams"))).where(F.col("k") <= most).drop("k")
    found = first.orderBy("lang", "h", "grams").toArrow()
    return Model([np.frombuffer(g, np.uint64) for g in found.column("grams").to_pylist()], found.column("lang").to_pylist())


def predict_language(documents: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, a learned language, and ``score`` from 0 to 1.

    Of languages with equal outputs the first by name is predicted. A null text, or one without a letter, is ``und`` with score 0; so is every text where no language was learned. Predictions depend on the text alone;
    repeated rows give repeated results, an empty table an empty one, other columns are not read. Long texts are used whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(*[documents[c].alias(f"k{i}") for i, c in enumerate(keep)], documents[text].cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part, texts in chunks(batch):
                codes, of, lettered = presence(texts)
                which, score = m.predict(codes, of, len(texts)) if m.languages else (np.zeros(len(texts), int), np.zeros(len(texts)))
                lettered &= len(m.languages) > 0
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[np.where(lettered, which, len(names) - 1)].tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0))], names=schema.fieldNames())

    return source.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")
