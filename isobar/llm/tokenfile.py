"""Token-ID output: a file of patched frame-of-reference blocks.

A token file is a folder with two Parquet tables, which Spark's committers write whole or not at all, in any store:

* ``segments``: runs of some hundred thousand ids of whole documents. ``blocks`` holds the packed ids, ``offsets`` is the index of
  the block starts in it (unsigned 32-bit, little-endian), ``doc_ids`` and ``doc_tokens`` tell the documents apart.
* ``starts``: the number of the first id of each segment in the whole file.

A block holds ``BLOCK`` ids (the last block of a segment is filled up with its last id). Its bytes: the least id (4), the width w (1),
the number e of exceptions (1), the ids less the least one in w bits each, bit 0 first (``BLOCK * w / 8``), the exceptions' places (e),
and what of them is beyond w bits (4 e). The width holds ``PERCENTILE`` of a hundred ids of the block; the others are exceptions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.bpe import WordCodes, _splitter, library_ids
from isobar.llm.shared import small_or_not
from isobar.llm.textarrays import chunks

BLOCK = 128
PERCENTILE = 90
HEAD = 6
#: Octets of text that make one segment, about.
SEGMENT_CHARS = 1 << 20
#: Distinct words that a worker remembers; of each it holds the ids only.
REMEMBERED = 300_000
#: Bytes of Parquet row groups, so that a reader holds few segments at a time.
ROW_GROUP = 8 << 20

SEGMENTS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    T.StructField("offsets", T.BinaryType()), T.StructField("blocks", T.BinaryType()),
])


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """The blocks of some ids, and the index of their starts."""
    if not len(ids):
        return b"", b""
    n_blocks = -(-len(ids) // BLOCK)
    x = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    x[: len(ids)] = ids
    x = x.reshape(n_blocks, BLOCK)
    base = x.min(axis=1)
    d = x - base[:, None]
    edge = np.partition(d, (nth := -(-PERCENTILE * BLOCK // 100) - 1), axis=1)[:, nth]
    width = np.ceil(np.log2(edge.astype(np.float64) + 1)).astype(np.int64)
    beyond = (d.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    odd = beyond != 0
    n_odd = odd.sum(axis=1)
    size = HEAD + BLOCK // 8 * width + 5 * n_odd
    offset = np.zeros(n_blocks, np.int64)
    np.cumsum(size[:-1], out=offset[1:])
    out = np.zeros(int(size.sum()), np.uint8)
    out[offset[:, None] + np.arange(4)] = base.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[offset + 4], out[offset + 5] = width, n_odd
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        bits = np.unpackbits(d[of].astype("<u4").view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        out[offset[of][:, None] + HEAD + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
    block, place = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(n_odd)])[block]
        at = offset[block] + HEAD + BLOCK // 8 * width[block]
        out[at + nth] = place
        out[(at + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = beyond[odd].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), offset.astype("<u4").tobytes()


def unpack(blocks: bytes, offsets: bytes, n: int) -> np.ndarray:
    """The first n ids of the blocks."""
    if not n:
        return np.zeros(0, np.uint32)
    raw, offset = np.frombuffer(blocks, np.uint8), np.frombuffer(offsets, "<u4").astype(np.int64)
    base = raw[offset[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint32)
    width, n_odd = raw[offset + 4].astype(np.int64), raw[offset + 5].astype(np.int64)
    d = np.zeros((len(offset), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(raw[offset[of][:, None] + HEAD + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        d[of] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(of), BLOCK)
    block = np.repeat(np.arange(len(offset)), n_odd)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(n_odd)])[block]
        at = offset[block] + HEAD + BLOCK // 8 * width[block]
        rest = raw[(at + n_odd[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        d[block, raw[at + nth]] |= (rest.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (d + base[:, None]).ravel()[:n]


def write_token_file(documents: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, to a token file in ascending ``doc_id`` order.

    Texts are encoded by the ``tokenizers`` library without special tokens, once per distinct word of a worker. A null text counts as
    empty (its document is ``end_id`` alone); null ids come first; rows that share an id are ordered by a digest of their text, and
    repeated rows are written as often as they occur. An empty table makes an empty file. Other columns are not read.
    One shuffle by ranges of (id, digest), so no range is hot unless whole rows repeat.
    """
    spark = documents.sparkSession
    rows = documents.select(documents[doc_id].cast("long").alias("doc_id"), F.coalesce(documents[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = _splitter(tokenizer)
        tokenize = split.tok.model.tokenize
        codes = WordCodes(split, lambda words: [[t.id for t in tokenize(w[:-1])] for w in words], remembered=REMEMBERED)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece, texts in chunks(batch, most=SEGMENT_CHARS):
                low, start, end, safe = split(texts)
                codes.forget()
                flat, begin = codes.ids(codes.rows(low, start, end))
                bounds = begin[np.searchsorted(start, texts.at)]
                n_tokens = np.diff(bounds) + 1
                if safe.all():
                    ids = np.full(len(flat) + len(texts), end_id, np.uint32)
                    own = np.ones(len(ids), bool)
                    own[np.cumsum(n_tokens) - 1] = False
                    ids[own] = flat
                else:
                    each = [flat[a:b] if ok else np.array(library_ids(split, t or ""), np.uint32) for a, b, ok, t in zip(bounds[:-1], bounds[1:], safe, piece.column(1).to_pylist(), strict=True)]
                    n_tokens = np.array([len(x) + 1 for x in each], np.int64)
                    last = np.array([end_id], np.uint32)
                    ids = np.concatenate([y for x in each for y in (x, last)])
                blocks, offsets = pack(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([n_tokens], pa.list_(pa.int64())), pa.array([offsets], pa.binary()), pa.array([blocks], pa.binary())],
                    names=SEGMENTS.fieldNames(),
                )
                seq += 1

    ordered.mapInArrow(run, SEGMENTS).write.option("parquet.block.size", ROW_GROUP).option("compression", "none").parquet(f"{path}/segments")
    sizes = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").select("part", "seq", "n")
    # The running sum is of one row per part; within a part it is per segment.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    sizes.select("part", "seq", inside.alias("inside")).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start")).write.parquet(f"{path}/starts")


def read_token_file(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The documents of a token file: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers), and with ``ids`` the ids themselves in an array."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    starts = spark.read.schema("part long, seq long, start long").parquet(f"{path}/starts")
    joined = segments.join(small_or_not(starts), ["part", "seq"]).drop("part", "seq")
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                flat = unpack(row["blocks"].as_py(), row["offsets"].as_py(), row["n"].as_py()).astype("<u4", copy=False)
                tokens = row["doc_tokens"].values.to_numpy()
                stop = np.cumsum(tokens)
                first = stop - tokens
                view = memoryview(flat.tobytes())
                crc = np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.int64)
                columns = [row["doc_ids"].values, pa.array(first + row["start"].as_py()), pa.array(tokens), pa.array(crc)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(run, schema)
