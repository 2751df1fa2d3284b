"""GRIB edition 2 in Spark: files to rows of fields, packed fields to arrays of values, rows back to messages.

Files are read by Spark's own ``binaryFile`` source, in any store and as a stream too, and parsed in Arrow batches. Values stay packed until they are asked for, so a query of metadata never decodes.
``register`` adds the format ``wmo-grib`` for ``spark.read`` and ``df.write`` on top of the same code.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from isobar.codecs import packings
from isobar.sources import layout, messages

NUMBERS = T.MapType(T.StringType(), T.DoubleType())
FIELDS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("msg_no", T.IntegerType()), T.StructField("field_no", T.IntegerType()), T.StructField("byte_offset", T.LongType()), T.StructField("total_length", T.LongType()),
    T.StructField("discipline", T.IntegerType()), T.StructField("identification", NUMBERS), T.StructField("grid_template", T.IntegerType()), T.StructField("n_points", T.LongType()), T.StructField("grid", NUMBERS),
    T.StructField("product_template", T.IntegerType()), T.StructField("product", NUMBERS), T.StructField("packing_template", T.IntegerType()), T.StructField("n_values", T.LongType()), T.StructField("packing", NUMBERS),
    T.StructField("bitmap_indicator", T.IntegerType()), T.StructField("shares_grid", T.BooleanType()), T.StructField("own_local", T.BooleanType()), T.StructField("reserved", T.BinaryType()), T.StructField("section1", T.BinaryType()), T.StructField("message_local", T.BinaryType()),
    T.StructField("section2", T.BinaryType()), T.StructField("section3", T.BinaryType()), T.StructField("section4", T.BinaryType()), T.StructField("section5", T.BinaryType()), T.StructField("bitmap", T.BinaryType()), T.StructField("effective_bitmap", T.BinaryType()),
    T.StructField("section7", T.BinaryType()), T.StructField("error", T.StringType()),
])
#: Reader modes: bad messages as rows with an ``error``, left out, or ending the query.
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def _numbers(values: dict | None) -> dict | None:
    return None if values is None else {k: float(v) for k, v in values.items() if not isinstance(v, list)}


def field_rows(path: str, source: bytes | messages.Octets | messages.Ranges, mode: str = "PERMISSIVE", data: bool = True, wanted: Callable[[dict], bool] | None = None, first: bool = False) -> Iterator[dict]:
    """One row per field of all messages of some octets, or of the first message only; without ``data`` the packed values are left out, and of ranges not even read. ``wanted`` tells from a row without its data whether it is asked for."""
    source = messages.Octets(bytes(source)) if isinstance(source, bytes | bytearray) else source
    for number, (at, n, error) in enumerate(messages.find_messages(source)):
        base = {"path": path, "msg_no": number, "byte_offset": at, "total_length": n}
        rows: list[dict] = []
        if error is None:
            try:
                # A message that nobody asks for is not read whole.
                light = not data or wanted is not None
                rows = _rows_of(base, messages.parse(messages.without_data(source, at, n) if light else source.read(at, n)))
                if wanted is not None:
                    rows = [r for r in rows if wanted(r)]
                if data and light and rows:
                    whole = _rows_of(base, messages.parse(source.read(at, n)))
                    rows = [whole[r["field_no"]] for r in rows]
                elif not data:
                    rows = [{**r, "section7": None} for r in rows]
            except ValueError as e:
                error, rows = str(e), []
        if error is not None:
            if mode == "FAILFAST":
                raise messages.MessageError(f"{path}, octet {at}: {error}")
            rows = [{**base, "error": error}] if mode == "PERMISSIVE" else []
            rows = [r for r in rows if wanted is None or wanted(r)]
        yield from rows
        if first:
            return


def _rows_of(base: dict, m: messages.Message) -> list[dict]:
    identification, rows = _numbers(layout.read(layout.SECTION1, m.identification)), []
    for k, f in enumerate(m.fields):
        points, grid_no, grid, _ = messages.grid_of(f.grid)
        product_no, product, _ = messages.product_of(f.product)
        values, packing_no, packing = messages.packing_of(f.packing)
        rows.append({
            **base, "field_no": k, "discipline": m.discipline, "identification": identification, "grid_template": grid_no, "n_points": points, "grid": _numbers(grid), "product_template": product_no,
            "product": _numbers(product), "packing_template": packing_no, "n_values": values, "packing": _numbers(packing), "bitmap_indicator": f.bitmap_indicator, "shares_grid": f.shares_grid, "own_local": f.own_local,
            "reserved": m.reserved, "section1": m.identification, "message_local": m.local, "section2": f.local, "section3": f.grid, "section4": f.product, "section5": f.packing,
            "bitmap": f.bitmap, "effective_bitmap": f.effective, "section7": f.data, "error": None,
        })
    return rows


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], to_arrow_schema(schema))


def parse_files(files: DataFrame, mode: str = "PERMISSIVE", data: bool = True) -> DataFrame:
    """Rows of fields of (path, content), as ``binaryFile`` gives them, batch or stream."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, octets = [], 0
                for row in field_rows(path, content.as_py(), mode, data):
                    held.append(row)
                    octets += row["total_length"]
                    if octets > 32 << 20:
                        yield _batch(held, FIELDS)
                        held, octets = [], 0
                if held:
                    yield _batch(held, FIELDS)

    return files.select("path", "content").mapInArrow(run, FIELDS)


def read_fields(spark: SparkSession, path: str, mode: str = "PERMISSIVE", data: bool = True, pattern: str = "*") -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path), mode, data)


def stream_fields(spark: SparkSession, path: str, mode: str = "PERMISSIVE", pattern: str = "*") -> DataFrame:
    """The fields of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parse_files(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path), mode)


def number(group: str, name: str) -> Column:
    """A number of a section as a whole number."""
    return F.col(group)[name].cast("long")


def field_values(row: dict, substitute: bool = False) -> np.ndarray:
    """The values of a field's row, rows from north to south and columns from west to east; missing points are NaN, or with ``substitute`` what stands for them in complex packing."""
    n, packing_no, numbers = messages.packing_of(row["section5"])
    if numbers is None:
        raise packings.PackingError(f"data representation template {packing_no} is not supported")
    v = packings.unpack(packing_no, row["section7"], numbers, n, substitute)
    if len(v) != n:
        raise packings.PackingError("the values are not as many as declared")
    points, grid_no, grid, _ = messages.grid_of(row["section3"])
    indicator = row["bitmap_indicator"]
    if indicator != 255:
        bits = row["effective_bitmap"]
        if indicator not in (0, 254) or bits is None:
            raise packings.PackingError(f"bit-map indicator {indicator} cannot be resolved")
        if len(bits) * 8 < points:
            raise packings.PackingError("the bit map is too short")
        present = np.unpackbits(np.frombuffer(bits, np.uint8))[:points].astype(bool)
        if present.sum() != len(v):
            raise packings.PackingError("the bit map does not fit the values")
        full = np.full(points, np.nan)
        full[present] = v
        v = full
    if grid is None:
        return v
    ni, nj, mode = grid["ni"], grid["nj"], grid["scan"]
    if 0xFFFFFFFF in (ni, nj):
        if mode:
            raise packings.PackingError("scanning modes of reduced grids are not supported")
        return v
    if ni * nj != len(v):
        raise packings.PackingError("the grid's sides do not make up its points")
    return canonical(v, mode, ni, nj)


def canonical(v: np.ndarray, mode: int, ni: int, nj: int) -> np.ndarray:
    lines = v.reshape(ni, nj) if mode & 0x20 else v.reshape(nj, ni)
    lines = lines.copy()
    if mode & 0x10:
        lines[1::2] = lines[1::2, ::-1]
    grid = lines.T if mode & 0x20 else lines
    if mode & 0x80:
        grid = grid[:, ::-1]
    if mode & 0x40:
        grid = grid[::-1]
    return np.ascontiguousarray(grid).ravel()


#: What decoding needs of a field.
DECODED_FROM = ("section3", "section5", "section7", "bitmap_indicator", "effective_bitmap", "error")


def decode_fields(fields: DataFrame, keep: tuple[str, ...] = ("path", "msg_no", "field_no"), substitute: bool = False) -> DataFrame:
    """(keep, values, decode_error): the values of every field, null for missing points, or with ``substitute`` what stands for them in complex packing. Only the sections that decoding needs are read; what cannot be decoded has an error."""
    source = fields.select(*keep, *[F.col(c).alias(f"from_{c}") for c in DECODED_FROM])
    schema = T.StructType([*[source.schema[k] for k in keep], T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("decode_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(len(keep) + i)[k].as_py() for i, name in enumerate(DECODED_FROM)}
                values, error = None, row["error"]
                if error is None:
                    try:
                        values = field_values(row, substitute)
                    except ValueError as e:
                        error = str(e)
                array = pa.array([None], pa.list_(pa.float64())) if values is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=np.isnan(values)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(k, 1) for i in range(len(keep))], array, pa.array([error], pa.string())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def points_of(decoded: DataFrame) -> DataFrame:
    """One row per point: the other columns, ``idx`` and ``value``."""
    others = [c for c in decoded.columns if c not in ("values", "decode_error")]
    return decoded.select(*others, F.posexplode("values").alias("idx", "value"))


def message_of(rows: list[dict]) -> bytes:
    """The octets of a message from the rows of its fields."""
    rows = sorted(rows, key=lambda r: r["field_no"])
    head = rows[0]
    fields = [messages.FieldSections(r["section2"], r["section3"], r["section4"], r["section5"], r["bitmap_indicator"], r["bitmap"] or b"", r["section7"], bool(r["shares_grid"]), bool(r["own_local"])) for r in rows]
    return messages.build(messages.Message(head["discipline"], head["section1"], head["reserved"] or b"\xff\xff", head["message_local"], fields))


def to_messages(fields: DataFrame) -> DataFrame:
    """(path, msg_no, content): fields put together again. The fields of one message meet in one row; a message is bounded by its format."""
    own = ["field_no", "discipline", "reserved", "section1", "message_local", "section2", "section3", "section4", "section5", "bitmap_indicator", "bitmap", "shares_grid", "own_local", "section7"]
    grouped = fields.where("error is null").groupBy("path", "msg_no").agg(F.collect_list(F.struct(*own)).alias("fields"))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("msg_no", T.IntegerType()), T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = message_of(batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([content], pa.binary())], names=schema.fieldNames())

    return grouped.mapInArrow(run, schema)


# ---- the format "wmo-grib"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


#: Columns that the reader compares itself, before it reads any data.
PLAIN = ("path", "msg_no", "field_no", "byte_offset", "total_length", "discipline", "grid_template", "n_points", "product_template", "packing_template", "n_values", "bitmap_indicator")
COMPARED = {
    EqualTo: lambda x, f: x == f.value, In: lambda x, f: x in f.value, GreaterThan: lambda x, f: x > f.value, GreaterThanOrEqual: lambda x, f: x >= f.value, LessThan: lambda x, f: x < f.value, LessThanOrEqual: lambda x, f: x <= f.value,
    StringStartsWith: lambda x, f: x.startswith(f.value),
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        self.data = options.get("includedata", "true").lower() != "false"
        self.first = options.get("firstonly", "false").lower() == "true"
        self.filters: list[Filter] = []
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode}")

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in PLAIN:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        """Null compares as not true, as in SQL."""
        return all((x := row.get(f.attribute[0])) is not None and COMPARED[type(f)](x, f) for f in self.filters)

    def partitions(self):
        from pyarrow import fs

        system, at = _open(self.path)
        info = system.get_file_info(at)
        paths = [self.path] if info.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", "."))]
        own = [f for f in self.filters if f.attribute[0] == "path"]
        return [_File(p) for p in paths if all(COMPARED[type(f)](p, f) for f in own)]

    def read(self, partition):
        system, at = _open(partition.path)
        with system.open_input_file(at) as f:
            source = messages.Ranges(f, f.size())
            rows, octets = [], 0
            for row in field_rows(partition.path, source, self.mode, self.data, self._wanted if self.filters else None, self.first):
                rows.append(row)
                octets += len(row.get("section7") or b"")
                if len(rows) >= 256 or octets > 32 << 20:
                    yield _batch(rows, FIELDS)
                    rows, octets = [], 0
            if rows:
                yield _batch(rows, FIELDS)


class _Writer(DataSourceWriter):
    """Writes rows of (…, content): each task one file of its messages, under a name that only a committed job moves into place. With ``overwrite`` the commit deletes the files that were there before."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        name = f"{at}/.part-{uuid.uuid4().hex}.grb"
        n = 0
        with system.open_output_stream(name) as f:
            for row in rows:
                f.write(bytes(row["content"]))
                n += 1
        message = WriterCommitMessage()
        message.name, message.n = name, n
        return message

    def commit(self, found):
        from pyarrow import fs

        system, at = _open(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")):
                    system.delete_file(f.path)
        for m in found:
            if m is not None and m.n:
                system.move(m.name, m.name.replace("/.part-", "/part-"))
            elif m is not None:
                system.delete_file(m.name)

    def abort(self, found):
        system, _ = _open(self.path)
        for m in found:
            if m is not None:
                system.delete_file(m.name)


class GriddedMessages(DataSource):
    """``spark.read.format("wmo-grib").load(path)``, with the options ``mode``, ``includeData`` (without, data are not read) and ``firstOnly`` (the first message of each file). Comparisons of plain columns are pushed into the scan: files are left out by their path, and data of other messages are not read. ``df.write.format("wmo-grib").save(path)`` for rows with ``content``."""

    @classmethod
    def name(cls):
        return "wmo-grib"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


class Messages:
    """The fields of a message's octets as a table function, for SQL: ``SELECT m.* FROM files, LATERAL messages(path, content) m``."""

    def eval(self, path: str, content: bytes):
        for r in field_rows(path or "", bytes(content or b""), data=False):
            yield tuple(r.get(c) for c in TABLE_FUNCTION)


#: The columns of the table function.
TABLE_FUNCTION = ("msg_no", "field_no", "byte_offset", "total_length", "discipline", "grid_template", "n_points", "product_template", "packing_template", "n_values", "bitmap_indicator", "error")


def register(spark: SparkSession) -> None:
    """Adds the format ``wmo-grib`` and the table function ``messages``, and lets the session push comparisons into scans of such formats, without which Spark refuses a reader that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GriddedMessages)
    spark.udtf.register("messages", F.udtf(Messages, returnType=T.StructType([FIELDS[c] for c in TABLE_FUNCTION])))
