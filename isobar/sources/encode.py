"""Values to messages: one field of a regular latitude/longitude grid in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from isobar.codecs import packings
from isobar.sources import layout, messages

IDENTIFICATION = dict(centre=98, subcentre=0, master_version=35, local_version=0, significance=1, year=2024, month=2, day=29, hour=12, minute=0, second=0, status=0, data_type=1)
EARTH = dict(shape=6, radius_scale=255, radius=0xFFFFFFFF, major_scale=255, major=0xFFFFFFFF, minor_scale=255, minor=0xFFFFFFFF)
POINT = dict(category=0, number=0, process=2, background=0, process_id=0, cutoff_hours=0, cutoff_minutes=0, time_unit=1, forecast_time=6, surface1=103, surface1_scale=0, surface1_value=2, surface2=255, surface2_scale=-127, surface2_value=0xFFFFFFFF)


def latlon(ni: int, nj: int, lat1: int, lon1: int, lat2: int, lon2: int, scan: int = 0) -> dict:
    """A grid of template 3.0; angles in millionths of a degree."""
    step = lambda a, b, n: abs(b - a) // (n - 1) if n > 1 else 0
    return {**EARTH, "ni": ni, "nj": nj, "basic_angle": 0, "subdivisions": 0xFFFFFFFF, "lat1": lat1, "lon1": lon1, "flags": 0x30, "lat2": lat2, "lon2": lon2, "di": step(lon1, lon2, ni), "dj": step(lat1, lat2, nj), "scan": scan}


def packed_sections(values: np.ndarray, packing: str, bits: int, substitute: float = float("nan")) -> tuple[bytes, bytes, bytes]:
    """Sections 5 to 7 of some values in data order. Missing points (NaN) go to a bit map, or into complex and run-length packing, which mark them themselves; ``substitute`` is what stands for them in complex packing."""
    v = np.asarray(values, np.float64)
    missing = np.isnan(v)
    inner = packing in ("complex", "complex1", "complex2", "runlength")
    bitmap = b"\xff"
    if missing.any() and not inner:
        bitmap = b"\x00" + np.packbits(~missing).tobytes()
        v = v[~missing]
    if packing == "simple":
        number, (data, t) = 0, packings.pack_simple(v, bits) if len(v) else (b"", packings.template(packings.Scale()))
    elif packing == "ieee":
        number, (data, t) = 4, packings.pack_ieee(v, 2 if bits > 32 else 1)
    elif packing == "jpeg2000":
        number, (data, t) = 40, packings.pack_jpeg2000(v, bits)
    elif packing == "png":
        number, (data, t) = 41, packings.pack_png(v, bits, max(len(v), 1), 1)
    elif packing == "ccsds":
        number, (data, t) = 42, packings.pack_ccsds(v, bits)
    elif packing == "runlength":
        number, (data, t) = 200, packings.pack_run_length(v, bits)
    elif inner:
        order = int(packing[7:] or 0)
        number, (data, t) = (3 if order else 2), packings.pack_complex(v, bits, order, substitute)
    else:
        raise ValueError(f"packing {packing}")
    return messages.packing_section(number, t, len(v)), bitmap, data


def message(values: np.ndarray, grid: dict, packing: str = "simple", bits: int = 16, product: dict = POINT, identification: dict = IDENTIFICATION, discipline: int = 0, grid_template: int = 0, product_template: int = 0, row_points: bytes = b"", row_octets: int = 0, substitute: float = float("nan")) -> bytes:
    """A message of one field; the values in data order. Reduced grids have their list of points per row in ``row_points``, of ``row_octets`` octets each."""
    section5, section6, section7 = packed_sections(values, packing, bits, substitute)
    f = messages.FieldSections(None, messages.grid_section(grid_template, grid, len(values), row_points, row_octets), messages.product_section(product_template, product), section5, section6[0], section6[1:], section7)
    return messages.build(messages.Message(discipline, layout.write(layout.SECTION1, identification), fields=[f]))


def encode_fields(rows: DataFrame, packing: str = "ieee", bits: int = 64) -> DataFrame:
    """(path, content): a message for each row of (path, values) and, where the columns are there, ``discipline``, ``identification``, ``grid_template`` and ``grid``, ``row_points`` (a list), ``product_template`` and ``product``.

    ``identification``, ``grid`` and ``product`` are maps of numbers by name, as the reader gives them; what they lack is taken from the defaults. Values are in data order, null where missing.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
    known = [c for c in ("discipline", "identification", "grid_template", "grid", "row_points", "product_template", "product") if c in rows.columns]
    source = rows.select(rows["path"].cast("string").alias("path"), "values", *known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for row in batch.to_pylist():
                v = np.array([np.nan if x is None else x for x in row["values"] or []], np.float64)
                more = {k: dict(row[k] or ()) for k in ("identification", "grid", "product") if k in row}
                grid = {**latlon(len(v), 1, 0, 0, 0, 1_000_000), **more.get("grid", {})}
                octets = b"".join(int(n).to_bytes(4, "big") for n in row.get("row_points") or ())
                content.append(message(v, grid, packing, bits, {**POINT, **more.get("product", {}), "time_ranges": ()}, {**IDENTIFICATION, **more.get("identification", {})}, row.get("discipline") or 0, row.get("grid_template") or 0, row.get("product_template") or 0, octets, 4 if octets else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def encode_rows(fields: DataFrame, key: str, packing: str, bits: int, substitute: float = float("nan")) -> DataFrame:
    """(path, content) of (key, values): a message for each row, its values as one parallel of a grid. ``path`` is the key."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
    source = fields.select(fields[key].cast("string").alias("path"), "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for row in batch.column(1):
                v = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                content.append(message(v, latlon(len(v), 1, 0, 0, 0, 1_000_000), packing, bits, substitute=substitute))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
