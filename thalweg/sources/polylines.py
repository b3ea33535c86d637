"""A Spark data source for polyline shapefiles (.shp with its .dbf), by the published formats."""

from __future__ import annotations

import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Fixed values of the formats: the magic number, the shape types that are lines, bytes of headers.
MAGIC, LINE_TYPES, SHP_HEADER, DBF_HEADER, DBF_FIELD = 9994, (3, 13, 23), 100, 32, 32


def dbf_fields(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, header length, record length and (name, type, length, decimals) of each field."""
    records, header, length = struct.unpack_from("<IHH", data, 4)
    fields, at = [], DBF_HEADER
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += DBF_FIELD
    return records, header, length, fields


def dbf_rows(data: bytes, start: int = 0, end: int | None = None):
    records, header, length, fields = dbf_fields(data)
    for n in range(start, records if end is None else min(end, records)):
        at, row = header + n * length + 1, []
        for _, kind, size, decimals in fields:
            text = data[at : at + size].decode("latin-1").strip()
            at += size
            if kind in "NF":
                row.append(None if not text or "*" in text else float(text) if decimals or kind == "F" else int(float(text)))
            else:
                row.append(text or None)
        yield row


def line_ends(data: bytes) -> list[tuple[float, float, float, float] | None]:
    """First and last vertex of each record; None for a record without a line."""
    if struct.unpack_from(">i", data, 0)[0] != MAGIC:
        raise ValueError("not a shapefile")
    out, at = [], SHP_HEADER
    while at + 8 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in LINE_TYPES:
            parts, points = struct.unpack_from("<ii", data, at + 44)
            first = at + 52 + 4 * parts
            out.append((*struct.unpack_from("<dd", data, first), *struct.unpack_from("<dd", data, first + 16 * (points - 1))) if points else None)
        else:
            out.append(None)
        at += 8 + 2 * words
    return out


class PolylineSource(DataSource):
    """spark.read.format("polylines").load("x.shp"): x1, y1, x2, y2 and the attributes, a row per line."""

    @classmethod
    def name(cls):
        return "polylines"

    def _read(self, extension: str) -> bytes:
        with open(self.options["path"].removesuffix(".shp") + extension, "rb") as f:
            return f.read()

    def schema(self):
        kinds = {"N": LongType(), "F": DoubleType()}
        fields = dbf_fields(self._read(".dbf"))[3]
        attributes = [StructField(n, DoubleType() if k == "N" and d else kinds.get(k, StringType())) for n, k, _, d in fields]
        return StructType([StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2")] + attributes)

    def reader(self, schema):
        return _Reader(self._read(".shp"), self._read(".dbf"))


class _Reader(DataSourceReader):
    ROWS = 50_000

    def __init__(self, shp: bytes, dbf: bytes):
        self.shp, self.dbf = shp, dbf

    def partitions(self):
        n = dbf_fields(self.dbf)[0]
        return [InputPartition((a, min(n, a + self.ROWS))) for a in range(0, max(n, 1), self.ROWS)]

    def read(self, partition):
        a, b = partition.value
        for ends, row in zip(line_ends(self.shp)[a:b], dbf_rows(self.dbf, a, b)):
            if ends:
                yield (*ends, *row)
