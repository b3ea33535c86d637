"""A Spark data source for line layers of GeoPackages (SQLite files), by the published format."""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Fixed values of the format: bytes of the envelope by its code, well-known types of one line and of several.
ENVELOPES, LINE, LINES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}, 2, 5


def _line(data: bytes, at: int) -> tuple[list[tuple[float, float]], int]:
    """First and last vertex of the line at an offset, and the offset behind it."""
    order = "<" if data[at] else ">"
    kind, n = struct.unpack_from(order + "II", data, at + 1)
    if kind % 1000 != LINE:
        raise ValueError("not a line")
    size = 8 * {0: 2, 1: 3, 2: 3, 3: 4}[kind // 1000]
    first = at + 9
    ends = [struct.unpack_from(order + "dd", data, first + size * k) for k in ((0, n - 1) if n else ())]
    return ends, first + size * n


def line_ends(blob: bytes | None) -> tuple[float, float, float, float] | None:
    """First vertex of the first line and last vertex of the last; None for an empty geometry."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + ENVELOPES[blob[3] >> 1 & 7]
    order = "<" if blob[at] else ">"
    kind, n = struct.unpack_from(order + "II", blob, at + 1)
    if kind % 1000 == LINES:
        at, found = at + 9, []
        for _ in range(n):
            ends, at = _line(blob, at)
            found += ends
    else:
        found, _ = _line(blob, at)
    return (*found[0], *found[-1]) if found else None


class GeoPackageSource(DataSource):
    """spark.read.format("geopackage").load("x.gpkg"), option layer: x1, y1, x2, y2 and the attributes, a row per line."""

    @classmethod
    def name(cls):
        return "geopackage"

    def _layer(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            layers = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall())
            name = self.options.get("layer") or next(iter(layers))
            columns = [(c[1], c[2].upper()) for c in db.execute(f'PRAGMA table_info("{name}")') if c[1] != layers[name]]
        return name, layers[name], columns

    def schema(self):
        def kind(t: str):
            return LongType() if "INT" in t or t == "BOOLEAN" else DoubleType() if t in ("REAL", "DOUBLE", "FLOAT") else StringType()

        return StructType([StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2")] + [StructField(c, kind(t)) for c, t in self._layer()[2]])

    def reader(self, schema):
        name, geometry, columns = self._layer()
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = ", ".join(f'"{c}"' for c in [geometry, *(c for c, _ in columns)])
            return _Reader(db.execute(f'SELECT {names} FROM "{name}"').fetchall())


class _Reader(DataSourceReader):
    ROWS = 20_000

    def __init__(self, rows):
        self.rows = rows

    def partitions(self):
        return [InputPartition(self.rows[k : k + self.ROWS]) for k in range(0, max(len(self.rows), 1), self.ROWS)]

    def read(self, partition):
        for blob, *attributes in partition.value:
            if ends := line_ends(blob):
                yield (*ends, *attributes)
