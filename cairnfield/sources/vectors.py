"""Attribute tables and features: CSV, GeoPackage, GeoJSON."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.tables import as_text

#: Bytes of the bounding box in a GeoPackage geometry's header, by envelope code.
_ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
_NUMERIC = ("INT", "REAL", "DOUBLE", "FLOAT", "NUMERIC", "DECIMAL")
RANGE = 100_000
#: Properties of a GeoJSON file become columns.
MOST_KEYS = 10_000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All values are text; a missing value is ""."""
    return spark.read.csv(path, header=True, encoding="UTF-8").fillna("")


def wkb_of(blob: bytes | None) -> bytes | None:
    """A GeoPackage geometry without its header; None if it isn't one."""
    if not blob or blob[:2] != b"GP" or len(blob) < 8:
        return None
    return blob[8 + _ENVELOPES.get(blob[3] >> 1 & 7, 0) :]


def gpkg_of(wkb: bytes, srid: int = 0) -> bytes:
    return b"GP\0\x01" + struct.pack("<i", srid) + wkb


def _layer(con: sqlite3.Connection, layer: str | None) -> tuple[str, str | None, list[tuple[str, str, bool]]]:
    """(table, geometry column, [(column, declared type, is key)]) of the first feature table by name."""
    names = [r[0] for r in con.execute("select table_name from gpkg_contents where data_type in ('features', 'attributes') order by data_type desc, table_name")]
    if not names or layer and layer not in names:
        raise ValueError("no attribute table")
    table = layer or names[0]
    geom = con.execute("select column_name from gpkg_geometry_columns where table_name = ?", (table,)).fetchone() if con.execute("select 1 from sqlite_master where name = 'gpkg_geometry_columns'").fetchone() else None
    columns = [(r[1], (r[2] or "TEXT").upper(), bool(r[5])) for r in con.execute(f'pragma table_info("{table}")')]
    return table, geom[0] if geom else None, columns


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str | None) -> None:
        self.path, self.layer = path, layer

    def partitions(self) -> list[_Rows]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            table, _, _ = _layer(con, self.layer)
            lo, hi = con.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{table}"').fetchone()
        return [_Rows(i, min(i + RANGE - 1, hi)) for i in range(lo, hi + 1, RANGE)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            table, geom, columns = _layer(con, self.layer)
            names = [c for c, _, key in columns if not key]
            numeric = [any(t in kind for t in _NUMERIC) for c, kind, key in columns if not key]
            chosen = ", ".join(f'"{c}"' for c in names)
            for row in con.execute(f'select {chosen} from "{table}" where rowid between ? and ?', (partition.first, partition.last)):
                yield tuple(wkb_of(v) if c == geom else (float("nan") if v is None else float(v)) if num else "" if v is None else str(v) for c, num, v in zip(names, numeric, row, strict=True))


class GeoPackageSource(DataSource):
    """spark.read.format("gpkg").option("layer", ...).load(file)"""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            _, geom, columns = _layer(con, self.options.get("layer"))
        return ", ".join(f"`{c}` {'binary' if c == geom else 'double' if any(t in kind for t in _NUMERIC) else 'string'}" for c, kind, key in columns if not key)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("layer"))


def read_gpkg(spark: SparkSession, path: str, fields: list[str] | None = None, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(GeoPackageSource)
    reader = spark.read.format("gpkg")
    df = (reader.option("layer", layer) if layer else reader).load(path)
    return df.select(*fields) if fields else df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Properties as text in order of first sight, geometry as JSON text; a geometry that can't be one is null."""
    lines = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    one = "struct<type string, features array<string>>"
    parsed = lines.select("doc", F.from_json("doc", one).alias("d"))
    features = parsed.select(F.explode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(F.array("doc"))).alias("f"))
    rows = features.select(F.from_json("f", "struct<geometry string, properties map<string,string>>").alias("f"), F.monotonically_increasing_id().alias("at"))
    keys = rows.select(F.posexplode(F.map_keys("f.properties")).alias("pos", "key"), "at").groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first")).orderBy("first")
    names = [r["key"] for r in keys.limit(MOST_KEYS + 1).collect()]
    if len(names) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} kinds of properties don't make a table")
    shape = F.col("f.geometry")
    good = F.get_json_object(shape, "$.type").isNotNull() & F.get_json_object(shape, "$.coordinates").isNotNull()
    return rows.select(*[F.coalesce(F.col("f.properties")[n], F.lit("")).alias(n) for n in names], F.when(good, shape).alias("geometry"))


def square_wkb(x0: float, y0: float, x1: float, y1: float) -> bytes:
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in ring)


def write_gpkg(cells: DataFrame, path: str, layer: str = "cells", res: float | None = None, srid: int = 0, most: int = 20_000_000) -> int:
    """A keyed table as a GeoPackage, rows ordered by gid as text; with res each cell gets its square.

    The file is written by the driver from a stream of partitions: more than ``most`` rows are refused.
    """
    if (n := cells.count()) > most:
        raise ValueError(f"{n} rows don't go into one file")
    kinds = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER"}
    con = sqlite3.connect(path)
    con.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
    con.execute("create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text)")
    con.execute("insert into gpkg_contents values (?, ?, ?, ?)", (layer, "features" if res else "attributes", layer, srid))
    if res:
        con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
    names = cells.columns
    declared = ", ".join(f'"{c}" {kinds.get(t, "REAL")}' for c, t in cells.dtypes)
    con.execute(f'create table "{layer}" (fid integer primary key, {"geom blob, " if res else ""}{declared})')
    rows = cells.orderBy("gid") if "gid" in names else cells
    marks = ", ".join("?" * (len(names) + bool(res)))
    into = ", ".join(f'"{c}"' for c in ([*["geom"] * bool(res), *names]))

    def shaped() -> Iterator[tuple]:
        for r in rows.toLocalIterator():
            if res:
                x, y = r["cell_col"] * res, r["cell_row"] * res
                yield (gpkg_of(square_wkb(x, y, x + res, y + res), srid), *r)
            else:
                yield tuple(r)

    con.executemany(f'insert into "{layer}" ({into}) values ({marks})', shaped())
    con.commit()
    con.close()
    return n


def write_csv_twin(cells: DataFrame, path: str) -> None:
    """The same rows without geometry."""
    as_text(cells.drop("geom", "geometry")).write.mode("overwrite").csv(path, header=True)


def write_json(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: round(v, 6) if isinstance(v, float) else v for k, v in report.items()}, f, indent=1, default=str)
