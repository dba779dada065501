"""Rasters in files: ASCII grids and plain GeoTIFFs, as tables of (row, col, band, value)."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import NODATA, Raster

CELLS = "row long, col long, band int, value double"
#: Fixed values of the TIFF format: sizes and codes of field types, tag numbers.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 339
_PIXEL, _TIE, _GEOKEYS, _NODATA = 33550, 33922, 34735, 42113
#: A file's array is held by one machine; larger rasters stay tables.
MOST_CELLS = 200_000_000


def _cells(spark: SparkSession, bands: np.ndarray, nodata: float | None) -> DataFrame:
    """Voids, tagged or NaN, have no row."""
    fine = np.isfinite(bands)
    if nodata is not None:
        fine &= bands != nodata
    b, r, c = np.nonzero(fine)
    return spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "band": (b + 1).astype(np.int32), "value": bands[b, r, c].astype(float)}), CELLS)


def read_ascii(spark: SparkSession, path: str) -> tuple[Raster, DataFrame]:
    head: dict[str, float] = {}
    rows = []
    for line in Path(path).read_text().splitlines():
        parts = line.split()
        if len(parts) == 2 and parts[0][0].isalpha() and not rows:
            head[parts[0].lower()] = float(parts[1])
        elif parts:
            rows.append([float(v) for v in parts])
    res, n = head["cellsize"], int(head["nrows"])
    west = head.get("xllcorner", head.get("xllcenter", 0) - res / 2)
    south = head.get("yllcorner", head.get("yllcenter", 0) - res / 2)
    values = np.array(rows).reshape(n, int(head["ncols"]))
    return Raster(west, south + n * res, res, values.shape[1], n), _cells(spark, values[None], head.get("nodata_value", NODATA))


def dense(cells: DataFrame, raster: Raster, nodata: float = NODATA) -> np.ndarray:
    """The array of one band, for a file."""
    if raster.width * raster.height > MOST_CELLS:
        raise ValueError("too large for one file; keep it a table")
    out = np.full((raster.height, raster.width), nodata)
    pdf = cells.where(raster.inside(F.col("row"), F.col("col"))).select("row", "col", "value").toPandas()
    out[pdf["row"], pdf["col"]] = pdf["value"].fillna(nodata)
    return out


def write_ascii(cells: DataFrame, raster: Raster, path: str) -> None:
    a = dense(cells, raster)
    head = f"ncols {raster.width}\nnrows {raster.height}\nxllcorner {raster.west!r}\nyllcorner {raster.south!r}\ncellsize {raster.res!r}\nNODATA_value {NODATA:g}\n"
    Path(path).write_text(head + "\n".join(" ".join(repr(float(v)) for v in row) for row in a) + "\n")


def write_geotiff(cells: DataFrame, raster: Raster, path: str) -> None:
    """One band of float32 in deflated strips; voids are NODATA."""
    a = dense(cells, raster).astype("<f4")
    rows = max(1, (1 << 20) // max(1, 4 * raster.width))
    strips = [zlib.compress(a[i : i + rows].tobytes()) for i in range(0, raster.height, rows)]
    epsg = int(raster.crs.split(":")[1]) if raster.crs and raster.crs.upper().startswith("EPSG:") else 0
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg or 32767]
    tags: list[tuple[int, int, list]] = [
        (_WIDTH, 4, [raster.width]), (_HEIGHT, 4, [raster.height]), (_BITS, 3, [32]), (_COMPRESSION, 3, [8]), (262, 3, [1]), (_OFFSETS, 4, []), (_SAMPLES, 3, [1]),
        (_ROWS, 4, [rows]), (_COUNTS, 4, [len(s) for s in strips]), (_FORMAT, 3, [3]), (_PIXEL, 12, [raster.res, raster.res, 0.0]),
        (_TIE, 12, [0.0, 0.0, 0.0, raster.west, raster.north, 0.0]), (_GEOKEYS, 3, keys), (_NODATA, 2, [c.encode() for c in f"{NODATA:g}\0"]),
    ]
    body, at = bytearray(), 8
    offsets = []
    for s in strips:
        offsets.append(at + len(body))
        body += s
    body += b"\0" * (len(body) % 2)
    entries = []
    for tag, kind, values in tags:
        values = offsets if tag == _OFFSETS else values
        data = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        if len(data) > 4:
            where = at + len(body)
            body += data + b"\0" * (len(data) % 2)
            data = struct.pack("<I", where)
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, at + len(body)) + body + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4)


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None) -> tuple[Raster, DataFrame, list[str]]:
    """(raster, cells, warnings) of a striped TIFF, plain or deflated. bands are 1-based; one that isn't there is refused."""
    raw = Path(path).read_bytes()
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    at = struct.unpack_from(f"{order}I", raw, 4)[0]
    tags: dict[int, list] = {}
    for i in range(struct.unpack_from(f"{order}H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * i)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(code) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", raw, at + 10 + 12 * i)[0]
        tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", raw, where))
    if tags.get(_COMPRESSION, [1])[0] not in (1, 8, 32946) or tags.get(317, [1])[0] != 1 or _OFFSETS not in tags:
        raise ValueError("only striped files, plain or deflated and without predictor, are read")
    width, height, samples = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, [1])[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(_FORMAT, [1])[0]] }{tags.get(_BITS, [8])[0] // 8}")
    parts = [raw[o : o + n] for o, n in zip(tags[_OFFSETS], tags[_COUNTS], strict=True)]
    data = np.frombuffer(b"".join(parts if tags.get(_COMPRESSION, [1])[0] == 1 else map(zlib.decompress, parts)), kind).astype(float)
    data = data.reshape(samples, height, width) if tags.get(_PLANAR, [1])[0] == 2 else data.reshape(height, width, samples).transpose(2, 0, 1)
    wanted = bands or list(range(1, samples + 1))
    if any(not 1 <= b <= samples for b in wanted):
        raise ValueError(f"bands {wanted} of {samples}")
    text = b"".join(tags[_NODATA]).decode().strip("\0 ") if _NODATA in tags else ""
    keys = tags.get(_GEOKEYS, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = codes.get(3072) or codes.get(2048)
    crs = f"EPSG:{epsg}" if epsg and epsg != 32767 else None
    warnings = [] if crs else ["no coordinate system"]
    if _PIXEL not in tags:
        warnings.append("no place on earth")
    res, tie = tags.get(_PIXEL, [1.0])[0], tags.get(_TIE, [0.0] * 6)
    if not bands and samples > 1:
        warnings.append("more than one band")
    return Raster(tie[3], tie[4], res, width, height, crs), _cells(spark, data[[b - 1 for b in wanted]], float(text) if text else None), warnings
