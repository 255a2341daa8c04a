"""TIFF rasters (.tif) as long-form cells: headers and strips are read by range, where they lie.

Spark lists the files and deals first the files, then their strips or tiles to tasks; a window
is compared with the strips' boxes, so that what it doesn't touch is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of decoded strips that a task is dealt, about, and cells that it sends at once.
TASK_BYTES, SENT = 32 << 20, 1 << 18
Box = tuple[float, float, float, float]

#: Fixed values of the format: tags, and bytes and codes of the field types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _SAMPLES, _STRIP_ROWS, _PLANES, _PREDICTOR, _FORMAT = 256, 257, 258, 259, 277, 278, 284, 317, 339
_STRIP_AT, _STRIP_SIZE, _TILE_WIDTH, _TILE_HEIGHT, _TILE_AT, _TILE_SIZE = 273, 279, 322, 323, 324, 325
_SCALE, _TIE, _MATRIX, _KEYS, _NODATA = 33550, 33922, 34264, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_RASTER_TYPE, _GEOGRAPHIC, _PROJECTED = 1025, 2048, 3072

_HEADER = (
    "path string, ncols int, nrows int, x0 double, y0 double, cellsize double, nodata double, xmax double, ymax double, epsg int, dtype string, compression int, predictor int, samples int, "
    "wide int, high int, at array<long>, bytes array<long>"
)
_CELLS = "path string, r int, c int, x double, y double, z double"


def _open(path: str):
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def _tags(file) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of a file's first image, classic or with 64-bit offsets."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    offset, count, step = ("Q", "Q", 20) if big else ("I", "H", 12)
    (at,) = struct.unpack(order + offset, head[8:16] if big else head[4:8])
    size = struct.calcsize(order + count)
    (n,) = struct.unpack(order + count, file.read_at(size, at))
    entries, out = file.read_at(n * step, at + size), {}
    for i in range(n):
        entry = entries[i * step : (i + 1) * step]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        (many,) = struct.unpack(order + offset, entry[4:12] if big else entry[4:8])
        if kind not in _TYPES:
            continue
        layout = f"{order}{many}{_TYPES[kind]}"
        room = entry[-8:] if big else entry[-4:]
        length = struct.calcsize(layout)
        raw = room[:length] if length <= len(room) else file.read_at(length, struct.unpack(order + offset, room)[0])
        out[tag] = struct.unpack(layout, raw)
    return order, out


def _header(path: str) -> dict:
    with _open(path) as file:
        order, tags = _tags(file)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    wide, high = tags[_WIDTH][0], tags[_HEIGHT][0]
    keys = tags.get(_KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if _MATRIX in tags:
        m = tags[_MATRIX]
        step, down, turn, left, top = m[0], -m[5], (m[1], m[4]), m[3], m[7]
    elif _SCALE in tags and _TIE in tags:
        (step, down), turn = tags[_SCALE][:2], (0.0, 0.0)
        i, j, _, x, y = tags[_TIE][:5]
        left, top = x - i * step, y + j * down
    else:
        raise ValueError(f"no place on a map in {path}")
    if any(turn) or step <= 0 or abs(step - down) > 1e-9 * step:
        raise ValueError(f"cells are no upright squares in {path}")
    if geo.get(_RASTER_TYPE) == 2:  # the tie is a centre
        left, top = left - step / 2, top + step / 2
    bits = set(tags.get(_BITS, (1,)))
    if len(bits) > 1 or min(bits) not in (8, 16, 32, 64):
        raise ValueError(f"samples of {sorted(bits)} bits in {path}")
    dtype = f"{order}{'uif'[one(_FORMAT, 1) - 1]}{min(bits) // 8}"
    tiled = _TILE_WIDTH in tags
    seg_w = tags[_TILE_WIDTH][0] if tiled else wide
    seg_h = tags[_TILE_HEIGHT][0] if tiled else min(high, one(_STRIP_ROWS, high))
    segments = -(-wide // seg_w) * -(-high // seg_h)
    at, sizes = (tags[t][:segments] for t in ((_TILE_AT, _TILE_SIZE) if tiled else (_STRIP_AT, _STRIP_SIZE)))
    apart = one(_PLANES, 1) == 2
    nodata = tags.get(_NODATA, (b"",))[0].split(b"\0")[0].strip()
    return {
        "path": path, "ncols": wide, "nrows": high, "x0": left, "y0": top - high * step, "cellsize": step, "nodata": float(nodata) if nodata else None, "xmax": left + wide * step, "ymax": top,
        "epsg": geo.get(_PROJECTED, geo.get(_GEOGRAPHIC)), "dtype": dtype, "compression": one(_COMPRESSION, 1), "predictor": one(_PREDICTOR, 1), "samples": 1 if apart else one(_SAMPLES, 1),
        "wide": seg_w, "high": seg_h, "at": list(at), "bytes": list(sizes),
    }


def headers(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(path, ncols, nrows, x0, y0, cellsize, nodata, xmax, ymax, epsg, ...) of each raster under ``path``.

    With a ``box`` (xmin, ymin, xmax, ymax), of those that touch it; files under ``reprojected/``
    are left out. Only headers are read. nodata and epsg are null where a file names none. Empty
    files are left out; what is no TIFF, has no place on a map or cells that aren't upright
    squares is an error. The columns are those of ``ascii_grid.headers`` and more, so its checks
    of a mosaic serve here, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_header(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pylist(found, schema=_arrow(_HEADER))

    # the files' contents are not among the columns, so listing reads none
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path)
    names = files.where("length > 0").select("path").where(~F.col("path").contains("/reprojected/"))
    found = names.mapInArrow(run, _HEADER)
    return found if box is None else found.where(_touches(F.col("x0"), F.col("y0"), F.col("xmax"), F.col("ymax"), box))


def _arrow(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


def _touches(x0, y0, x1, y1, box: Box):
    return (x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1])


def _decoded(raw: bytes, s: dict) -> np.ndarray:
    """First sample of a strip or tile, (rows, columns)."""
    if s["compression"] in (8, 32946):
        raw = zlib.decompress(raw)
    elif s["compression"] != 1:
        raise ValueError(f"compression {s['compression']} of {s['path']} is not read; plain and deflated files are")
    kind, wide, samples = np.dtype(s["dtype"]), s["wide"], s["samples"]
    rows = min(s["high"], len(raw) // (wide * samples * kind.itemsize))
    if rows < min(s["high"], s["nrows"] - s["top"]):
        raise ValueError(f"a strip of {s['path']} ends too early")
    if s["predictor"] == 3:  # differences of bytes, of which each row holds the highest first
        planes = np.frombuffer(raw, np.uint8)[: rows * wide * samples * kind.itemsize].reshape(rows, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, wide * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, wide, samples)[:, :, 0]
    cells = np.frombuffer(raw, kind)[: rows * wide * samples].reshape(rows, wide, samples)[:, :, 0]
    return np.cumsum(cells, axis=1, dtype=kind.newbyteorder("=")) if s["predictor"] == 2 else cells


def read(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(path, r, c, x, y, z) of every cell of the first band, x and y at its centre, z null for no data and for NaN.

    With a ``box``, of the cells whose centre is in it; only strips or tiles that it touches are
    read. Plain and deflated files with any predictor are read, other compressions are an error.
    """
    index = F.posexplode(F.arrays_zip("at", "bytes")).alias("i", "part")
    segments = headers(spark, path, box).select(*(c for c in _HEADER.replace(",", "").split(" ")[::2] if c not in ("at", "bytes")), index).select("*", "part.at", "part.bytes").drop("part")
    across = F.ceil(F.col("ncols") / F.col("wide")).cast("int")
    segments = segments.withColumns({"top": F.floor(F.col("i") / across).cast("int") * F.col("high"), "left": F.col("i") % across * F.col("wide")})
    west, north = F.col("x0") + F.col("left") * F.col("cellsize"), F.col("ymax") - F.col("top") * F.col("cellsize")
    if box is not None:
        segments = segments.where(_touches(west, north - F.col("high") * F.col("cellsize"), west + F.col("wide") * F.col("cellsize"), north, box))
    size = segments.agg(F.sum(F.col("wide").cast("long") * F.col("high") * 8 * F.col("samples"))).first()[0] or 0
    dealt = segments.repartition(max(1, -(-int(size) // TASK_BYTES)), "path", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                with _open(s["path"]) as file:
                    raw = file.read_at(s["bytes"], s["at"])
                cells = _decoded(raw, s)[: s["nrows"] - s["top"], : s["ncols"] - s["left"]].astype(float)
                x, y = s["x0"] + (s["left"] + np.arange(cells.shape[1]) + 0.5) * s["cellsize"], s["ymax"] - (s["top"] + np.arange(cells.shape[0]) + 0.5) * s["cellsize"]
                cols = np.flatnonzero((x >= box[0]) & (x <= box[2])) if box else np.arange(len(x))
                rows = np.flatnonzero((y >= box[1]) & (y <= box[3])) if box else np.arange(len(y))
                for first in range(0, len(rows) * bool(len(cols)), step := max(1, SENT // max(1, len(cols)))):
                    some = rows[first : first + step]
                    z = cells[np.ix_(some, cols)].ravel()
                    none = np.isnan(z) | (False if s["nodata"] is None else z == s["nodata"])
                    r, c = np.repeat(some, len(cols)), np.tile(cols, len(some))
                    columns = [pa.array([s["path"]] * len(z)), pa.array(r + s["top"], pa.int32()), pa.array(c + s["left"], pa.int32()), pa.array(x[c]), pa.array(y[r]), pa.array(z, mask=none)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "r", "c", "x", "y", "z"])

    return dealt.mapInArrow(run, _CELLS)


def mosaic(cells: DataFrame, head: DataFrame) -> DataFrame:
    """(r, c, x, y, z) of the cells of all files of ``head`` on one grid, rows from the north, columns from the west.

    Where files overlap, the last path that has a value there counts. ``head`` must be one cell
    size (``ascii_grid.compatible``); cells of either source serve.
    """
    whole = head.agg(F.min("x0").alias("_x0"), F.max("ymax").alias("_top"), F.min("cellsize").alias("_step"))
    r, c = F.floor((F.col("_top") - F.col("y")) / F.col("_step")).cast("int"), F.floor((F.col("x") - F.col("_x0")) / F.col("_step")).cast("int")
    placed = cells.join(head.select("path"), "path", "left_semi").join(F.broadcast(whole)).select(r.alias("r"), c.alias("c"), "x", "y", "z", "path")
    return placed.groupBy("r", "c").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max_by("z", F.when(F.col("z").isNotNull(), F.col("path"))).alias("z"))
