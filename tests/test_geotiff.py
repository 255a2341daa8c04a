"""TIFF rasters against arrays: layouts, byte orders, predictors, windows and mosaics."""

import struct
import zlib

import numpy as np
import pytest
from rillflow.sources import ascii_grid, geotiff


def write_tiff(path, cells, order="<", strip=None, tile=None, deflate=False, predictor=1, nodata=None, place=(500.0, 320.0), step=5.0, centre=False, epsg=2180, extra_bands=0, big=False):
    """A small TIFF of one image; returns the places of its strips or tiles."""
    high, wide = cells.shape
    seg_h, seg_w = (tile, tile) if tile else (strip or high, wide)
    kind = cells.dtype.newbyteorder(order)
    lead, offset, count_of, room_of = (16, "Q", "Q", 8) if big else (8, "I", "H", 4)
    body, at, sizes = b"", [], []
    for top in range(0, high, seg_h):
        for left in range(0, wide, seg_w):
            part = cells[top : top + seg_h, left : left + seg_w]
            if tile:
                part = np.pad(part, ((0, seg_h - part.shape[0]), (0, seg_w - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype)).astype(part.dtype)
            if predictor == 3:
                planes = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
            else:
                raw = np.repeat(part.astype(kind)[:, :, None], 1 + extra_bands, axis=2).tobytes()
            raw = zlib.compress(raw) if deflate else raw
            at.append(lead + len(body))
            sizes.append(len(raw))
            body += raw
    keys = [1, 1, 0, 2, 1025, 0, 1, 2 if centre else 1, 3072, 0, 1, epsg]
    shift = step / 2 if centre else 0.0
    tags = [
        (256, "I", [wide]), (257, "I", [high]), (258, "H", [cells.dtype.itemsize * 8] * (1 + extra_bands)), (259, "H", [8 if deflate else 1]), (277, "H", [1 + extra_bands]), (317, "H", [predictor]),
        *([(322, "I", [tile]), (323, "I", [tile]), (324, "I", at), (325, "I", sizes)] if tile else [(273, "I", at), (278, "I", [seg_h]), (279, "I", sizes)]),
        (339, "H", [{"u": 1, "i": 2, "f": 3}[cells.dtype.kind]] * (1 + extra_bands)), (33550, "d", [step, step, 0.0]), (33922, "d", [0, 0, 0, place[0] + shift, place[1] - shift, 0]), (34735, "H", keys),
        *([(42113, "s", [str(nodata).encode() + b"\0"])] if nodata is not None else []),
    ]
    entries, rest, start = b"", b"", lead + len(body)
    room = start + struct.calcsize("<" + count_of) + (20 if big else 12) * len(tags) + room_of
    for tag, code, values in sorted(tags):
        raw = values[0] if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        count = len(raw) if code == "s" else len(values)
        held = raw.ljust(room_of, b"\0") if len(raw) <= room_of else struct.pack(order + offset, room + len(rest))
        rest += raw if len(raw) > room_of else b""
        entries += struct.pack(order + "HH" + offset, tag, {"s": 2, "H": 3, "I": 4, "d": 12}[code], count) + held
    head = struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start)
    path.write_bytes((b"II" if order == "<" else b"MM") + head + body + struct.pack(order + count_of, len(tags)) + entries + b"\0" * room_of + rest)
    return at


def grid(df, shape):
    out = np.full(shape, np.nan)
    rows = df.collect()
    assert len({(r.r, r.c) for r in rows}) == len(rows)
    for r in rows:
        assert (r.x, r.y) == (500 + 5 * r.c + 2.5, 320 - 5 * r.r - 2.5)
        out[r.r, r.c] = np.nan if r.z is None else r.z
    return out, len(rows)


LAYOUTS = [
    dict(dtype="f4", strip=3),
    dict(dtype="f4", order=">", tile=16, deflate=True),
    dict(dtype="f4", tile=16, deflate=True, predictor=3),
    dict(dtype="f8", order=">", strip=4, deflate=True, predictor=3),
    dict(dtype="i2", strip=7, deflate=True, predictor=2),
    dict(dtype="u1", centre=True),
    dict(dtype="i4", strip=2, extra_bands=2),
    dict(dtype="f4", order=">", tile=16, deflate=True, big=True),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda d: "-".join(f"{k}{v}" for k, v in d.items()))
def test_cells_of_all_layouts(spark, tmp_path, layout):
    layout = dict(layout)
    cells = np.random.default_rng(3).integers(0, 200, (21, 37)).astype(layout.pop("dtype"))
    cells[4, 5] = 99
    write_tiff(tmp_path / "a.tif", cells, nodata=99, **layout)
    (tmp_path / "empty.tif").write_bytes(b"")
    head = geotiff.headers(spark, str(tmp_path)).collect()
    assert [(h.ncols, h.nrows, h.x0, h.y0, h.cellsize, h.nodata, h.xmax, h.ymax, h.epsg) for h in head] == [(37, 21, 500.0, 215.0, 5.0, 99.0, 685.0, 320.0, 2180)]
    got, n = grid(geotiff.read(spark, str(tmp_path)), cells.shape)
    assert n == cells.size
    np.testing.assert_array_equal(got, np.where(cells == 99, np.nan, cells.astype(float)))


def test_a_window_reads_its_strips_only(spark, tmp_path):
    cells = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    at = write_tiff(tmp_path / "a.tif", cells, tile=16, deflate=True)
    raw = bytearray((tmp_path / "a.tif").read_bytes())
    for k, place in enumerate(at):
        if k not in (5, 6):  # what is read besides these can't be inflated
            raw[place : place + 2] = b"\xff\xff"
    (tmp_path / "a.tif").write_bytes(raw)
    box = (500 + 5 * 20, 320 - 5 * 24, 500 + 5 * 40, 320 - 5 * 18)
    got, n = grid(geotiff.read(spark, str(tmp_path), box), cells.shape)
    assert n == 6 * 20
    np.testing.assert_array_equal(got[18:24, 20:40], cells[18:24, 20:40])
    assert geotiff.read(spark, str(tmp_path), (0, 0, 9, 9)).count() == 0
    with pytest.raises(Exception, match="inflate|decompress|header"):
        geotiff.read(spark, str(tmp_path)).collect()


def test_files_on_one_grid(spark, tmp_path):
    """Overlapping files: the last with a value counts; ASCII's checks of a mosaic serve."""
    a, b = np.arange(12, dtype="f4").reshape(3, 4), np.full((3, 4), 50, "f4")
    b[0, 0] = -1
    write_tiff(tmp_path / "a.tif", a, nodata=-1)
    write_tiff(tmp_path / "b.tif", b, nodata=-1, place=(510.0, 315.0))
    head = geotiff.headers(spark, str(tmp_path))
    assert ascii_grid.compatible(head).first().same_size and ascii_grid.mosaic_info(head).first().n_cells == 24
    expect = np.full((4, 6), np.nan)
    expect[:3, :4] = a
    expect[1:, 2:] = np.where(b == -1, expect[1:, 2:], b)
    got, n = grid(geotiff.mosaic(geotiff.read(spark, str(tmp_path)), head), expect.shape)
    assert n == 20
    np.testing.assert_array_equal(got, expect)


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "text.tif").write_text("no raster, but sixteen bytes or more")
    with pytest.raises(Exception, match="no TIFF file"):
        geotiff.headers(spark, str(tmp_path)).collect()
    cells = np.zeros((6, 6), "f4")
    other = tmp_path / "other"
    other.mkdir()
    write_tiff(other / "short.tif", cells, deflate=True)
    raw = (other / "short.tif").read_bytes()
    deflated = zlib.compress(cells.tobytes())
    assert deflated in raw
    packed = raw.replace(struct.pack("<HHIHH", 259, 3, 1, 8, 0), struct.pack("<HHIHH", 259, 3, 1, 5, 0))
    assert packed != raw
    (other / "short.tif").write_bytes(packed)
    with pytest.raises(Exception, match="compression 5"):
        geotiff.read(spark, str(other)).collect()
    assert geotiff.headers(spark, str(other), (0, 0, 1, 1)).count() == 0
