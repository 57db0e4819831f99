"""Decoders and encoders of raster and vector file formats, in numpy: baseline GeoTIFF, classic netCDF
and polygon shapefiles. They work on the bytes of one file, so that files are read where tasks run."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# ---------------------------------------------------------------- GeoTIFF

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT = 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _GEOKEYS, _NODATA = 33550, 33922, 34735, 42113
NO_COMPRESSION, LZW, DEFLATE = 1, 5, 8


@dataclass
class Raster:
    """Bands (band, row, column); the corner and size of pixels; the code of the reference system."""

    bands: np.ndarray
    origin: tuple[float, float] = (0.0, 0.0)
    size: tuple[float, float] = (1.0, 1.0)
    epsg: int | None = None
    nodata: float | None = None


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, with a clear code and an early change of width."""
    out, table, width, held, bits, before = bytearray(), [bytes([k]) for k in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise ValueError("a code that is not in the table")
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        width = min(12, (len(table) + 1).bit_length())
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    size = 258

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        # the reader is one entry behind, and widens one entry early
        if size > 4094:
            put(256)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        else:
            width = max(9, size.bit_length())
        word = bytes([byte])
    if word:
        put(table[word])
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


_PACK = {NO_COMPRESSION: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6)}
_UNPACK = {NO_COMPRESSION: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, 32946: zlib.decompress}


def read_geotiff(data: bytes) -> Raster:
    """Striped or tiled, chunky or planar, without compression or with LZW or deflate; a predictor by differences."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        size = struct.calcsize(order + _TYPES[kind]) * count
        place = entry[8:12] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + size]
        tags[tag] = (place[:size],) if kind == 2 else struct.unpack(f"{order}{count * len(_TYPES[kind])}{_TYPES[kind][0]}", place[:size])
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1)
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
    planar = one(_PLANAR, 1) == 2
    tiled = _TILE_OFFSETS in tags
    part_width, part_height = (one(_TILE_WIDTH), one(_TILE_HEIGHT)) if tiled else (width, min(one(_ROWS, height), height))
    starts, sizes = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
    across, down = -(-width // part_width), -(-height // part_height)
    deep = 1 if planar else samples
    out = np.zeros((samples, height, width), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(starts, sizes)):
        plane, rest = divmod(k, across * down)
        row, column = rest // across * part_height, rest % across * part_width
        rows = part_height if tiled else min(part_height, height - row)
        raw = _UNPACK[one(_COMPRESSION, 1)](data[start : start + size])
        part = np.frombuffer(raw, kind, rows * part_width * deep).reshape(rows, part_width, deep)
        if one(_PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        part = part[: height - row, : width - column].transpose(2, 0, 1)
        out[plane if planar else slice(None), row : row + part.shape[1], column : column + part.shape[2]] = part[0] if planar else part
    scale, tie, keys = tags.get(_SCALE, (1.0, 1.0)), tags.get(_TIEPOINT, (0.0,) * 6), tags.get(_GEOKEYS, ())
    codes = [v for k, place, _, v in zip(*[iter(keys[4:])] * 4) if k in (3072, 2048) and not place]
    text = one(_NODATA, b"").rstrip(b"\0 ")
    return Raster(out, (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), (scale[0], scale[1]), codes[-1] if codes else None, float(text) if text else None)


def write_geotiff(raster: Raster, compression: int = LZW) -> bytes:
    """Planar strips, one for each band."""
    bands = np.ascontiguousarray(raster.bands, raster.bands.dtype.newbyteorder("<"))
    n, height, width = bands.shape
    strips = [_PACK[compression](b.tobytes()) for b in bands]
    kinds = {"u": 1, "i": 2, "f": 3}
    starts = np.cumsum([8, *map(len, strips)])
    entries = [
        (_WIDTH, "I", [width]), (_HEIGHT, "I", [height]), (_BITS, "H", [bands.dtype.itemsize * 8] * n), (_COMPRESSION, "H", [compression]), (262, "H", [1]), (_OFFSETS, "I", starts[:-1].tolist()),
        (_SAMPLES, "H", [n]), (_ROWS, "I", [height]), (_COUNTS, "I", [len(s) for s in strips]), (_PLANAR, "H", [2]), (_FORMAT, "H", [kinds[bands.dtype.kind]] * n),
        (_SCALE, "d", [*raster.size, 0.0]), (_TIEPOINT, "d", [0.0, 0.0, 0.0, *raster.origin, 0.0]),
    ]
    if raster.epsg is not None:
        entries.append((_GEOKEYS, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, raster.epsg]))
    if raster.nodata is not None:
        entries.append((_NODATA, "s", str(raster.nodata).encode() + b"\0"))
    at = int(starts[-1] + starts[-1] % 2)
    extra_at, rows, extra = at + 2 + 12 * len(entries) + 4, [], b""
    for tag, kind, values in entries:
        packed = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", extra_at + len(extra))
        rows.append(struct.pack("<HHI", tag, {"B": 1, "s": 2, "H": 3, "I": 4, "d": 12}[kind], len(values)) + place)
        if len(packed) > 4:
            extra += packed + b"\0" * (len(packed) % 2)
    body = b"".join(strips)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (at - 8 - len(body)) + struct.pack("<H", len(rows)) + b"".join(rows) + b"\0" * 4 + extra


# ---------------------------------------------------------------- classic netCDF

_NC = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


@dataclass
class Cube:
    """Variables by name as (names of dimensions, values, attributes), and the attributes of the file."""

    variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]]
    attributes: dict = field(default_factory=dict)


def read_netcdf(data: bytes) -> Cube:
    """Files of the classic and the 64-bit offset format; packed values are scaled, fill values become NaN."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic netCDF file")
    wide, at = ">q" if data[3] == 2 else ">i", 4

    def number(form=">i"):
        nonlocal at
        (value,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return value

    def name():
        nonlocal at
        size = number()
        found = data[at : at + size].decode()
        at += size + -size % 4
        return found

    def listed(read):
        number()  # what is listed
        return [read() for _ in range(number())]

    def attribute():
        nonlocal at
        key, kind, count = name(), number(), number()
        values = np.frombuffer(data, _NC[kind], count, at)
        at += values.nbytes + -values.nbytes % 4
        return key, values.tobytes().decode() if kind == 2 else values[0].item() if count == 1 else values.tolist()

    records = number()
    dims = listed(lambda: (name(), number()))
    attributes = dict(listed(attribute))
    heads = listed(lambda: (name(), [number() for _ in range(number())], dict(listed(attribute)), number(), number(), number(wide)))
    step = sum(size for _, ids, _, _, size, _ in heads if ids and not dims[ids[0]][1])
    out = {}
    for key, ids, own, kind, size, start in heads:
        shape = [dims[i][1] for i in ids]
        if ids and not shape[0]:  # one record after another, all variables in each
            shape[0] = records
            count = int(np.prod(shape[1:]))
            values = np.array([np.frombuffer(data, _NC[kind], count, start + k * step) for k in range(records)]).reshape(shape)
        else:
            values = np.frombuffer(data, _NC[kind], int(np.prod(shape)), start).reshape(shape)
        if kind != 2 and {"_FillValue", "scale_factor", "add_offset"} & own.keys():
            missing = values == own["_FillValue"] if "_FillValue" in own else False
            values = np.where(missing, np.nan, values * own.get("scale_factor", 1.0) + own.get("add_offset", 0.0))
        out[key] = (tuple(dims[i][0] for i in ids), values.astype(values.dtype.newbyteorder("=")), own)
    return Cube(out, attributes)


# ---------------------------------------------------------------- shapefiles


def read_polygons(data: bytes) -> list[list[np.ndarray] | None]:
    """Rings (points, 2) of the polygons of a .shp file; None for an empty shape."""
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        kind = struct.unpack("<i", data[at + 8 : at + 12])[0]
        if kind not in (0, 5, 15, 25):
            raise ValueError("only polygons are read")
        rings = None
        if kind:
            parts, points = struct.unpack("<2i", data[at + 44 : at + 52])
            starts = [*struct.unpack(f"<{parts}i", data[at + 52 : at + 52 + 4 * parts]), points]
            line = np.frombuffer(data, "<f8", 2 * points, at + 52 + 4 * parts).reshape(points, 2)
            rings = [line[a:b] for a, b in zip(starts, starts[1:])]
        out.append(rings)
        at += 8 + size
    return out


def read_records(data: bytes, encoding: str = "utf-8") -> list[dict]:
    """Rows of the .dbf table beside a shapefile; blank numbers are None."""
    rows, head, size = struct.unpack("<IHH", data[4:12])
    columns = [data[k : k + 32] for k in range(32, head - 1, 32)]
    columns = [(c[:11].split(b"\0")[0].decode(encoding), chr(c[11]), c[16], c[17]) for c in columns]
    out = []
    for k in range(rows):
        line, at, row = data[head + k * size : head + (k + 1) * size], 1, {}
        for name, kind, width, places in columns:
            text = line[at : at + width].decode(encoding, "replace").strip(" \0")
            at += width
            if kind in "NF":
                row[name] = (float(text) if places or kind == "F" else int(text)) if text and text.strip("*") else None
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            else:
                row[name] = text
        if line[:1] != b"*":
            out.append(row)
    return out
