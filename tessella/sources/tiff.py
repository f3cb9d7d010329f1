"""TIFF headers and chunks (tiles or strips): none, LZW, Deflate and PackBits
compression, horizontal and floating-point predictors, interleaved bands."""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from ..functions.georef import GEOGRAPHIC_KEY, PIXEL_IS_POINT, PROJECTED_KEY, RASTER_TYPE_KEY, UNSET_CODES, WORLD_FILE_ENDINGS
from ..operators.render import Layout, expand_bands, to_bytes

#: Field types (code -> struct letter) and tags of the format.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113


@dataclass
class Header:
    """What one file says of itself."""

    width: int
    height: int
    layout: Layout
    dtype: str
    samples: int
    compression: int
    predictor: int
    order: str
    offsets: list[int]
    sizes: list[int]
    tiled: bool
    tags: dict[int, tuple] = field(default_factory=dict)

    @property
    def nodata(self) -> str | None:
        v = self.tags.get(NODATA)
        return v[0].decode("latin-1").split("\0")[0] if v else None


def read_header(data: bytes) -> Header:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack(f"{order}H", data[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", data[8:16])[0] if big else struct.unpack(f"{order}I", data[4:8])[0]
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", data[at : at + (8 if big else 2)])[0]
    at += 8 if big else 2
    size, room, word = (20, 8, "Q") if big else (12, 4, "I")
    tags: dict[int, tuple] = {}
    for k in range(n):
        entry = data[at + k * size : at + (k + 1) * size]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        count = struct.unpack(f"{order}{word}", entry[4 : 4 + room])[0]
        if kind not in TYPES:
            continue
        letters = TYPES[kind]
        length = struct.calcsize(f"{order}{letters}") * count if kind != 2 else count
        raw = entry[4 + room : 4 + room + length]
        if length > room:
            where = struct.unpack(f"{order}{word}", entry[4 + room : 4 + 2 * room])[0]
            raw = data[where : where + length]
        tags[tag] = (raw,) if kind == 2 else struct.unpack(f"{order}{letters * count}" if len(letters) > 1 else f"{order}{count}{letters}", raw)

    def one(tag: int, default=None):
        return tags[tag][0] if tags.get(tag) else default

    if one(PLANAR, 1) == 2:
        raise ValueError("files with separate planes are not supported")
    width, height = one(WIDTH), one(HEIGHT)
    tiled = TILES in tags
    layout = Layout(width, height, one(TILE_W) if tiled else width, one(TILE_H) if tiled else min(one(ROWS, height), height))
    bits, form = one(BITS, 1), one(FORMAT, 1)
    letter = {1: "u", 2: "i", 3: "f"}.get(form, "u")
    dtype = f"{letter}{bits // 8}" if bits >= 8 else f"bits{bits}"
    return Header(
        width, height, layout, dtype, one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), order,
        list(tags[TILES if tiled else STRIPS]), list(tags[TILE_SIZES if tiled else STRIP_SIZES]), tiled, tags,
    )


def unpack_lzw(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, widened one code early."""
    out = bytearray()
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, b""
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def _decompress(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression == 5:
        return unpack_lzw(raw)
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 32773:
        return unpack_bits(raw)
    raise ValueError(f"compression {compression} is not supported")


def read_chunk(data: bytes, header: Header, chunk: int) -> np.ndarray:
    """A chunk's RGBA pixels, clipped to the raster."""
    lay = header.layout
    raw = _decompress(data[header.offsets[chunk] : header.offsets[chunk] + header.sizes[chunk]], header.compression)
    w, h = lay.data_size(chunk)
    full_w, full_h = (lay.chunk_w, lay.chunk_h) if header.tiled else (w, h)
    if header.dtype.startswith("bits"):
        flat = np.frombuffer(raw, np.uint8)  # packed samples are not unpacked
        return expand_bands(flat, w, h)
    kind = np.dtype(header.dtype).newbyteorder(header.order)
    n = header.samples
    if header.predictor == 3:
        rows = np.frombuffer(raw, np.uint8).reshape(full_h, -1).copy()
        rows = np.add.accumulate(rows.reshape(full_h, -1, n), axis=1, dtype=np.uint8).reshape(full_h, kind.itemsize, full_w * n)
        px = np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(full_h, full_w, n)
    else:
        px = np.frombuffer(raw, kind, full_h * full_w * n).reshape(full_h, full_w, n)
        if header.predictor == 2:
            px = np.add.accumulate(px.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    own = np.ascontiguousarray(px[:h, :w])
    return expand_bands(to_bytes(own.ravel()), w, h)


def world_file(path: str) -> list[float] | None:
    """a, b, c, d, e, f of the sidecar of highest priority, or None."""
    stem = os.path.splitext(path)[0]
    for ending in WORLD_FILE_ENDINGS:
        if os.path.isfile(stem + ending):
            with open(stem + ending) as f:
                lines = [x.strip() for x in f if x.strip()]
            if len(lines) != 6:
                raise ValueError(f"{stem + ending}: six numbers are expected")
            a, d, b, e, c, f6 = map(float, lines)
            return [a, b, c, d, e, f6]
    return None


def _short(keys: tuple, wanted: int) -> int | None:
    if len(keys) < 4:
        raise ValueError("the geokey directory is too short")
    for k in range(1, min(keys[3], len(keys) // 4 - 1) + 1):
        ident, place, count, value = keys[4 * k : 4 * k + 4]
        if ident == wanted and place == 0 and count == 1:
            return value
    return None


def georeference(header: Header, path: str | None, src_crs: str | None) -> dict:
    """crs, kind ('affine' or 'tiepoint'), p (six numbers) and raster_offset."""
    keys, raster_type = header.tags.get(GEOKEYS), None
    if keys is not None:
        codes = [c for c in (_short(keys, PROJECTED_KEY), _short(keys, GEOGRAPHIC_KEY)) if c is not None and c not in UNSET_CODES]
        if not codes:
            raise ValueError("the geokeys name no EPSG code")
        crs, raster_type = f"EPSG:{codes[0]}", _short(keys, RASTER_TYPE_KEY)
    elif src_crs:
        crs = src_crs
    else:
        raise ValueError("the file names no reference system; give one with --src-crs")
    from_world_file = False
    if MATRIX in header.tags:
        m = header.tags[MATRIX]
        if len(m) < 16:
            raise ValueError("the transformation matrix has fewer than 16 values")
        kind, p = "affine", [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif SCALE in header.tags and TIEPOINT in header.tags:
        s, t = header.tags[SCALE], header.tags[TIEPOINT]
        if len(s) < 2 or len(t) < 6:
            raise ValueError("the pixel scale or tie point is too short")
        kind, p = "tiepoint", [t[0], t[1], t[3], t[4], s[0], s[1]]
    else:
        own = world_file(path) if path else None
        if own is None:
            raise ValueError("no transform in the file and no world file beside it")
        kind, p, from_world_file = "affine", own, True
    offset = -0.5 if from_world_file or raster_type == PIXEL_IS_POINT else 0.0
    return {"crs": crs, "kind": kind, "p": [float(v) for v in p], "raster_offset": offset}


def write_tiff(path: str, px: np.ndarray, extra: dict[int, tuple[str, tuple]] | None = None, rows: int = 64, deflate: bool = True) -> None:
    """A striped little-endian file of (height, width, bands) samples, for fixtures."""
    h, w, n = px.shape
    strips = [px[k : k + rows].tobytes() for k in range(0, h, rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    form = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
    entries: dict[int, tuple[str, tuple]] = {
        WIDTH: ("I", (w,)), HEIGHT: ("I", (h,)), BITS: ("H", (px.dtype.itemsize * 8,) * n), COMPRESSION: ("H", (8 if deflate else 1,)),
        262: ("H", (2 if n >= 3 else 1,)), SAMPLES: ("H", (n,)), ROWS: ("I", (rows,)), PLANAR: ("H", (1,)), FORMAT: ("H", (form,) * n),
        STRIP_SIZES: ("I", tuple(map(len, strips))),
    }
    entries |= extra or {}
    place, offsets = 8, []
    for s in strips:
        offsets.append(place)
        place += len(s)
    entries[STRIPS] = ("I", tuple(offsets))
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    body, table = b"", b""
    end = place + 2 + 12 * len(entries) + 4
    for tag in sorted(entries):
        letter, values = entries[tag]
        raw = values[0] if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        count = len(raw) if letter == "s" else len(values)
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value = struct.pack("<I", end + len(body))
            body += raw + b"\0" * (len(raw) % 2)
        table += struct.pack("<HHI", tag, codes[letter], count) + value
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", place) + b"".join(strips) + struct.pack("<H", len(entries)) + table + b"\0" * 4 + body)
