"""The single-file tile archive (PMTiles version 3), and tile encoders."""

from __future__ import annotations

import gzip
import hashlib
import os
import struct
import zlib
from collections.abc import Iterable

import numpy as np

#: Fixed values of the format: tile types, compressions, header size.
TILE_TYPES = {"png": 2, "avif": 5}
NO_COMPRESSION, GZIP = 1, 2
HEADER = "<7sB8Q" + "QQQ" + "BBBBBB" + "iiii" + "B" + "ii"
ROOT_MOST = 16384 - 127


def encode_png(rgba: bytes, size: int) -> bytes:
    rows = np.frombuffer(rgba, np.uint8).reshape(size, size * 4)
    raw = np.hstack((np.zeros((size, 1), np.uint8), rows)).tobytes()
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", size, size, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def encoder(quality: int, speed: int):
    """(tile type, function): AVIF where a library is installed, else PNG."""
    try:
        import io

        from PIL import Image, features

        if features.check("avif"):

            def avif(rgba: bytes, size: int) -> bytes:
                out = io.BytesIO()
                Image.frombytes("RGBA", (size, size), rgba).save(out, "AVIF", quality=quality, speed=speed)
                return out.getvalue()

            return "avif", avif
    except ImportError:
        pass
    return "png", encode_png


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def write_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """entries: (tile id, offset, length, run length), ascending."""
    out = [_varint(len(entries))]
    last = 0
    for e in entries:
        out.append(_varint(e[0] - last))
        last = e[0]
    out += [_varint(e[3]) for e in entries] + [_varint(e[2]) for e in entries]
    for k, e in enumerate(entries):
        follows = k and e[1] == entries[k - 1][1] + entries[k - 1][2]
        out.append(_varint(0 if follows else e[1] + 1))
    return gzip.compress(b"".join(out), mtime=0)


def read_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    raw, at = gzip.decompress(data), 0

    def take() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    n = take()
    ids, last = [], 0
    for _ in range(n):
        last += take()
        ids.append(last)
    runs, sizes = [take() for _ in range(n)], [take() for _ in range(n)]
    offsets: list[int] = []
    for k in range(n):
        v = take()
        offsets.append(v - 1 if v else offsets[k - 1] + sizes[k - 1])
    return list(zip(ids, offsets, sizes, runs, strict=True))


def write_archive(path: str, tiles: Iterable[tuple[int, bytes]], tile_type: str, zooms: tuple[int, int], bounds: tuple[float, float, float, float], leaf: int = 4096) -> int:
    """Write tiles, given in ascending tile id, to a temporary file that is then renamed."""
    work, body = path + ".part", path + ".tiles"
    entries: list[list[int]] = []
    seen: dict[bytes, tuple[int, int]] = {}
    n = place = 0
    with open(body, "wb") as f:
        for tile_id, data in tiles:
            if entries and tile_id < entries[-1][0] + entries[-1][3]:
                raise ValueError("tiles must come in ascending order")
            key = hashlib.sha256(data).digest()
            if key not in seen:
                seen[key] = (place, len(data))
                f.write(data)
                place += len(data)
            offset, size = seen[key]
            if entries and entries[-1][1:3] == [offset, size] and tile_id == entries[-1][0] + entries[-1][3]:
                entries[-1][3] += 1
            else:
                entries.append([tile_id, offset, size, 1])
            n += 1
    root, leaves = write_directory([tuple(e) for e in entries]), b""
    if len(root) > ROOT_MOST:
        top = []
        for k in range(0, len(entries), leaf):
            part = write_directory([tuple(e) for e in entries[k : k + leaf]])
            top.append((entries[k][0], len(leaves), len(part), 0))
            leaves += part
        root = write_directory(top)
    meta = gzip.compress(b"{}", mtime=0)
    at = 127 + len(root)
    e7 = lambda v: round(v * 1e7)
    west, south, east, north = bounds
    head = struct.pack(
        HEADER, b"PMTiles", 3, 127, len(root), at, len(meta), at + len(meta), len(leaves), at + len(meta) + len(leaves), place,
        n, len(entries), len(seen), 1, GZIP, NO_COMPRESSION, TILE_TYPES[tile_type], *zooms, e7(west), e7(south), e7(east), e7(north),
        zooms[0], e7((west + east) / 2), e7((south + north) / 2),
    )
    with open(work, "wb") as f, open(body, "rb") as g:
        f.write(head + root + meta + leaves)
        while block := g.read(1 << 20):
            f.write(block)
    os.remove(body)
    os.replace(work, path)
    return n


def read_archive(path: str) -> tuple[dict, dict[int, bytes]]:
    """(header fields, tiles by id) of an archive of this module's making."""
    with open(path, "rb") as f:
        data = f.read()
    v = struct.unpack(HEADER, data[:127])
    head = {"tile_type": v[16], "min_zoom": v[17], "max_zoom": v[18], "bounds": [x / 1e7 for x in v[19:23]], "center_zoom": v[23], "n_tiles": v[10]}
    out = {}
    todo = read_directory(data[v[2] : v[2] + v[3]])
    for tile, offset, size, run in todo:
        if run == 0:
            todo += read_directory(data[v[6] + offset : v[6] + offset + size])
        for k in range(run):
            out[tile + k] = data[v[8] + offset : v[8] + offset + size]
    return head, out
