"""Files written byte by byte here, read by the TIFF reader."""

import struct
import zlib

import numpy as np
import pytest

from tessella.operators import render
from tessella.sources import tiff


def lzw(data: bytes) -> bytes:
    """Codes widen one code early; a clear code before the table is full."""
    bits, table, width, have = "", {}, 9, b""

    def out(code):
        nonlocal bits
        bits += f"{code:0{width}b}"

    def clear():
        nonlocal table, width
        out(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    n = 258
    for b in data:
        b = bytes([b])
        if have + b in table:
            have += b
            continue
        out(table[have])
        table[have + b] = n
        n += 1
        if n == 4094:
            clear()
            n = 258
        elif n + 1 > 1 << width:
            width += 1
        have = b
    if have:
        out(table[have])
        n += 1
        if n + 1 > 1 << width and width < 12:
            width += 1
    out(257)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def predicted(px: np.ndarray, predictor: int, order: str) -> bytes:
    h, w, n = px.shape
    if predictor == 2:
        first = np.concatenate((np.zeros((h, 1, n), px.dtype), px[:, :-1]), axis=1)
        px = px - first
    if predictor == 3:
        size = px.dtype.itemsize
        planes = px.astype(px.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * n, size).transpose(0, 2, 1).reshape(h, -1)
        shifted = np.concatenate((np.zeros((h, n), np.uint8), planes[:, :-n]), axis=1)
        return (planes - shifted).tobytes()
    return px.astype(px.dtype.newbyteorder(order)).tobytes()


def build(px: np.ndarray, tile: tuple[int, int] | None, rows: int, compression: int, predictor: int, order: str, big: bool) -> bytes:
    h, w, n = px.shape
    parts = []
    if tile:
        th, tw = tile
        full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, n), px.dtype)
        full[:h, :w] = px
        parts = [full[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
    else:
        parts = [px[y : y + rows] for y in range(0, h, rows)]
    packed = [PACK[compression](predicted(p, predictor, order)) for p in parts]
    body, word, head = b"", "Q" if big else "I", 16 if big else 8
    offsets = []
    for p in packed:
        offsets.append(head + len(body))
        body += p
    form = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
    kind = 16 if big else 4
    tags = {
        256: (3, [w]), 257: (3, [h]), 258: (3, [8 * px.dtype.itemsize] * n), 259: (3, [compression]), 277: (3, [n]),
        317: (3, [predictor]), 339: (3, [form] * n),
    }
    if tile:
        tags |= {322: (3, [tile[1]]), 323: (3, [tile[0]]), 324: (kind, offsets), 325: (kind, [len(p) for p in packed])}
    else:
        tags |= {273: (kind, offsets), 278: (3, [rows]), 279: (kind, [len(p) for p in packed])}
    room, entries = (8 if big else 4), b""
    for tag, (t, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{tiff.TYPES[t]}", *values)
        if len(raw) > room:
            at = head + len(body)
            body += raw
            raw = struct.pack(f"{order}{word}", at)
        entries += struct.pack(f"{order}HH{word}", tag, t, len(values)) + raw.ljust(room, b"\0")
    at = head + len(body)
    count = struct.pack(f"{order}{'Q' if big else 'H'}", len(tags))
    mark = b"II" if order == "<" else b"MM"
    first = struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at)
    return mark + first + body + count + entries + b"\0" * 8


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize(
    ("dtype", "bands", "compression", "predictor"),
    [
        ("u1", 3, 1, 1), ("u1", 4, 5, 2), ("u1", 1, 32773, 1), ("u2", 1, 8, 2), ("u2", 3, 5, 2), ("i2", 1, 8, 1),
        ("f4", 1, 8, 3), ("f4", 3, 5, 3), ("f4", 1, 1, 1), ("f8", 1, 8, 3),
    ],
)
def test_chunks(dtype, bands, compression, predictor, tile, order, big):
    rng = np.random.default_rng(8)
    kind = np.dtype(dtype)
    px = rng.normal(50, 900, (45, 70, bands)) if kind.kind == "f" else rng.integers(0, 250, (45, 70, bands))
    px = px.astype(kind)
    data = build(px, tile, 10, compression, predictor, order, big)
    head = tiff.read_header(data)
    assert (head.width, head.height, head.samples, head.tiled) == (70, 45, bands, tile is not None)
    th, tw = tile or (10, 70)
    chunks = [px[y : y + th, x : x + tw] for y in range(0, 45, th) for x in range(0, 70, tw)]
    assert len(head.offsets) == len(chunks)
    for k, own in enumerate(chunks):
        own = np.ascontiguousarray(own)
        want = render.expand_bands(render.to_bytes(own.ravel()), own.shape[1], own.shape[0])
        assert (tiff.read_chunk(data, head, k) == want).all()


def test_lzw_fills_its_table_more_than_once():
    rng = np.random.default_rng(9)
    for data in (b"", b"a", b"a" * 100_000, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 60_000, dtype=np.uint8).tobytes()):
        assert tiff.unpack_lzw(lzw(data)) == data


def test_what_is_no_tiff_is_refused():
    for data in (b"", b"XX\0\0", b"II\x07\0\0\0\0\0"):
        with pytest.raises(ValueError):
            tiff.read_header(data)
    px = np.zeros((4, 4, 1), np.uint8)
    data = build(px, None, 4, 1, 1, "<", False)
    head = tiff.read_header(data)
    head.compression = 7
    with pytest.raises(ValueError):
        tiff.read_chunk(data, head, 0)
