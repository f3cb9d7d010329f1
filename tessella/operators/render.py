"""Rendering of whole tiles: the sampling rules of ``sampling`` on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SIZE = 256
EPSILON = np.finfo(np.float64).eps


@dataclass
class Layout:
    """A source's size and its grid of chunks (tiles or strips)."""

    width: int
    height: int
    chunk_w: int
    chunk_h: int

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.chunk_h)

    def data_size(self, chunk: int) -> tuple[int, int]:
        col, row = chunk % self.across, chunk // self.across
        return min(self.chunk_w, self.width - col * self.chunk_w), min(self.chunk_h, self.height - row * self.chunk_h)


@dataclass
class Source:
    """Chunks of one source, as RGBA planes; a chunk that is absent reads as outside."""

    layout: Layout
    chunks: dict[int, np.ndarray] = field(default_factory=dict)

    def pixels(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(RGBA, valid) at whole coordinates."""
        lay = self.layout
        out = np.zeros((*x.shape, 4), np.uint8)
        inside = (x >= 0) & (y >= 0) & (x < lay.width) & (y < lay.height)
        number = np.where(inside, (y // lay.chunk_h) * lay.across + x // lay.chunk_w, -1)
        valid = np.zeros(x.shape, bool)
        for c in np.unique(number):
            if (data := self.chunks.get(int(c))) is not None:
                at = number == c
                lx, ly = x[at] % lay.chunk_w, y[at] % lay.chunk_h
                good = (ly < data.shape[0]) & (lx < data.shape[1])
                part = np.zeros((len(lx), 4), np.uint8)
                part[good] = data[ly[good], lx[good]]
                out[at], valid[at] = part, good
        return out, valid


def expand_bands(samples: np.ndarray, width: int, height: int) -> np.ndarray:
    """RGBA of interleaved 8-bit samples; band four is alpha, further bands are ignored."""
    stride = max(1, len(samples) // max(1, width * height))
    full = np.zeros(width * height * stride, np.uint8)
    full[: min(len(samples), len(full))] = samples[: len(full)]
    px = full.reshape(height, width, stride)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = px[..., :3] if stride >= 3 else px[..., :1]
    if stride == 2:
        out[..., 3] = px[..., 1]
    elif stride >= 4:
        out[..., 3] = px[..., 3]
    return out


def to_bytes(samples: np.ndarray) -> np.ndarray:
    """Samples of any type as 8 bits: stretched between the chunk's finite extremes."""
    if samples.dtype == np.uint8 or not samples.size:
        return samples.astype(np.uint8)
    v = samples.astype(np.float64)
    finite = v[np.isfinite(v)]
    span = finite.max() - finite.min() if finite.size else 0.0
    if abs(span) < EPSILON:
        return np.zeros(v.shape, np.uint8)
    share = np.clip((v - finite.min()) / span, 0, 1)
    return np.floor(np.nan_to_num(share, nan=0.0) * 255 + 0.5).astype(np.uint8)


def sample_grid(corners: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Source coordinates of a tile's pixels; corners are UL, UR, LR, LL. The first and
    last pixels lie on the edges, and a row advances by repeated addition."""
    ul, ur, lr, ll = corners
    v = (np.arange(size) / (size - 1))[:, None]
    left, right = ul + (ll - ul) * v, ur + (lr - ur) * v
    step = (right - left) / (size - 1)
    out = []
    for axis in (0, 1):
        steps = np.repeat(step[:, axis : axis + 1], size, axis=1)
        steps[:, 0] = left[:, axis]
        out.append(np.add.accumulate(steps, axis=1))
    return out[0], out[1]


def _around(source: Source, x: np.ndarray, y: np.ndarray, nodata):
    x0, y0 = np.floor(x), np.floor(y)
    bound = 2.0**53
    xi, yi = (np.clip(np.nan_to_num(v), -bound, bound).astype(np.int64) for v in (x0, y0))
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        px, ok = source.pixels(xi + i, yi + j)
        if nodata is not None:
            ok = ok & ~(px[..., :3] == np.array(nodata, np.uint8)).all(axis=-1)
        yield x0 + i, y0 + j, px, ok


def nearest(selected: list[tuple[Source, np.ndarray]], nodata=None, size: int = SIZE) -> np.ndarray:
    """The nearest valid pixel over all sources; the earlier source wins ties."""
    out, best = np.zeros((size, size, 4), np.uint8), np.full((size, size), np.inf)
    for source, corners in selected:
        x, y = sample_grid(corners, size)
        for nx, ny, px, ok in _around(source, x, y, nodata):
            d = (nx - x) ** 2 + (ny - y) ** 2
            win = ok & (d < best)
            best[win], out[win] = d[win], px[win]
    return out


def bilinear(selected: list[tuple[Source, np.ndarray]], nodata=None, size: int = SIZE) -> np.ndarray:
    """Weighted mean over valid neighbours, from the first source that has any weight."""
    out, todo = np.zeros((size, size, 4), np.uint8), np.ones((size, size), bool)
    for source, corners in selected:
        x, y = sample_grid(corners, size)
        tx, ty = x - np.floor(x), y - np.floor(y)
        weights = ((1 - tx) * (1 - ty), tx * (1 - ty), (1 - tx) * ty, tx * ty)
        total, acc = np.zeros((size, size)), np.zeros((size, size, 4))
        for w, (_, _, px, ok) in zip(weights, _around(source, x, y, nodata), strict=True):
            w = np.where(ok, w, 0.0)
            total += w
            acc += px * w[..., None]
        use = todo & (total > EPSILON)
        out[use] = np.clip(np.floor(acc[use] / total[use][:, None] + 0.5), 0, 255).astype(np.uint8)
        todo &= ~use
    return out


def needed_chunks(corners: np.ndarray, layout: Layout) -> list[int]:
    """Chunks under the bounding box of the corners, one pixel wider on each side."""
    (x0, y0), (x1, y1) = np.floor(corners.min(axis=0)) - 1, np.ceil(corners.max(axis=0)) + 1
    if not np.isfinite([x0, y0, x1, y1]).all() or x1 < 0 or y1 < 0 or x0 >= layout.width or y0 >= layout.height:
        return []
    cols = range(max(0, int(x0)) // layout.chunk_w, min(layout.width - 1, int(x1)) // layout.chunk_w + 1)
    rows = range(max(0, int(y0)) // layout.chunk_h, min(layout.height - 1, int(y1)) // layout.chunk_h + 1)
    return [r * layout.across + c for r in rows for c in cols]
