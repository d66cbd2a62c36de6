"""Measures of grey pictures: numpy functions of one picture, for use in Arrow or pandas functions over small grids.

A picture is a 2-d array of luma. PNG (8 bits, not interlaced), BMP (24 or 32 bits) and PGM are decoded here; others need a hook.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np


def luma(rgb: np.ndarray) -> np.ndarray:
    """BT.601 grey of an array whose last axis begins with red, green and blue."""
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def _png(data: bytes) -> np.ndarray | None:
    at, idat, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(float)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        return None
    w, h, _, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            line = np.add.accumulate(line.reshape(w, channels), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b, c = (int(line[x - channels]) if x >= channels else 0), int(above[x]), (int(above[x - channels]) if x >= channels else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    p = out.reshape(h, w, channels).astype(float)
    if palette is not None and color == 3:
        return luma(palette[p[..., 0].astype(int)])
    return p[..., 0] if color in (0, 4) else luma(p)


def _bmp(data: bytes) -> np.ndarray | None:
    start, w, h, _, bits = struct.unpack_from("<I4xiiHH", data, 10)
    if bits not in (24, 32):
        return None
    row, n = (w * bits // 8 + 3) // 4 * 4, bits // 8
    p = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n).astype(float)
    return luma((p[::-1] if h > 0 else p)[..., 2::-1])


def _pgm(data: bytes) -> np.ndarray | None:
    kind, w, h, most, body = data.split(maxsplit=4)
    return np.frombuffer(body, np.uint8, int(w) * int(h)).reshape(int(h), int(w)).astype(float) if kind == b"P5" and int(most) < 256 else None


#: First bytes and decoder; users may add their own (the decoder hook).
DECODERS: list[tuple[bytes, Callable[[bytes], np.ndarray | None]]] = [(b"\x89PNG", _png), (b"BM", _bmp), (b"P5", _pgm)]


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey picture of a file, or None if no decoder can read it."""
    for mark, decoder in DECODERS:
        if data and data.startswith(mark):
            try:
                return decoder(data)
            except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                return None
    return None


def resize(p: np.ndarray, n: int) -> np.ndarray:
    """n x n by area average; the shape is not kept."""

    def weights(size: int) -> np.ndarray:
        edge = np.linspace(0, size, n + 1)
        at = np.arange(size)
        return np.clip(np.minimum(at + 1, edge[1:, None]) - np.maximum(at, edge[:-1, None]), 0, None) / (size / n)

    return weights(p.shape[0]) @ p @ weights(p.shape[1]).T


def to_long(bits: np.ndarray) -> int:
    """Up to 64 bits, the first the highest, as a signed number."""
    x = int("".join("1" if b else "0" for b in bits.ravel()), 2)
    return x - (1 << 64) if x >= 1 << 63 else x


def difference_bits(p: np.ndarray, rows: int, flat: float = 2.0) -> np.ndarray:
    """rows x rows bits: whether a cell is brighter than its right neighbour by more than `flat`."""
    wide = resize_to(p, rows, rows + 1)
    return wide[:, :-1] - wide[:, 1:] > flat


def resize_to(p: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """rows x columns by area average."""
    edges = lambda size, n: np.linspace(0, size, n + 1)

    def average(x: np.ndarray, n: int) -> np.ndarray:
        run = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, 0)))
        e = edges(x.shape[0], n)
        low = np.minimum(e.astype(int), x.shape[0] - 1)
        at = run[low] + (e - low)[:, None] * x[low]
        return np.diff(at, axis=0) / (x.shape[0] / n)

    return average(average(p, rows).T, columns).T


def coarse_and_fine(p: np.ndarray) -> tuple[int, list[int]]:
    """64-bit and 256-bit difference hashes."""
    fine = difference_bits(p, 16).reshape(4, 64)
    return to_long(difference_bits(p, 8)), [to_long(x) for x in fine]


def strict_difference_hash(p: np.ndarray) -> str:
    """64 characters 0 and 1: left brighter than right on 9 x 8 cells, without a tolerance."""
    return "".join("1" if b else "0" for b in difference_bits(p, 8, 0.0).ravel())


def laplacian_variance(p: np.ndarray) -> float:
    inner = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(inner.var())


_COS = np.cos(np.pi / 32 * (np.arange(32)[None, :] + 0.5) * np.arange(8)[:, None])


def low_frequencies(p: np.ndarray) -> np.ndarray:
    """The 8 x 8 lowest DCT-II terms of the 32 x 32 picture."""
    grid = resize(p, 32) if p.shape != (32, 32) else p
    return _COS @ grid @ _COS.T


def _hash_of(terms: np.ndarray) -> int:
    own = terms.ravel()[1:]
    return sum(1 << k for k, x in enumerate(own > np.sort(own)[31]) if x)


def perceptual_hashes(p: np.ndarray) -> list[int]:
    """63-bit hashes of the picture's eight turns and mirrorings, all from one transform: a mirroring flips signs of odd terms."""
    terms = low_frequencies(p)
    odd = 1.0 - 2.0 * (np.arange(8) % 2)
    out = []
    for t in (terms, terms.T):
        for rows in (np.ones(8), odd):
            out += [_hash_of(t * rows[:, None] * columns[None, :]) for columns in (np.ones(8), odd)]
    return out


def trimmed(p: np.ndarray, std: float = 6.0, apart: float = 8.0, most: float = 0.35, least: float = 0.03) -> np.ndarray | None:
    """The picture without its uniform border, or None if less than 3 % of it is border.

    From each side lines go while they are even and near the first one's mean, up to 35 % of the side.
    """

    def border(lines: np.ndarray) -> int:
        n = 0
        while n < int(most * len(lines)) and lines[n].std() <= std and abs(lines[n].mean() - lines[0].mean()) <= apart:
            n += 1
        return n

    top, bottom, left, right = border(p), border(p[::-1]), border(p.T), border(p.T[::-1])
    inner = p[top : p.shape[0] - bottom, left : p.shape[1] - right]
    return inner if inner.size and 1 - inner.size / p.size >= least else None


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's, 0 if either is flat."""
    x, y = a - a.mean(), b - b.mean()
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size > 0 else 0.0


def gradient(p: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(p)
    return np.hypot(gx, gy)


def turns(p: np.ndarray) -> list[np.ndarray]:
    """The eight turns and mirrorings, in the order of `perceptual_hashes`."""
    return [v for t in (p, p.T) for r in (t, t[::-1]) for v in (r, r[:, ::-1])]


def classify_pair(a: np.ndarray, b: np.ndarray, hashes_a: list[int], hashes_b: list[int], shot_allowed: bool = False, detail: float | None = None) -> tuple[str | None, int, float, float]:
    """(rule, distance, correlation, edge correlation) of two 32 x 32 grids: D02 re-encoded, D03 turned, D05 edited, D06 similar shot, or no rule.

    b is tried in its eight turns; the best correlation among those within the hash distance counts.
    """
    best = (None, 64, 0.0, 0.0)
    for k, (view, h) in enumerate(zip(turns(b), hashes_b, strict=True)):
        d = (hashes_a[0] ^ h).bit_count()
        if d > 8:
            continue
        c, e = correlation(a, view), correlation(gradient(a), gradient(view))
        rule = None
        if c >= 0.985 and e >= 0.97:
            rule = "D03" if k else "D05" if abs(a.mean() - view.mean()) > 8 else "D02"
        elif not k and shot_allowed and d <= 4 and c >= 0.85 and e >= 0.5 and (detail is None or detail >= 0.90):
            rule = "D06"
        if (rule is not None, c) > (best[0] is not None, best[2]):
            best = (rule, d, c, e)
    return best


def clarity_and_centering(p: np.ndarray) -> tuple[float, float]:
    """Laplacian variance per variance, and how near the centre of gradients lies to the picture's (1 centre, 0 corner)."""
    g = gradient(p)
    total = g.sum()
    if total <= 0:
        return 0.0, 0.0
    y, x = (np.arange(n) for n in p.shape)
    cy, cx = (g.sum(1) @ y / total) / max(1, p.shape[0] - 1) - 0.5, (g.sum(0) @ x / total) / max(1, p.shape[1] - 1) - 0.5
    return laplacian_variance(p) / max(float(p.var()), 1e-9), float(max(0.0, 1 - np.hypot(cy, cx) / np.hypot(0.5, 0.5)))


def screen_measure(p: np.ndarray, levels: int = 32) -> tuple[float, float]:
    """(share of the most common level, share of cells that differ from their neighbours)."""
    level = (p * (levels / 256)).astype(int)
    return float(np.bincount(level.ravel()).max() / level.size), float((gradient(p) > 8).mean())


def measures(content: bytes | None) -> tuple | None:
    """mean, std, sharpness, coarse, fine, width, height, hashes of a file's picture, or None."""
    p = decode(content)
    if p is None:
        return None
    grid = resize(p, 64)
    coarse, fine = coarse_and_fine(grid)
    return float(grid.mean()), float(grid.std()), laplacian_variance(grid), coarse, fine, p.shape[1], p.shape[0], perceptual_hashes(p)
