"""Images as arrays, for use inside per-image functions: PNG, blur, distance transform, pixel components.

An image is one row (path, content); ``decoded`` maps a function of an array over such rows, image by image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_SIGN = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray) -> bytes:
    """Height x width x 4 bytes to an RGBA file."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + w * 4), np.uint8)
    rows[:, 1:] = image.astype(np.uint8).reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """An 8-bit, not interlaced grey, RGB or RGBA file to height x width x 4 bytes."""
    if raw[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(raw):
        (n,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    w, h, depth, kind, _, _, woven = head
    if depth != 8 or woven or kind not in _CHANNELS:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlacing")
    c = _CHANNELS[kind]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.int64)  # a row and a column of zeros before the image
    for y, line in enumerate(lines, 1):
        rule, own, up = line[0], line[1:].reshape(w, c).astype(np.int64), out[y - 1]
        if rule == 0:
            out[y, 1:] = own
        elif rule == 1:
            out[y, 1:] = np.cumsum(own, axis=0) % 256
        elif rule == 2:
            out[y, 1:] = (own + up[1:]) % 256
        else:
            for x in range(1, w + 1):
                left = out[y, x - 1]
                if rule == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - up[x - 1]
                    a, b, d = abs(p - left), abs(p - up[x]), abs(p - up[x - 1])
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up[x], up[x - 1]))
                out[y, x] = (own[x - 1] + guess) % 256
    image = out[1:, 1:].astype(np.uint8)
    rgb = np.repeat(image[..., :1], 3, axis=2) if c < 3 else image[..., :3]
    alpha = image[..., -1:] if c in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], axis=2)


def box(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Mean over 2r + 1 places, edges repeated."""
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r + 1, r)
    s = np.cumsum(np.pad(a.astype(float), pad, "edge"), axis=axis)
    n = a.shape[axis]
    hi, lo = np.take(s, range(2 * r + 1, 2 * r + 1 + n), axis=axis), np.take(s, range(n), axis=axis)
    return (hi - lo) / (2 * r + 1)


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian by three box means each way."""
    r = max(1, round((np.sqrt(4 * sigma * sigma + 1) - 1) / 2))
    for _ in range(3):
        a = box(box(a, r, 0), r, 1)
    return a


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact straight distance of each place to the nearest place outside the mask (infinite if there is none)."""
    h, w = mask.shape
    far = float(h + w)
    down = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        down[y] = np.minimum(down[y], down[y + 1] + 1)
    column = np.minimum(down, far * 4)
    x = np.arange(w)
    square = np.stack([(column[y][None] ** 2 + (x[:, None] - x[None]) ** 2).min(axis=1) for y in range(h)])
    return np.where(square >= (far * 4) ** 2, np.inf, np.sqrt(square))


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the 4-connected components, 0 outside; a component's number is that of its first place in order."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        near = np.where(mask, label, big)
        p = np.pad(near, 1, constant_values=big)
        least = np.minimum.reduce([near, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        new = np.where(mask, least, 0)
        new = np.where(mask, np.concatenate([[0], new.ravel()])[new], 0)  # the label's own label
        if (new == label).all():
            return label
        label = new


def decoded(images: DataFrame, visit: Callable[[np.ndarray], list[tuple]], schema: str, content: str = "content", path: str = "path") -> DataFrame:
    """Rows (path, ...) that ``visit`` makes of each image. ``schema`` names the columns after path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [path, *(c.strip().split(" ")[0] for c in schema.split(","))]
        for pdf in batches:
            yield pd.DataFrame([(p, *row) for p, raw in zip(pdf[path], pdf[content]) for row in visit(decode_png(bytes(raw)))], columns=names)

    return images.select(path, content).mapInPandas(run, f"{path} string, {schema}")
