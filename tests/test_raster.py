import zlib

import numpy as np
import pytest

from lapidary.functions import raster

rng = np.random.default_rng(3)


def test_png_round_trip():
    image = rng.integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (raster.decode_png(raster.encode_png(image)) == image).all()
    with pytest.raises(ValueError):
        raster.decode_png(b"no image")


def test_png_filters():
    """Each line filter, written by its definition."""
    image = rng.integers(0, 256, (6, 4, 3)).astype(int)
    lines = b""
    zero = np.zeros(3, int)
    for y, rule in enumerate([0, 1, 2, 3, 4, 4]):
        line = []
        for x in range(4):
            a, b, c = image[y, x - 1] if x else zero, image[y - 1, x] if y else zero, image[y - 1, x - 1] if x and y else zero
            p = a + b - c
            paeth = [min(((abs(p[i] - v[i]), k, v[i]) for k, v in enumerate((a, b, c))), key=lambda t: t[:2])[2] for i in range(3)]
            line.append((image[y, x] - [zero, a, b, (a + b) // 2, np.array(paeth)][rule]) % 256)
        lines += bytes([rule]) + np.array(line).astype(np.uint8).tobytes()
    raw = raster.encode_png(np.zeros((6, 4, 4)))
    cut = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + b"\0\0\0\0"
    head = bytearray(raw[16:29])
    head[9] = 2
    file = raw[:8] + cut(b"IHDR", bytes(head)) + cut(b"IDAT", zlib.compress(lines)) + cut(b"IEND", b"")
    assert (raster.decode_png(file)[..., :3] == image).all()


def test_distance_against_all_places():
    mask = rng.random((9, 11)) > 0.2
    out = np.argwhere(~mask)
    want = np.array([[0.0 if not mask[y, x] else np.sqrt(((out - [y, x]) ** 2).sum(axis=1).min()) for x in range(11)] for y in range(9)])
    assert np.allclose(raster.distance(mask), want)
    assert np.isinf(raster.distance(np.ones((3, 3), bool))).all()


def test_components_against_flood():
    mask = rng.random((12, 12)) > 0.45
    label, seen, n = raster.components(mask), np.zeros((12, 12), int), 0
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        n, stack = n + 1, [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < 12 and 0 <= b < 12 and mask[a, b] and not seen[a, b]:
                seen[a, b] = n
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    pairs = set(zip(label[mask], seen[mask]))
    assert len(pairs) == n == len(set(label[mask])) and (label[~mask] == 0).all()


def test_blur_keeps_the_mean():
    a = np.zeros((31, 31))
    a[15, 15] = 1
    b = raster.blur(a, 2.0)
    assert b.sum() == pytest.approx(1) and b.max() == b[15, 15] and b[15, 10] == pytest.approx(b[10, 15])


def test_images_in_spark(spark):
    image = np.zeros((4, 6, 4), np.uint8)
    image[1:3, 1:3] = 255
    df = spark.createDataFrame([("a.png", bytearray(raster.encode_png(image)))], "path string, content binary")
    got = raster.decoded(df, lambda im: [(int((raster.components(im[..., 0] > 0) > 0).sum()),)], "n int").collect()
    assert [tuple(r) for r in got] == [("a.png", 4)]
