import struct

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import images
from tidemark.functions import vectors as V


def bmp(picture):
    """A bitmap file of (height, width, 3) red, green, blue."""
    h, w, _ = picture.shape
    rows = b"".join(r.tobytes() + b"\0" * (-3 * w % 4) for r in picture[::-1, :, ::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def slow(picture, side):
    """Bicubic over a growing support, pixel by pixel."""

    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def line(values, side):
        n, out = len(values), []
        scale = max(n / side, 1.0)
        for k in range(side):
            centre = (k + 0.5) * n / side
            own = range(max(int(centre - 2 * scale + 0.5), 0), min(int(centre + 2 * scale + 0.5), n))
            w = [kernel((i + 0.5 - centre) / scale) for i in own]
            out.append(min(max(int(np.floor(sum(a * float(values[i]) for a, i in zip(w, own, strict=True)) / sum(w) + 0.5)), 0), 255))
        return out

    wide = np.array([[line(r[:, c], side) for c in range(3)] for r in picture]).transpose(0, 2, 1)
    return np.array([[line(wide[:, x, c], side) for c in range(3)] for x in range(side)]).transpose(2, 0, 1)


def test_resampling_equals_pixel_by_pixel():
    rng = np.random.default_rng(3)
    for h, w in ((16, 16), (40, 23), (5, 9), (1, 1), (100, 3)):
        picture = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        got, wanted = images.resized(picture, 16).astype(int), slow(picture, 16)
        assert np.abs(got - wanted).max() <= 1 and (got != wanted).mean() < 0.01
    assert (images.resized(np.full((50, 70, 3), 77, np.uint8), 16) == 77).all()


def test_images_of_the_image_source(spark, tmp_path):
    rng = np.random.default_rng(4)
    pictures = {f"{k}.bmp": rng.integers(0, 256, (30 + k, 20, 3)).astype(np.uint8) for k in range(3)}
    for name, p in pictures.items():
        (tmp_path / name).write_bytes(bmp(p))
    (tmp_path / "broken.bmp").write_bytes(b"no picture")
    rows = spark.read.format("image").load(str(tmp_path)).select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image")
    found = {r.name: r for r in rows.select("name", images.image_words(F.col("image")).alias("w"), images.image_input(F.col("image")).alias("x")).collect()}
    assert found["broken.bmp"].w is None and found["broken.bmp"].x is None
    for name, p in pictures.items():
        assert found[name].w == images.hash_text(p) and len(found[name].w.split()) == 15 * 16 + 3 * 256
        assert np.allclose(np.array(found[name].x).reshape(3, 224, 224), images.encoder_input(p), atol=1e-6)
    direct = V.hashed_features(spark.createDataFrame([(n, images.hash_text(p)) for n, p in pictures.items()], "name string, t string"), "name", "t")
    key = lambda df: sorted((r.name, r.bucket, round(r.weight, 9)) for r in df.collect())
    assert key(images.hashed_images(rows, "name")) == key(direct)


def test_grey_and_transparent_pictures():
    grey = images.red_green_blue(1, 2, 1, bytes([5, 9]))
    assert grey.tolist() == [[[5, 5, 5], [9, 9, 9]]]
    assert images.red_green_blue(1, 1, 4, bytes([1, 2, 3, 200])).tolist() == [[[3, 2, 1]]]
