"""Features of images as Spark's image source gives them (height, width, nChannels, data in BGR order).

Resampling is bicubic over a support that grows with the reduction, rows and columns apart, with bytes
between the two, as common image libraries do it. A batch of images is one matrix product a size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vectors as V

SIDE = 224
# Mean and deviation of red, green and blue that image encoders expect.
MEAN, DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
#: Side of the picture that a hash is made of, and how many values of a colour are one bucket.
HASHED, BUCKET = 16, 32


@lru_cache(maxsize=256)
def weights(have: int, want: int) -> np.ndarray:
    """(want, have): what each old pixel adds to each new one."""
    scale = max(have / want, 1.0)
    centre = (np.arange(want) + 0.5) * have / want
    first = np.maximum((centre - 2 * scale + 0.5).astype(int), 0)
    last = np.minimum((centre + 2 * scale + 0.5).astype(int), have)
    at = np.arange(have)
    x = np.abs((at[None] + 0.5 - centre[:, None]) / scale)
    near, far = 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    found = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    found[(at[None] < first[:, None]) | (at[None] >= last[:, None])] = 0
    return found / found.sum(axis=1, keepdims=True)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def resized(picture: np.ndarray, side: int) -> np.ndarray:
    """(side, side, 3) bytes of (height, width, 3) bytes."""
    wide = _bytes(np.einsum("wx,hxc->hwc", weights(picture.shape[1], side), picture.astype(np.float64)))
    return _bytes(np.einsum("hy,ywc->hwc", weights(picture.shape[0], side), wide)).astype(np.uint8)


def red_green_blue(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Of one, three or four channels, without what isn't colour."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def hash_text(picture: np.ndarray) -> str:
    """Numbers of edges and colours of a small picture, as words."""
    small = resized(picture, HASHED).astype(np.float32)
    edges = np.abs(np.diff(small.mean(axis=2), axis=0)).ravel() * np.float32(100)
    colours = [small[..., c].ravel() // BUCKET for c in range(3)]
    return " ".join(str(int(x)) for x in np.concatenate([edges, *colours]))


def encoder_input(picture: np.ndarray) -> np.ndarray:
    """Red, green and blue planes of ``SIDE`` x ``SIDE``, of mean 0 and deviation 1."""
    scaled = (resized(picture, SIDE).astype(np.float32) / 255 - np.float32(MEAN)) / np.float32(DEVIATION)
    return scaled.transpose(2, 0, 1).astype(np.float32)


def _each(image: Column, kind: str, of) -> Column:
    """``of`` each picture; null for one that couldn't be read."""

    @F.arrow_udf(kind)
    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for heights, widths, channels, data in columns:
            out = []
            for h, w, c, raw in zip(heights.to_pylist(), widths.to_pylist(), channels.to_pylist(), data.to_pylist(), strict=True):
                out.append(of(red_green_blue(h, w, c, raw)) if raw and h and w and h > 0 and w > 0 and c in (1, 3, 4) and len(raw) == h * w * c else None)
            yield pa.array(out, pa.string() if kind == "string" else pa.list_(pa.float32()))

    return run(*(image[k] for k in ("height", "width", "nChannels", "data")))


def image_words(image: Column) -> Column:
    """What a picture is hashed by (string): edges and colour buckets as words."""
    return _each(image, "string", hash_text)


def image_input(image: Column) -> Column:
    """A picture for an image encoder (array<float>, three planes one after the other)."""
    return _each(image, "array<float>", lambda p: encoder_input(p).ravel())


def hashed_images(images: DataFrame, id_col: str, image_col: str = "image") -> DataFrame:
    """(id, bucket, weight) of pictures by the hashing encoder; a picture that can't be read has no rows."""
    words = images.select(id_col, image_words(F.col(image_col)).alias("__words")).where("__words is not null")
    return V.hashed_features(words, id_col, "__words")
