"""Crops and sharpness of decoded images: rows of Spark's image source, one byte per channel, BGR."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The two regions as shares of height and width (top, bottom, left, right), and the variance below
#: which an image is blurred.
REGIONS = [(0.0, 0.25, 0.0, 0.6), (0.25, 0.55, 0.0, 1.0)]
BLURRED = 100.0
#: Weights of blue, green and red in the grey value.
GREY = np.array([0.114, 0.587, 0.299])


def crop(image: np.ndarray, region: tuple[float, float, float, float]) -> np.ndarray:
    h, w = image.shape[:2]
    top, bottom, left, right = region
    return image[int(h * top) : int(h * bottom), int(w * left) : int(w * right)]


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of the grey image, borders reflected."""
    grey = np.rint(image[..., :3] @ GREY) if image.ndim == 3 and image.shape[2] >= 3 else image.reshape(image.shape[:2]).astype(float)
    g = np.pad(grey.astype(float), 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey.astype(float), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


@F.pandas_udf(DoubleType())
def sharpness(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Variance of the Laplacian; null for an image without pixels."""
    out = []
    for h, w, c, raw in zip(height, width, channels, data, strict=True):
        ok = raw is not None and h and w and len(raw) == h * w * c
        out.append(laplacian_variance(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), int(c))) if ok else None)
    return pd.Series(out, dtype=float)


def is_blurred(image: Column) -> Column:
    return sharpness(image["height"], image["width"], image["nChannels"], image["data"]) < BLURRED


#: Weights of a resampled pixel are whole numbers of 1/2048.
WEIGHT_BITS = 11


@lru_cache(maxsize=256)
def _taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of new pixels in a row of old ones: the two old pixels around its centre, and their weights."""
    centre = (np.arange(new) + 0.5) * (old / new) - 0.5
    left = np.floor(centre)
    share = np.where((left < 0) | (left >= old - 1), 0.0, centre - left)
    left = np.clip(left, 0, old - 1).astype(np.int64)
    one = 1 << WEIGHT_BITS
    return left, np.minimum(left + 1, old - 1), np.rint((1 - share) * one).astype(np.int64), np.rint(share * one).astype(np.int64)


def resample(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image in another size, each pixel between the four around its centre in proportion (bilinear)."""
    h, w = image.shape[:2]
    wide = image.astype(np.int64)
    if w != width:
        a, b, wa, wb = _taps(w, width)
        shape = (1, -1) + (1,) * (image.ndim - 2)
        wide = wide[:, a] * wa.reshape(shape) + wide[:, b] * wb.reshape(shape)
    else:
        wide = wide << WEIGHT_BITS
    if h != height:
        a, b, wa, wb = _taps(h, height)
        shape = (-1,) + (1,) * (image.ndim - 1)
        wide = wide[a] * wa.reshape(shape) + wide[b] * wb.reshape(shape)
    else:
        wide = wide << WEIGHT_BITS
    half = 1 << (2 * WEIGHT_BITS - 1)
    return ((wide + half) >> (2 * WEIGHT_BITS)).astype(np.uint8)


def stack(parts: list[np.ndarray]) -> np.ndarray:
    """The parts one below the other, each in its own height and all in the width of the widest one."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([p if p.shape[1] == width else resample(p, p.shape[0], width) for p in parts])


def resized(images: DataFrame, height: int, width: int) -> DataFrame:
    """Rows (key, height, width, nChannels, data) of images in one size; an image without pixels stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, h, w, c, raw in batch[["key", "height", "width", "nChannels", "data"]].itertuples(index=False):
                if raw is not None and h and w and len(raw) == h * w * c:
                    h, w, raw = height, width, resample(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), int(c)), height, width).tobytes()
                out.append((key, h, w, c, raw))
            yield pd.DataFrame(out, columns=["key", "height", "width", "nChannels", "data"])

    rows = images.select("key", "height", "width", "nChannels", "data")
    return rows.mapInPandas(run, rows.schema)


def regions(images: DataFrame, wanted: list[tuple[float, float, float, float]] = REGIONS) -> DataFrame:
    """Rows (key, height, width, nChannels, data) with each image replaced by its regions, stacked; an image without
    pixels stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, h, w, c, raw in batch[["key", "height", "width", "nChannels", "data"]].itertuples(index=False):
                if raw is not None and h and w and len(raw) == h * w * c:
                    image = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), int(c))
                    cut = [p for p in (crop(image, r) for r in wanted) if p.size]
                    if cut:
                        image = stack(cut)
                        h, w, raw = *image.shape[:2], image.tobytes()
                out.append((key, h, w, c, raw))
            yield pd.DataFrame(out, columns=["key", "height", "width", "nChannels", "data"])

    rows = images.select("key", "height", "width", "nChannels", "data")
    return rows.mapInPandas(run, rows.schema)
