"""Pictures of maps as PNG (SNK-2, SNK-3, SNK-4), without a plotting library.

Pixels are averaged on the executors to at most ``most`` places a side, so the driver gets a picture
of bounded size from an image of any size.
"""

from __future__ import annotations

import zlib
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import edge_pixels

GAP = 4  # white columns between panels


def png(rgb: np.ndarray) -> bytes:
    """An array (height, width, 3) of bytes as a PNG file."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1).tobytes()
    part = lambda name, data: pack(">I", len(data)) + name + data + pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def reduced(pixels: DataFrame, nx: int, ny: int, columns: list[str], most: int = 1000) -> tuple[dict[str, np.ndarray], int]:
    """Means of columns on a grid of at most ``most`` places a side, as arrays (x, y), and the width of a place."""
    step = -(-max(nx, ny) // most)
    shape = -(-nx // step), -(-ny // step)
    got = pixels.groupBy(F.floor((F.col("x") - 1) / step).alias("i"), F.floor((F.col("y") - 1) / step).alias("j")).agg(*(F.avg(c).alias(c) for c in columns)).toArrow()
    i, j = got.column("i").to_numpy(), got.column("j").to_numpy()
    out = {}
    for c in columns:
        out[c] = np.full(shape, np.nan)
        out[c][i, j] = got.column(c).to_numpy()
    return out, step


def grey(values: np.ndarray, lo: float = 0.01, hi: float = 0.995) -> np.ndarray:
    """Grey levels of an array (x, y) between two quantiles, stretched by asinh; y runs upwards; NaN is blue."""
    good = np.isfinite(values)
    a, b = np.quantile(values[good], [lo, hi]) if good.any() else (0.0, 1.0)
    level = np.arcsinh(10 * np.clip((np.where(good, values, a) - a) / (b - a if b > a else 1.0), 0, 1)) / np.arcsinh(10)
    rgb = np.repeat((255 * level).round().astype(np.uint8)[:, :, None], 3, axis=2)
    rgb[~good] = (40, 60, 160)
    return rgb.transpose(1, 0, 2)[::-1]


def panels(pictures: list[np.ndarray]) -> np.ndarray:
    """Pictures side by side."""
    white = np.full((max(p.shape[0] for p in pictures), GAP, 3), 255, np.uint8)
    row = []
    for p in pictures:
        row += [np.pad(p, ((0, white.shape[0] - p.shape[0]), (0, 0), (0, 0)), constant_values=255), white]
    return np.concatenate(row[:-1], axis=1)


def diagnostic_plot(pixels: DataFrame, nx: int, ny: int, columns: list[str], most: int = 1000) -> bytes:
    """SNK-2: maps of a run (flux, sky, skyRMS, SBlim, ...) side by side."""
    got, _ = reduced(pixels, nx, ny, columns, most)
    return png(panels([grey(got[c]) for c in columns]))


def psf_plot(image: DataFrame, model: DataFrame, nx: int, ny: int, most: int = 1000) -> bytes:
    """SNK-3: image, model and what the model leaves."""
    both = image.select("x", "y", "flux").join(model.select("x", "y", F.col("flux").alias("model")), ["x", "y"], "left")
    both = both.withColumn("model", F.coalesce("model", F.lit(0.0))).withColumn("left", F.col("flux") - F.col("model"))
    return diagnostic_plot(both, nx, ny, ["flux", "model", "left"], most)


def segment_plot(pixels: DataFrame, segmap: DataFrame, nx: int, ny: int, most: int = 1000) -> bytes:
    """SNK-4: the image with the outlines of its segments in colours that follow from their labels."""
    got, step = reduced(pixels, nx, ny, ["flux"], most)
    out = grey(got["flux"]).copy()
    edge = edge_pixels(segmap).groupBy(F.floor((F.col("x") - 1) / step).alias("i"), F.floor((F.col("y") - 1) / step).alias("j")).agg(F.min("segID").alias("segID")).toArrow()
    i, j, s = (edge.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "segID"))
    hue = s * 0.618034 % 1
    colour = 0.5 + 0.5 * np.cos(2 * np.pi * (hue[:, None] + np.array([0, 1 / 3, 2 / 3])))
    out[out.shape[0] - 1 - j, i] = (80 + 175 * colour).astype(np.uint8)
    return png(out)
