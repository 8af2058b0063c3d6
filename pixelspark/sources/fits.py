"""SRC-2, D14: primary images of FITS files as pixel relations, through Spark's binary reader.

A file is one row of bytes and is decoded on the executors; a pixel relation comes out as chunks
of rows, so memory follows the largest file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2880
# BITPIX codes of the format.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def read_header(data: bytes) -> tuple[dict[str, str], int]:
    """Keys and values of the first header, and where its data starts."""
    cards: dict[str, str] = {}
    at = 0
    while at < len(data):
        for i in range(at, at + BLOCK, 80):
            card = data[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at + BLOCK
            if card[8:10] == "= ":
                value = card[10:].strip()
                if value.startswith("'"):
                    end = value.replace("''", "\0\0").find("'", 1)
                    value = value[1 : end if end > 0 else None].replace("''", "'").rstrip()
                else:
                    value = value.split("/")[0].strip()
                cards[key] = value
        at += BLOCK
    raise ValueError("no END card")


def read_image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and image[x, y] (the first axis is x); BLANK becomes NaN, BSCALE and BZERO are applied."""
    header, at = read_header(data)
    nx, ny = int(header["NAXIS1"]), int(header["NAXIS2"])
    kind = np.dtype(TYPES[int(header["BITPIX"])])
    raw = np.frombuffer(data, kind, nx * ny, at).reshape(ny, nx).T
    image = raw.astype(float)
    if kind.kind in "iu" and "BLANK" in header:
        image[raw == int(header["BLANK"])] = np.nan
    return header, image * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))


def write_image(image: np.ndarray, header: dict[str, str] | None = None) -> bytes:
    """A FITS file of doubles; for fixtures and small exports."""
    nx, ny = image.shape
    cards = {"SIMPLE": "T", "BITPIX": "-64", "NAXIS": "2", "NAXIS1": str(nx), "NAXIS2": str(ny), **(header or {})}
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
    body = np.ascontiguousarray(image.T, dtype=">f8").tobytes()
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode() + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def fits_pixels(spark: SparkSession, folder: str, bands: list[str] | None = None) -> DataFrame:
    """Pixels (band, x, y, flux) of ``<band>.fits`` files; a NaN pixel is NULL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.fits$", 1).alias("band"), "content")
    if bands is not None:
        named = named.where(F.col("band").isin(bands))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for band, content in zip(pdf["band"], pdf["content"], strict=True):
                _, image = read_image(content)
                for y in range(image.shape[1]):
                    yield pd.DataFrame({"band": band, "x": np.arange(1, image.shape[0] + 1, dtype=np.int32), "y": np.int32(y + 1), "flux": image[:, y]})

    out = named.mapInPandas(run, "band string, x int, y int, flux double")
    return out.withColumn("flux", F.when(~F.isnan("flux"), F.col("flux")))


def fits_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers (band, nx, ny, keyvalues) of the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for band, content in zip(pdf["band"], pdf["content"], strict=True):
                header, _ = read_header(content)
                yield pd.DataFrame({"band": [band], "nx": [int(header["NAXIS1"])], "ny": [int(header["NAXIS2"])], "keyvalues": [header]})

    return files.select(F.regexp_extract("path", r"([^/]+)\.fits$", 1).alias("band"), "content").mapInPandas(run, "band string, nx int, ny int, keyvalues map<string,string>")
