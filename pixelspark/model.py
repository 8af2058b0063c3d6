"""Schemas and conventions: long relations, NULL for missing, x and y from 1.

The centre of pixel (x, y) is (x - 0.5, y - 0.5).  ``mask <> 0`` excludes a pixel.  Labels above
zero are segments.  Relations may carry ``image_id`` and ``band``; operators keep them as keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# DDL of the common relations, for readers with a given schema.
PIXELS = "image_id STRING, band STRING, x INT, y INT, flux DOUBLE, mask INT"
SEGMAP = "image_id STRING, x INT, y INT, segID INT"
SKYGRID = "image_id STRING, gx INT, gy INT, xc DOUBLE, yc DOUBLE, sky DOUBLE, skyRMS DOUBLE"
KERNEL = "dx INT, dy INT, w DOUBLE"
APERTURES = "k INT, cx DOUBLE, cy DOUBLE, rad DOUBLE, ang DOUBLE, axrat DOUBLE, wt DOUBLE, rad_re DOUBLE, nser DOUBLE"
IMAGES = "image_id STRING, nx INT, ny INT, magzero DOUBLE, gain DOUBLE, pixscale DOUBLE, keyvalues MAP<STRING, STRING>"


def keys_of(df: DataFrame) -> list[str]:
    """The image keys that a relation carries."""
    return [c for c in ("image_id", "band") if c in df.columns]


def shared_keys(*relations: DataFrame) -> list[str]:
    """The image keys that all of the relations carry."""
    return [c for c in keys_of(relations[0]) if all(c in df.columns for df in relations[1:])]


def with_summary(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the one row of their image in ``summary``; without keys that is a single row."""
    return rows.join(summary, keys, "left") if keys else rows.crossJoin(F.broadcast(summary))


@dataclass
class Run:
    """Named results of a pipeline (maps and catalogues)."""

    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None

    def write(self, path: str) -> None:
        """Each frame as Parquet below ``path``, partitioned by image where it has one."""
        for name, df in self.frames.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("image_id") if "image_id" in df.columns else writer).parquet(f"{path}/{name}")
