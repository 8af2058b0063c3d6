"""Several images in one relation give what each gives alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import catalogues as C
from pixelspark.operators import filters as L
from pixelspark.operators import kernels as B
from pixelspark.operators import maps as M
from pixelspark.operators import models as D
from pixelspark.operators import pipeline as P
from pixelspark.operators import segments as G
from pixelspark.operators import stats as S

NX = NY = 24


def made(spark, seed):
    """An image of 24 x 24 with touching labels that differ from seed to seed."""
    rng = np.random.default_rng(seed)
    px = M.pixels_from_array(spark, rng.normal(20, 8, (NX, NY)).round(3).tolist())
    cut = F.col("x") % (5 + seed % 2) != 0
    return px.withColumn("segID", F.when((F.col("flux") > 12) & cut, F.expr(f"(x - 1) div {4 + seed % 3} + 6 * ((y - 1) div 6) + 1").cast("int")).otherwise(0))


@pytest.fixture(scope="module")
def images(spark):
    one = {n: made(spark, s).cache() for n, s in (("a", 1), ("b", 2))}
    both = one["a"].withColumn("image_id", F.lit("a")).unionByName(one["b"].withColumn("image_id", F.lit("b"))).cache()
    return one, both


def labels(px):
    return px.select(*[c for c in ("image_id", "x", "y", "segID") if c in px.columns])


def cat_of(px):
    out = S.segment_flux(px).join(S.moments(px), [*[c for c in ("image_id",) if c in px.columns], "segID"])
    return out.join(S.brightest(px), [*[c for c in ("image_id",) if c in px.columns], "segID"]).withColumns({"ang": F.lit(10.0), "axrat": F.lit(0.7), "cenfrac": F.lit(0.01), "sep": F.lit(1.0)})


def other(px):
    """A second map of the same pixels."""
    return labels(px.withColumn("segID", F.when(F.col("flux") > 18, F.expr("(x - 1) div 8 + 3 * ((y - 1) div 8) + 1").cast("int")).otherwise(0)))


def unique(px):
    return cat_of(px).withColumn("uniqueID", F.ceil("xmax") * 100 + F.ceil("ymax"))


def sources(px):
    return cat_of(px).withColumnRenamed("segID", "k")


PSF = B.gaussian_psf(5, 2.0)

RUNS = {
    "groups": lambda px: G.group_segments(labels(px))[0],
    "group_map": lambda px: G.group_segments(labels(px))[1],
    "auto_merge": lambda px: G.auto_merge(labels(px), cat_of(px), 0.5),
    "compare": lambda px: G.compare(labels(px), other(px)),
    "merge_maps": lambda px: G.merge_maps(labels(px), other(px), unique(px), unique(px.drop("segID").join(other(px), [*[c for c in ("image_id",) if c in px.columns], "x", "y"]))),
    "extend": lambda px: G.extend_map(labels(px), other(px)),
    "closure": lambda px: G.merge_closure(G.group_segments(labels(px))[0]),
    "gauss": lambda px: D.deblend_gauss(px.where("segID > 0"), G.group_segments(labels(px))[0], cat_of(px)),
    "line": lambda px: D.deblend_line(px.where("segID > 0"), G.group_segments(labels(px))[0], cat_of(px)),
    "iterative": lambda px: D.deblend_iterative(px.where("segID > 0"), G.group_segments(labels(px))[0], cat_of(px)),
    "psf": lambda px: D.deblend_psf(px.where("segID > 0"), G.group_segments(labels(px))[0], cat_of(px), PSF),
    "merge_groups": lambda px: C.merge_groups(S.segment_flux(px), S.segment_flux(px).withColumnRenamed("segID", "groupID"), G.group_segments(labels(px))[0], [1, 2, 3]),
    "nearest": lambda px: C.nearest(cat_of(px).where("segID % 2 = 0"), cat_of(px).where("segID % 2 = 1"), 6.0),
    "label_at": lambda px: C.label_at(cat_of(px).drop("label"), labels(px)),
    "resample": lambda px: L.resample(px, NX, NY, 1.5),
    "render": lambda px: L.render_points(cat_of(px), PSF, NX, NY),
    "psf_update": lambda px: D.psf_update(px.withColumn("sigma", F.lit(3.0)), sources(px), PSF),
    "psf_extract": lambda px: D.psf_extract(px.withColumn("sigma", F.lit(3.0)), sources(px), PSF),
}


def same(one, two):
    """Equal rows whatever their order; floats up to rounding, which depends on the order of sums."""
    order = sorted(one.columns)
    assert order == sorted(two.columns)
    key = lambda r: ([repr(v) for v in r if not isinstance(v, float)], [round(v, 3) + 0.0 for v in r if isinstance(v, float)])
    a, b = (sorted((tuple(r[c] for c in order) for r in df.collect()), key=key) for df in (one, two))
    assert a and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for c, v, w in zip(order, x, y, strict=True):
            assert v == w or isinstance(v, float) and v == pytest.approx(w, rel=1e-6, abs=1e-6, nan_ok=True), (c, v, w)


@pytest.mark.parametrize("name", RUNS)
def test_two_images_equal_two_runs(images, name):
    one, both = images
    got, run = RUNS[name](both), RUNS[name]
    assert "image_id" in got.columns
    for image_id, px in one.items():
        same(got.where(F.col("image_id") == image_id).drop("image_id"), run(px))


def test_detection_of_two_images(images):
    one, both = images
    c = P.Config(NX, NY, grid=12, box=12, iters=2, redosky=False, groups=True, deblend=True, magzero=25.0)
    given = {n: labels(px).where("segID > 0") for n, px in one.items()}
    pixels = both.drop("segID")
    run = P.detect(pixels, c, segmap=labels(both).where("segID > 0"))
    for image_id, px in one.items():
        alone = P.detect(px.drop("segID"), c, segmap=given[image_id])
        for name in ("segstats", "group", "deblend"):
            same(getattr(run, name).where(F.col("image_id") == image_id).drop("image_id"), getattr(alone, name))
