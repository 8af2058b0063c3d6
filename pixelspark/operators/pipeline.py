"""Entry points: detection on one image (PIP-*), several bands (CAT-2), segments from an image (SEG-4, SEG-6)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import flux_scale, flux_to_sb
from ..lineage import cut, drop
from ..model import Run, keys_of, shared_keys
from . import catalogues, filters, kernels, maps, models, segments, sky, stats
from .watershed import watershed


@dataclass(frozen=True)
class Config:
    """Parameters of the pipeline, with the usual defaults."""

    nx: int
    ny: int
    skycut: float = 1.0
    pixcut: int = 3
    tolerance: float = 4.0
    ext: int = 2
    reltol: float = 0.0
    cliptol: float = float("inf")
    sigma: float = 1.0
    smooth: bool = True
    sb_limit: float | None = None
    sb_dilate: float = 2.0
    sb_n100: int = 100
    size: int = 5
    shape: str = "disc"
    iters: int = 6
    threshold: float = 1.05
    magzero: float = 0.0
    gain: float | None = None
    pixscale: float = 1.0
    grid: int = 100
    box: int = 100
    skytype: str = "median"
    rmstype: str = "quanlo"
    interpolation: str = "bilinear"
    redosky: bool = True
    redoskysize: int = 21
    final_sky: str = "reference"  # 'always', or only where a mask exists
    local_sky: bool = False
    rotstats: bool = False
    boundstats: bool = False
    near: bool = False
    groups: bool = False
    deblend: bool = False
    flux_unit: str = "Raw"
    static: bool = False
    cor_err: dict[float, float] | Callable | None = field(default=None, hash=False)
    app_diam: float | None = None
    header: dict[str, float] | None = field(default=None, hash=False)


def static_photometry(config: Config) -> Config:
    """PIP-3: photometry of given segments as they are."""
    from dataclasses import replace

    return replace(config, static=True, iters=0, redosky=False)


def make_sky(pixels: DataFrame, c: Config) -> DataFrame:
    if c.static:
        return pixels.drop("sky", "skyRMS").withColumns({"sky": F.lit(0.0), "skyRMS": F.lit(1.0)})
    return sky.sky_map(pixels, c.nx, c.ny, min(c.grid, c.nx, c.ny), min(c.box, c.nx, c.ny), c.skytype, c.rmstype, c.interpolation)


def signal(pixels: DataFrame, c: Config) -> DataFrame:
    """S/N image, blurred if wanted, below-threshold and masked pixels zero."""
    keys = [*keys_of(pixels), "x", "y"]
    sn = maps.threshold(pixels, -1e300)
    if c.smooth:
        sn = pixels.join(filters.blur(sn.select(*keys, "sn"), c.sigma, "sn"), keys)
    keep = (F.col("sn") > c.skycut) & (F.coalesce(F.col("mask"), F.lit(0)) == 0)
    if c.sb_limit is not None:
        keep = keep & (flux_to_sb(F.col("sn") * F.col("skyRMS"), c.magzero, c.pixscale) < c.sb_limit)
    return sn.withColumn("sn", F.when(keep, F.col("sn")).otherwise(0.0))


def make_segments(pixels: DataFrame, c: Config) -> DataFrame:
    """SEG-4: label map of an image whose sky is known."""
    return watershed(signal(pixels, c), c.skycut, c.pixcut, c.ext, c.tolerance, c.reltol, c.cliptol)


def dilate_with_stats(pixels: DataFrame, segmap: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """SEG-6: dilated map (masked pixels without label) and its catalogue."""
    grown = segments.dilate(segmap, kernels.brush(c.size, c.shape), c.nx, c.ny)
    px = labelled(pixels, grown)
    return grown, stats.segment_stats(px, c.nx, c.ny, c.magzero, c.gain, c.pixscale)


def labelled(pixels: DataFrame, segmap: DataFrame) -> DataFrame:
    """JN-4: pixels with their label, 0 where there is none or the pixel is masked."""
    keys = [*keys_of(pixels), "x", "y"]
    out = pixels.drop("segID").join(segmap.select(*keys, "segID"), keys, "left")
    return out.withColumn("segID", F.when(F.coalesce(F.col("mask"), F.lit(0)) != 0, 0).otherwise(F.coalesce("segID", F.lit(0))))


def grow(pixels: DataFrame, segmap: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """PIP-2: the growth loop; returns the map and (segID, iter, flux, N100) of the kept state.

    A segment goes on while its flux grew by more than the threshold (or its ring is brighter than
    its limit and large), the flux is positive, the ring is fainter than the last one, and it
    grew in the round before.  Only rings of growing segments are taken.
    """
    net = pixels.withColumn("net", F.col("flux") - F.col("sky"))
    keys = [*keys_of(pixels), "segID"]
    brush = kernels.brush(c.size, c.shape)
    cols = [*keys_of(pixels), "x", "y"]

    def fluxes(seg: DataFrame) -> DataFrame:
        px = labelled(net, seg).where("segID > 0")
        return px.groupBy(*keys).agg(F.coalesce(F.sum("net"), F.lit(0.0)).alias("f"), F.count("net").alias("n"), F.avg("skyRMS").alias("rms"))

    state = fluxes(segmap).select(*keys, "f", "n", (F.col("rms") * 10 ** (-0.4 * c.sb_dilate)).alias("limit"), F.lit(float("inf")).alias("ring"), F.lit(True).alias("alive"), F.lit(0).alias("iter"), F.col("f").alias("f0"), F.col("n").alias("n0"))
    state, seg = cut(state), segmap
    for i in range(1, c.iters + 1):
        alive = state.where("alive").select(*keys)
        if alive.isEmpty():
            break
        bigger = segments.dilate(seg, brush, c.nx, c.ny, expand=alive)
        new = fluxes(bigger).select(*keys, F.col("f").alias("f1"), F.col("n").alias("n1"))
        s = state.join(new, keys, "left")
        ring = F.try_divide(F.col("f1") - F.col("f"), F.col("n1") - F.col("n"))
        go = F.expr("alive and f1 > 0 and n1 > n") & (ring < F.col("ring")) & ((F.try_divide("f1", "f") > c.threshold) | ((ring > F.col("limit")) & (F.col("n1") - F.col("n") > c.sb_n100)))
        s = s.withColumn("go", F.coalesce(go, F.lit(False)))
        state = cut(
            s.select(*keys, F.when(F.col("go"), F.col("f1")).otherwise(F.col("f")).alias("f"), F.when(F.col("go"), F.col("n1")).otherwise(F.col("n")).alias("n"), "limit", F.when(F.col("go"), ring).otherwise(F.col("ring")).alias("ring"), F.col("go").alias("alive"), F.when(F.col("go"), F.lit(i)).otherwise(F.col("iter")).alias("iter"), "f0", "n0")
        )
        took = state.where("alive").select(*keys, F.lit(True).alias("took"))
        fresh = bigger.join(seg.select(*cols), cols, "left_anti").join(took, keys, "left_semi")
        seg = cut(seg.select(*cols, "segID").unionByName(fresh.select(*cols, "segID")))
    return seg, state.select(*keys, "iter", "f0", "n0", F.col("f").alias("flux_grown"))


def detect(pixels: DataFrame, c: Config, segmap: DataFrame | None = None, flag: float | None = None) -> Run:
    """PIP-1: sky, segments, growth, statistics, and on demand adjacency, groups and deblending.

    ``pixels`` holds x, y, flux, optionally mask and the image keys.  With ``segmap`` detection is
    skipped.  Without any detection the catalogue is empty.
    """
    keys = [*keys_of(pixels), "x", "y"]
    has_mask = "mask" in pixels.columns
    px = maps.with_mask(pixels, flag)
    given = segmap is not None
    now = make_sky(px.withColumn("objects", F.lit(0)), c)
    now = cut(now)
    seg = segmap.where("segID > 0") if given else cut(make_segments(now, c))
    if c.redosky and not given and not seg.isEmpty():
        wide = segments.dilate(seg, kernels.brush(c.redoskysize, "disc"), c.nx, c.ny).select(*keys, F.lit(1).alias("objects"))
        now = cut(make_sky(px.join(wide, keys, "left").na.fill({"objects": 0}), c))
    first = seg
    seg, history = grow(now, seg, c)
    if c.redosky and not given and (c.final_sky == "always" or has_mask):
        wide = segments.dilate(seg, kernels.brush(c.redoskysize, "disc"), c.nx, c.ny).select(*keys, F.lit(1).alias("objects"))
        now = cut(make_sky(px.join(wide, keys, "left").na.fill({"objects": 0}), c))
    if c.local_sky:
        now = local_annulus_sky(now, seg, c)
    net = labelled(now, seg).withColumn("flux", F.col("flux") - F.col("sky"))
    cat = stats.segment_stats(net, c.nx, c.ny, c.magzero, c.gain, c.pixscale, c.rotstats, c.boundstats, c.cor_err, app_diam=c.app_diam, header=c.header)
    ids = [*keys_of(pixels), "segID"]
    ring_sky = labelled(now, segments.dilate(seg, kernels.brush(c.size, c.shape), c.nx, c.ny).join(seg.select(*keys), keys, "left_anti")).where("segID > 0").groupBy(*ids).agg(F.avg(F.col("flux") - F.col("sky")).alias("skyseg_mean"))
    cat = cat.join(history, ids, "left").join(ring_sky, ids, "left")
    cat = cat.withColumn("origfrac", F.try_divide("f0", "flux")).withColumnRenamed("n0", "Norig").drop("f0", "flux_grown")
    last = cat.where(F.col("iter") == c.iters).groupBy(*keys_of(pixels)).agg(F.percentile("origfrac", 0.5).alias("mid"))
    cat = cat.join(last, keys_of(pixels), "left") if keys_of(pixels) else cat.crossJoin(F.broadcast(last))
    cat = cat.withColumn("flag_keep", (F.col("iter") < c.iters) | F.coalesce(F.col("origfrac") >= F.col("mid"), F.lit(True))).drop("mid")
    f = flux_scale(c.flux_unit, c.magzero)
    if f != 1.0:
        cat = cat.withColumns({n: F.col(n) * f for n in ("flux", "flux_app", "flux_reflect", "flux_err", "flux_err_sky", "flux_err_skyRMS", "flux_err_shot", "flux_err_cor")})
    cat = cut(cat)
    out = {"segim": seg, "segim_orig": first, "sky": now.select(*keys, "sky", "skyRMS"), "SBlim": maps.sb_limit_map(now, c.skycut, c.magzero, c.pixscale).select(*keys, "SBlim"), "segstats": cat, "objects": seg.select(*keys)}
    out["diagnostics"] = stats.sky_diagnostics(labelled(now, seg))
    if c.near:
        out["near"] = segments.near(labelled(now, seg).select(*keys, "segID"))
    if c.groups or c.deblend:
        groups, groupim = segments.group_segments(seg)
        out |= {"group": groups, "groupim": groupim}
        grouped = labelled(now, groupim.withColumnRenamed("groupID", "segID")).withColumn("flux", F.col("flux") - F.col("sky"))
        out["groupstats"] = stats.segment_stats(grouped, c.nx, c.ny, c.magzero, c.gain, c.pixscale).withColumnRenamed("segID", "groupID")
        if c.deblend:
            db = models.deblend_line(net.where("segID > 0").select(*keys, "flux", "segID"), groups, cat, c.magzero)
            out["not_deblended"] = models.too_large(groups)
            out["deblend"] = models.deblend_errors(db, cat)
    return Run(out)


def local_annulus_sky(pixels: DataFrame, segmap: DataFrame, c: Config) -> DataFrame:
    """PIP-4: inside each segment the sky rises by the mean of its next dilation ring."""
    keys = [*keys_of(pixels), "x", "y"]
    ids = [*keys_of(pixels), "segID"]
    ring = segments.dilate(segmap, kernels.brush(c.size, c.shape), c.nx, c.ny).join(segmap.select(*keys), keys, "left_anti")
    mean = labelled(pixels, ring).where("segID > 0").groupBy(*ids).agg(F.avg(F.col("flux") - F.col("sky")).alias("extra"))
    return labelled(pixels, segmap).join(mean, ids, "left").withColumn("sky", F.col("sky") + F.coalesce("extra", F.lit(0.0))).drop("extra", "segID")


def multiband(pixels: DataFrame, detect_bands: list[str], bands: list[str], config: dict[str, tuple[float, float]], c: Config) -> Run:
    """CAT-2: detection on one band or an inverse-variance stack, then photometry of every band at once.

    ``config[band]`` is (zero point, sky RMS).  Total photometry uses the grown map, colour photometry the
    first one; each is one grouping over all bands.
    """
    px = maps.bands_present(pixels, sorted({*detect_bands, *bands}))
    if len(detect_bands) == 1:
        base = px.where(F.col("band") == detect_bands[0]).drop("band")
    else:
        base = catalogues.stack(px.where(F.col("band").isin(detect_bands)), {b: config[b] for b in detect_bands}, c.magzero).select(*[k for k in ("image_id",) if k in px.columns], "x", "y", "flux")
    run = detect(base, c)
    zero = {b: config[b][0] for b in bands}
    wanted = px.where(F.col("band").isin(bands))
    wide = lambda seg, suffix: catalogues.bands_wide(catalogues.band_photometry(wanted, seg, zero), bands, ["flux", "N100", "mag"], suffix)
    frames = dict(run.frames)
    frames["cat_tot"] = wide(run.segim, "t")
    frames["cat_col"] = wide(run.segim_orig, "c")
    if "groupim" in frames:
        frames["cat_grp"] = wide(run.groupim.withColumnRenamed("groupID", "segID"), "g")
    return Run(frames)


def fit_with_extra(image: DataFrame, sources: DataFrame, psf: kernels.Kernel, c: Config, rounds: int = 5) -> DataFrame:
    """FIT-6: PSF photometry, detection on what it leaves, and photometry again with the found sources.

    ``image`` has x, y, flux, sigma; extra sources get keys above the present ones.  Returns the rows of
    ``sources`` from the second fit and the extra ones with ``extra`` true.
    """
    first = models.psf_fit(image, sources, psf, c.nx, c.ny, rounds, magzero=c.magzero)
    ids = shared_keys(image, sources)
    whole = F.floor(F.col("xcen") + 0.5) - 0.5, F.floor(F.col("ycen") + 0.5) - 0.5
    model = filters.render_points(first.select(*ids, whole[0].alias("xcen"), whole[1].alias("ycen"), "flux"), psf, c.nx, c.ny).withColumnRenamed("flux", "model")
    left = image.join(model, [*ids, "x", "y"], "left").select(*ids, "x", "y", (F.col("flux") - F.coalesce("model", F.lit(0.0))).alias("flux"))
    found = detect(left, c).segstats.where("flux > 0 and xcen is not null")
    shift = F.broadcast(sources.agg(F.max("k").alias("shift")))
    extra = found.crossJoin(shift).select(*ids, (F.col("segID") + F.coalesce("shift", F.lit(0))).alias("k"), "xcen", "ycen", "flux")
    every = sources.select(*ids, "k", "xcen", "ycen", "flux").unionByName(extra)
    again = models.psf_fit(image, every, psf, c.nx, c.ny, rounds, magzero=c.magzero)
    return again.join(sources.select(*ids, "k", F.lit(False).alias("extra")), [*ids, "k"], "left").withColumn("extra", F.coalesce("extra", F.lit(True)))


def propagate(pixels: DataFrame, segmap: DataFrame, lam: float = 1e-4) -> DataFrame:
    """SEG-8: every pixel takes the label it is reached from at the least cost.

    A step between neighbours costs sqrt((difference of values)^2 + lam) / sqrt(1 + lam).  Costs are
    relaxed for all pixels at once until none changes; ties go to the smaller label.
    """
    keys = keys_of(pixels)
    start = pixels.join(segmap.where("segID > 0").select(*keys, "x", "y", "segID"), [*keys, "x", "y"], "left").select(*keys, "x", "y", "flux", F.when(F.col("segID").isNotNull(), 0.0).alias("cost"), "segID")
    around = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in segments.AROUND))
    now = cut(start)
    while True:  # costs only fall, so this ends
        sent = now.where("segID is not null").withColumn("k", F.explode(around)).select(*keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y"), F.col("flux").alias("v"), F.col("cost").alias("c0"), F.col("segID").alias("s"))
        step = F.col("c0") + F.sqrt(F.pow(F.col("flux") - F.col("v"), 2) + lam) / (1 + lam) ** 0.5
        best = sent.join(now.select(*keys, "x", "y", "flux"), [*keys, "x", "y"]).groupBy(*keys, "x", "y").agg(F.min(F.struct(step.alias("c"), "s")).alias("b"))
        both = now.join(best, [*keys, "x", "y"], "left")
        better = F.coalesce((F.col("b.c") < F.col("cost") - 1e-12) | (F.col("cost").isNull() & F.col("b.c").isNotNull()), F.lit(False))
        nxt = cut(both.select(*keys, "x", "y", "flux", F.when(better, F.col("b.c")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("b.s")).otherwise(F.col("segID")).alias("segID"), better.alias("moved")))
        drop(now)
        if nxt.where("moved").isEmpty():
            return nxt.select(*keys, "x", "y", "segID")
        now = nxt


def texture(pixels: DataFrame, levels: int = 8) -> DataFrame:
    """AGG-25: Haralick features of each segment from its co-occurrence of neighbouring grey levels.

    Grey levels divide each segment's range; pairs to the right and above count both ways.
    Returns the thirteen features: angular second moment, contrast, correlation, variance, inverse difference moment,
    average, variance and entropy of the sum, entropy, variance and entropy of the difference, and two information measures.
    """
    keys = [*keys_of(pixels), "segID"]
    good = pixels.where("segID > 0 and flux is not null")
    span = good.groupBy(*keys).agg(F.min("flux").alias("lo"), F.max("flux").alias("hi"))
    g = good.join(span, keys).select(*keys, "x", "y", F.least(F.coalesce(F.floor(F.try_divide(F.col("flux") - F.col("lo"), F.col("hi") - F.col("lo")) * levels), F.lit(0)), F.lit(levels - 1)).cast("double").alias("g"))
    moved = g.withColumn("k", F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"))))).select(*keys, (F.col("x") + F.col("k.i")).alias("x"), (F.col("y") + F.col("k.j")).alias("y"), F.col("g").alias("h"))
    pairs = g.join(moved, [*keys, "x", "y"]).select(*keys, F.explode(F.array(F.struct(F.col("g").alias("a"), F.col("h").alias("b")), F.struct(F.col("h").alias("a"), F.col("g").alias("b")))).alias("p")).select(*keys, "p.a", "p.b")
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    p = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    # marginals of every cell, and the distributions of sum and difference
    p = p.withColumns({"pa": F.sum("p").over(Window.partitionBy(*keys, "a")), "pb": F.sum("p").over(Window.partitionBy(*keys, "b"))})
    m = p.groupBy(*keys).agg(
        F.sum(F.expr("p * p")).alias("asm"), F.sum(F.expr("p * (a - b) * (a - b)")).alias("contrast"), F.sum(F.expr("p * a")).alias("ma"), F.sum(F.expr("p * a * a")).alias("maa"), F.sum(F.expr("p * a * b")).alias("mab"), F.sum(F.expr("p / (1 + (a - b) * (a - b))")).alias("idm"), F.sum(F.expr("-p * ln(p)")).alias("entropy"), F.sum(F.expr("-p * ln(pa * pb)")).alias("hxy1")
    )
    per_level = p.groupBy(*keys, "a").agg(F.sum("p").alias("p"))
    levels_ = per_level.groupBy(*keys).agg(F.sum(F.expr("-p * ln(p)")).alias("hx"))

    def spread(of: str, name: str) -> DataFrame:
        d = p.groupBy(*keys, F.expr(of).alias("v")).agg(F.sum("p").alias("p"))
        return d.groupBy(*keys).agg(F.sum(F.expr("p * v")).alias(f"{name}_mean"), F.sum(F.expr("p * v * v")).alias(f"{name}_square"), F.sum(F.expr("-p * ln(p)")).alias(f"{name}_entropy"))

    m = m.join(levels_, keys).join(spread("a + b", "sum"), keys).join(spread("abs(a - b)", "diff"), keys)
    # the matrix is symmetric, so both marginals have one entropy and hxy2 is twice it
    hxy2 = 2 * F.col("hx")
    return m.select(
        *keys, "asm", "contrast", F.try_divide(F.expr("mab - ma * ma"), F.expr("maa - ma * ma")).alias("correlation"), F.expr("maa - ma * ma").alias("variance"), "idm",
        F.col("sum_mean").alias("sum_average"), F.expr("sum_square - sum_mean * sum_mean").alias("sum_variance"), "sum_entropy", "entropy", F.expr("diff_square - diff_mean * diff_mean").alias("diff_variance"), "diff_entropy",
        F.try_divide(F.col("entropy") - F.col("hxy1"), "hx").alias("information1"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (hxy2 - F.col("entropy"))))).alias("information2"),
    )
