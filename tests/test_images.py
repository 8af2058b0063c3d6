"""Operators on small synthetic images: plain models, invariants, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import apertures as A
from pixelspark.operators import filters as L
from pixelspark.operators import kernels as B
from pixelspark.operators import maps as M
from pixelspark.operators import models as D
from pixelspark.operators import pipeline as P
from pixelspark.operators import segments as G
from pixelspark.operators import sky as K
from pixelspark.operators import stats as S
from pixelspark.operators.catalogues import stack
from pixelspark.operators.watershed import flood, watershed
from pixelspark.sources import fits


def image(spark, a):
    return M.pixels_from_array(spark, a.tolist())


def array(df, shape, column="flux"):
    out = np.full(shape, np.nan)
    for r in df.select("x", "y", column).collect():
        out[r["x"] - 1, r["y"] - 1] = np.nan if r[column] is None else r[column]
    return out


def plain_watershed(a, skycut, ext, abstol, pixcut):
    """Global flooding written from the rules, without components."""
    nx, ny = a.shape
    px = sorted(((-a[x, y], y, x) for x in range(nx) for y in range(ny) if a[x, y] > skycut))
    label, peak, count = {}, {}, 0
    for v, y, x in px:
        c, touching, best = -v, set(), None
        for dy in range(-ext, ext + 1):
            for dx in range(-ext, ext + 1):
                q = (x + dx, y + dy)
                if (dx or dy) and q in label:
                    touching.add(label[q])
                    if a[q] > c and (best is None or a[q] > best[0]):
                        best = (a[q], label[q])
        if best is None:
            count += 1
            label[x, y], peak[count] = count, c
        else:
            label[x, y] = best[1]
        touching = sorted(touching)
        weak = [s for s in touching[1:] if peak[s] - c < abstol]
        for s in weak:
            for q in [q for q in label if label[q] == s]:
                label[q] = touching[0]
    out = np.zeros(a.shape, int)
    for q, s in label.items():
        out[q] = s
    ids, n = np.unique(out, return_counts=True)
    for s, k in zip(ids, n, strict=True):
        if k < pixcut:
            out[out == s] = 0
    return out


@pytest.mark.parametrize("seed,ext,abstol", [(1, 1, 0.0), (2, 1, 2.0), (3, 2, 3.0)])
def test_watershed_equals_plain_model(spark, seed, ext, abstol):
    a = np.random.default_rng(seed).integers(0, 8, (14, 11)).astype(float)
    got = watershed(image(spark, a).withColumnRenamed("flux", "sn"), 3.0, 2, ext, abstol)
    want = plain_watershed(a, 3.0, ext, abstol, 2)
    assert {(r["x"], r["y"]): r["segID"] for r in got.collect()} == {(x + 1, y + 1): want[x, y] for x, y in zip(*np.nonzero(want), strict=True)}


def test_flood_of_a_plateau_and_a_saddle():
    x, y = np.array([1, 2, 3, 4, 5]), np.ones(5, int)
    label, seeds = flood(x, y, np.array([5.0, 4.0, 2.0, 4.0, 6.0]), ext=1, abstol=1.0)
    assert len(set(label)) == 2 and len(seeds) == 2
    label, _ = flood(x, y, np.array([5.0, 4.0, 3.5, 4.0, 6.0]), ext=1, abstol=3.0)
    assert len(set(label)) == 1


def test_blur_equals_numpy(spark):
    a = np.random.default_rng(5).normal(size=(9, 7))
    a[3, 3] = np.nan
    k = dict(B.gaussian_1d(1.0))
    want = np.zeros_like(a)
    for x in range(9):
        for y in range(7):
            s = [(k.get(i - x, 0) * k.get(j - y, 0), a[i, j]) for i in range(9) for j in range(7) if not math.isnan(a[i, j])]
            want[x, y] = sum(w * v for w, v in s) / sum(w for w, _ in s)
    assert np.allclose(array(L.blur(image(spark, a), 1.0), a.shape), want)


def test_brushes():
    assert len(B.brush(3, "box")) == 9 and len(B.brush(4, "box")) == 25
    assert {(i, j) for i, j, _ in B.brush(3, "diamond")} == {(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)}
    assert sum(w for *_, w in B.normalised(B.brush(5, "gaussian"))) == pytest.approx(1)
    with pytest.raises(ValueError):
        B.brush(3, "star")


def test_dilation_takes_the_smallest_label_and_keeps_owners(spark):
    seg = spark.createDataFrame([(2, 2, 7), (4, 2, 3)], "x int, y int, segID int")
    got = {(r["x"], r["y"]): r["segID"] for r in G.dilate(seg, B.brush(3, "box"), 5, 5).collect()}
    assert got[3, 2] == 3 and got[2, 2] == 7 and got[1, 1] == 7 and (5, 4) not in got
    assert G.dilate(seg.limit(0), B.brush(3, "box"), 5, 5).isEmpty()


def test_circle_cover_is_within_the_stated_error(spark):
    n = 101
    df = spark.range(n).select(((F.col("id") - 50) / 100.0).alias("o"))
    grid = df.crossJoin(df.withColumnRenamed("o", "p"))
    cells = grid.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    cover = A.circle_cover(F.col("i") + F.col("o"), F.col("j") + F.col("p"), F.lit(0.5), 3)
    worst = cells.groupBy("o", "p").agg(F.sum(cover).alias("s")).agg(F.max(F.abs(F.col("s") / (math.pi / 4) - 1))).first()[0]
    assert worst <= 0.065


def test_subset_of_targets_gives_the_same_apertures(spark):
    a = np.random.default_rng(2).integers(1, 50, (20, 20)).astype(float)
    px = image(spark, a).withColumn("segID", F.expr("(x - 1) div 5 + 4 * ((y - 1) div 5) + 1").cast("int"))
    centres = S.brightest(px).withColumnsRenamed({"xmax": "xcen", "ymax": "ycen"})
    every = {r["segID"]: r for r in A.segment_photometry(px, centres, [3.0]).collect()}
    some = A.segment_photometry(px, centres.where("segID in (2, 9)"), [3.0]).collect()
    assert len(some) == 2 and all(every[r["segID"]] == r for r in some)


def test_profile_edge_rules(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 1, 0), (1, 2, 0.0, 2, 0), (2, 2, 0.0, 2, 0), (3, 1, -4.0, 3, 0), (3, 2, 1.0, 3, 0), (4, 1, 2.0, 4, 1), (4, 2, None, 4, 0)], "x int, y int, flux double, segID int, mask int")
    got = {r["segID"]: r for r in S.flux_profile(df).collect()}
    assert got[1]["N100"] == 1 and got[1]["N50"] is None and got[1]["cenfrac"] is None
    assert got[2]["N50"] == got[2]["N90"] == got[2]["N100"] == 2
    assert got[3]["flux"] == -3 and got[3]["N50"] is None and got[3]["N100"] == 2
    assert got[4]["flux"] is None and got[4]["N50"] == 1 and got[4]["N90"] == pytest.approx(1.8)


def test_catalogue_has_the_fixed_columns_also_when_empty(spark):
    df = spark.createDataFrame([], "x int, y int, flux double, segID int")
    cat = S.segment_stats(df, 10, 10)
    assert cat.columns == S.SEGSTATS and cat.isEmpty()


def test_stack_depth(spark):
    rows = [(b, x, 1, float(x)) for b in "abcde" for x in range(1, 4)]
    px = spark.createDataFrame(rows, "band string, x int, y int, flux double")
    got = stack(px, {b: (0.0, 10.0 if b == "a" else 20.0) for b in "abcde"}, 0.0).collect()
    assert all(r["skyRMS"] == pytest.approx(7.0710678) and r["flux"] == pytest.approx(r["x"]) for r in got)


def test_clip_recovers_the_sky_of_a_contaminated_sample():
    rng = np.random.default_rng(666)
    v = np.concatenate([rng.normal(size=20_000), rng.normal(size=20_000) + rng.uniform(0, 100, 20_000)])
    kept = K.clip_exact(v)
    assert abs(np.median(kept)) < 0.25 and len(kept) < 30_000


def test_bicubic_reproduces_the_nodes_and_a_plane(spark):
    z = np.add.outer(2.0 * np.arange(5), 3.0 * np.arange(6))
    c = K.bicubic_coefficients(z)
    t = np.array([1, 0.3, 0.09, 0.027])
    u = np.array([1, 0.7, 0.49, 0.343])
    assert np.allclose(np.einsum("a,xyab,b->xy", t, c, u), z[:-1, :-1] + 0.6 + 2.1)
    z = np.random.default_rng(1).normal(size=(6, 6))
    assert np.allclose(K.bicubic_coefficients(z)[:, :, 0, 0], z[:-1, :-1])


def test_converged_sky_equals_a_plain_model(spark):
    """Tiles of a normal sky under bright contaminants: the same numbers, and near the truth."""
    rng = np.random.default_rng(3)
    a = rng.normal(50, 4, (60, 60))
    a[rng.random((60, 60)) < 0.1] += rng.exponential(60)
    px = image(spark, a)
    got = {(r["gx"], r["gy"]): r for r in K.tile_stats(K.tile_windows(px, 30, 29, 60, 60), "converge", "converge").collect()}
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for (gx, gy), r in got.items():
        cx, cy = gx * 30 + 15, gy * 30 + 15
        v = a[max(cx - 15, 0) : cx + 14, max(cy - 15, 0) : cy + 14].ravel()
        v = v[v < np.median(v) + 10 * np.std(v[v < np.median(v)], ddof=1)]
        mu, sd = v.mean(), v.std(ddof=1)
        top = mu + sd
        low = v[v < top]
        for _ in range(100):
            z = (top - mu) / sd
            g = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / phi(z)
            mu, sd = mu + 2 * (low.mean() - mu + sd * g), sd * low.std(ddof=1) / (sd * math.sqrt(1 - z * g - g * g))
        assert r["sky"] == pytest.approx(mu, rel=1e-6) and r["skyRMS"] == pytest.approx(sd, rel=1e-6)
        assert r["sky"] == pytest.approx(50, abs=2)


def test_annulus_sky_equals_a_plain_model(spark):
    a = np.random.default_rng(5).normal(20, 3, (40, 40))
    r = K.annulus_sky(image(spark, a), 20, 20, 5, 18).first()
    v = sorted((math.hypot(x + 0.5 - 20, y + 0.5 - 20), y, x, a[x, y]) for x in range(40) for y in range(40))
    v = [t for t in v if 5 <= t[0] <= 18]
    kept = set(K.clip_exact(np.array([t[3] for t in v])).tolist())
    v = [t for t in v if t[3] in kept]
    rings = [[t[3] for t in part] for part in np.array_split(np.array(v, dtype=object), 10)]
    m, n = np.array([np.median(q) for q in rings]), np.array([len(q) for q in rings])
    err = np.array([np.std(q, ddof=1) for q in rings]) / np.sqrt(n)
    near, before = np.ones(10, bool), -1
    while near.sum() != before:
        before = near.sum()
        sky = np.average(m[near], weights=1 / err[near] ** 2)
        near = abs(m - sky) <= err
    assert r["sky"] == pytest.approx(sky, abs=0.02) and r["skyerr"] == pytest.approx(m.std(ddof=1), rel=0.1)
    assert r["skyRMS"] == pytest.approx(3, abs=0.4) and 1 <= r["Nnear"] <= 10


def test_gaussian_brush_has_its_width_in_pixels():
    k = {(i, j): w for i, j, w in B.brush(5, "gaussian", sigma=1.0)}
    assert sum(k.values()) == pytest.approx(1) and k[1, 0] / k[0, 0] == pytest.approx(math.exp(-0.5)) and k[2, 1] / k[0, 0] == pytest.approx(math.exp(-2.5))


def test_propagation_equals_dijkstra(spark):
    import heapq

    rng = np.random.default_rng(9)
    a = rng.random((12, 10)).round(3)
    seeds = {(2, 3): 1, (9, 8): 2, (10, 1): 3}
    seg = spark.createDataFrame([(x + 1, y + 1, s) for (x, y), s in seeds.items()], "x int, y int, segID int")
    got = {(r["x"] - 1, r["y"] - 1): r["segID"] for r in P.propagate(image(spark, a), seg, 1e-4).collect()}
    heap, cost = [(0.0, s, x, y) for (x, y), s in seeds.items()], {}
    while heap:
        c, s, x, y = heapq.heappop(heap)
        if (x, y) in cost:
            continue
        cost[x, y] = (c, s)
        for i, j in G.AROUND:
            if 0 <= x + i < 12 and 0 <= y + j < 10 and (x + i, y + j) not in cost:
                heapq.heappush(heap, (c + math.sqrt((a[x, y] - a[x + i, y + j]) ** 2 + 1e-4) / math.sqrt(1 + 1e-4), s, x + i, y + j))
    assert got == {q: s for q, (_, s) in cost.items()}


def test_psf_weights_of_every_mode(spark):
    px = image(spark, np.arange(1.0, 26).reshape(5, 5)).withColumn("segID", F.when(F.col("x") < 3, 1).otherwise(2))
    groups = spark.createDataFrame([(1, [1, 2], 25, 2)], "groupID int, segIDs array<int>, Npix long, Ngroup int")
    stats = S.segment_flux(px).join(S.brightest(px), "segID")
    psf = B.brush(3, "box")
    flux = {s: sum(v for v, own in zip(range(1, 26), [1] * 10 + [2] * 15, strict=True) if own == s) for s in (1, 2)}
    for convmode in ("psf", "extended"):
        for fluxweight in ("sum", "peak", "none"):
            got = {r["segID"]: r for r in D.deblend_psf(px, groups, stats, psf, 0.0, convmode, fluxweight).collect()}
            w = np.zeros((2, 5, 5))
            for s, cols, peak in ((0, (0, 1), (1, 4)), (1, (2, 3, 4), (4, 4))):
                at = [peak] if convmode == "psf" else [(x, y) for x in cols for y in range(5)]
                for x, y in at:
                    w[s, max(x - 1, 0) : x + 2, max(y - 1, 0) : y + 2] += 1
                caught = w[s][list(cols)].sum()
                assert got[s + 1]["beamcorrect"] == pytest.approx(max(9 / caught, 1))
                w[s] *= {"sum": flux[s + 1], "peak": (10, 25)[s], "none": 1}[fluxweight] / (5 * len(cols) if convmode == "extended" else 1)
            for _ in range(2):
                t = w.sum(0)
                w = np.where(t > 0, w / np.where(t > 0, t, 1), 0)
                w[w < 0.1] = 0
            for s in (0, 1):
                assert got[s + 1]["flux_db"] == pytest.approx((w[s] * np.arange(1.0, 26).reshape(5, 5)).sum())


def test_aperture_flux_and_sky_coordinates_of_the_catalogue(spark):
    a = np.zeros((21, 21))
    a[5:16, 5:16] = 2.0
    px = image(spark, a).withColumn("segID", F.when(F.col("flux") > 0, 1).otherwise(0))
    header = {"CRVAL1": 10.0, "CRVAL2": 0.0, "CRPIX1": 11.0, "CRPIX2": 11.0, "CD1_1": -0.001, "CD2_2": 0.001}
    r = S.segment_stats(px, 21, 21, 25.0, app_diam=6.0, header=header, cor_err=lambda n: n / 1000).first()
    assert r["flux_app"] == pytest.approx(2 * math.pi * 9, rel=1e-6) and r["mag_app"] == pytest.approx(-2.5 * math.log10(r["flux_app"]) + 25)
    assert (r["RAcen"], r["Deccen"]) == (pytest.approx(10.0), pytest.approx(0.0, abs=1e-9)) and r["cor_seg"] == pytest.approx(0.121)
    assert r["RAmax"] == pytest.approx(10.005, abs=1e-6) and r["Decmax"] == pytest.approx(-0.005, abs=1e-6)


def test_regions_have_one_sky_each(spark):
    px = image(spark, np.arange(40.0).reshape(8, 5)).withColumn("region", F.when(F.col("x") <= 4, 1).otherwise(2))
    assert K.by_region(px).count() == 2 and K.by_region(px, pedestal=True).count() == 1


def test_fft_parts_add_up(spark):
    a = np.random.default_rng(4).normal(size=(16, 12))
    px = image(spark, a).withColumn("objects", F.lit(0))
    both = K.split_fft(px, 6.0).withColumn("s", F.col("sky_lo") + F.col("sky_hi"))
    assert np.allclose(array(both, a.shape, "s"), a)


def test_psf_update_is_the_minimum(spark):
    psf = B.gaussian_psf(7, 2.5)
    src = spark.createDataFrame([(1, 20.0, 20.0, 80.0)], "k int, xcen double, ycen double, flux double")
    model = L.render_points(src.withColumns({"xcen": F.col("xcen") - 0.5, "ycen": F.col("ycen") - 0.5}), psf, 40, 40)
    residual = model.withColumn("flux", F.col("flux") * 0.25).withColumn("sigma", F.lit(2.0))
    got = D.psf_update(residual, src, psf).first()
    assert got["flux"] == pytest.approx(100)


def test_gain_is_that_of_all_bins(spark):
    rng = np.random.default_rng(3)
    n = 150_000  # mostly different pairs of flux and sky; the brightest are the noisiest
    sky = 10_000 + np.arange(n) // 10 / 10
    flux = np.round(sky + rng.normal(0, np.where(np.arange(n) < 110_000, 20.0, 400.0)))
    px = spark.createDataFrame([(float(f), float(s)) for f, s in zip(flux, sky, strict=True)], "flux double, sky double")
    low = min(flux.min(), 0.0)

    def cost(g):
        v, m = flux - low, np.round(sky - low, 1)
        return -(v * g * np.log(m * g) - m * g + np.log(g)).sum() + sum(math.lgamma(x * g + 1) for x in v.tolist())

    got = D.gain_estimate(px)
    assert cost(got) < min(cost(got * 0.99), cost(got * 1.01))


def test_deblended_flux_is_shared_out_whole(spark):
    a = np.zeros((12, 8))
    a[2:10, 2:6] = np.random.default_rng(1).uniform(1, 9, (8, 4))
    px = image(spark, a).withColumn("segID", F.when(F.col("flux") > 0, F.when(F.col("x") <= 6, 1).otherwise(2)).otherwise(0))
    groups, _ = G.group_segments(px.select("x", "y", "segID"))
    assert [tuple(r["segIDs"]) for r in groups.collect()] == [(1, 2)]
    stats = S.segment_flux(px).join(S.moments(px), "segID").join(S.brightest(px), "segID").withColumns({"ang": F.lit(0.0), "axrat": F.lit(1.0)})
    inside = px.where("segID > 0")
    for out in (D.deblend_gauss(inside, groups, stats), D.deblend_line(inside, groups, stats, radtrunc=9.0), D.deblend_iterative(inside, groups, stats, radtrunc=9.0)):
        assert sum(r["flux_db"] for r in out.collect()) == pytest.approx(a.sum(), rel=1e-6)


def test_merge_lists(spark):
    lists = spark.createDataFrame([([1, 2],), ([3],), ([2, 5],)], "segIDs array<int>")
    assert sorted(tuple(r[0]) for r in G.merge_closure(lists).collect()) == [(1, 2, 5), (3,)]
    assert [r[0] for r in G.zap_lists(lists, [2]).collect()] == [[3]]


def test_detection_finds_bright_sources(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(100, 2, (60, 60))
    spots = [(15, 15), (15, 45), (45, 30)]
    xx, yy = np.meshgrid(np.arange(60), np.arange(60), indexing="ij")
    for x, y in spots:
        a += 400 * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 8)
    run = P.detect(image(spark, a), P.Config(60, 60, skycut=3.0, grid=30, box=30, iters=2, redoskysize=9, near=True, groups=True, deblend=True))
    cat = run.segstats.collect()
    found = [min(math.hypot(r["xcen"] - 0.5 - x, r["ycen"] - 0.5 - y) for x, y in spots) for r in cat if r["flux"] > 2000]
    assert len(found) == 3 and max(found) < 0.5
    assert run.sky.agg(F.avg("sky")).first()[0] == pytest.approx(100, abs=1)
    assert run.deblend.count() == len(cat)


def test_detection_on_nothing_is_empty(spark):
    run = P.detect(image(spark, np.zeros((12, 12))), P.Config(12, 12, grid=6, box=6, iters=1))
    assert run.segstats.isEmpty()


def test_mask_rules(spark):
    px = spark.createDataFrame([(1, 1, None), (2, 1, -99.0), (3, 1, 5.0)], "x int, y int, flux double")
    got = {r["x"]: (r["flux"], r["mask"]) for r in M.with_mask(px, -99.0).collect()}
    assert got == {1: (0.0, 1), 2: (0.0, 1), 3: (5.0, 0)}
    assert {r["x"]: r["flux"] for r in M.restore_missing(M.with_mask(px), px).collect()} == {1: None, 2: -99.0, 3: 5.0}


def test_fits_round_trip(spark, tmp_path):
    a = np.random.default_rng(7).normal(size=(5, 4))
    a[1, 1] = np.nan
    (tmp_path / "r.fits").write_bytes(fits.write_image(a, {"CRPIX1": "3.0"}))
    px = fits.fits_pixels(spark, str(tmp_path), ["r"])
    assert np.allclose(array(px, a.shape), a, equal_nan=True)
    head = fits.fits_headers(spark, str(tmp_path)).first()
    assert (head["nx"], head["ny"], head["keyvalues"]["CRPIX1"]) == (5, 4, "3.0")


def test_propagation_fills_the_image(spark):
    px = image(spark, np.zeros((6, 3)))
    seeds = spark.createDataFrame([(1, 2, 1), (6, 2, 2)], "x int, y int, segID int")
    got = {(r["x"], r["y"]): r["segID"] for r in P.propagate(px, seeds).collect()}
    assert len(got) == 18 and got[2, 2] == 1 and got[5, 1] == 2


def test_superellipse_of_a_uniform_disc(spark):
    xx, yy = np.meshgrid(np.arange(41) - 20.0, np.arange(41) - 20.0, indexing="ij")
    a = ((xx / 8) ** 2 + (yy / 16) ** 2 <= 1).astype(float)
    px = image(spark, a).withColumn("segID", F.when(F.col("flux") > 0, 1).otherwise(0))
    e = A.moment_ellipse(px).first()
    assert e["axrat"] == pytest.approx(0.5, abs=0.02) and e["radhi"] == pytest.approx(16 / 2**0.5, rel=0.03)
    got = A.superellipse(px, A.moment_ellipse(px)).first()
    assert got["axrat"] == pytest.approx(0.5, abs=0.05)


def test_stream_equals_batch(spark, tmp_path):
    from pixelspark.streaming.photometry import stream_segment_flux

    df = spark.createDataFrame([("a", i % 3, float(i)) for i in range(30)], "image_id string, segID int, flux double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_segment_flux(stream).writeStream.outputMode("complete").format("memory").queryName("seg_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = stream_segment_flux(df)
    assert sorted(map(tuple, spark.table("seg_out").collect())) == sorted(map(tuple, want.collect()))


def plain_akima(z, px, py):
    c = K.bicubic_coefficients(z)
    out = np.zeros((len(px), len(py)))
    for a, x in enumerate(px):
        for b, y in enumerate(py):
            i, j = min(int(x), z.shape[0] - 2), min(int(y), z.shape[1] - 2)
            t, u = (x - i) ** np.arange(4), (y - j) ** np.arange(4)
            out[a, b] = t @ c[i, j] @ u
    return out


def test_bicubic_resampling_and_recentring(spark):
    x, y = np.meshgrid(np.arange(12), np.arange(10), indexing="ij")
    a = np.exp(-((x - 4.2) ** 2 + (y - 6.1) ** 2) / 6)
    at = lambda m, n, shift: np.clip((np.arange(m) + 0.5 + shift) * 0.5 - 0.5, 0, n - 1)
    want = plain_akima(a, at(24, 12, 0), at(20, 10, 0))
    got = array(L.resample(image(spark, a), 12, 10, 0.5, "image", kind="bicubic"), (24, 20))
    assert np.allclose(got, want * a.sum() / want.sum())
    i, j = np.unravel_index(np.argmax(want), want.shape)
    moved = plain_akima(a, at(24, 12, i + 0.5 - 12), at(20, 10, j + 0.5 - 10))
    got = array(L.resample(image(spark, a), 12, 10, 0.5, "norm", kind="bicubic", recentre=True), (24, 20))
    assert np.allclose(got, moved / moved.sum())


def test_fuzz_fits_find_known_profiles(spark):
    truth = {1: (20.0, 20.0, 3000.0), 2: (60.0, 25.0, 800.0)}
    x, y = np.meshgrid(np.arange(80) + 0.5, np.arange(50) + 0.5, indexing="ij")
    a = sum(f * D.sersic_image(np.hypot(x - cx, y - cy), 6.0, 1.0, 1.0) for cx, cy, f in truth.values())
    px = image(spark, a)
    near = F.when(F.col("x") <= 40, 1).otherwise(2)
    r2 = F.when(F.col("x") <= 40, F.pow(F.col("x") - 20.5, 2) + F.pow(F.col("y") - 20.5, 2)).otherwise(F.pow(F.col("x") - 60.5, 2) + F.pow(F.col("y") - 25.5, 2))
    seg = px.where(r2 < 16).select("x", "y", near.alias("segID"))
    ring = px.where(r2 < 144).select("x", "y", near.alias("segID"), "flux", F.lit(0.1).alias("sigma"))
    stats = spark.createDataFrame([(s, cx, cy, 0.0, 4.0, 1.0, 0.0) for s, (cx, cy, _) in truth.items()], "segID int, xcen double, ycen double, mag double, R50 double, axrat double, ang double")
    rows = D.annulus_sources(seg, ring, stats)
    for r in D.fuzz_fit(rows, magzero=25.0).collect():
        assert r["re"] == pytest.approx(6.0, rel=0.03) and r["mag"] == pytest.approx(-2.5 * math.log10(truth[r["segID"]][2]) + 25, abs=0.05)
    out, shape = D.fuzz_fit_shared(rows, re=(1.0, 20.0), nser=(0.5, 4.0), magzero=25.0, rounds=5)
    assert shape["re"] == pytest.approx(6.0, rel=0.1) and shape["nser"] == pytest.approx(1.0, rel=0.1)
    assert {r["segID"]: r["flux"] for r in out.collect()} == {s: pytest.approx(f, rel=0.1) for s, (_, _, f) in truth.items()}


def test_pictures(spark):
    import struct
    import zlib

    from pixelspark.sinks import plots

    a = np.random.default_rng(2).normal(10, 2, (30, 20))
    px = image(spark, a).withColumns({"sky": F.lit(10.0), "segID": F.when(F.col("x").between(5, 12) & F.col("y").between(4, 9), 3).otherwise(0)})

    def opened(data):
        w, h = struct.unpack(">II", data[16:24])
        n = struct.unpack(">I", data[33:37])[0]
        rows = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(h, 1 + 3 * w)
        assert data[:4] == b"\x89PNG" and not rows[:, 0].any()
        return rows[:, 1:].reshape(h, w, 3)

    assert opened(plots.diagnostic_plot(px, 30, 20, ["flux", "sky"])).shape == (20, 64, 3)
    assert opened(plots.diagnostic_plot(px, 30, 20, ["flux"], most=10)).shape == (7, 10, 3)
    seen = opened(plots.segment_plot(px, px.select("x", "y", "segID"), 30, 20))
    coloured = {(int(i) + 1, 20 - int(j)) for j, i in np.argwhere((seen[:, :, 0] != seen[:, :, 1]) | (seen[:, :, 1] != seen[:, :, 2]))}
    assert coloured == {(x, y) for x in range(5, 13) for y in range(4, 10) if x in (5, 12) or y in (4, 9)}
    model = px.select("x", "y", F.lit(10.0).alias("flux"))
    assert opened(plots.psf_plot(px, model, 30, 20)).shape == (20, 98, 3)
