"""What shows only on larger tables: empty regions, tall images, copies, long borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import apertures as A
from pixelspark.operators import catalogues as C
from pixelspark.operators import kernels as B
from pixelspark.operators import maps as M
from pixelspark.operators import segments as G
from pixelspark.operators import sky as K
from pixelspark.operators import watershed as W


def image(spark, a):
    return M.pixels_from_array(spark, a.tolist())


def most_rows(df):
    """The rows of ``df``, and the most that any node of its plan gave out."""
    rows = df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        m = p.metrics().get("numOutputRows")
        return max([m.get().value() if m.isDefined() else 0, *map(walk, inner)])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_a_region_above_its_limit_stays(spark):
    px = image(spark, np.arange(40.0).reshape(8, 5)).withColumn("region", F.when(F.col("x") <= 4, 1).otherwise(2))
    own = spark.createDataFrame([(2, 0.5, 10.0)], "region int, quantile double, limit double")
    got = {r["region"]: (r["sky"], r["n"]) for r in K.by_region(px, arguments=own).collect()}
    assert got == {1: (9.5, 20), 2: (None, 0)}


def test_numbers_of_places_differ_on_a_tall_image(spark):
    top = spark.createDataFrame([(0.5, 1499.5), (1.5, 499.5)], "xmax double, ymax double")
    assert top.select(G.unique_id(F.col("xmax"), F.col("ymax"), 2000)).distinct().count() == 2


def test_nearest_makes_no_row_for_each_pair(spark):
    rng = np.random.default_rng(5)
    # many copies of few places, two dense clusters apart, and places all over
    xy = np.concatenate([rng.integers(0, 9, (900, 2)) * 0.5, rng.normal(size=(300, 2)) * 0.01 + 30, rng.normal(size=(300, 2)) * 0.01 + [70, 31], rng.uniform(-300, 300, (600, 2))])
    src = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "segID int, xcen double, ycen double")
    got, most = most_rows(C.nearest(src.where("segID % 2 = 0"), src.where("segID % 2 = 1"), 60.0))
    want = {}
    for i in range(0, len(xy), 2):
        d = np.sqrt((xy[1::2, 0] - xy[i, 0]) ** 2 + (xy[1::2, 1] - xy[i, 1]) ** 2)
        if d.min() <= 60:
            want[i] = (int(np.argmin(d)) * 2 + 1, d.min())
    assert {r["segID"]: (r["match"], r["dist"]) for r in got} == want and most < 60 * len(xy)


def plain_components(there, connectivity, reach):
    """By spreading from pixel to pixel: the component's least y * 2^32 + x at each pixel that is there."""
    near = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)] if connectivity == 8 else [(1, 0), (-1, 0), (0, 1), (0, -1)]
    out = {}
    for p in sorted(there, key=lambda p: (p[1], p[0])):
        todo, name = [p], p[1] * 2**32 + p[0]
        while todo:
            q = todo.pop()
            if q in there and q not in out:
                out[q] = name
                todo += [(q[0] + i, q[1] + j) for i, j in near]
    return out


@pytest.mark.parametrize("connectivity, reach, share, in_one", [(4, 1, 0.62, 10**6), (4, 1, 0.62, 0), (8, 1, 0.3, 0), (8, 3, 0.05, 10**6)])
def test_components_over_tiles(spark, monkeypatch, connectivity, reach, share, in_one):
    monkeypatch.setattr(G, "TILE", 16)
    a = np.random.default_rng(3).random((50, 90)) < share
    there = {(int(x) - 4, int(y) - 7) for x, y in zip(*np.nonzero(a), strict=True)}
    px = spark.createDataFrame(sorted(there), "x int, y int").withColumn("band", F.lit("a"))
    got = G.components(px, connectivity, reach, in_one=in_one).collect()
    assert {(r["x"], r["y"]): r["comp"] for r in got} == plain_components(there, connectivity, reach) and len(got) == len(there)


def test_components_are_written_once(spark, monkeypatch):
    # a line of 900 pixels that turns at every border
    line = [(x, y) for y in range(1, 31) for x in (range(1, 31) if y % 2 else [30 if y % 4 == 2 else 1])]
    written, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or cut(df))
    got = G.components(spark.createDataFrame(line, "x int, y int"))
    assert got.select("comp").distinct().count() == 1 and len(written) == 2


def test_a_bin_holds_many_components(spark, monkeypatch):
    a = np.round(np.random.default_rng(8).normal(size=(40, 40)), 1) * 10
    px = image(spark, a).withColumnRenamed("flux", "sn")
    order = lambda df: sorted(map(tuple, df.collect()))
    one = order(W.watershed(px, 5.0, 2, 1, 2.0))
    monkeypatch.setattr(W, "BIN", 5)
    assert one == order(W.watershed(px, 5.0, 2, 1, 2.0)) and len(one) > 100


def test_many_minima_are_sought_side_by_side():
    goal = np.random.default_rng(2).uniform(-1.5, 1.5, (50, 2))
    cost = lambda rows, p: ((p - goal[rows]) ** 2).sum(axis=1) + (p[:, 0] - goal[rows, 0]) ** 4
    full = np.ones((50, 2))
    both = A.simplex(cost, 0 * full, 0.3 * full, -full, full)
    alone = [A.simplex(lambda _, p, i=i: cost(np.full(len(p), i), p), 0 * full[:1], 0.3 * full[:1], -full[:1], full[:1])[0] for i in range(50)]
    assert np.array_equal(both, alone) and np.median(np.abs(both - goal.clip(-1, 1))) < 1e-3


def test_equal_apertures_are_measured_once(spark):
    px = image(spark, np.random.default_rng(6).random((20, 20)))
    shapes = [(7.0, 8.5, 3.0, 20.0, 0.5), (12.5, 6.0, 2.0, 0.0, 0.8), (7.0, 8.5, 3.0, 20.0, 0.6), (30.0, 3.0, 2.0, 0.0, 1.0)]
    columns = "k int, cx double, cy double, rad double, ang double, axrat double"
    one = spark.createDataFrame([(i, *s) for i, s in enumerate(shapes)], columns)
    many = spark.createDataFrame([(i, *shapes[i % 4]) for i in range(400)], columns)
    for shape in ("circle", "ellipse"):
        want = {r["k"]: r["flux"] for r in A.aperture_flux(px, one, 2, shape).collect()}
        got, most = most_rows(A.aperture_flux(px, many, 2, shape))
        assert {r["k"]: r["flux"] for r in got} == pytest.approx({i: want[i % 4] for i in range(400)}) and want[0] > 0 and most <= 4000
        weigh = lambda ap, shape=shape: most_rows(A.weight_map(px, ap.withColumns({"wt": 1.0 + F.col("k") % 4, "rad_re": F.lit(2.0), "nser": F.lit(2.0)}), 2, shape, scalar=False))
        (base, _), (rows, most) = weigh(one), weigh(many)
        base, rows = ({(r["x"], r["y"]): r["weight"] for r in t} for t in (base, rows))
        assert rows.keys() == base.keys() and all(abs(rows[p] - 100 * base[p]) < 1e-9 for p in rows) and most <= 4000


def test_edges_are_dilated_in_parts(spark, monkeypatch):
    a = np.random.default_rng(9).random((30, 40))
    seg = image(spark, a).where("flux > 0.6").select("x", "y", F.expr("1 + x div 7 + 9 * (y div 7)").cast("int").alias("segID"))
    monkeypatch.setattr(G, "PART", 50)
    order = lambda df: sorted(map(tuple, df.select("x", "y", "segID").collect()))
    out = G.dilate_edges(seg, B.brush(5, "disc"), 30, 40)
    assert order(out) == order(G.dilate(seg, B.brush(5, "disc"), 30, 40))
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
