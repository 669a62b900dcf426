import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestline.functions.scalars import inside_edges, inside_ring, ring_edges, ring_from_wkt
from harvestline.operators import outlines as O, spatial as G
from harvestline.operators.cover import cell_cover
from harvestline.sources.tables import with_bbox


@pytest.fixture(scope="module")
def mosaic(spark):
    """3x3 unit squares and one far away."""
    rows = []
    for i in range(3):
        for j in range(3):
            rows.append((f"{i}{j}", [float(x) for x in (i, i + 1, i + 1, i, i)], [float(y) for y in (j, j, j + 1, j + 1, j)]))
    rows.append(("far", [90.0, 91.0, 91.0, 90.0], [90.0, 90.0, 91.0, 90.0]))
    return with_bbox(spark.createDataFrame(rows, "region_id string, xs array<double>, ys array<double>"))


def test_point_in_polygon_fixture(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 2.9)], "x double, y double")
    ring = lambda *v: F.array(*[F.lit(float(a)) for a in v])
    got = df.select(inside_ring("x", "y", ring(0, 4, 4, 0, 0), ring(0, 0, 3, 3, 0))).collect()
    assert [r[0] for r in got] == [True, False, True]


def test_wkt_ring(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3.5, 0 0))",)], "w string")
    xs, ys = ring_from_wkt("w")
    assert tuple(df.select(xs, ys).first()) == ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 3.5, 0.0])


@pytest.mark.parametrize("cell", [0.3, 1.0, 50.0])
def test_pixels_meet_their_region_for_any_cell_size(spark, mosaic, cell):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.uniform(-1, 4, 400), "y": rng.uniform(-1, 4, 400), "value": 1.0})
    got = G.pixel_in_polygon(spark.createDataFrame(pdf), mosaic, cell).toPandas()
    want = pdf[(pdf.x > 0) & (pdf.x < 3) & (pdf.y > 0) & (pdf.y < 3)]
    assert len(got) == len(want)
    assert (got.region_id == got.x.astype(int).astype(str) + got.y.astype(int).astype(str)).all()


@pytest.mark.parametrize("cell", [0.7, 10.0])
def test_box_pairs_come_once(spark, mosaic, cell):
    scenes = spark.createDataFrame([("s", 0.5, 1.5, 0.5, 0.8), ("t", 50.0, 60.0, 50.0, 60.0)], "scene_id string, min_x double, max_x double, min_y double, max_y double")
    got = sorted(tuple(r) for r in G.bbox_clip(scenes, mosaic, cell).collect())
    assert got == [("s", "00"), ("s", "10")]


def test_nearest_pixel_is_exact_at_any_distance(spark, mosaic):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.uniform(0, 40, 3000).round(3), "y": rng.uniform(0, 40, 3000).round(3)})
    pdf["value"] = np.arange(3000.0)
    none = spark.createDataFrame([], "region_id string")
    got = G.nearest_pixel_fallback(mosaic, spark.createDataFrame(pdf), none).toPandas().set_index("region_id")
    assert len(got) == 10
    for r in mosaic.collect():
        cx, cy = np.mean(r.xs[:-1]), np.mean(r.ys[:-1])
        assert np.isclose(got.loc[r.region_id, "dist"], np.hypot(pdf.x - cx, pdf.y - cy).min())


def test_swath_sample_within_radius_only(spark):
    swath = spark.createDataFrame([(0.0, 0.0, 1.0), (300.0, 0.0, 2.0)], "x double, y double, value double")
    grid = spark.createDataFrame([(0, 0, 100.0, 0.0), (0, 1, 1000.0, 0.0)], "row int, col int, x double, y double")
    assert [tuple(r) for r in G.swath_to_grid_nn(swath, grid, 210.0).collect()] == [(0, 0, 1.0, 100.0)]


def test_queen_neighbours_of_the_centre(mosaic):
    edges = G.queen_neighbors(mosaic).where("src = '11'").collect()
    assert len(edges) == 8 and all(abs(e.w - 1 / 8) < 1e-12 for e in edges)


def test_dissolved_square_has_outer_edges_only(mosaic):
    one = mosaic.where("region_id <> 'far'").withColumn("parent", F.lit("p"))
    assert G.dissolve_outline(one, "parent").count() == 12


def test_parcel_goes_to_first_region_it_touches(spark, mosaic):
    rows = [(1, [0.9, 1.2, 1.0, 0.9], [0.2, 0.2, 0.4, 0.2]), (2, [-0.5, 3.5, 3.5, -0.5, -0.5], [1.4, 1.4, 1.6, 1.6, 1.4]), (3, [60.0, 61.0, 60.0, 60.0], [60.0, 60.0, 61.0, 60.0])]
    parcels = with_bbox(spark.createDataFrame(rows, "field_id int, xs array<double>, ys array<double>"))
    got = {r.field_id: r.region_id for r in G.region_overlay(parcels, mosaic, 1.0).collect()}
    assert got == {1: "00", 2: "01"}


def test_zonal_statistics_leave_nodata_out(spark):
    df = spark.createDataFrame([("r", "s", "b", v) for v in (0.0, 2.0, 4.0, 9.0)], "region_id string, scene_id string, band string, value double")
    r = G.zonal_median_std(df).first()
    assert r.median == 4.0 and r.n == 3 and abs(r.std - np.std([2, 4, 9])) < 1e-12


def ring(*points):
    return [float(x) for x, _ in points], [float(y) for _, y in points]


SQUARE = [(1, 1), (2, 1), (2, 2), (1, 2)]
L_SHAPE = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]


@pytest.mark.parametrize("turn", range(4))
@pytest.mark.parametrize("back", [False, True])
def test_equal_rings_share_area_from_any_start(spark, turn, back):
    points = SQUARE[turn:] + SQUARE[:turn]
    points = points[::-1] if back else points
    cases = {
        "same": (SQUARE, True), "inside": ([(0, 0), (3, 0), (3, 3), (0, 3)], True), "around": ([(1.4, 1.4), (1.6, 1.4), (1.5, 1.6)], True),
        "side": ([(2, 1), (3, 1), (3, 2), (2, 2)], False), "corner": ([(2, 2), (3, 2), (3, 3), (2, 3)], False), "apart": ([(5, 5), (6, 5), (6, 6)], False),
        "half_edge": ([(1, 1), (2, 1), (1.5, 0)], False), "inner_edge": ([(1, 1), (2, 1), (1.5, 1.5)], True), "crossing": ([(0, 1.4), (3, 1.4), (3, 1.6), (0, 1.6)], True),
        "notch": (L_SHAPE, False), "notch_over": ([(x * 1.1, y * 1.1) for x, y in L_SHAPE], True)}
    rows = [(k, *ring(*points, points[0]), *ring(*other, other[0])) for k, (other, _) in cases.items()]
    df = spark.createDataFrame(rows, "id string, xs array<double>, ys array<double>, us array<double>, vs array<double>")
    got = {r["id"]: (r["hit"], r["area"]) for r in df.select("id", G.rings_overlap("xs", "ys", "us", "vs").alias("hit"), G.shared_area("xs", "ys", "us", "vs").alias("area")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert np.allclose([got[k][1] for k in ("same", "inside", "crossing", "side", "inner_edge")], [1, 1, 0.2, 0, 0.25])


def test_shared_area_of_random_rings_equals_sampling(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(12):
        rings = []
        for _ in range(2):
            angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
            radius = rng.uniform(0.3, 1, 9)
            rings.append(np.stack([radius * np.cos(angle) + rng.uniform(-0.4, 0.4), radius * np.sin(angle)], 1) + 7)
        points = rng.uniform(5, 9, (40_000, 2))

        def holds(r):
            x0, y0, x1, y1 = *r.T, *np.roll(r, -1, 0).T
            cross = ((y0 > points[:, 1:]) != (y1 > points[:, 1:])) & (points[:, :1] < (x1 - x0) * (points[:, 1:] - y0) / (y1 - y0) + x0)
            return cross.sum(1) % 2 == 1

        want.append((holds(rings[0]) & holds(rings[1])).mean() * 16)
        rows.append((k, *ring(*rings[0], rings[0][0]), *ring(*rings[1], rings[1][0])))
    df = spark.createDataFrame(rows, "id int, xs array<double>, ys array<double>, us array<double>, vs array<double>")
    got = [r[0] for r in df.orderBy("id").select(G.shared_area("xs", "ys", "us", "vs")).collect()]
    assert np.allclose(got, want, atol=0.06)


def test_islands_and_holes(spark):
    text = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1)), ((6 0, 8 0, 8 2, 6 2, 6 0)))"
    xs, ys = ring_from_wkt("w")
    regions = with_bbox(spark.createDataFrame([("r", text)], "region_id string, w string").select("region_id", xs.alias("xs"), ys.alias("ys")))
    pixels = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (3.5, 2.0), (7.0, 1.0), (5.0, 1.0), (7.0, 3.0)], "x double, y double")
    got = sorted((r.x, r.y) for r in G.pixel_in_polygon(pixels, regions, 1.5).collect())
    assert got == [(0.5, 0.5), (3.5, 2.0), (7.0, 1.0)]


@pytest.fixture(scope="module")
def odd_shapes(spark):
    """Random stars, half of them on whole coordinates (corners on cell borders, level edges, repeated
    corners), an island, a hole, an equal row, a row without id and rows without a ring."""
    rng = np.random.default_rng(1)
    rows = [("islands", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1)), ((6 0, 8 0, 8 2, 6 2, 6 0)))")]
    for k in range(6):
        n = rng.integers(5, 60)
        angle, radius = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.5, 4, n)
        points = np.stack([4 + radius * np.cos(angle), 3 + radius * np.sin(angle)], 1)
        points = points.round(0) if k % 2 else points
        rows.append((f"star{k}", "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + "))"))
    rows += [rows[2], (None, rows[3][1])]
    xs, ys = ring_from_wkt("w")
    shapes = spark.createDataFrame(rows, "region_id string, w string").select("region_id", xs.alias("xs"), ys.alias("ys"))
    return with_bbox(shapes.unionByName(spark.createDataFrame([("none", None, None), ("empty", [], [])], shapes.schema)))


@pytest.mark.parametrize("cell", [0.1, 0.5, 1.0, 2.3, 50.0])
def test_cells_of_any_size_give_the_rows_of_the_whole_ring(spark, odd_shapes, cell):
    rng = np.random.default_rng(2)
    at = np.vstack([rng.uniform(-1, 9, (2000, 2)), rng.integers(-2, 20, (1000, 2)) / 2])  # half of the second lot on corners and borders
    pixels = spark.createDataFrame(pd.DataFrame({"x": at[:, 0], "y": at[:, 1], "value": np.arange(len(at), dtype=float)}))
    whole = pixels.crossJoin(odd_shapes.withColumn("_e", ring_edges("xs", "ys"))).where(inside_edges("x", "y", "_e"))
    rows = lambda df: sorted((r.value, str(r.region_id)) for r in df.collect())
    assert rows(G.pixel_in_polygon(pixels, odd_shapes, cell)) == rows(whole)


def test_cells_inside_hold_no_edges(spark):
    n = 4000
    angle = np.append(np.arange(n) / n * 2 * np.pi, 0.0)
    disc = spark.createDataFrame([("d", (100 * np.cos(angle)).tolist(), (100 * np.sin(angle)).tolist())], "region_id string, xs array<double>, ys array<double>")
    cover = cell_cover(disc, 5.0).toPandas()
    inside = cover._edges.isnull()
    assert not cover.duplicated(["_cx", "_cy"]).any()
    assert abs(inside.sum() * 25 - np.pi * 100**2) < 2 * np.pi * 100 * 10  # all but a rim two cells wide
    assert cover[~inside]._edges.map(len).max() < 80 and (cover._ends.map(len) <= 1).all()


def squares(*cells):
    return [([float(v) for v in (i, i + 1, i + 1, i, i)], [float(v) for v in (j, j, j + 1, j + 1, j)]) for i, j in cells]


def test_outlines_close_to_rings(spark):
    rows = [("hole", *s) for s in squares(*[(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)])]
    rows += [("corner", *squares((0, 0))[0]), ("corner", *[v[::-1] for v in squares((1, 1))[0]])]  # one member runs clockwise
    rows += [("row", *s) for s in squares(*[(i, 0) for i in range(40)])]
    rows += [(None, *squares((5, 5))[0]), ("none", None, None), ("empty", [], [])]
    members = spark.createDataFrame(rows, "parent string, xs array<double>, ys array<double>")
    rings = O.outline_rings(members, "parent").collect()
    assert sorted((str(r.parent), r.n_edges, r.area) for r in rings) == [
        ("None", 4, 1.0), ("corner", 4, 1.0), ("corner", 4, 1.0), ("hole", 4, -1.0), ("hole", 12, 9.0), ("row", 82, 40.0)]
    for r in rings:
        corners = list(zip(r.xs, r.ys))
        assert corners[0] == corners[-1] == min(corners) and len(set(corners)) == r.n_edges
        assert all(abs(x0 - x1) + abs(y0 - y1) == 1 for (x0, y0), (x1, y1) in zip(corners, corners[1:]))
    assert O.outline_rings(members.limit(0), "parent").count() == 0


def test_dissolved_regions_feed_the_other_operators(spark):
    members = spark.createDataFrame([("ring", *s) for s in squares(*[(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)])],
                                    "parent string, xs array<double>, ys array<double>")
    whole = O.dissolve(members, "parent")
    parcels = with_bbox(spark.createDataFrame([(k, *s) for k, s in enumerate([
        ([1.2, 1.8, 1.8, 1.2], [1.2, 1.2, 1.8, 1.2]), ([0.2, 0.8, 0.8, 0.2], [0.2, 0.2, 0.8, 0.2]), ([1.5, 2.5, 2.5, 1.5], [1.2, 1.2, 1.8, 1.2])])],
        "field_id int, xs array<double>, ys array<double>"))
    assert sorted(r.field_id for r in G.region_overlay(parcels, whole, 1.0, region_id="parent").collect()) == [1, 2]
    pixels = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (2.5, 1.5), (3.5, 1.5)], "x double, y double")
    assert sorted((r.x, r.y) for r in G.pixel_in_polygon(pixels, whole, 0.7, "parent").collect()) == [(0.5, 0.5), (2.5, 1.5)]
