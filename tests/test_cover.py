"""Shapes as pieces and squares, and nearest sites, against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import cover, shocks, spatial
from terrane.params import load_params
from terrane.plans import catalogue_engine as ce

P = load_params()
RINGS = "array<array<struct<x:double,y:double>>>"


def star(r, cx, cy, radius, n):
    out = []
    for i in range(n):
        q = radius * r.uniform(0.3, 1)
        out.append((cx + q * math.cos(2 * math.pi * i / n), cy + q * math.sin(2 * math.pi * i / n)))
    return out if r.random() < 0.5 else out[::-1]


def cut_to_box(poly, x0, y0, x1, y1):
    def cut(p, inside, meet):
        out = []
        for i in range(len(p)):
            a, b = p[i - 1], p[i]
            if inside(a) != inside(b):
                out.append(meet(a, b))
            if inside(b):
                out.append(b)
        return out

    at_x = lambda v: lambda a, b: (v, a[1] + (b[1] - a[1]) * (v - a[0]) / (b[0] - a[0]))
    at_y = lambda v: lambda a, b: (a[0] + (b[0] - a[0]) * (v - a[1]) / (b[1] - a[1]), v)
    for inside, meet in ((lambda p: p[0] >= x0, at_x(x0)), (lambda p: p[0] <= x1, at_x(x1)), (lambda p: p[1] >= y0, at_y(y0)), (lambda p: p[1] <= y1, at_y(y1))):
        poly = cut(poly, inside, meet)
    return abs(sum(poly[i - 1][0] * poly[i][1] - poly[i][0] * poly[i - 1][1] for i in range(len(poly))) / 2)


def in_rings(x, y, rings):
    odd = False
    for ring in rings:
        for i in range(len(ring)):
            a, b = ring[i - 1], ring[i]
            odd ^= (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]
    return odd


@pytest.fixture(scope="module")
def polygons():
    r = random.Random(1)
    out = [(i, [star(r, r.uniform(0, 5000), r.uniform(0, 5000), r.choice([100, 600, 2500]), r.choice([3, 5, 12, 40]))]) for i in range(14)]
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    return out + [(100, [square(0.0, 4000.0), square(1000.0, 2500.0)]), (101, [square(500.0, 3500.0)[::-1], square(750.0, 800.0)])]


def test_overlay_area(spark, polygons):
    """Any polygons, with holes and in both directions, with edges along those of the cells."""
    layer = spark.createDataFrame(polygons, f"pid long, rings {RINGS}")
    corners = lambda x, y: [(x, y), (x + 250.0, y), (x + 250.0, y + 250.0), (x, y + 250.0)]
    cells = {i * 24 + j: (i * 250.0 - 500, j * 250.0 - 500) for i in range(24) for j in range(24)}
    df = spark.createDataFrame([(k, corners(*v)) for k, v in cells.items()], "cell long, ring array<struct<x:double,y:double>>")
    for size in (250.0, 900.0):
        got = {(x.cell, x.pid): x.area for x in cover.overlay_area(df, layer, "cell", ["pid"], size=size).collect()}
        for k, (x, y) in cells.items():
            for pid, rings in polygons:
                want = cut_to_box(rings[0], x, y, x + 250, y + 250) - sum(cut_to_box(h, x, y, x + 250, y + 250) for h in rings[1:])
                assert got.get((k, pid), 0.0) == pytest.approx(want, abs=1e-4)


def test_inside_polygons(spark, polygons):
    r = random.Random(2)
    points = [(i, r.uniform(-500, 5500), r.uniform(-500, 5500)) for i in range(1500)] + [(2000 + i, 500.0 * i, 500.0 * (i % 3)) for i in range(9)]
    df, layer = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(polygons, f"pid long, rings {RINGS}")
    want = {(p, pid) for p, x, y in points for pid, rings in polygons if in_rings(x, y, rings)}
    for size in (30.0, 1000.0):
        assert {(x.p, x.pid) for x in cover.inside_polygons(df, layer, "rings", ["pid"], size, "x", "y").collect()} == want
    assert cover.inside_polygons(df, layer.limit(0), "rings", ["pid"], 100.0, "x", "y").count() == 0
    empty = spark.createDataFrame([(1, None), (2, []), (3, [[]])], f"pid long, rings {RINGS}")
    assert cover.inside_polygons(df, empty, "rings", ["pid"], 100.0, "x", "y").count() == 0


def test_squares_grow_with_length(spark):
    """A diagonal line has pieces in proportion to its length; a large polygon has few squares inside."""
    lines = spark.createDataFrame([(n, [(0.0, 0.0), (100.0 * n, 100.0 * n)]) for n in (10, 20, 40)], "id long, line array<struct<x:double,y:double>>")
    counts = {r.id: r["count"] for r in cover.line_pieces(lines, "line", ["id"], 100.0).groupBy("id").count().collect()}
    assert counts[20] <= 2 * counts[10] and counts[40] <= 2 * counts[20] and counts[10] == 15
    box = lambda a: [[(1.0, 1.0), (a, 1.0), (a, a), (1.0, a)]]
    boxes = spark.createDataFrame([(n, box(100.0 * n)) for n in (16, 32, 64)], f"id long, rings {RINGS}")
    squares = {r.id: r["count"] for r in cover.quadtree(boxes, "rings", ["id"], 100.0).groupBy("id").count().collect()}
    assert squares[64] < 2.3 * squares[32] < 5.3 * squares[16]


def test_nearest_of(spark):
    """The nearest site lies beyond the first radius, or far outside all of the points."""
    r = random.Random(3)
    points = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(200)] + [(500, 9e5, 9e5), (501, None, 1.0)]
    sites = [(i, r.uniform(0, 300), r.uniform(0, 300)) for i in range(40)] + [(77, 5e4, 0.0), (78, 5e4, 0.0), (79, None, None)]
    p, s = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(sites, "site long, sx double, sy double")
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)
    want = {k: min((math.hypot(x - a, y - b), i) for i, a, b in sites if a is not None) for k, x, y in points if x is not None}
    for start in (None, 1.0, 1e7):
        got = {x.k: (x.dist_m, x.site) for x in spatial.nearest_of(p, ["k"], s, "site", "x", "y", "sx", "sy", cut, start).collect()}
        assert got == {k: (pytest.approx(d), i) for k, (d, i) in want.items()}
    assert spatial.nearest_of(p, ["k"], s.limit(0), "site", "x", "y", "sx", "sy", cut).count() == 0
    assert spatial.nearest_of(p.limit(0), ["k"], s, "site", "x", "y", "sx", "sy", cut).count() == 0


def test_fields_are_measured_from_the_geometry(spark):
    """A cell 300 m from the end of a 4 km line is in the first band, though the line's centre is 2 km away."""
    cells = spark.createDataFrame([(1, 0.0, 300.0), (2, 2000.0, -900.0), (3, 5000.0, 0.0), (4, 6100.0, 200.0), (5, 2100.0, 2100.0)], "cell long, x_m double, y_m double")
    line, box = [(0.0, 0.0), (4000.0, 0.0)], [(6000.0, 0.0), (6500.0, 0.0), (6500.0, 500.0), (6000.0, 500.0)]
    rows = [(1, "rail", line, False), (2, "plant", box, True), (3, "data", None, None)]
    schema = "project_id long, archetype string, shape array<struct<x:double,y:double>>, area boolean"
    sites = spark.createDataFrame(rows, schema).withColumns({"x": F.lit(2000.0), "y": F.lit(2000.0), "weight": F.lit(1.0), "construction_start": F.lit(1990.0), "open_year": F.lit(1991.0), "site": F.lit(1), "year": F.lit(2000)})
    _, fields, multipliers = ce._tables(sites)
    got = shocks.field_effects(sites.withColumn("flags", F.array().cast("array<string>")), fields, multipliers, cells, (0.0, 0.0))
    by = {(r.project_id, r.cell, r.category, r.target): r.value for r in got.collect()}
    assert by[1, 1, "premium", "residential"] == 0.09 and by[1, 2, "premium", "residential"] == 0.055 and by[1, 3, "premium", "residential"] == 0.055
    assert by[2, 4, "disamenity", "residential"] == -0.05 and (1, 4, "premium", "residential") not in by
    near = math.hypot(100, 100)
    assert 0 < by[3, 5, "premium", "residential"] <= 0.02 * (1 - near / 900) + 1e-12


def test_site_of_a_far_project(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "cell long, x_m double, y_m double")
    projects = spark.createDataFrame([(1, 2, None, None), (2, 9, 1e6, 5.0), (3, None, -8e5, 0.0), (4, 9, None, None)], "project_id long, cell long, x double, y double")
    assert {r.project_id: r.site for r in shocks.site_cells(projects, cells).collect()} == {1: 2, 2: 2, 3: 1}
