"""Shapes as pieces of edges and as squares of several sizes, so that no shape goes whole to where a part of it counts.

A polygon is an array of rings, the first its outer one and the others holes; a ring is an array of (x, y). Lines and
rings are cut into pieces no longer than a square, so the squares that they go to grow with their length. A polygon is
covered by a quadtree: squares that no edge meets stay as large as they are, the others are split down to the least
size. A square keeps the edges that meet it and whether its lower left corner is inside, which is all that a point in
it needs. Points look up one square of each size, by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.normal import let

POINT = "struct<x:double,y:double>"
SEGMENTS = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
#: Squares of a quadtree are split this often at most: a shape of 2 ** 24 least squares a side has no larger ones.
LEVELS = 24
#: Where on an edge, and by what weights of a cell's corners, a cell is asked whether it is inside: no round shares.
EDGE_AT, ANCHOR_STEP = 0.4871093, 0.0713
#: Cells count as smaller by this share, so that edges of polygons along their own edges are outside, whatever the rounding.
SHRINK = 1e-12


def signed_area(ring: Column) -> Column:
    """Area of a ring, positive where it runs anticlockwise."""
    n = F.size(ring)

    def part(p: Column, i: Column) -> Column:
        q, o = F.get(ring, (i + 1) % n), F.get(ring, F.lit(0))
        return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])

    return F.aggregate(F.transform(ring, part), F.lit(0.0), lambda a, v: a + v) / 2


def _edges(ring: Column, closed: bool) -> Column:
    """The edges of an array of points as (x1, y1, x2, y2); a line of one point has one edge of no length."""
    n = F.size(ring)
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    if closed:
        return F.transform(ring, lambda p, i: edge(p, F.get(ring, (i + 1) % n)))
    return F.transform(F.slice(ring, F.lit(1), F.greatest(n - 1, F.least(n, F.lit(1)))), lambda p, i: edge(p, F.get(ring, F.least(i + 1, n - 1))))


def oriented_edges(rings: Column) -> Column:
    """All edges of a polygon, its inside on their left: outer rings run anticlockwise, holes clockwise."""

    def turned(ring: Column, i: Column) -> Column:
        right = F.when(i == 0, signed_area(ring) >= 0).otherwise(signed_area(ring) <= 0)
        return _edges(F.when(right, ring).otherwise(F.reverse(ring)), True)

    return F.flatten(F.transform(rings, turned))


def _cut(df: DataFrame, edges: Column, keep: list[str], longest: float) -> DataFrame:
    """(keep..., x1, y1, x2, y2): the edges in pieces no longer than longest; neighbours share their ends exactly."""
    rows = df.select(*keep, F.explode(edges).alias("_e")).select(*keep, "_e.*")
    parts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / float(longest))).cast("int")
    rows = rows.withColumn("_n", parts).withColumn("_k", F.explode(F.expr("sequence(0, _n - 1)")))
    at = lambda a, b, k: F.when(k == 0, F.col(a)).when(k == F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n"))
    ends = [at(f"{v}1", f"{v}2", F.col("_k") + d).alias(f"{v}{d + 1}") for d in (0, 1) for v in ("x", "y")]
    return rows.select(*keep, *ends)


def line_pieces(df: DataFrame, line: str, keep: list[str], longest: float) -> DataFrame:
    """(keep..., x1, y1, x2, y2) of lines of points, in pieces no longer than longest. Null and empty lines give none."""
    return _cut(df, _edges(F.col(line), False), keep, longest)


def ring_pieces(df: DataFrame, rings: str, keep: list[str], longest: float) -> DataFrame:
    """(keep..., x1, y1, x2, y2) of polygons' edges, the inside on the left, in pieces no longer than longest."""
    return _cut(df, oriented_edges(F.col(rings)), keep, longest)


def piece_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the piece (x1, y1, x2, y2) of its row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.when(length > 0, length)))).otherwise(0.0)
    return F.hypot(x - F.col("x1") - t * dx, y - F.col("y1") - t * dy)


def _legs(edges: Column) -> Column:
    """Edges with what their distances need: dx, dy and the squared length, 1 where it is 0."""
    dx, dy = (lambda e: e["x2"] - e["x1"]), (lambda e: e["y2"] - e["y1"])
    square = lambda e: dx(e) * dx(e) + dy(e) * dy(e)
    return F.transform(edges, lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"), dx(e).alias("dx"), dy(e).alias("dy"), F.when(square(e) > 0, square(e)).otherwise(1.0).alias("length")))


def _leg_distance(e: Column, x: Column, y: Column) -> Column:
    """Distance from a point to one of _legs."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * e["dx"] + (y - e["y1"]) * e["dy"]) / e["length"]))
    return let(t, lambda t: F.hypot(x - e["x1"] - t * e["dx"], y - e["y1"] - t * e["dy"]))


def _crossed(e: Column, x: Column, y: Column) -> Column:
    """1 if the way to (x, y) along x, from the left of all, crosses an edge, as _crossings has it."""
    over = (e["y1"] > y) != (e["y2"] > y)
    return F.when(over & (e["x1"] + e["dx"] * (y - e["y1"]) / F.when(over, e["dy"]) <= x), 1).otherwise(0)


def near_small_shapes(points: DataFrame, shapes: DataFrame, point: list[str], keep: list[str], reach: float, x: str, y: str, cut) -> DataFrame:
    """(point..., keep..., dist_m) of the points within reach of each shape, 0 inside a ring.

    shapes have the columns keep, shape, an array of few points, and area, whether it is a ring; their boxes must be a
    few times reach wide at most. A shape goes to the squares of its box, a point to its own, so a pair meets once and
    nothing is grouped. cut writes the points of squares that have shapes, so Spark knows their size.
    """
    at = lambda v: F.floor(v / float(reach)).cast("long")
    ends = [f(F.transform("shape", lambda p: p[v])).alias(f"_{n}{v}") for v in ("x", "y") for n, f in (("low", F.array_min), ("high", F.array_max))]
    rows = shapes.select(*keep, "area", F.when(F.col("area"), _legs(_edges(F.col("shape"), True))).otherwise(_legs(_edges(F.col("shape"), False))).alias("_es"), *ends)
    for name, column in _squares(F.col("_lowx") - float(reach), F.col("_highx") + float(reach), F.col("_lowy") - float(reach), F.col("_highy") + float(reach), reach):
        rows = rows.withColumn(name, column)
    own = points.select(*point, F.col(x).alias("_px"), F.col(y).alias("_py")).withColumn("_bx", at(F.col("_px"))).withColumn("_by", at(F.col("_py")))
    own = cut(own.join(rows.select("_bx", "_by").distinct(), ["_bx", "_by"], "left_semi"))
    px, py = F.col("_px"), F.col("_py")
    gap = lambda v, p: F.greatest(F.lit(0.0), F.col(f"_low{v}") - p, p - F.col(f"_high{v}"))
    boxed = F.hypot(gap("x", px), gap("y", py)) <= float(reach)
    pairs = rows.join(own, ["_bx", "_by"]).filter(boxed)
    beside = F.array_min(F.transform("_es", lambda e: _leg_distance(e, px, py)))
    odd = F.aggregate(F.transform("_es", lambda e: _crossed(e, px, py)), F.lit(0), lambda a, v: a + v) % 2 == 1
    # exploded, so that a filter does not compute the distance once more
    close = F.filter(F.array(F.when(F.col("area") & odd, 0.0).otherwise(beside)), lambda d: d <= float(reach))
    return pairs.select(*point, *keep, F.explode(close).alias("dist_m"))


def _squares(low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: float) -> list[tuple[str, Column]]:
    at = lambda v: F.floor(v / float(size)).cast("long")
    return [("_bx", F.explode(F.sequence(at(low_x), at(high_x)))), ("_by", F.explode(F.sequence(at(low_y), at(high_y))))]


def distances_within(points: DataFrame, pieces: DataFrame, point: list[str], keep: list[str], reach: float, x: str, y: str) -> DataFrame:
    """(point..., keep..., dist_m): the distance of each point to each shape that has a piece within reach.

    points have the columns point, x and y; pieces come from line_pieces or ring_pieces, no longer than reach. A piece
    goes to the squares, of reach a side, that are no farther than reach from its box: sixteen at most.
    """
    around = pieces
    low, high = (lambda v: F.least(F.col(f"{v}1"), F.col(f"{v}2")) - float(reach)), (lambda v: F.greatest(F.col(f"{v}1"), F.col(f"{v}2")) + float(reach))
    for name, column in _squares(low("x"), high("x"), low("y"), high("y"), reach):
        around = around.withColumn(name, column)
    at = lambda v: F.floor(F.col(v) / float(reach)).cast("long")
    pairs = points.select(*point, F.col(x).alias("_px"), F.col(y).alias("_py")).withColumn("_bx", at("_px")).withColumn("_by", at("_py")).join(around, ["_bx", "_by"])
    pairs = pairs.withColumn("_d", piece_distance(F.col("_px"), F.col("_py"))).filter(F.col("_d") <= float(reach))
    return pairs.groupBy(*point, *keep).agg(F.min("_d").alias("dist_m"))


def distance_to_pieces(points: DataFrame, pieces: DataFrame, key: str, ceiling: float, x: str, y: str, cut, start: float) -> DataFrame:
    """(key, dist_m): the distance of each point to the nearest piece, at most the ceiling, which no piece at all gives.

    Radii grow from start, the pieces' greatest length, by two; points that have met a piece are asked no more. cut
    writes a round.
    """
    pieces, own, out = cut(pieces), points.select(key, x, y), None
    radius = min(float(start), float(ceiling))
    while True:
        near = cut(distances_within(own, pieces, [key], [], radius, x, y))
        out = near if out is None else out.unionByName(near)
        if radius >= ceiling:
            break
        own = cut(own.join(near.select(key), key, "left_anti"))
        if own.isEmpty():
            break
        radius = min(2 * radius, float(ceiling))
    return points.select(key).join(out, key, "left").select(key, F.coalesce("dist_m", F.lit(float(ceiling))).alias("dist_m"))


def _crossings(segments: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How many segments the way from (ax, ay) along x and then along y to (bx, by) crosses. Points count as a little
    to the right of and above themselves, so ends of edges and edges along the way are met once or not at all."""

    def met(s: Column) -> Column:
        over = (s["y1"] > ay) != (s["y2"] > ay)
        x = s["x1"] + (s["x2"] - s["x1"]) * (ay - s["y1"]) / F.when(over, s["y2"] - s["y1"])
        beside = (s["x1"] > bx) != (s["x2"] > bx)
        y = s["y1"] + (s["y2"] - s["y1"]) * (bx - s["x1"]) / F.when(beside, s["x2"] - s["x1"])
        level = over & (x > F.least(ax, bx)) & (x <= F.greatest(ax, bx))
        upright = beside & (y > F.least(ay, by)) & (y <= F.greatest(ay, by))
        return F.when(level, 1).otherwise(0) + F.when(upright, 1).otherwise(0)

    return F.aggregate(F.transform(segments, met), F.lit(0), lambda a, v: a + v)


def _touching(segments: Column, x: Column, y: Column, size: Column) -> Column:
    """The segments that may meet the closed square at (x, y): their box does, and its corners are not all on one side."""

    def near(s: Column) -> Column:
        box = (F.least(s["x1"], s["x2"]) <= x + size) & (F.greatest(s["x1"], s["x2"]) >= x) & (F.least(s["y1"], s["y2"]) <= y + size) & (F.greatest(s["y1"], s["y2"]) >= y)
        side = lambda px, py: (s["x2"] - s["x1"]) * (py - s["y1"]) - (s["y2"] - s["y1"]) * (px - s["x1"])
        corners = [side(x, y), side(x + size, y), side(x, y + size), side(x + size, y + size)]
        return box & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.filter(segments, near)


def quadtree(polygons: DataFrame, rings: str, keep: list[str], size: float) -> DataFrame:
    """(keep..., level, ix, iy, inside, segments): squares of size * 2 ** level that cover each polygon.

    inside says whether the square's lower left corner is in the polygon. A square without segments is wholly inside;
    one with segments is of level 0. Polygons that are null or have no ring give no squares.
    """
    edges = _edges_of(F.col(rings))
    rows = polygons.select(*keep, edges.alias("segments")).filter("size(segments) > 0")
    low, high = (lambda v: F.array_min(F.transform("segments", lambda s: F.least(s[f"{v}1"], s[f"{v}2"])))), (lambda v: F.array_max(F.transform("segments", lambda s: F.greatest(s[f"{v}1"], s[f"{v}2"]))))
    rows = rows.select("*", *[f(v).alias(f"{n}_{v}") for v in ("x", "y") for n, f in (("low", low), ("high", high))])
    wide = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) / float(size)
    rows = rows.withColumn("level", F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))).cast("int")))
    top = rows.agg(F.max("level")).first()[0]
    if top is None:
        top = 0
    first = lambda v: F.floor(F.col(v) / (float(size) * F.pow(F.lit(2.0), "level"))).cast("long")
    rows = rows.withColumn("ix", F.explode(F.sequence(first("low_x"), first("high_x")))).withColumn("iy", F.explode(F.sequence(first("low_y"), first("high_y"))))
    side = float(size) * F.pow(F.lit(2.0), "level")
    x, y = F.col("ix") * side, F.col("iy") * side
    # from a point that is left of and below all of the polygon
    inside = _crossings(F.col("segments"), F.col("low_x") - 1.0, y, x, y) % 2 == 1
    rows = rows.select(*keep, "level", "ix", "iy", F.when(x < F.col("low_x"), False).otherwise(inside).alias("inside"), _touching(F.col("segments"), x, y, side).alias("segments"))
    rows = rows.filter("inside OR size(segments) > 0")
    for level in range(top, 0, -1):
        splits = (F.col("level") == level) & (F.size("segments") > 0)
        half = F.lit(float(size) * 2.0 ** (level - 1))

        def child(dx: int, dy: int) -> Column:
            ix, iy = F.col("ix") * 2 + dx, F.col("iy") * 2 + dy
            cx, cy = ix * half, iy * half
            odd = _crossings(F.col("segments"), F.col("ix") * 2 * half, F.col("iy") * 2 * half, cx, cy) % 2 == 1
            return F.struct(F.lit(level - 1).alias("level"), ix.alias("ix"), iy.alias("iy"), (F.col("inside") != odd).alias("inside"), _touching(F.col("segments"), cx, cy, half).alias("segments"))

        same = F.struct("level", "ix", "iy", "inside", "segments")
        each = F.explode(F.when(splits, F.array(*[child(dx, dy) for dx in (0, 1) for dy in (0, 1)])).otherwise(F.array(same))).alias("_s")
        rows = rows.select(*keep, each).select(*keep, "_s.*").filter("inside OR size(segments) > 0")
    return rows


def _edges_of(rings: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(rings, lambda r: _edges(r, True))), F.array().cast(SEGMENTS))


def inside_polygons(points: DataFrame, polygons: DataFrame, rings: str, keep: list[str], size: float, x: str, y: str) -> DataFrame:
    """points with the columns keep of each polygon that holds them; a point on an edge belongs to what is right of or
    above it. size: the least squares of the cover, which decide speed alone."""
    squares = quadtree(polygons, rings, keep, size)
    top = squares.agg(F.max("level")).first()[0]
    at = lambda v: F.expr(f"shiftright(floor(`{v}` / {float(size)!r}D), _level)")
    named = squares.select(*keep, F.col("level").alias("_level"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("inside").alias("_in"), F.col("segments").alias("_segs"))
    probes = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(int(top or 0))))).withColumn("_ix", at(x)).withColumn("_iy", at(y))
    met = probes.join(named.hint("merge"), ["_level", "_ix", "_iy"])
    side = float(size) * F.pow(F.lit(2.0), "_level")
    odd = _crossings(F.col("_segs"), F.col("_ix") * side, F.col("_iy") * side, F.col(x), F.col(y)) % 2 == 1
    return met.filter(F.col("_in") != odd).drop("_level", "_ix", "_iy", "_in", "_segs")


def _shares(ring: Column, ax: Column, ay: Column) -> Column:
    """Twice what a piece of a polygon's edge adds to the area that the polygon shares with a convex ring around (ax, ay).

    By Green's theorem that is the piece's own part inside the ring, and, for each edge of the ring, how much of it the
    piece turns from outside to inside or back; counted from a point on the edge, which the anchor is linked with.
    """
    px, py, qx, qy = F.col("x1") - ax, F.col("y1") - ay, F.col("x2") - ax, F.col("y2") - ay
    n = F.size(ring)
    at = lambda p, v, a: (p[v] - a) * (1 - SHRINK)
    edges = F.transform(ring, lambda u, i: let(F.get(ring, (i + 1) % n), lambda v: F.struct(at(u, "x", ax).alias("ux"), at(u, "y", ay).alias("uy"), at(v, "x", ax).alias("vx"), at(v, "y", ay).alias("vy"))))

    def own(es: Column) -> Column:
        def narrow(acc: Column, e: Column) -> Column:
            f = lambda x, y: (e["vx"] - e["ux"]) * (y - e["uy"]) - (e["vy"] - e["uy"]) * (x - e["ux"])
            fp, fq = f(px, py), f(qx, qy)
            rise = fq - fp
            t = -fp / F.when(rise != 0, rise)
            never = (rise == 0) & (fp <= 0)
            return F.struct(
                F.when(never, 2.0).when(rise > 0, F.greatest(acc["t0"], t)).otherwise(acc["t0"]).alias("t0"), F.when(rise < 0, F.least(acc["t1"], t)).otherwise(acc["t1"]).alias("t1")
            )

        start = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))
        return let(F.aggregate(es, start, narrow), lambda r: F.greatest(F.lit(0.0), r["t1"] - r["t0"]) * (px * (qy - py) - py * (qx - px)))

    def hit(ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column, Column]:
        """Whether the piece meets the way from u to v, where on the way, and +1 where the way enters the polygon."""
        f = lambda x, y: (vx - ux) * (y - uy) - (vy - uy) * (x - ux)
        g = lambda x, y: (qx - px) * (y - py) - (qy - py) * (x - px)
        over = (f(px, py) > 0) != (f(qx, qy) > 0)
        gu, gv = g(ux, uy), g(vx, vy)
        t = gu / F.when(gu != gv, gu - gv)
        return over & (t >= 0) & (t <= 1), t, F.when(gv > gu, 1.0).otherwise(-1.0)

    def turned(e: Column) -> Column:
        mx, my = e["ux"] + EDGE_AT * (e["vx"] - e["ux"]), e["uy"] + EDGE_AT * (e["vy"] - e["uy"])
        way, _, enters = hit(F.lit(0.0), F.lit(0.0), mx, my)
        cut, t, inward = hit(e["ux"], e["uy"], e["vx"], e["vy"])
        share = F.when(way, enters).otherwise(0.0) + F.when(cut, inward * F.when(t > EDGE_AT, 1 - t).otherwise(-t)).otherwise(0.0)
        return share * (e["ux"] * e["vy"] - e["uy"] * e["vx"])

    return let(edges, lambda es: own(es) + F.aggregate(F.transform(es, turned), F.lit(0.0), lambda a, v: a + v))


def overlay_area(cells: DataFrame, layer: DataFrame, cell: str, keep: list[str], ring: str = "ring", rings: str = "rings", size: float = 1000.0) -> DataFrame:
    """(cell, keep..., area): the area that each polygon of layer shares with each convex cell, where there is any.

    keep must name the polygon. Pieces of edges meet cells by square; what is inside comes from a quadtree at one point
    of each cell. No polygon is in one row with a cell, so it may be of any size; cells should be about a square.
    """
    corners = F.col(ring)
    convex = cells.select(F.col(cell), F.when(signed_area(corners) >= 0, corners).otherwise(F.reverse(corners)).alias("_ring"))
    weight = lambda i: 1.0 + ANCHOR_STEP * i * i
    total = F.aggregate(F.transform("_ring", lambda p, i: weight(i)), F.lit(0.0), lambda a, v: a + v)
    anchor = lambda v: F.aggregate(F.transform("_ring", lambda p, i: p[v] * weight(i)), F.lit(0.0), lambda a, w: a + w) / total
    low, high = (lambda v: F.array_min(F.transform("_ring", lambda p: p[v]))), (lambda v: F.array_max(F.transform("_ring", lambda p: p[v])))
    convex = convex.withColumn("_ax", anchor("x")).withColumn("_ay", anchor("y")).withColumn("_own", signed_area(F.col("_ring")))
    boxes = convex.select("*", low("x").alias("_lx"), high("x").alias("_hx"), low("y").alias("_ly"), high("y").alias("_hy"))
    at = lambda v: F.floor(v / float(size)).cast("long")
    dealt = boxes
    for name, column in _squares(F.col("_lx"), F.col("_hx"), F.col("_ly"), F.col("_hy"), size):
        dealt = dealt.withColumn(name, column)
    ends = ring_pieces(layer, rings, keep, size)
    ends = ends.select("*", *[f(f"{v}1", f"{v}2").alias(f"_{n}{v}") for v in ("x", "y") for n, f in (("low", F.least), ("high", F.greatest))])
    parts = ends
    for name, column in _squares(F.col("_lowx"), F.col("_highx"), F.col("_lowy"), F.col("_highy"), size):
        parts = parts.withColumn(name, column)
    # a pair that shares several squares meets in the first of them alone
    first = (F.col("_bx") == F.greatest(at(F.col("_lx")), at(F.col("_lowx")))) & (F.col("_by") == F.greatest(at(F.col("_ly")), at(F.col("_lowy"))))
    boxed = (F.col("_lowx") <= F.col("_hx")) & (F.col("_highx") >= F.col("_lx")) & (F.col("_lowy") <= F.col("_hy")) & (F.col("_highy") >= F.col("_ly"))
    # merged, as both sides are more rows than their files tell
    pairs = dealt.join(parts.hint("merge"), ["_bx", "_by"]).filter(first & boxed)
    edge = pairs.select(cell, *keep, "_own", (_shares(F.col("_ring"), F.col("_ax"), F.col("_ay")) / 2).alias("_part"))
    whole = inside_polygons(convex.select(cell, "_ax", "_ay", "_own"), layer, rings, keep, size, "_ax", "_ay").select(cell, *keep, "_own", F.col("_own").alias("_part"))
    sums = edge.unionByName(whole).groupBy(cell, *keep).agg(F.sum("_part").alias("area"), F.max("_own").alias("_own"))
    return sums.filter(F.col("area") > 1e-9 * F.col("_own")).drop("_own")
