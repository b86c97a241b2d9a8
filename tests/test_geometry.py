"""Decoders of vector formats against geometries written byte by byte."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as g


def wkb(kind, parts, little=True, many=False, z=False, srid=None, ewkb=False):
    """Well-known binary of the parts; z adds a third number that must be read over."""
    code = {"point": 1, "linestring": 2, "polygon": 3}[kind]

    def head(n, e, with_srid=False):
        n = n | (0x80000000 if z and ewkb else 0) | (0x20000000 if with_srid else 0) if ewkb else n + (1000 if z else 0)
        return struct.pack("<BI" if e == "<" else ">BI", int(e == "<"), n) + (struct.pack(f"{e}I", srid) if with_srid else b"")

    def point(p, e):
        return struct.pack(f"{e}{3 if z else 2}d", *p, *([7.25] if z else []))

    def body(rings, e):
        if kind == "point":
            return point(rings[0][0], e)
        line = lambda ps: struct.pack(f"{e}I", len(ps)) + b"".join(point(p, e) for p in ps)
        return line(rings[0]) if kind == "linestring" else struct.pack(f"{e}I", len(rings)) + b"".join(line(r) for r in rings)

    e = "<" if little else ">"
    if not many:
        return head(code, e, srid is not None) + body(parts[0], e)
    out = head(code + 3, e, srid is not None) + struct.pack(f"{e}I", len(parts))
    for i, p in enumerate(parts):
        inner = "<>"[i % 2]  # parts may differ in byte order
        out += head(code, inner) + body(p, inner)
    return out


def plain(row):
    return None if row is None else (row.kind, [[[(p.x, p.y) for p in ring] for ring in part] for part in row.parts])


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(5)
    number = lambda: r.choice([0.0, -0.5, 1e-7, 123456.789, -r.random() * 1e6, r.random() * 1e-3, 5e15 + 1, 3.0])
    ring = lambda n: [(number(), number()) for _ in range(n)]
    out = []
    for _ in range(4):
        out += [("point", [[ring(1)]]), ("linestring", [[ring(r.randrange(2, 6))]]), ("polygon", [[ring(4), ring(3)]])]
        out += [("point", [[ring(1)], [ring(1)]]), ("linestring", [[ring(2)], [ring(5)]]), ("polygon", [[ring(4)], [ring(5), ring(3), ring(3)]])]
    return out


def test_wkb(spark, shapes):
    rows, want = [], {}
    for i, (kind, parts) in enumerate(shapes):
        for k, kw in enumerate(({}, {"little": False}, {"z": True}, {"z": True, "ewkb": True, "srid": 4326}, {"ewkb": True, "srid": 7, "little": False})):
            rows.append((i * 10 + k, bytearray(wkb(kind, parts, many=len(parts) > 1 or k == 4, **kw))))
            want[i * 10 + k] = (kind, parts)
    odd = [(-1, None), (-2, bytearray()), (-3, bytearray(b"\x01\x63\x00\x00\x00\x00\x00\x00\x00")), (-4, bytearray(wkb("linestring", [[[(1.0, 2.0)] * 3]])[:-5])), (-5, bytearray(struct.pack("<BII", 1, 2, 2**32 - 1)))]
    df = spark.createDataFrame(rows + odd, "id long, data binary").select("id", g.from_wkb(F.col("data")).alias("g"))
    got = {x.id: x.g for x in df.collect()}
    assert {i: plain(got[i]) for i in want} == want
    assert got[-1] is None and got[-2] is None and got[-3] is None
    assert all(got[i].parts[0][0] is None for i in (-4, -5))


def test_texts(spark, shapes):
    rows, want = [], {}
    num = lambda v: repr(v)
    line = lambda ps: "(" + ", ".join(f"{num(x)} {num(y)}" for x, y in ps) + ")"
    area = lambda rs: "(" + ",".join(map(line, rs)) + ")"
    name = {"point": "Point", "linestring": "LineString", "polygon": "Polygon"}
    for i, (kind, parts) in enumerate(shapes):
        many = len(parts) > 1
        each = [area(p) if kind == "polygon" else line(p[0]) for p in parts]
        wkt = ("MULTI" if many else "") + kind.upper() + (" (" + ", ".join(each) + ")" if many else " " + each[0])
        coords = [p if kind == "polygon" else p[0] if kind == "linestring" else p[0][0] for p in parts]
        js = {"type": ("Multi" if many else "") + name[kind], "coordinates": coords if many else coords[0]}
        rows.append((i, wkt, json.dumps(js if i % 2 else {"type": "Feature", "properties": {}, "geometry": js})))
        want[i] = (kind, parts)
    df = spark.createDataFrame(rows, "id long, wkt string, js string").select("id", g.from_wkt(F.col("wkt")).alias("w"), g.from_geojson(F.col("js")).alias("j"))
    for x in df.collect():
        assert plain(x.w) == want[x.id] and plain(x.j) == want[x.id]
    odd = {
        "SRID=4326;POINT Z (1 2 3)": ("point", [[[(1.0, 2.0)]]]), "multipoint (1 2, 3 4)": ("point", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]), "LINESTRING(+1. .5,1e3 -2E-1)": ("linestring", [[[(1.0, 0.5), (1000.0, -0.2)]]]),
        "POLYGON EMPTY": ("polygon", []), "CIRCLE (1 2)": None, "": None, "MULTIPOLYGON(((0 0,1 0,1 1)),((2 2 9,3 2 9,3 3 9)))": ("polygon", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)]]]),
    }
    got = spark.createDataFrame(list(enumerate(odd)), "id long, t string").select("t", g.from_wkt(F.col("t")).alias("w")).collect()
    assert {x.t: plain(x.w) for x in got} == odd
    assert spark.range(1).select(g.from_geojson(F.lit("no")).alias("a"), g.from_geojson(F.lit(None)).alias("b"), g.from_wkt(F.lit(None)).alias("c")).first() == (None, None, None)


def test_round_trip(spark, shapes):
    rows = [(i, kind, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]) for i, (kind, parts) in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"id long, kind string, parts {g.PARTS}")
    args = (F.col("kind"), F.col("parts"))
    out = df.select("id", g.from_wkb(g.to_wkb(*args)).alias("b"), g.from_wkt(g.to_wkt(*args)).alias("w"), g.from_geojson(g.to_geojson(*args)).alias("j"))
    for x in out.collect():
        assert plain(x.b) == plain(x.w) == plain(x.j) == shapes[x.id]
