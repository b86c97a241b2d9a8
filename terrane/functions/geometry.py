"""Geometries in WKB, WKT and GeoJSON as Columns.

A decoded geometry is (kind, parts): kind is point, linestring or polygon, for one or many of them, and parts an array
of arrays of arrays of points (x, y). A polygon's part has its rings, the outer one first; a line's or point's part has
one array of points. Other dimensions than x and y are read over. What cannot be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.normal import let

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
PARTS = f"array<{RINGS}>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
#: Numbers of the binary form, and the names of the text forms.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}


def _kind(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "^multi", "")


def _u32(h: Column, at: Column, little: Column) -> Column:
    """Four bytes at a byte offset of a hex text, unsigned; null where they are not all there."""
    b = [F.substring(h, at * 2 + 1 + 2 * i, F.lit(2)) for i in range(4)]
    text = F.when(little, F.concat(*b[::-1])).otherwise(F.concat(*b))
    return F.when(F.length(text) == 8, F.conv(text, 16, 10).cast("long"))


def _f64(h: Column, at: Column, little: Column) -> Column:
    """A double from eight bytes, by its sign, exponent and fraction."""

    def value(two: Column) -> Column:
        high, low = two["high"], two["low"]
        exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
        fraction = (high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(2**32) + low).cast("double")
        size = F.when(exponent == 0, fraction * F.lit(2.0**-1074)).otherwise((fraction + F.lit(2.0**52)) * F.pow(F.lit(2.0), exponent - 1075))
        return F.when(exponent == 0x7FF, F.lit(None)).otherwise(F.when(high >= 2**31, -size).otherwise(size))

    first, second = _u32(h, at, little), _u32(h, at + 4, little)
    return let(F.struct(F.when(little, second).otherwise(first).alias("high"), F.when(little, first).otherwise(second).alias("low")), value)


def from_wkb(data: Column) -> Column:
    """(kind, parts) of well-known binary, either byte order in each part, with or without z, m and a reference system."""
    none = F.array().cast(f"array<{POINT}>")

    def head(h: Column, at: Column) -> Column:
        little = F.substring(h, at * 2 + 1, F.lit(2)) == "01"

        def read(code: Column) -> Column:
            flags, plain = F.shiftright(code, 28), code.bitwiseAND(F.lit(0x0FFFFFFF))
            thousands = F.floor(plain / 1000)
            extra = flags.bitwiseAND(F.lit(8)).cast("boolean").cast("int") + flags.bitwiseAND(F.lit(4)).cast("boolean").cast("int")
            dims = F.lit(2) + extra + F.when(thousands == 3, 2).when(thousands > 0, 1).otherwise(0)
            start = at + 5 + F.when(flags.bitwiseAND(F.lit(2)) > 0, 4).otherwise(0)
            return F.struct(little.alias("little"), (plain % 1000).cast("int").alias("code"), (dims * 8).cast("long").alias("step"), start.alias("at"))

        return let(_u32(h, at + 1, little), read)

    def points(h: Column, o: Column, at: Column, n: Column) -> Column:
        one = lambda i: F.struct(_f64(h, at + i * o["step"], o["little"]).alias("x"), _f64(h, at + i * o["step"] + 8, o["little"]).alias("y"))
        # n is what the data claim: no more points than bytes
        fits = (n > 0) & (at + n * o["step"] <= F.length(h) / 2)
        return F.when(n == 0, none).when(fits, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), one))

    def counted(h: Column, o: Column, at: Column, n: Column, step) -> Column:
        """Folds n times from at: step gives (end, rings) of one."""
        start = F.struct(at.alias("at"), F.array().cast(RINGS).alias("rings"))
        times = F.when((n > 0) & (n <= F.length(h)), F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(times, start, lambda acc, _: step(acc))

    def simple(h: Column, o: Column) -> Column:
        """(at, rings) of a point, line or polygon whose header is read."""
        at, little = o["at"], o["little"]

        def ring(acc: Column) -> Column:
            return let(_u32(h, acc["at"], little), lambda n: F.struct((acc["at"] + 4 + n * o["step"]).alias("at"), F.concat(acc["rings"], F.array(points(h, o, acc["at"] + 4, n))).alias("rings")))

        spot = F.struct((at + o["step"]).alias("at"), F.array(points(h, o, at, F.lit(1).cast("long"))).alias("rings"))
        line = let(_u32(h, at, little), lambda n: F.struct((at + 4 + n * o["step"]).alias("at"), F.array(points(h, o, at + 4, n)).alias("rings")))
        area = let(_u32(h, at, little), lambda n: counted(h, o, at + 4, n, ring))
        return F.when(o["code"] == 1, spot).when(o["code"] == 2, line).when(o["code"] == 3, area)

    def many(h: Column, o: Column) -> Column:
        start = F.struct((o["at"] + 4).alias("at"), F.array().cast(PARTS).alias("parts"))

        def part(acc: Column) -> Column:
            return let(head(h, acc["at"]), lambda inner: let(simple(h, inner), lambda s: F.struct(s["at"].alias("at"), F.concat(acc["parts"], F.array(s["rings"])).alias("parts"))))

        def all_of(n: Column) -> Column:
            times = F.when((n > 0) & (n <= F.length(h)), F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(times, start, lambda acc, _: part(acc))["parts"]

        return let(_u32(h, o["at"], o["little"]), all_of)

    def read(h: Column) -> Column:
        def body(o: Column) -> Column:
            parts = F.when(o["code"] <= 3, F.array(simple(h, o)["rings"])).when(o["code"] <= 6, many(h, o))
            names = F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))]), F.least(F.greatest(o["code"], F.lit(1)), F.lit(6)))
            return F.when(o["code"].between(1, 6), F.struct(_kind(names).alias("kind"), parts.alias("parts")))

        return let(head(h, F.lit(0).cast("long")), body)

    return F.when(F.length(data) >= 9, let(F.hex(data), read))


def _nested(kind: Column, said: Column) -> Column:
    """(kind, parts) from nested arrays of coordinates, as JSON, and the kind's name."""
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    line = lambda ps: F.transform(ps, point)
    read = lambda depth: F.from_json(said, "array<" * depth + "double" + ">" * depth)
    rings = lambda rs: F.transform(rs, line)
    parts = (
        F.when(kind == "point", F.array(F.array(F.array(point(read(1))))))
        .when(kind == "multipoint", F.transform(read(2), lambda p: F.array(F.array(point(p)))))
        .when(kind == "linestring", F.array(F.array(line(read(2)))))
        .when(kind == "multilinestring", F.transform(read(3), lambda ps: F.array(line(ps))))
        .when(kind == "polygon", F.array(rings(read(3))))
        .when(kind == "multipolygon", F.transform(read(4), rings))
    )
    return F.when(parts.isNotNull(), F.struct(_kind(kind).alias("kind"), parts.alias("parts")))


def from_geojson(text: Column) -> Column:
    """(kind, parts) of a GeoJSON geometry, or of a feature's geometry."""
    inner = F.when(F.get_json_object(text, "$.type") == "Feature", F.get_json_object(text, "$.geometry")).otherwise(text)
    return _nested(F.lower(F.get_json_object(inner, "$.type")), F.get_json_object(inner, "$.coordinates"))


def from_wkt(text: Column) -> Column:
    """(kind, parts) of well-known text, with or without a reference system, z and m; EMPTY has no parts."""
    plain = F.regexp_replace(F.trim(text), r"(?i)^SRID=\d+;", "")
    name = F.lower(F.regexp_extract(plain, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_extract(plain, r"(?s)^[^(]*(\(.*\))\s*$", 1)
    # one pair of brackets around each point, and numbers as JSON has them
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    bare = F.regexp_replace(body, rf"\(\s*({number}(?:\s+{number})+)\s*\)", "($1)")
    loose = F.when(name == "multipoint", F.regexp_replace(bare, rf"\(({number}(?:\s+{number})+)\)", "$1")).otherwise(bare)
    loose = F.when((name == "multipoint") & ~F.startswith(loose, F.lit("(")), F.concat(F.lit("("), loose, F.lit(")"))).otherwise(loose)
    tight = F.regexp_replace(F.regexp_replace(loose, rf"({number}(?:\s+{number})+)", "[$1]"), rf"({number})\s+(?={number})", "$1,")
    tight = F.regexp_replace(tight, rf"({number})\s+(?={number})", "$1,")
    said = F.regexp_replace(F.regexp_replace(tight, r"(?<![\d.])\.(\d)", "0.$1"), r"(\d)\.(?!\d)", "$1.0")
    said = F.regexp_replace(said, r"\+(?=[\d])", "")
    said = F.regexp_replace(said, r"(?<![\d.eE])(-?)0+(?=\d)", "$1")
    said = F.translate(said, "()", "[]")
    said = F.when(name == "point", F.regexp_extract(said, r"(?s)^\[(.*)\]$", 1)).otherwise(said)
    known = F.when(name.isin(*[k.lower() for k in KINDS.values()]), name)
    empty = F.struct(_kind(known).alias("kind"), F.array().cast(PARTS).alias("parts"))
    return F.when(known.isNotNull() & F.upper(plain).rlike(r"EMPTY\s*$"), empty).when(known.isNotNull(), _nested(known, said))


def double_hex(x: Column) -> Column:
    """The eight bytes of a double, highest first, as hex: sign, exponent and fraction by arithmetic, which is exact.

    Doubles below 2 ** -1022, which have fewer digits, have their own exponent; -0.0 is 0.0, and NaN and infinities are
    named by one pattern each.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(F.when(size > 0, size))).cast("int")

    def bits(e: Column) -> Column:
        fraction = ((size / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0**52)).cast("long")
        high = F.shiftright(fraction, 32) + (e + 1023).cast("long") * F.lit(2**20) + F.when(x < 0, F.lit(2**31)).otherwise(F.lit(0).cast("long"))
        return F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(fraction.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))

    tiny = F.concat(F.lpad(F.hex(F.shiftright((size / F.lit(2.0**-1074)).cast("long"), 32) + F.when(x < 0, F.lit(2**31)).otherwise(F.lit(0).cast("long"))), 8, "0"), F.lpad(F.hex((size / F.lit(2.0**-1074)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    fixed = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    odd = F.when(F.isnan(x), "7FF8000000000000").when(x == float("inf"), "7FF0000000000000").when(x == float("-inf"), "FFF0000000000000")
    return F.when(odd.isNotNull(), odd).when(x == 0, F.lit("0" * 16)).when(size < 2.0**-1022, tiny).otherwise(let(fixed, bits))


def to_wkb(kind: Column, parts: Column) -> Column:
    """Well-known binary, highest byte first, always of the many-part kinds."""
    u32 = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    point = lambda p: F.concat(double_hex(p["x"]), double_hex(p["y"]))
    line = lambda ps: F.concat(u32(F.size(ps)), F.array_join(F.transform(ps, point), ""))
    head = lambda code: F.concat(F.lit("00"), u32(code))
    code = F.when(kind == "point", 1).when(kind == "linestring", 2).when(kind == "polygon", 3)

    def part(rings: Column) -> Column:
        area = F.concat(u32(F.size(rings)), F.array_join(F.transform(rings, line), ""))
        body = F.when(kind == "point", point(F.get(F.get(rings, F.lit(0)), F.lit(0)))).when(kind == "linestring", line(F.get(rings, F.lit(0)))).otherwise(area)
        return F.concat(head(code), body)

    return F.unhex(F.concat(head(code + 3), u32(F.size(parts)), F.array_join(F.transform(parts, part), "")))


def to_wkt(kind: Column, parts: Column) -> Column:
    """Well-known text, of the many-part kinds."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    line = lambda ps: F.concat(F.lit("("), F.array_join(F.transform(ps, point), ", "), F.lit(")"))
    area = lambda rings: F.concat(F.lit("("), F.array_join(F.transform(rings, line), ", "), F.lit(")"))
    each = F.when(kind == "polygon", F.transform(parts, area)).otherwise(F.transform(parts, lambda rings: line(F.get(rings, F.lit(0)))))
    body = F.when(F.size(parts) == 0, F.lit("EMPTY")).otherwise(F.concat(F.lit("("), F.array_join(each, ", "), F.lit(")")))
    return F.concat(F.lit("MULTI"), F.upper(kind), F.lit(" "), body)


def to_geojson(kind: Column, parts: Column) -> Column:
    """A GeoJSON geometry, of the many-part kinds."""
    names = F.when(kind == "point", "MultiPoint").when(kind == "linestring", "MultiLineString").when(kind == "polygon", "MultiPolygon")
    point = lambda p: F.array(p["x"], p["y"])
    line = lambda ps: F.transform(ps, point)
    first = lambda rings: F.get(rings, F.lit(0))
    points = F.to_json(F.transform(parts, lambda rings: point(F.get(first(rings), F.lit(0)))))
    lines = F.to_json(F.transform(parts, lambda rings: line(first(rings))))
    areas = F.to_json(F.transform(parts, lambda rings: F.transform(rings, line)))
    said = F.when(kind == "point", points).when(kind == "linestring", lines).otherwise(areas)
    return F.concat(F.lit('{"type":"'), names, F.lit('","coordinates":'), said, F.lit("}"))
