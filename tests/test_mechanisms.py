"""Joins in time, sessions, shortest paths, sensitivity, spatial tests and snapshots against plain versions."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.geometry import double_hex
from terrane.operators import hedonic, networks, sensitivity, timejoin
from terrane.sources import snapshot_tree
from terrane.streaming import monitor


def test_as_of(spark):
    """A key of most rows, ties, rows that repeat, keys and times that are missing."""
    r = random.Random(1)
    key = lambda: r.choice([1] * 8 + [2, 3, None])
    left = [(i, key(), r.choice([float(r.randrange(200)), r.uniform(-5, 220), None])) for i in range(400)] + [(7, 1, 50.0)] * 2
    right = [(key(), r.choice([float(r.randrange(200)), None]), o, f"v{o}" if o % 5 else None) for o in range(300)]
    a, b = spark.createDataFrame(left, "id long, k long, at double"), spark.createDataFrame(right, "k long, since double, o long, v string")
    want = []
    for i, k, t in left:
        held = [(s, o, v) for rk, s, o, v in right if k is not None and rk == k and s is not None and t is not None and s <= t]
        best = max(held, key=lambda x: x[:2], default=None)
        want.append((i, k, t, best and best[1], best and best[2]))
    for slices in (1, 4, 64):
        got = [tuple(x) for x in timejoin.as_of(a, b, "k", "at", "since", "o", ["o", "v"], slices).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert timejoin.as_of(a, b.limit(0), "k", "at", "since", "o", ["v"]).filter("v IS NULL").count() == len(left)
    assert timejoin.as_of(a.limit(0), b, "k", "at", "since", "o", ["v"]).count() == 0


def test_in_intervals(spark):
    r = random.Random(2)
    points = [(i, r.choice([1, 1, 1, 2, None]), r.choice([float(r.randrange(50)), None])) for i in range(200)]
    spans = [(r.choice([1, 1, 2, None]), r.choice([float(r.randrange(50)), None]), r.choice([float(r.randrange(60)), None]), j) for j in range(60)]
    a, b = spark.createDataFrame(points, "id long, k long, at double"), spark.createDataFrame(spans, "k long, a double, b double, j long")
    want = sorted((i, j) for i, k, t in points for sk, s, e, j in spans if k is not None and k == sk and None not in (t, s, e) and s <= t < e)
    for slices in (1, 7, 100):
        assert sorted((x.id, x.j) for x in timejoin.in_intervals(a, b, "k", "at", "a", "b", ["j"], slices).collect()) == want
    assert timejoin.in_intervals(a, b.limit(0), "k", "at", "a", "b", ["j"]).count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    """The stream gives the table's sessions, but for those that an event could still join; late events are dropped."""
    r = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = sorted((base + dt.timedelta(minutes=r.randrange(0, 4000)), r.randrange(4), float(i), i % 5) for i in range(200))
    schema = "ts timestamp, project long, value double, state_rank long"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    batch = {(x.project, x.start): tuple(x) for x in monitor.sessions(spark.createDataFrame(rows, schema), "90 minutes").collect()}
    assert sum(x[3] for x in batch.values()) == len(rows)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = monitor.sessions(stream, "90 minutes", "10 minutes")
    query = out.writeStream.format("memory").queryName("session_runs").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(x.project, x.start): tuple(x) for x in spark.table("session_runs").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert all(x[2] > rows[-1][0] - dt.timedelta(minutes=11) for k, x in batch.items() if k not in got)


def test_shortest_paths(spark):
    r = random.Random(4)
    n, edges = 30, []
    for _ in range(60):
        edges.append((str(r.randrange(n)), str(r.randrange(n)), round(r.uniform(0.5, 9), 3)))
    edges += [(str(100 + i), str(101 + i), 1.0) for i in range(40)]
    d = {(u, u): 0.0 for e in edges for u in e[:2]}
    for u, v, m in edges:
        d[u, v] = min(m, d.get((u, v), 1e9))
    nodes = sorted({u for u, _ in d})
    for k in nodes:
        for i in nodes:
            if (i, k) in d:
                for j in nodes:
                    if (k, j) in d:
                        d[i, j] = min(d.get((i, j), 1e9), d[i, k] + d[k, j])
    rounds = []

    def cut(df):
        rounds.append(1)
        return spark.createDataFrame(df.collect(), df.schema)

    got = {(x.u, x.v): x.minutes for x in networks.shortest_paths(spark.createDataFrame(edges, "u string, v string, minutes double"), cut).collect()}
    assert got.keys() == d.keys() and all(got[k] == pytest.approx(v) for k, v in d.items())
    assert len(rounds) <= 10  # the longest way has 40 edges
    with pytest.raises(Exception, match="less than no time"):
        networks.shortest_paths(spark.createDataFrame([("a", "b", -1.0)], "u string, v string, minutes double"), cut)


def test_sobol(spark):
    """Each dimension meets each of 2 ** k equal intervals once in 2 ** k points; the first two do so in pairs."""
    points = np.array([tuple(x) for x in spark.range(256).select(*[sensitivity.sobol(F.col("id"), d + 1) for d in range(sensitivity.MOST)]).collect()])
    assert (points[0] == 0).all() and (points[1] == 0.5).all()
    for k in (4, 6, 8):
        for d in range(sensitivity.MOST):
            assert sorted((points[: 2**k, d] * 2**k).astype(int)) == list(range(2**k))
    cells = {(int(a * 16), int(b * 16)) for a, b in points[:, :2]}
    assert len(cells) == 256 and len({tuple(p) for p in points}) == 256
    with pytest.raises(ValueError):
        sensitivity.directions(11)


def test_indices(spark):
    """A sum has first-order shares in the ratio of its variances, and no interactions; a product has some."""
    draws = spark.range(4096)
    rows = sensitivity.design(draws, "id", ["a", "b", "c"])
    assert rows.count() == 5 * 4096
    got = {x.parameter: x for x in sensitivity.indices(rows.withColumn("f", F.col("a") + 2 * F.col("b")), "id", "f", ["a", "b", "c"]).collect()}
    assert got["a"].first_order == pytest.approx(0.2, abs=0.01) and got["b"].total == pytest.approx(0.8, abs=0.01) and got["c"].total == 0 and got["c"].first_order == 0
    both = {x.parameter: x for x in sensitivity.indices(rows.withColumn("f", (F.col("a") - 0.5) * (F.col("b") - 0.5)), "id", "f", ["a", "b", "c"]).collect()}
    assert both["a"].first_order == pytest.approx(0, abs=0.02) and both["a"].total == pytest.approx(1, abs=0.03)
    flat = sensitivity.indices(rows.withColumn("f", F.lit(1.0)), "id", "f", ["a", "b", "c"]).collect()
    assert all(x.first_order is None and x.total is None for x in flat) and sensitivity.indices(rows.withColumn("f", F.lit(1.0)).limit(0), "id", "f", ["a"]).count() == 0


def test_moran_of_residuals_and_errors(spark):
    """Moments by traces against whole matrices; standard errors against the same."""
    r = np.random.default_rng(5)
    n = 60
    xy = r.uniform(0, 1, (n, 2))
    w = np.zeros((n, n))
    for i in range(n):
        near = np.argsort(((xy - xy[i]) ** 2).sum(1))[1:5]
        w[i, near] = 0.25
    x = r.normal(size=(n, 2))
    y = 1 + x @ [0.5, -0.3] + np.linalg.solve(np.eye(n) - 0.5 * w, r.normal(size=n) * 0.3)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "cell long, y double, a double, b double")
    links = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "cell long, other long, weight double")
    design = np.c_[np.ones(n), x]
    m = np.eye(n) - design @ np.linalg.inv(design.T @ design) @ design.T
    e, s0 = m @ y, w.sum()
    k = design.shape[1]
    value = n / s0 * (e @ w @ e) / (e @ e)
    mean = n / s0 * np.trace(m @ w) / (n - k)
    spread = (n / s0) ** 2 * (np.trace(m @ w @ m @ w.T) + np.trace(m @ w @ m @ w) + np.trace(m @ w) ** 2) / ((n - k) * (n - k + 2)) - mean**2
    got = hedonic.moran_residuals(df, links, "cell", "other", "y", ["a", "b"])
    assert got["moran_i"] == pytest.approx(value) and got["mean"] == pytest.approx(mean) and got["deviation"] == pytest.approx(math.sqrt(spread)) and got["p"] < 0.2
    wy = w @ y
    z1 = np.c_[design, w @ x]
    hat = z1 @ np.linalg.lstsq(z1, wy, rcond=None)[0]
    z = np.c_[design, hat]
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    u = y - np.c_[design, wy] @ beta
    bread = np.linalg.inv(z.T @ z)
    errors = np.sqrt(np.diag(bread @ (z.T * u**2) @ z @ bread))
    lag = hedonic.fit_lag(df, links, "cell", "other", "y", ["a", "b"])
    assert [lag[c] for c in ("se_intercept", "se_a", "se_b", "se_rho")] == pytest.approx(list(errors), rel=1e-6)
    error = hedonic.fit_error(df, links, "cell", "other", "y", ["a", "b"])
    assert error["se_a"] > 0 and abs(error["a"] - 0.5) < 4 * error["se_a"]


def test_double_hex(spark):
    values = [0.0, 1.0, -1.5, 0.1, 1e300, 5e-324, -2.2250738585072014e-308, 1e-310, 2.0**52 + 1, 1.7976931348623157e308, math.pi, float("inf"), float("-inf")]
    got = [x.h for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", double_hex(F.col("v")).alias("h")).orderBy("i").collect()]
    assert got == [struct.pack(">d", v).hex().upper() for v in values]


def test_snapshot_tree(spark):
    """A change of one bit, a row more and a row less are found by their ranges, and these alone are read again."""
    rows = [(i, float(i) / 3, None if i % 7 == 0 else f"t{i}") for i in range(0, 5000, 2)]
    df = spark.createDataFrame(rows, "k long, v double, t string")
    kept = snapshot_tree.tree(df, "k", 64, 4)
    again = snapshot_tree.tree(df.repartition(7), "k", 64, 4)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.collect()))
    tops = [x for x in kept.collect() if x.level == kept.agg(F.max("level")).first()[0]]
    assert len(tops) == 1 and tops[0].n == len(rows) and snapshot_tree.changed_ranges(kept, again, 64, 4).count() == 0
    nudged = math.nextafter(1000 / 3, 1e9)
    changed = [(k, nudged if k == 1000 else v, "" if k == 2002 else t) for k, v, t in rows if k != 3000] + [(4001, 0.5, "new")]
    now = snapshot_tree.tree(spark.createDataFrame(changed, "k long, v double, t string"), "k", 64, 4)
    found = snapshot_tree.changed_ranges(kept, now, 64, 4)
    want = sorted({k // 64 * 64 for k in (1000, 2002, 3000, 4001)})
    assert [tuple(x) for x in found.collect()] == [(k, k + 63) for k in want]
    assert sorted(x.k for x in snapshot_tree.rows_of(df, "k", found).collect()) == [k for k, *_ in rows if k // 64 * 64 in want]
    assert snapshot_tree.tree(df.limit(0), "k").count() == 0
    twice = snapshot_tree.tree(df.unionByName(df.filter("k = 10")), "k", 64, 4)
    assert [tuple(x) for x in snapshot_tree.changed_ranges(kept, twice, 64, 4).collect()] == [(0, 63)]
    longer = snapshot_tree.tree(df.unionByName(spark.createDataFrame([(10**6, 1.0, "far")], df.schema)), "k", 64, 4)
    assert [tuple(x)[0] for x in snapshot_tree.changed_ranges(kept, longer, 64, 4).collect()] == [10**6 // 64 * 64]
    assert sorted(tuple(x) for x in snapshot_tree.tree(spark.createDataFrame([(None, 1.0, "a"), (-5, 1.0, None)], df.schema), "k", 64, 4).filter("level = 0").select("node", "n").collect()) == [(-(2**57), 1), (-1, 1)]


def test_quantiles_over_many_decades(spark):
    """Values over hundreds of decades are closed in until few are left."""
    from terrane.operators import measures as ms

    r = random.Random(7)
    values = [math.copysign(10.0 ** r.uniform(-300, 300), r.random() - 0.3) for _ in range(3000)] + [5.0] * 200
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ms.quantiles(df, {"a": ("v", 0.5), "b": ("v", 0.1), "c": ("v", 1.0)}, bins=16).first()
    assert got.a == pytest.approx(np.quantile(values, 0.5)) and got.b == pytest.approx(np.quantile(values, 0.1)) and got.c == max(values)


def test_ward_jobs(spark):
    from terrane.operators import substrate as sub
    from terrane.schema import SECTORS

    cells = spark.createDataFrame([(1, "a", 100.0, 1), (2, "a", 300.0, 0), (3, "b", 0.0, 5), (4, "b", None, 2), (5, "c", 50.0, 1)], "cell long, ward string, com_sqm double, shops int")
    schema = "ward string, sector string, jobs double"
    wards = spark.createDataFrame([("a", "it_office", 80.0), ("a", "retail_svc", 10.0), ("b", "retail_svc", 6.0)], schema)
    got = {r.cell: dict(zip(SECTORS, r.jobs_by_sector)) for r in sub.ward_jobs(cells, wards, {"it_office": 2.0}, {"retail_svc": "shops"}).collect()}
    assert got[1]["it_office"] == 40 and got[2]["it_office"] == 120 and got[1]["retail_svc"] == 10 and got[2]["retail_svc"] == 0
    assert got[3]["retail_svc"] == got[4]["retail_svc"] == 3 and sum(got[5].values()) == 0
    for bad, said in ((("z", "it_office", 1.0), "without cells: z"), (("a", "moon", 1.0), "unknown sectors")):
        with pytest.raises(ValueError, match=said):
            sub.ward_jobs(cells, spark.createDataFrame([bad], schema), {}, {})
