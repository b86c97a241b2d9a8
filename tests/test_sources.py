"""Cells from sources, ledgers, migrations, clients, score cards, extraction and the service."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import cell_columns as cc, govern, ingest, measures as ms, substrate
from terrane.params import ParamError, load_params
from terrane.plans import extract, ledger, scorecard, service
from terrane.plans.backtest import resampled
from terrane.schema import TABLES, Col, SchemaError, Table
from terrane.sources import clients, migrate
from terrane.sources.readers import MemoryReader, MissingCapability, StateAdapter, adapter_for
from terrane.sources.ship import kept
from terrane.sources.store import Store, StoreError, content_hash

P = load_params()


def test_cell_gates(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "a")], "cell long, zone string")
    with pytest.raises(cc.IngestError):
        cc.coastal_class(cells, None, True)
    assert {r.crz_class for r in cc.coastal_class(cells, None, False).collect()} == {"none"}
    fractions = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.6), ("b", 0.3)], "zone string, frac double")
    with pytest.raises(cc.IngestError, match="1 zones"):
        cc.check_fractions(fractions, "zone", "frac", 0.01)
    assert cc.check_fractions(fractions, "zone", "frac", 0.2) is fractions
    with pytest.raises(ParamError):
        cc.households(F.lit(1.0), {"low": None})
    with pytest.raises(cc.IngestError):
        cc.jobs_proxy({}, {"shop": ("moon", 1.0)})
    modes = {"partner": ("licensed",), "own": ("own", "licensed")}
    cc.check_listing_source("own", "licensed", modes)
    for mode, licence in (("scraped", "licensed"), ("partner", None), ("partner", "own")):
        with pytest.raises(cc.IngestError):
            cc.check_listing_source(mode, licence, modes)
    report = spark.createDataFrame([("price", 0.6), ("rent", 0.9)], "column string, real double")
    assert govern.check_coverage(report, {"rent": 0.8}) is report
    for wanted in ({"price": 0.7}, {"light": 0.1}):
        with pytest.raises(govern.GuardError):
            govern.check_coverage(report, wanted)
    with pytest.raises(ValueError, match="order"):
        cc.first_match(report, ["column"], [])
    few = cc.uplift(spark.createDataFrame([(1, 20.0)], "cell long, broker double"), spark.createDataFrame([(1, 10.0)], "cell long, registered double"), cells.withColumn("dist_cbd_m", F.lit(5.0)), P)
    assert {r.uplift for r in few.collect()} == {2.0}
    near = cc.buffered(spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double"), spark.createDataFrame([(7, 3.0, 4.0), (8, 3.1, 4.0)], "t long, tx double, ty double"), 5.0, "p", "t")
    assert [tuple(r) for r in near.collect()] == [(1, 7)]
    assert cc.footprint_history({}, cells).count() == 0


def test_map_columns(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 3000.0, 0.0)], "cell long, x_m double, y_m double")
    line = lambda y: spark.createDataFrame([([(0.0, y), (100.0, y)],)], ingest_line)
    ingest_line = "line array<struct<x:double,y:double>>"
    counts = spark.createDataFrame([(1, 2)], "cell long, shop long")
    got = {r.cell: r for r in cc.map_columns(cells, (0.0, 400.0), line(300.0), None, spark.createDataFrame([(2500.0, 0.0)], "x double, y double"), line(450.0), counts, ["shop"], {"shop": ("retail_svc", 6.0)}, 5000.0).collect()}
    assert got[1].dist_cbd_m == 400 and got[1].dist_arterial_m == pytest.approx(300) and got[1].dist_coast_m is None and got[1].util_power == 1 and got[1].jobs_by_sector[5] == 12
    assert got[2].util_power == 1 and got[2].shop == 0 and sum(got[2].jobs_by_sector) == 0


def test_steps(spark):
    cells = spark.createDataFrame([(1, 0), (2, 0)], "cell long, a int")
    light = MemoryReader({"light": spark.createDataFrame([(1, 5.0), (2, 6.0)], "cell long, light double")})
    steps = [("viirs", ["light"], lambda x: light.table("light")), ("made", ["a"], lambda x: x.select("cell", (F.col("light") > 5).cast("int").alias("a")))]
    out, runs = ledger.run_steps(cells, steps, "cell", "c", "h", lambda df: kept(df, "step"), content_hash)
    assert sorted(tuple(r) for r in out.select("cell", "light", "a").collect()) == [(1, 5.0, 0), (2, 6.0, 1)] and runs.count() == 2
    again, more = ledger.run_steps(cells, steps, "cell", "c", "h", lambda df: kept(df, "step"), content_hash)
    assert ledger.upsert_runs(runs, more).count() == 2
    with pytest.raises(ValueError, match="did not give"):
        ledger.run_steps(cells, [("x", ["b"], lambda x: x)], "cell", "c", "h", lambda df: kept(df, "step"), content_hash)
    derived = ledger.derived_run(spark, "l0", "c", ["eps"], 2, "h", "x", [r.run_id for r in runs.collect()])
    assert derived.first().source == "derived:l0" and len(derived.first().parents) == 2
    with pytest.raises(ValueError, match="rest on"):
        ledger.derived_run(spark, "l0", "c", ["eps"], 2, "h", "x", [])
    flagged = ingest.mark_imputed(cells, "a", F.col("cell") == 1, "zero")
    rows = ledger.imputation_rows(flagged, "cell", "r")
    assert [tuple(r) for r in rows.collect()] == [(1, "a", "zero", "r")] and ledger.append_imputation(rows, rows).count() == 2 and ledger.imputation_rows(cells, "cell", "r").count() == 0


def test_migrations(spark, tmp_path):
    root = str(tmp_path / "store")
    store = migrate.connect(spark, root)
    assert set(migrate.applied(spark, root)) == set(range(1, len(TABLES) + 1)) and store.read("projects").count() == 0 and migrate.migrate(spark, root) == []
    seen = []
    steps = (*migrate.MIGRATIONS, migrate.Migration(90, "note", lambda s, r: seen.append(r)), migrate.Migration(91, "bad", lambda s, r: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        migrate.migrate(spark, root, steps)
    assert seen == [root] and 90 in migrate.applied(spark, root) and 91 not in migrate.applied(spark, root)
    with pytest.raises(ValueError, match="ledger"):
        migrate.migrate(spark, root, (migrate.Migration(90, "other", lambda s, r: None),))
    with pytest.raises(StoreError):
        migrate.connect(spark, str(tmp_path / "none"), read_only=True)
    assert isinstance(migrate.connect(spark, root, read_only=True), Store)
    assert [r.crs for r in migrate.geometry_metadata(spark).collect()] == ["EPSG:4326"] * 2
    for code in (("unknown", False), ("abc", True)):
        with pytest.raises(migrate.ProvenanceError):
            migrate.run_provenance("s", P, code=code)
        assert migrate.run_provenance("s", P, allow_dirty=True, code=code)["dirty_override"]
    assert migrate.run_provenance("s", P, code=("abc", False))["code"] == "abc" and migrate.git_state(tmp_path / "nowhere") == ("unknown", True)
    cache, made = migrate.RunCache(spark, str(tmp_path / "cache")), []
    key = cache.key(P.hash(), "base", "s", 1)
    for _ in range(2):
        assert cache.run(key, lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1] and cache.get(cache.key(P.hash(), "base", "s", 2)) is None
    table = Table("t", ("a",), (Col("a", "bigint", low=0), Col("b", "string", nullable=True, among=("x",))))
    df = spark.createDataFrame([(1, "x"), (1, None), (-1, "y")], "a long, b string")
    assert {(r["check"], r["n"]) for r in table.counts(df).collect()} == {("a", 1), ("b", 1), ("key", 1)}
    with pytest.raises(SchemaError):
        table.validate(df)


def test_archive(spark, tmp_path):
    asked, slept, now = [], [], [0.0]

    def opener(url, body):
        asked.append(url)
        return b"a,b\n1,x\n2,y\n"

    reader = clients.HttpArchiveReader(spark, {"one": "http://h/one.csv", "two": "http://h/two.csv"}, str(tmp_path), {"one": "a int, b string", "two": "a int, b string"}, 2.0, opener, lambda: now[0], slept.append)
    assert reader.exists("one") and reader.table("one").count() == 2 and reader.table("one").count() == 2 and asked == ["http://h/one.csv"]
    now[0] = 0.5
    assert reader.table("two").count() == 2 and slept == [1.5]
    reader.fetch("one", force=True)
    assert len(asked) == 3
    with pytest.raises(clients.ClientError):
        reader.fetch("three")


def test_table_service(spark):
    def opener(url, body):
        assert "annotations=duration" in url and url.startswith("http://r/table/v1/walk/")
        rows = [[60.0 * (i + j) if i + j < 3 else None for j in range(url.partition("destinations=")[2].partition("&")[0].count(";") + 1)] for i in range(url.partition("sources=")[2].partition("&")[0].count(";") + 1)]
        return json.dumps({"code": "Ok", "durations": rows}).encode()

    service_ = clients.TableService({"walk": "http://r/"}, 2, opener)
    got = service_.matrix(np.zeros((3, 2)), np.zeros((2, 2)), "walk")
    assert got.tolist() == [[0, 1], [1, 2], [0, 1]] and np.isinf(clients.TableService("http://r", 9, opener).matrix(np.zeros((3, 2)), np.zeros((2, 2)), "walk")[2, 1])
    with pytest.raises(clients.ClientError):
        service_.matrix(np.zeros((1, 2)), np.zeros((1, 2)), "car")
    with pytest.raises(clients.ClientError):
        clients.TableService("http://r", 2, lambda u, b: b'{"code": "NoTable"}').matrix(np.zeros((1, 2)), np.zeros((1, 2)), "walk")


def test_catalogue_of_scenes(spark):
    def opener(url, body):
        item = lambda i, c: {"id": i, "properties": {"datetime": "2020-01-01", "eo:cloud_cover": c}, "assets": {"B04": {"href": f"s3://{i}"}}}
        return json.dumps({"features": [item("a", 10.0), item("b", 90.0)], "links": [{"rel": "next", "href": "http://c/2"}]} if url.endswith("search") else {"features": [item("c", 5.0)]}).encode()

    got = clients.ImageryCatalogue("http://c", "s2", opener).scenes(spark, (0, 0, 1, 1), "2020-01-01", "2020-02-01", 60.0, ("B04", "B08")).collect()
    assert [(r.scene, r.assets) for r in got] == [("a", {"B04": "s3://a"}), ("c", {"B04": "s3://c"})]


def test_parameter_guards(tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("a: {x: {value: 1.0, conf: R, scope: global, fitted_on: {cities: [h], data_through: 2019}}, y: {value: 2.0, conf: G, scope: local}, z: {value: 3.0, conf: G, scope: global, citation: c}}")
    p = load_params(path=f)
    assert [r["path"] for r in govern.check_parameter_provenance(p, 2019, require=True)] == ["a.x", "a.z"]
    for kw in ({"t0": 2018}, {"t0": 2019, "allow_equal": False}):
        with pytest.raises(govern.GuardError):
            govern.check_parameter_provenance(p, **kw)
    with pytest.raises(govern.GuardError):
        govern.write_estimates(f, {"a.y": 5.0, "a.x": 1.0}, ["c"], 2021)
    assert govern.write_estimates(f, {"a.x": 1.5}, ["c"], 2021) == ["a.x"] and load_params(path=f).value("a.x") == 1.5
    with pytest.raises(govern.GuardError, match="2021|after"):
        govern.check_parameter_provenance(load_params(path=f), 2020)
    with pytest.raises(govern.GuardError):
        govern.check_parameter_provenance(P, 2030, require=True)
    sources = {"osm": {"attribution": "(c) OSM", "aliases": ["map"]}, "x": {"attribution": ""}}
    assert govern.attribution_text(sources, ["map", "osm"]) == "(c) OSM"
    for bad in (lambda: govern.attribution_text(sources, ["none"]), lambda: govern.source_provenance("osm", sources, {}), lambda: govern.confidence_tags(P, ["price.eta"], ("E",))):
        with pytest.raises(govern.GuardError):
            bad()
    assert govern.source_provenance("osm", sources, {"osm": {"class": "open"}})["licence_class"] == "open"


def zones(spark, noise, n=40, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(0.05, 0.02, n)
    rows = [(i, float(v + noise * rng.normal()), float(rng.normal(0.05, 0.02)), float(v), float(v - 0.03), float(v + (0.05 if i % 5 else -0.01)), i % 7 == 0, float(v), float(v + noise * rng.normal()), float(rng.normal())) for i, v in enumerate(a)]
    return spark.createDataFrame(rows, "zone long, pred double, b2 double, actual double, low double, high double, overheated boolean, settled double, settled_pred double, settled_b4 double")


def test_scorecards_and_gate(spark):
    cards = None
    for i, city in enumerate("abc"):
        one = kept(scorecard.card(zones(spark, 0.015, seed=i), city, 2012, 8, P, replicates=100), "card")
        cards = one if cards is None else cards.unionByName(one)
    got = cards.collect()
    assert all(r.spearman > 0.55 and r.beat_b2 > 0.3 and r.beat_b2_low < r.beat_b2 < r.beat_b2_high and r.coverage == pytest.approx(0.8) and not r.alarm and r.beat_b4 > 0 for r in got)
    assert scorecard.verdict(cards, P) == (True, [])
    lines = scorecard.to_json(cards)
    back = scorecard.from_json(spark, lines)
    assert sorted(map(str, back.collect())) == sorted(map(str, cards.select(*back.columns).collect()))
    two = cards.filter("city <> 'a'")
    assert {r.criterion for r in scorecard.gate(two, P).collect() if not r.passed} == {"cities"}
    one = {r.criterion: r for r in scorecard.gate(cards.filter("city = 'a'"), P).collect()}
    assert not one["beat_b2_ci_lower"].passed and one["beat_b2_ci_lower"].observed is None
    settled = kept(scorecard.card(zones(spark, 0.015), "d", 2012, 8, P, price_test=False), "card")
    assert settled.first().spearman is None and settled.first().settlement_spearman > 0.5
    ok, said = scorecard.verdict(cards.unionByName(settled), P)
    assert ok and "1 cards scored settlement only" in said[0]
    small = kept(scorecard.card(zones(spark, 0.0001, n=12), "e", 2012, 8, P, replicates=50), "card")
    assert small.first().alarm and small.first().underpowered
    ok, said = scorecard.verdict(cards.unionByName(small), P)
    assert not ok and any("look-ahead" in x for x in said)
    assert not any(r.passed for r in scorecard.gate(cards.filter("false"), P).filter("criterion <> 'powered'").collect())
    assert len(scorecard.gate(cards, P.with_values({"gate.gate_on_b4": True})).collect()) == 7
    counts = np.bincount(resampled(1, 4000, 5).ravel(), minlength=5)
    assert counts.min() > 0.9 * counts.mean() and counts.max() < 1.1 * counts.mean()


def test_extraction(spark):
    good = json.dumps({"matched_id": "A1", "match_type": "exact", "reasoning": "same", "confidence": 0.9})
    said = {"mentioned": "x", "sentence": "s", "candidates": "[]"}
    transport = extract.ReplayTransport(["no", f"```json\n{good}\n```"])
    got = extract.ask(transport, "entity_resolution", "m", **said)
    assert got["status"] == "parsed" and got["attempts"] == 2 and "not valid" in transport.calls[1]["user"]
    bad = extract.ask(extract.ReplayTransport(["[]", '{"match_type": "exact", "reasoning": "r", "confidence": 7}']), "entity_resolution", "m", **said)
    assert bad["status"] == "parse_failed" and "confidence" in bad["error"]
    unsure = extract.ask(extract.ReplayTransport([good.replace("0.9", "0.3")]), "entity_resolution", "m", **said)
    rows = extract.recorded(spark, [got, bad, unsure])
    assert [r.decision for r in extract.routed(rows, "entity_resolution", 0.6).collect()] == ["auto_applied", "parse_failed", "pending"]
    assert [r.ok for r in extract.parsed(rows, "entity_resolution").select(extract.confident_match(F.col("got"), 0.6).alias("ok")).collect()] == [True, False, False]
    assert {r.decision for r in extract.routed(rows.withColumn("is_new", F.lit(True)), "entity_resolution", 0.1).collect()} == {"pending", "parse_failed"}
    project = json.dumps({"projects": [{"name": "P", "archetype_guess": "rail", "is_reannouncement": False, "confidence": 0.8}, {"name": "Q", "archetype_guess": "rail", "is_reannouncement": False, "confidence": 0.2}], "document_type": "news"})
    many = extract.ask(extract.ReplayTransport([project]), "project_extraction", "m", archetypes="rail", pub_date="d", url="u", text="t")
    assert extract.routed(extract.recorded(spark, [many]), "project_extraction", 0.5).first().decision == "pending"
    docs = spark.createDataFrame([("x", "s", "[]"), ("y", "s", "[]")], "mentioned string, sentence string, candidates string")
    everyone = extract.ask_all(docs, "entity_resolution", "m", ["mentioned", "sentence", "candidates"], lambda: (lambda system, user, model: '{"matched_id": null, "match_type": "none", "reasoning": "r", "confidence": 0.9}'))
    assert [r.status for r in everyone.collect()] == ["parsed", "parsed"]
    for wrong in (lambda: extract.render("poem"), lambda: extract.render("clearance_filing", words="x")):
        with pytest.raises(extract.ExtractionError):
            wrong()
    assert set(extract.PROMPTS) == {*extract.SCHEMAS, "narrative"} and all(spark.createDataFrame([], s).columns for s in extract.SCHEMAS.values())
    with pytest.raises(govern.GuardError):
        extract.narrative(extract.ReplayTransport(["Prices rose 9 % [growth]."]), "m", {"growth": 3.0}, "s", "a", 50)
    assert "3.0" in extract.narrative(extract.ReplayTransport(["Prices rose 3.0 % [growth]."]), "m", {"growth": 3.0}, "s", "a", 50)
    with pytest.raises(AssertionError):
        extract.ReplayTransport([])("", "", "")


def test_service(spark):
    table = lambda k: spark.createDataFrame([("a", 110.0 * k, 100.0), ("b", 120.0 * k, 100.0), ("c", None, 100.0)], "zone string, price double, base_price double")
    block = {"snapshot": "s", "params": P.hash(), "code": "abc", "dirty": False, "dirty_override": False}
    runs = service.RunStore([service.Stored("v", name, 2030, table(k), block, ("price.eta",), ("osm",)) for name, k in (("base", 1.0), ("metro", 1.1))])
    router = service.create_router(runs, P, {"osm": {"attribution": "(c) OSM", "licence": "odbl"}}, "1.0")
    assert router.answer("GET", "/health") == {"status": "ok", "version": "1.0"}
    out = router.answer("GET", "/cities/v/outlook", scenario="base", horizon="2030")
    assert [(z["zone"], z["change_pct"], z["rank"]) for z in out["zones"]] == [("b", 20.0, 1), ("a", 10.0, 2), ("c", None, 3)] and out["flag"]
    assert router.answer("POST", "/cities/v/scenarios", scenario="metro", horizon=2030)["zones"][0]["difference_pct"] == 10.0
    report = router.answer("POST", "/cities/v/reports", scenario="base", horizon=2030, sections=[["Best", "Zone b gains 20.0 % [zones.b.change_pct]."]])
    assert "gains 20.0 % ." in report["text"] or "gains 20.0 %" in report["text"]
    assert report["attribution"] == "(c) OSM" and report["provenance"]["tags"] == {"price.eta": "R"}
    with pytest.raises(govern.GuardError):
        router.answer("POST", "/cities/v/reports", scenario="base", horizon=2030, sections=[["Best", "Zone b gains 33 % [zones.b.change_pct]."]])
    for fields, handler in ((("ask_price",), dict), ((), dict)):
        with pytest.raises(govern.GuardError):
            router.add("GET", "/raw", fields, handler)
    router.add("GET", "/leak", ("rows",), lambda: {"rows": [{"listing_id": 1}]})
    router.add("GET", "/odd", ("rows",), lambda: {"rows": [], "more": 1})
    for path in ("/leak", "/odd"):
        with pytest.raises(govern.GuardError):
            router.answer("GET", path)
    with pytest.raises(service.NotFound):
        router.answer("GET", "/cities/v/outlook", scenario="none", horizon=2030)
    server = service.serve(router)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.loads(urllib.request.urlopen(f"{base}/policy/exposure", timeout=20).read())["policy"]
        assert json.loads(urllib.request.urlopen(f"{base}/attributions", timeout=20).read())["text"] == "(c) OSM"
        assert json.loads(urllib.request.urlopen(f"{base}/about?city=v", timeout=20).read())["version"] == "1.0"
        assert json.loads(urllib.request.urlopen(f"{base}/cities/v/provenance", timeout=20).read())["provenance"]["code"] == "abc"
        for path, code in (("/leak", 451), ("/nowhere", 404), ("/cities/v/outlook?scenario=base", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(base + path, timeout=20)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_registry_and_quantile_helpers(spark):
    rows = [("p", "funded", True, None, 5.0, 2030.0, 2020, False, "none"), ("p", "odd", False, None, 0.0, 2010.0, 2020, True, "none"), (None, "funded", True, None, 1.0, None, 2020, False, "none")]
    df = spark.createDataFrame(rows, "project_id string, stage string, is_public boolean, commitment_form string, capex double, open_year double, announced_year long, claims_construction boolean, physical_state string")
    got = sorted(map(tuple, ingest.registry_problems(df, ["funded"], ["verbal"]).collect()), key=str)
    assert got == sorted([(None, "no_id"), ("p", "repeated"), ("p", "repeated"), ("p", "stage"), ("p", "commitment"), ("p", "size"), ("p", "dates"), ("p", "not_seen")], key=str)
    more = df.withColumn("source_urls", F.when(F.col("stage") == "odd", F.array(F.lit("u"))))
    signed = spark.createDataFrame([("p", "stage", "model-1"), ("p", "capex", "reviewer")], "project_id string, field string, changed_by string")
    found = [tuple(r) for r in ingest.registry_problems(more, ["announced", "funded", "odd"], ["verbal"], signed).collect()]
    assert found.count(("p", "no_source")) == 1 and found.count((None, "no_source")) == 1 and found.count(("p", "unsigned")) == 2
    by_hand = signed.unionByName(spark.createDataFrame([("p", "stage", "reviewer")], signed.schema))
    assert ("p", "unsigned") not in [tuple(r) for r in ingest.registry_problems(more, ["announced", "funded", "odd"], ["verbal"], by_hand).collect()]
    assert ms.cut_points(spark.range(1000), "id", 4) == pytest.approx([250, 500, 750], abs=3)


def test_measures_that_raise(spark):
    cells = spark.createDataFrame([("a", 60.0), ("a", 45.0), ("b", 10.0)], "zone string, people double")
    assert ms.check_district_totals(cells.filter("zone = 'a'"), "zone", F.col("people"), 100.0, 0.1).count() == 2
    with pytest.raises(ValueError, match="b \\(10.0\\)"):
        ms.check_district_totals(cells, "zone", F.col("people"), 100.0, 0.1)
    projects = spark.createDataFrame([(i, i == 0) for i in range(20)], "id long, dead boolean")
    assert ms.check_dead(projects, "dead", 1, 0.05) is projects
    for least, share in ((2, 0.01), (1, 0.06)):
        with pytest.raises(ValueError, match="dead projects"):
            ms.check_dead(projects, "dead", least, share)
    with pytest.raises(ValueError):
        ms.check_dead(projects.limit(0), "dead", 1, 0.0)
    columns = spark.createDataFrame([("p", 0.1, False), ("p", 0.3, True), ("q", 0.2, None), ("r", 2.0, False)], "k string, w double, gone boolean")
    got = {r.k: r.data_conf for r in ms.confidence(columns, "k", "w", 0.9, 0.2, F.col("gone"), 0.05).collect()}
    assert got == {"p": pytest.approx(0.75), "q": pytest.approx(0.7), "r": 0.2}
    panel = ms.panel_median(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, v double"), "k", F.col("v"), 2)
    assert {r.k: (r.price, r.n) for r in panel.collect()} == {"a": (2.0, 2), "b": (None, 1), "c": (None, 0)}
    growth = ms.city_growth(spark.createDataFrame([(2000, 1.0), (2002, 1.21), (2002, None)], "y long, v double"), "y", "v", 2000, 2002, -0.5, 0.5)
    assert growth.first().cagr == pytest.approx(0.1) and ms.city_growth(spark.createDataFrame([(2000, 0.0), (2002, 1.0)], "y long, v double"), "y", "v", 2000, 2002, -0.5, 0.5).first().cagr is None


def test_adapters(spark):
    ap = adapter_for("AP")
    assert ap.capabilities() == {"guidance", "projects", "registrations", "parcels", "allotments"} and StateAdapter().capabilities() == set() and StateAdapter().parcels(None) is None
    deals = spark.createDataFrame([("d", 900.0, 10.0), ("e", 900.0, 0.0)], "document_id string, consideration_inr double, area_sqyd double")
    assert [r.price_inr_sqft for r in ap.registrations(deals).collect()] == [10.0]
    assert ap.parcels(spark.createDataFrame([(2.0,)], "extent_acres double")).first().area_sqm == pytest.approx(8093.7, abs=0.1)
    assert ap.allotments(spark.createDataFrame([(1.0, "x")], "extent_acres double, allottee string")).first().allottee == "x"
    with pytest.raises(PermissionError):
        ap.check_bulk("parcels")
    for missing in (StateAdapter().guidance, StateAdapter().projects):
        with pytest.raises(MissingCapability):
            missing(None)


def test_hex_cover(spark):
    ring = [(2000.0, 2000.0), (2600.0, 2000.0), (2600.0, 2600.0), (2000.0, 2600.0)]
    boundary = spark.createDataFrame([(ring,)], f"ring {ingest.RING}")
    cover = ingest.hex_cover(spark, boundary, 200.0, 2)
    rows = cover.collect()
    city = [r for r in rows if r.in_city]
    pieces = ingest.overlay(cover, boundary.withColumn("k", F.lit(1)), "cell", ["k"]).agg(F.sum("area")).first()[0]
    assert pieces == pytest.approx(360_000) and len({r.cell for r in rows}) == len(rows)
    step = lambda a, b: max(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r))
    assert all(min(step(r, x) for x in city) <= 2 for r in rows) and any(min(step(r, x) for x in city) == 2 for r in rows)
    assert ingest.hex_cover(spark, boundary, 200.0, 0).count() == len(city)


def test_elasticity_fit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        u, g, b, m = rng.uniform(0, 0.8), rng.normal(), rng.uniform(0, 0.9), rng.uniform(200, 9000)
        eps = np.exp(0.4 + 0.6 * np.log(1 - u + 0.01) - 0.3 * g + 0.2 * np.log(1 - b + 0.01) + 0.05 * np.log(m))
        rows.append((0.3, float(0.3 * eps), float(u), float(g), float(b), float(m)))
    rows += [(0.0001, 5.0, 0.1, 0.0, 0.1, 500.0), (0.3, -0.2, 0.1, 0.0, 0.1, 500.0)]
    df = spark.createDataFrame(rows, "dln_price double, dln_floorspace double, undevelopable_frac double, regulatory_index double, builtup_frac double, mean_parcel_sqm double")
    fit = substrate.fit_elasticity(df, 0.01)
    assert [fit[k] for k in ("intercept", *substrate.TERMS)] == pytest.approx([0.4, 0.6, -0.3, 0.2, 0.05], abs=1e-6) and fit["n"] == 300 and fit["r2"] == pytest.approx(1)
    back = substrate.regressed_elasticity(df.limit(1), fit).first()
    assert back.eps == pytest.approx(back.dln_floorspace / back.dln_price)
    with pytest.raises(ValueError, match="lacks"):
        substrate.regressed_elasticity(df, {"intercept": 1.0})
    with pytest.raises(ValueError, match="no zone"):
        substrate.fit_elasticity(df, 9.0)


def test_report_figures():
    data = {"growth": 3.0}
    good = [("A", "Prices rose 3.0 % [growth], see [figure:one]."), ("B", "And [figure:two].")]
    assert govern.verify_report(good, ["one", "two"], data) == 3
    assert govern.verify_report(good, ["one", "two", "three"], data, every=False) == 3
    for sections, figures in ((good, ["one"]), (good, ["one", "two", "three"]), (good, ["one", "two", "two"]), ([("A", "9 % [growth]")], [])):
        with pytest.raises(govern.GuardError):
            govern.verify_report(sections, figures, data)
