"""Backtests, ledgers and geodesics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.geodesic import geodesic_m, with_geodesic
from terrane.operators.govern import GuardError
from terrane.plans import backtest as bt, ledger


def kept(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def parts(spark):
    cells = spark.createDataFrame([(i, 100.0 + i, float(i)) for i in range(20)], "cell long, price double, dist double")
    history = spark.createDataFrame([(i, y, 50.0 * 1.1 ** (y - 2015) * (1 + i / 100)) for i in range(18) for y in range(2015, 2021)], "cell long, year long, price double")
    projects = spark.createDataFrame([(1, 2016, "x"), (2, 2017, "x"), (3, 2019, "x")], "project_id long, announced_year long, stage string")
    stages = spark.createDataFrame([(1, 2016, "announced"), (1, 2018, "funded"), (1, 2020, "construction"), (2, 2017, "announced")], "project_id long, year long, stage string")
    return cells, history, projects, stages


def test_freeze(spark, parts):
    cells, history, projects, stages = parts
    fz = bt.freeze(2018, cells, history, projects, stages, {"price": 2018})
    assert {r.project_id: r.stage for r in fz.projects.collect()} == {1: "funded", 2: "announced"} and fz.history.agg(F.max("year")).first()[0] == 2018
    price = {r.cell: r.price for r in fz.cells.collect()}
    assert price[0] == pytest.approx(50 * 1.1**3) and price[19] == 119.0
    with pytest.raises(GuardError):
        bt.freeze(2018, cells, history, projects, stages, {"price": 2019})
    with pytest.raises(GuardError):
        bt.freeze(2018, cells, history, projects, stages.filter("project_id = 1"), {"price": 2018})
    gone = spark.createDataFrame([(1, "abandoned")], "project_id long, outcome string")
    with pytest.raises(GuardError):
        bt.freeze(2018, cells, history, projects, stages, {"price": 2018}, outcomes=gone, min_dead=2)


def test_baselines(parts):
    fz = bt.freeze(2018, *parts, {"price": 2018})
    for made in (bt.b0_city(fz, 2, 3), bt.b2_momentum(fz, 2, 3)):
        assert {r.cell: r.pred for r in made.collect()}[5] == pytest.approx(50 * 1.1**5 * 1.05)
    assert bt.b1_distance(fz, "dist").count() == 20
    later = parts[1].filter("year = 2020").select("cell", F.col("price").alias("actual"))
    rows = bt.b2_momentum(fz, 2, 3).join(fz.cells.select("cell", F.col("price").alias("start")), "cell").join(later, "cell")
    noisy = rows.withColumn("pred", F.col("pred") * (1 + F.col("cell") / 1000)).withColumn("actual", F.col("actual") * (1 + F.col("cell") / 500))
    got = bt.score(noisy, "pred", "actual", "start", 2, 5).first()
    assert got.rho == pytest.approx(1) and got.n == 18 and got.precision == pytest.approx(0.4) and got.mape > 0


def test_growth(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), int(x + 0.3 * rng.normal() > 0), 10.0) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "cell long, x double, grew int, room double")
    out = bt.b4_growth(df, df.select("cell", "x", "room"), ["x"], "grew", "room", 95.0, 2, kept).collect()
    assert sum(r.built for r in out) == pytest.approx(190) and min(r.x for r in out if r.built > 0) > max(sorted(r.x for r in out if r.built == 0)[:150])


def test_bootstrap(spark):
    low, mid, high = bt.bootstrap_ci([1.0, 2.0, 3.0, 4.0, 5.0], 0)
    assert low < mid == 3.0 < high and bt.bootstrap_ci([1.0, 2.0], 1) == bt.bootstrap_ci([1.0, 2.0], 1)
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    rows = spark.createDataFrame([(i % 30, float(v + 0.2 * rng.normal()), float(rng.normal()), float(v)) for i, v in enumerate(a)], "zone long, good double, bad double, actual double")
    got = [r.difference for r in bt.bootstrap_rank_difference(rows, "good", "bad", "actual", 30, 1).collect()]
    again = bt.bootstrap_rank_difference(rows.repartition(3), "good", "bad", "actual", 30, 1).agg(F.avg("difference")).first()[0]
    assert len(got) == 30 and min(got) > 0.5 and again == pytest.approx(np.mean(got))


def test_ledger(spark):
    runs = [ledger.ingest_run(spark, "osm", "c", cols, 3, "p", "h") for cols in (["a", "b"], ["b", "a"], ["a"])]
    ids = [r.first().run_id for r in runs]
    assert ids[0] == ids[1] != ids[2]
    cells = spark.createDataFrame([("1", 1, None, 2)], "h3 string, a int, c int, d int")
    assert ledger.unaccounted(cells, runs[0], ("h3",)) == ["d"]
    said = '```json\n{"record_type": "project", "project_id": "p", "field": "stage", "value": "funded", "confidence": 0.9, "is_new": false, "is_stage_change": false}\n```'
    parsed = ledger.parse_candidates(spark.createDataFrame([(1, said), (2, "sorry"), (3, None)], "candidate_id long, answer string"), "answer")
    assert [r.status for r in parsed.orderBy("candidate_id").collect()] == ["parsed", "parse_failed", "parse_failed"]
    decided = spark.createDataFrame([(1, 5, "edited", "announced", "ann"), (1, 4, "rejected", None, "bob")], "candidate_id long, at long, decision string, value string, reviewer string")
    state = ledger.queue_state(parsed.filter("candidate_id = 1"), decided)
    assert ledger.history_rows(state).first().asDict() == {"project_id": "p", "field": "stage", "old_value": None, "new_value": "announced", "changed_by": "ann"}


def test_geodesic(spark):
    # one degree of the equator, a quarter meridian, and a published pair (Flinders Peak to Buninyong)
    got = geodesic_m([0, 0, 144.42486789], [0, 0, -37.95103342], [1, 0, 143.92649553], [0, 90, -37.65282114])
    assert got == pytest.approx([111319.4908, 10001965.7293, 54972.271], abs=0.01)
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (5.0, 5.0, 5.0, 5.0)], "a double, b double, c double, d double")
    assert [r.metres for r in with_geodesic(df, "a", "b", "c", "d").collect()] == pytest.approx([111319.4908, 0.0], abs=0.01)
