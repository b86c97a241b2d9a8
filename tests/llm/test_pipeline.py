"""Each stage of the pipeline against a brute-force version of it, on its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from terrane.llm import quality, sharding
from terrane.llm.common import load
from tests.llm.test_llm import BAD, SCHEMA, WORD, brute_components, brute_hits, brute_targets

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = load(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    kept = cp.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    bits = quality.mask(quality.POLICIES[quality.POLICY])
    assert ids(kept) == sorted(i for i, t in text.items() if not quality.measure(t)[-1] & bits)
    single = cp.near_dedup(spark, kept, SF)
    assert single.columns == docs.columns
    assert ids(single) == sorted(i for i, _, _, keep in brute_components([(i, text[i]) for i in ids(kept)]) if keep)
    clean = cp.decontaminate(spark, single, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == [i for i in ids(single) if not brute_hits(text[i], bench)[-1]]
    mixed = cp.mix_sources(spark, clean, SF)
    assert mixed.columns == docs.columns
    size = {i: len(WORD.findall(text[i])) for i in text}
    drawn, held = Counter(ids(mixed)), defaultdict(list)
    for i in ids(clean):
        held[source[i]].append(i)
    want = brute_targets({s: sum(size[i] for i in x) for s, x in held.items()})
    assert set(drawn) <= set(ids(clean)) and max(drawn.values()) <= 3
    for s, x in held.items():
        taken = sum(size[i] * drawn[i] for i in x)
        assert abs(taken - want[s]) <= max(0.05 * want[s], max(size[i] for i in x))
    placed = cp.shard(spark, mixed, SF).collect()
    n = len(placed)
    assert Counter(r.doc_id for r in placed) == drawn and sorted(r.position for r in placed) == list(range(n))
    assert all(r.position == sharding.permute(r.row_number, n) == r.slot * 24 + r["shard"] for r in placed)


def test_run_repeats(spark):
    a, b = (sorted(map(repr, cp.run(spark, SF).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b and len(a) > 0
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]


@pytest.mark.parametrize("rows", [BAD, []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert name == "shard" or out.columns == docs.columns
        assert out.count() <= 3 * len(rows)
    assert rows == [] or ids(cp.near_dedup(spark, docs.filter(F.col("doc_id") == 7), SF)) == [7]


def test_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{w}{i * i % 997}" for i in range(200)) for w in ("a", "b", "c"))
    rows = [
        (None, ""), (None, None), (None, one), (None, one), (4, one + " more"), (3, one), (None, one + " and more"),
        (None, two), (None, two + " end"), (7, three), (7, "another short text"), (7, three), (8, ""), (8, ""), (9, ""),
    ]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _key long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, SF).collect()), key=repr)
    null = [x for x in got if x[0] is None]
    assert sorted(x for x in got if x[0] is not None) == [(3, one), (7, "another short text"), (7, three), (8, ""), (9, "")]
    assert sorted((t or "") for _, t in null) in (["", "", two], ["", "", two + " end"])
    assert cp.near_dedup(spark, docs, SF).columns == docs.columns
