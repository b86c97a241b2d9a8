"""Filter audit, prefix trie, n-gram join and running sums against brute force, with edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import conversations, interactions, neardup, ngramjoin, scan
from terrane.llm.common import load

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
DOCS = "doc_id long, text string, source string, id long, part string, mask string, digest int, n long, good boolean"
ODD = [
    (1, None, None), (2, "", "a"), (None, "one TWO", "b"), (None, "one TWO", "b"), (4, "one TWO", None), (5, "one TWO", ""), (5, "one TWO", ""), (6, LONG, "a"), (7, LONG, "a"),
    (8, "ÀÉ Ab $", "a"), (9, "x " * 60, "b"), (-3, "  ", "b"), (10, " ".join(f"w{i}" for i in range(80)), "c"),
]
ODD = [(*r, 3, "p", "m", 4, 5, True) for r in ODD]


def flags(rows):
    """Failing letters of (doc_id, text, source)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        yield {
            c for c, bad in zip("ABCDE", (
                len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                i is not None and i > least[t],
            )) if bad
        }


def audit_brute(rows, quality, toxic):
    out, orders = defaultdict(Counter), ["".join(p) for p in itertools.permutations("ABCDE")]
    for (i, _, source), fails in zip(rows, flags(rows)):
        for order in orders:
            gone = None
            for step, f in enumerate(order, 1):
                at = out[source or "", order, step]
                at["unique_fails"] += fails == {f}
                if f in fails and gone is None:
                    gone = step
                    at["removed"] += 1
                    at["good_lost"] += i in quality
                    at["toxic_lost"] += i in toxic
                elif f in fails:
                    at["redundant"] += 1
                at["kept"] += gone is None
    for part in {k[0] for k in out}:
        total = Counter()
        for order in orders:
            for step, f in enumerate(order, 1):
                total[f] += out[part, order, step]["removed"]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step]["shapley"] = total[f]
    return out


def same_audit(df, rows, quality, toxic):
    want, got = audit_brute(rows, quality, toxic), df.collect()
    assert len(got) == len(want) and len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    for r in got:
        w = want[r.part, r.filter_order, r.step]
        assert all(r[c] == w[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")), (r, w)


def test_filter_audit(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, None), (8, None, 1), (None, 1, 1), (6, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(ODD, DOCS)
    same_audit(interactions.op11_audit(df, labels), [r[:3] for r in ODD], {4, 5}, {4, 8})
    same_audit(interactions.op11_audit(df, labels.limit(0)), [r[:3] for r in ODD], set(), set())
    assert interactions.op11_audit(df.limit(0), labels).count() == 0
    docs = load(spark, SF, "documents")
    told = load(spark, SF, "labels").collect()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    same_audit(interactions.op11_audit(docs, load(spark, SF, "labels")), rows, {r.doc_id for r in told if r.quality == 1}, {r.doc_id for r in told if r.toxic == 1})


def test_audit_of_other_filters(spark):
    """Two filters: two orders; a mask of more bits is an error."""
    masks = spark.createDataFrame([("p", 0), ("p", 1), ("p", 3), ("p", 3), ("q", 2)], "part string, mask int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interactions.audit(masks, "XY").collect()}
    assert got["p", "XY", 1] == (1, 3, 0, 1, 4) and got["p", "XY", 2] == (1, 0, 2, 0, 2) and got["p", "YX", 1] == (2, 2, 0, 0, 2) and len(got) == 8
    with pytest.raises(Exception, match="mask out of range"):
        interactions.audit(masks, "X").collect()
    with pytest.raises(ValueError):
        interactions.outcome_matrices("AA")


def test_outcome_matrices():
    made = interactions.outcome_matrices()
    assert all(m.shape == (32, 600) for m in made.values())
    assert ((made["removed"] + made["redundant"]).sum(axis=1) == 120 * np.array([m.bit_count() for m in range(32)])).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, parts):
    """Groups that run over several ranges, over whole ranges, and end with one."""
    r = random.Random(parts)
    rows = [(g, i, r.randrange(100), r.randrange(-(2**62), 2**62)) for g, n in ((1, 3), (2, 500), (3, 1), (4, 40), (9, 300)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, a long, x long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = scan.running(df, [F.col("i")], "g", sums=("a",), xors=("x",)).collect()
        every = scan.running(df, [F.col("g"), F.col("i")], sums=("a",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, total, x, at, whole, all_of = {}, 0, 0, None, {}, 0
    for g, i, a, b in sorted(rows):
        total, x = (total + a, x ^ b) if g == at else (a, b)
        at, all_of = g, all_of + a
        want[g, i], whole[g, i] = (total, x), all_of
    assert {(r.g, r.i): (r.run_a, r.run_x) for r in got} == want and len(got) == len(rows)
    assert {(r.g, r.i): r.run_a for r in every} == whole
    assert scan.running(df.limit(0), [F.col("i")], "g", sums=("a",)).count() == 0


def trie_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + mine[h:]
    members = defaultdict(set)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * words
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


TURNS = "conv_id long, turn long, role string, text string, conv long, depth string, owner int, i long, key string, h long"


def same_trie(spark, rows):
    df = spark.createDataFrame([(*r, 7, "d", 3, 4, "k", 5) for r in rows], TURNS)
    got = conversations.op12_trie(df).collect()
    want, n = trie_brute(rows)
    assert len(got) == n == len(want)
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {tuple(r[c] for c in cols) for r in got} == want


def test_trie(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(0, 130), 1000, 1001, 2**40, -1, -20, -37]:
        if c in (40, 60):
            continue  # absent bases
        for t in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a b", "a  b c", "", None, "x", "y z"])))
    rows += [(3, 0, "user", "a b")] * 3 + [(None, 0, "user", "lost"), (5, 2, None, None), (5, 2, "", "")]
    same_trie(spark, rows)
    same_trie(spark, [(7, 1, "user", "only")])
    assert conversations.op12_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversations.op12_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "", 1, 1, "", 1)], TURNS)).count() == 0


def test_trie_of_hot_groups(spark, monkeypatch):
    """A conversation of most turns, many copies of one, many children of one turn, and a ladder of branches."""
    monkeypatch.setattr(conversations, "BLOCK", 16)
    monkeypatch.setattr(conversations, "HEAVY_ROWS", 5)
    monkeypatch.setattr(conversations, "PIECE", 4)
    rows = [(21, t, "user", f"turn {t}") for t in range(150)]
    rows += [(100_000 + i, t, "user", f"same {t}") for i in range(60) for t in range(5)]
    rows += [(200_000 + 20 * i, t, "user", "first words" if t == 0 else f"{i} {t}") for i in range(40) for t in range(3)]
    rows += [(300_000 + 20 * i, t, "user", f"rung {t}" if t < i else f"off {i}") for i in range(30) for t in range(i + 1)]
    same_trie(spark, rows)


def test_preorder(spark):
    """Subtrees are intervals: those of two nodes lie apart or one holds the other, and numbers have no gap."""
    got = conversations.prefix_trie(load(spark, SF, "conversations")).collect()
    assert sorted(r.preorder for r in got) == list(range(len(got)))
    by = sorted((r.preorder, r.subtree_end, r.depth, r.n_leaves) for r in got)
    assert by[0][:3] == (0, len(got), 0) and all(s < e for s, e, _, _ in by)
    for s, e, d, leaves in by:
        inside = [x for x in by if s <= x[0] < e]
        assert all(x[1] <= e and x[2] >= d for x in inside) and sum(x[1] == x[0] + 1 for x in inside) == leaves


def components_brute(texts, words, percent):
    sets = {i: neardup.shingles((t or "").encode(), words) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            links += 1
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}, links


def families(seed, percent, count=40, words=60):
    """Copies about the threshold, of several originals, with shared boilerplate."""
    r, out = random.Random(seed), []
    page = [f"page{i}" for i in range(words)]
    for f in range(count):
        base = [f"f{f}w{r.randrange(10**6)}" for _ in range(r.choice([3, 8, words, 3 * words]))]
        if f % 3 == 0:
            base = page + base[: words // 3]
        for _ in range(r.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) * (100 - percent) // 300) + 1)):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**9)}"
            out.append(" ".join(copy))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("turns", [0, 3])
def test_ngram_join(spark, monkeypatch, turns):
    """Every class by brute force, with leaders and by rarest shingles alone."""
    monkeypatch.setattr(neardup, "TURNS", turns)
    texts = families(turns, 90)
    want, links = components_brute(texts, 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.op13_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want
    assert links > 50


def test_ngram_join_odd(spark):
    rows = [(i, t) for i, t, *_ in ODD] + [(20, "One two"), (21, "a b c d"), (22, "a b c d"), (None, "A B C D"), (23, "a b c e"), (24, LONG + " more")]
    got = ngramjoin.op13_join(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, node int")).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert of[1] == (0, 1) and of[2] == (0, 2) and of[-3] == (0, -3) and of[5] == (1, 4) and of[20] == (1, 4) and of[22] == (2, 21) and of[23] == (2, 23)
    assert of[7][1] == of[24][1] == 6
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(1, 4), (1, 4), (2, 21)]
    assert ngramjoin.op13_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [2, 5, 9, 10, 19, 20, 57, 400, 3000])
def test_partenum_shares_a_signature(n):
    """Any two sets at the threshold, of equal or different sizes, share a signature."""
    r = np.random.default_rng(n)
    for _ in range(60):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        cut, add = int(r.integers(0, n // 9 + 1)), int(r.integers(0, n // 9 + 1))
        y = np.r_[x[cut:], r.integers(0, 2**63, add, dtype=np.uint64)]
        both = n - cut
        if 100 * both >= 90 * (n + len(y) - both) and (cut or add):
            assert len(np.intersect1d(ngramjoin.signatures_of(np.unique(x), 90), ngramjoin.signatures_of(np.unique(y), 90)))


def test_bands_of_sizes():
    """Sets at the threshold are in one band or in neighbouring ones."""
    for n in range(1, 3000):
        low = ngramjoin.band_of(-(-n * 90 // 100), 90)[0]
        assert ngramjoin.band_of(n, 90)[0] - low in (0, 1)


def test_rule_prefixes(spark):
    """Two sets at the threshold share one of their first shingles in any order, the shorter one's by its shorter list."""
    r = np.random.default_rng(3)
    for rule in (neardup.Rule(), ngramjoin.RULE):
        sizes = spark.range(0, 200).select("id", rule.probe(F.col("id")).alias("probe"), rule.index(F.col("id")).alias("index")).collect()
        probe, index = {x.id: x.probe for x in sizes}, {x.id: x["index"] for x in sizes}
        assert all(probe[n] >= index[n] >= 1 for n in range(1, 200))
        for _ in range(300):
            n = int(r.integers(1, 80))
            x = r.permutation(10_000)[:n]
            cut, add = int(r.integers(0, n)), int(r.integers(0, n + 1))
            y = np.unique(np.r_[x[cut:], r.integers(20_000, 30_000, add)])
            both = len(np.intersect1d(x, y))
            if 100 * both < rule.percent * (n + len(y) - both):
                continue
            x, y = (np.sort(v) for v in ((x, y) if n <= len(y) else (y, x)))
            assert set(x[: index[len(x)]].tolist()) & set(y[: probe[len(y)]].tolist())


def test_neardup_family_without_links(spark, monkeypatch):
    """A template of hundreds of pages, some of them altered copies of each other: every link by brute force."""
    monkeypatch.setattr(neardup, "TURNS", 0)
    r, texts = random.Random(8), []
    core = [f"core{i}" for i in range(130)]
    for _ in range(260):
        own = [f"own{r.randrange(10**9)}" for _ in range(45)]
        texts.append(core + own)
        if r.random() < 0.1:
            texts.append(core + own[: r.choice([30, 38, 44])] + [f"new{r.randrange(10**9)}"])
    r.shuffle(texts)
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, links = components_brute(texts, 5, 75)
    got = {x.id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and links > 5


def test_secrets_of_long_lists():
    """Spans are looked up along the text, so a list of many hashes costs in proportion to its length."""
    import time

    from terrane.llm import secret_scan

    r = random.Random(1)
    lists = {n: "\n".join("%064x" % r.getrandbits(256) + " " + "".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=40)) for _ in range(n)) for n in (3000, 24000)}
    took = {}
    for n, text in lists.items():
        start = time.process_time()
        found = secret_scan.candidates(text)
        took[n] = time.process_time() - start
        assert sum(x[0] == "hex" for x in found) == n and sum(not x[4] for x in found) >= 0.95 * n
        for (_, _, e, *_), (_, s, *_) in zip(found, found[1:]):
            assert s >= e
    assert took[24000] < 24 * took[3000] + 0.5


@pytest.mark.parametrize(("text", "letter"), [("½ ²", False), ("Ⅷ", False), ("12 ٢", False), ("́", False), ("_-", False), ("½ a", True), ("中", True), ("ʰ", True)])
def test_language_needs_a_letter(text, letter):
    from terrane.llm import langid

    model = langid.Model(("a", "b"), np.zeros((langid.FEATURES, 2)), np.ones((langid.N_SCRIPTS, 2), bool), 1)
    assert (model.predict(text.encode())[0] != "und") == letter


def test_language_whole(spark):
    """Training and prediction of a small table by plain counting and an exhaustive walk."""
    from terrane.llm import langid

    r, rows = random.Random(4), []
    words = {"x": ["aba", "bab", "abba", "baab"], "y": ["xyz", "zyx", "yyx", "zzy"], "z": ["аб", "баб"]}
    for i in range(60):
        lang = r.choice("xyz")
        rows.append((i, " ".join(r.choices(words[lang], k=r.randrange(1, 9))), lang))
    rows += [(100, "aba bab abba baab aba zyx zyx zyx xyz", None), (101, None, "x"), (102, "7 8", "x"), (None, "xyz", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, lang) for i, t, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 5 and lang and t]
    langs = sorted({lang for _, lang in learned})
    grams = {lang: np.full(langid.FEATURES, langid.SMOOTHING) for lang in langs}
    scripts = {lang: np.zeros(langid.N_SCRIPTS) for lang in langs}
    for t, lang in learned:
        g, _, s = langid.features(t.encode())
        np.add.at(grams[lang], g, 1)
        np.add.at(scripts[lang], s, 1)
    model = langid.train(df)
    assert list(model.langs) == langs
    got = {x.doc_id: x.lang_pred for x in langid.op6_language(df).collect()}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == "und"
            continue
        each = []
        for w in t.split():
            g, _, s = langid.features(w.encode())
            each.append([sum(np.log(grams[x] / grams[x].sum())[g]) if all(k == 0 or scripts[x][k] / scripts[x].sum() >= langid.SCRIPT_SHARE for k in s) else -1e9 for x in langs])
        best, label = -1e18, None
        for path in itertools.product(range(len(langs)), repeat=len(each)) if len(each) <= 9 else []:
            value = sum(e[k] for e, k in zip(each, path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:]))
            if value > best + 1e-9:
                best, label = value, path
        held = Counter()
        for w, k in zip(t.split(), label):
            held[k] += len(w)
        top = max(held.values())
        assert got[i] in {langs[k] for k, n in held.items() if n == top}, (i, t, got[i])


def test_license_tags_by_place():
    """Tags are where the automaton finds their words, with their own marks, and each ends before the next."""
    from terrane.llm.licenses import scan

    text = "État SPDX License Identifier: GPL-3.0 (no tag) SPDX-License-Identifier: MIT AND (ISC or GPL-2.0) spdx-license-identifier :Apache-2.0\nSPDX-License-Identifier:\nBSD-2-Clause"
    n_words, *_, labels, expression, _, permissive = scan(text.encode())
    assert expression == "MIT AND (ISC or GPL-2.0); Apache-2.0" and permissive is True and {"mit", "isc", "gpl", "apache"} <= set(labels.split(","))
    many = " ".join(f"word{i} SPDX-License-Identifier: GPL-2.0 AND MIT" for i in range(5000))
    assert scan(many.encode())[6].count(";") == 4999 and scan(many.encode())[8] is False
