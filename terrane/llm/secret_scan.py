"""Secret scans with corpus-wide ownership frequency.

One pass over whole texts finds candidates. Their values are hashed, and the hashes are counted over the corpus by
distinct repositories and distinct owners: a value that many owners or many repositories hold is a copied example; one
that few of both hold, and that looks random, is taken for live. The base spans stay whatever their frequency; the method adds the live
spans of kinds that the base does not have. Only hashes, ids and spans leave the first pass.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass, written

#: Fixed patterns of the contract, and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ takes whole runs, so a least length changes no span
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Kinds in the order of the spans; those after hex are the method's own.
KINDS = ("assign", "access", "hex", "vendor", "jwt", "pem", "url", "random")
#: The method's patterns; group 1 is the value. Runs have no upper length and are not given back, so a pass is linear.
MORE = (
    ("vendor", re.compile(r"\b((?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|glpat-)[A-Za-z0-9_-]{16,})")),
    ("jwt", re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    ("pem", re.compile(r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s*(?:[A-Za-z0-9-]+:[^\n]*\n)*+[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ )*PRIVATE KEY-----)")),
    ("url", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:([^\s:/@]{6,}+)@")),
    ("random", re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{24,}+={0,2}+)(?![A-Za-z0-9+/_=-])")),
)
#: Marks in a text without which none of a kind can be there: most texts are done after a few plain searches.
_ASSIGN_MARKS = ("passw", "secret", "token", "api")
_MORE_MARKS = {"vendor": ("gh", "xox", "sk", "glpat"), "jwt": ("eyJ",), "pem": ("PRIVATE KEY",), "url": ("://",)}
#: Values of at most this many owners and this many repositories may be live; those of more of either are examples.
MAX_OWNERS = 2
MAX_REPOS = 16
SALTS = 16
MIN_ENTROPY = 3.5


def entropy(value: str) -> float:
    """Bits for each character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Digits, letters of both cases or hex, and enough entropy."""
    kinds = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)))
    return kinds >= 2 and any(c.isdigit() for c in value) and entropy(value) >= min(MIN_ENTROPY, 0.8 * math.log2(max(len(value), 2)))


def candidates(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, base) of one text, in order of start, then kind. Offsets are code points."""
    if not text:
        return []
    out = []
    low = text.lower()
    # lower() keeps the ASCII marks; the pattern decides
    if any(m in low for m in _ASSIGN_MARKS):
        out += [("assign", m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    taken = _union(sorted((s, e) for _, s, e, _, _ in out))
    for kind, pattern in MORE:
        if kind in _MORE_MARKS and not any(m in text for m in _MORE_MARKS[kind]):
            continue
        new, at = [], 0
        for m in pattern.finditer(text):
            s, e = m.span(1)
            while at < len(taken) and taken[at][1] <= s:  # matches and spans taken both run forward
                at += 1
            if (at == len(taken) or taken[at][0] >= e) and (kind == "pem" or looks_random(m[1])):
                out.append((kind, s, e, m[1], False))
                new.append((s, e))
        taken = sorted(taken + new)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)


_FOUND = "doc_id long, text_hash long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base_spans string, kinds array<string>, starts array<long>, ends array<long>, h1 array<long>, bases array<boolean>"


def _scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in batch.column(3).to_pylist():
        found = candidates(text)
        base = [x for x in found if x[4]]
        counts = Counter(x[0] for x in base)
        rows.append((
            xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base),
            [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [xxhash.xxh3_64_intdigest(x[3].encode("utf-8", "surrogatepass")) - 2**63 for x in found], [x[4] for x in found],
        ))
    long, text = pa.int64(), pa.string()
    types = (long, long, long, long, text, text, pa.list_(text), pa.list_(long), pa.list_(long), pa.list_(long), pa.list_(pa.bool_()))
    cols = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)]
    return pa.RecordBatch.from_arrays([batch.column(0), cols[0], batch.column(1), batch.column(2), *cols[1:]], [x.split()[0] for x in _FOUND.split(", ")])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The contract's columns, then n_example and n_live, for every row of df.

    n_example counts a row's candidates (base ones too) whose value more than max_owners owners or more than max_repos
    repositories hold, n_live the rest. Distinct repositories count whoever owns them, so one that two owners name
    counts once. Where the owner is null, each repository counts as an owner of its own; where the repository is null,
    each text does. Null and empty texts have no spans. Rows that repeat an id and text get the same result each. An
    empty table gives an empty table. Columns of df beyond the four named are not read.
    """
    text_key = F.concat(F.lit("text "), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).cast("string"))
    repo = F.coalesce(F.concat(F.lit("repo "), F.col(repo_col).cast("string")), text_key)
    owner = F.coalesce(F.concat(F.lit("owner "), F.col(owner_col).cast("string")), repo)
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), repo.alias("repo"), owner.alias("owner"), F.col(text_col).alias("text"))
    found = written(arrow_pass(named, _scan_batch, _FOUND), "secret-candidates")
    each = found.filter(F.size("kinds") > 0).select("doc_id", "text_hash", "repo", "owner", F.explode(F.arrays_zip("kinds", "starts", "ends", "h1", "bases")).alias("c"))
    each = each.select("doc_id", "text_hash", "repo", "owner", F.col("c.kinds").alias("kind"), F.col("c.starts").alias("start"), F.col("c.ends").alias("end"), F.col("c.h1").alias("value"), F.col("c.bases").alias("base"))
    spread = held_by(each).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # an example that very many documents hold is dealt to SALTS tasks
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt")
    spread = each.select("doc_id", "text_hash", "kind", "start", "end", "value", "base").distinct().select("*", salt).join(spread, ["value", "salt"])
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    reported = F.col("base") | live
    span = F.when(reported, F.struct(F.col("start"), order[F.col("kind")].alias("rank"), F.col("end"), F.col("kind")))
    per = spread.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.sum((~live).cast("long")).alias("n_example"), F.sum(live.cast("long")).alias("n_live"),
    )
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = per.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), text.alias("spans"), "n_example", "n_live")
    out = found.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_example"), zero("n_live"))


def held_by(each: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos): distinct owners and repositories of each value.

    Distinct (value, owner) and (value, repo) come first, so an example in every third row is counted in many tasks.
    """
    names = F.explode(F.array(F.struct(F.lit("owner").alias("what"), F.col("owner").alias("name")), F.struct(F.lit("repo").alias("what"), F.col("repo").alias("name")))).alias("n")
    one = each.select("value", names).select("value", "n.what", "n.name").distinct()
    return one.groupBy("value").agg(F.count_if(F.col("what") == "owner").alias("n_owners"), F.count_if(F.col("what") == "repo").alias("n_repos"))


def op7_secrets(documents: DataFrame) -> DataFrame:
    """Owners are sources, repositories are documents."""
    return scan_secrets(documents)


def base_spans(documents: DataFrame) -> DataFrame:
    """The base columns of the scan, which SQL expresses."""
    return scan_secrets(documents).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_spans_sql() -> str:
    """Spans from the pieces between matches: a match begins where the pieces and matches before it end."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + f"|{either('api')}_?{either('key')}"
    patterns = {
        "assign": rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": f"AKIA[A-Z0-9]{{{{{MIN_ACCESS - 4},}}}}", "hex": "[0-9a-f]{{16,}}",
    }
    kinds = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        pattern = pattern.replace("{{", "{").replace("}}", "}")
        value = f"length(regexp_extract_all(text, '{pattern}', 2)[i]) >= {MIN_ASSIGN}" if kind == "assign" else "TRUE"
        kinds.append(f"""SELECT id, '{kind}' AS kind, {rank} AS rank, start, start + length(m[i]) AS stop FROM (
          SELECT id, m, i, ok, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
          FROM (SELECT id, m, gaps, i, {value} AS ok FROM (SELECT id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS gaps, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM d))) WHERE ok""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({' UNION ALL '.join(kinds)}),
    p AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN p USING (id)
    """
