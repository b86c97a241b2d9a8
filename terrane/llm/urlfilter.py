"""URL filters from a sorted digest array.

The rules' strings (host and path) are hashed to 64 bits by xxhash and sorted into one file: keys, offsets, strings.
Each Python worker memory-maps the file that Spark hands out to its machine, hashes every suffix of a URL's host with
every path prefix that some rule has the length of, probes the keys by vectorised binary search, and confirms each
match against the stored string, so two strings with equal digests cannot be mistaken for each other.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass
from terrane.sources.ship import put_shared, shared_dir

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The method's own list: hosts that are blocked where no rule fits. A real one comes from a table.
LISTED = tuple(f"{name}.example.{end}" for name in ("spam-farm", "casino-win", "free-bets", "cheap-pills") for end in ("com", "net", "org"))
MAGIC = b"URLDIGST"
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): both empty for a null url or one without ://."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def _packed(digests: np.ndarray, codes: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, strings: bytes) -> bytes:
    head = np.array([len(digests), len(lengths)], np.int64)
    return MAGIC + b"".join(x.tobytes() for x in (head, lengths.astype(np.int64), digests.astype(np.uint64), codes.astype(np.int64), offsets.astype(np.int64))) + strings


def build(rules: tuple[tuple[str, str, str], ...], listed: tuple[str, ...] = ()) -> bytes:
    """The file: count, the path lengths that rules have (0 for a whole host), sorted keys, verdict codes, string offsets, strings.

    Codes: 0 allow and 1 block for rules, 2 for a listed host. Equal digests of different strings stay side by side.
    """
    rows = [((host + path).encode(), len(path.encode()), int(verdict == "block")) for verdict, host, path in rules] + [(b"\0" + host.encode(), 0, 2) for host in listed]
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r[0]), r[0]))
    lengths = np.array(sorted({r[1] for r in rows if r[2] != 2}), np.int64)
    offsets = np.r_[0, np.cumsum([len(r[0]) for r in rows])]
    return _packed(np.array([xxhash.xxh64_intdigest(r[0]) for r in rows], np.uint64), np.array([r[2] for r in rows]), lengths, offsets, b"".join(r[0] for r in rows))


def build_from_tables(rules: DataFrame, listed: DataFrame) -> bytes:
    """The file of build() from tables: rules (verdict, host, path) and listed (host), of any length.

    Executors lower-case, hash, sort and drop what is repeated; the driver holds the list once, as columns, since the
    file goes to every machine whole. Rules without a host or verdict and hosts that are null are left out; of rules
    with the same host and path a block wins.
    """
    low = lambda name: F.translate(F.col(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit(""))
    ruled = rules.filter("host IS NOT NULL AND verdict IS NOT NULL").select(F.concat(low("host"), path).alias("key"), F.octet_length(path).cast("long").alias("length"), (F.col("verdict") == "block").cast("long").alias("code"))
    names = listed.filter("host IS NOT NULL").select(F.concat(F.lit("\0"), low("host")).alias("key"), F.lit(0).cast("long").alias("length"), F.lit(2).cast("long").alias("code"))
    every = ruled.groupBy("key", "length").agg(F.max("code").alias("code")).unionByName(names.distinct())

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(0).cast(pa.binary())
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, raw.to_pylist()), np.uint64, len(raw))
        # with the top bit turned round, signed numbers sort as unsigned ones do
        return pa.RecordBatch.from_arrays([pa.array((hashed ^ np.uint64(1 << 63)).view(np.int64)), raw, batch.column(1), batch.column(2)], ["digest", "key", "length", "code"])

    got = arrow_pass(every, digest, "digest long, key binary, length long, code long", 65536).orderBy("digest", "key", "length").toArrow()
    codes, lengths = (got[c].to_numpy() for c in ("code", "length"))
    keys = got["key"].to_pylist()
    return _packed(
        got["digest"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63), codes, np.unique(lengths[codes != 2]), np.r_[0, np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))], b"".join(keys)
    )


class Digests:
    """A memory-mapped file of build()."""

    def __init__(self, path: str) -> None:
        self.map = np.memmap(path, np.uint8, "r")
        if bytes(self.map[:8]) != MAGIC:
            raise ValueError("not a digest file")
        n, m = (int(x) for x in self.map[8:24].view(np.int64))
        at = 24
        self.lengths, at = self.map[at : at + 8 * m].view(np.int64), at + 8 * m
        self.keys, at = self.map[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.codes, at = self.map[at : at + 8 * n].view(np.int64), at + 8 * n
        self.offsets, at = self.map[at : at + 8 * (n + 1)].view(np.int64), at + 8 * (n + 1)
        self.strings = self.map[at:]

    def string(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """Index of each string, -1 where it is not stored."""
        out = np.full(len(wanted), -1, np.int64)
        if not wanted or not len(self.keys):
            return out
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, hashed)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashed):
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == hashed[k]:
                if self.string(i) == wanted[k]:
                    out[k] = i
                    break
                i += 1
        return out


def _suffixes(host: str) -> list[str]:
    """The host, and what follows each of its dots."""
    return [host] + [host[m.end() :] for m in re.finditer(r"\.", host)]


def judge(urls: list[str | None], digests: Digests) -> list[tuple[str, str, str | None, str, bool]]:
    """(host, path, rule, verdict, listed) of each url; the longest rule that fits decides, else the list of hosts."""
    split = [parts(u) for u in urls]
    wanted, owner = [], []
    lengths = digests.lengths.tolist()
    for k, (host, path) in enumerate(split):
        raw = path.encode("utf-8", "surrogatepass")
        for suffix in _suffixes(host) if host else []:
            key = suffix.encode("utf-8", "surrogatepass")
            probes = [key + raw[:n] for n in lengths if n <= len(raw)] + [b"\0" + key]
            wanted.extend(probes)
            owner.extend([k] * len(probes))
    best: dict[int, bytes] = {}
    verdicts: dict[int, int] = {}
    listed: set[int] = set()
    at = digests.find(wanted)
    for j in np.flatnonzero(at >= 0):
        k, code = owner[j], int(digests.codes[at[j]])
        if code == 2:
            listed.add(k)
        elif len(wanted[j]) > len(best.get(k, b"")):
            best[k], verdicts[k] = wanted[j], code
    out = []
    for k, (host, path) in enumerate(split):
        blocked = verdicts[k] if k in best else int(k in listed)
        out.append((host, path, best[k].decode() if k in best else None, "block" if blocked else "allow", k in listed))
    return out


def hand_out(spark: SparkSession, data: bytes) -> str:
    """Gives the file to every machine of the cluster, from the shared folder; its name there, after its content."""
    name = f"urls-{hashlib.sha256(shared_dir(spark).encode() + data).hexdigest()[:24]}.bin"  # a name may have one path only
    spark.sparkContext.addFile(put_shared(spark, name, data))
    return name


def filter_urls(df: DataFrame, rules=RULES, listed=LISTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of df.

    rules (verdict, host, path) and listed (hosts) are tuples, or tables of which none may be missing: build_from_tables.
    Null urls and those without :// have empty parts and are allowed. Repeated rows and rows without an id are judged
    each by its url alone. Of rules that fit, the longest wins; equal ones of both verdicts block. An empty table gives
    an empty table; other columns of df are not read.
    """
    data = build_from_tables(rules, listed) if isinstance(rules, DataFrame) else build(tuple(rules), tuple(listed))
    name = hand_out(df.sparkSession, data)
    opened: list[Digests] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not opened:
            opened.append(Digests(SparkFiles.get(name)))
        rows = judge(batch.column(1).to_pylist(), opened[0])
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["page_id", "host", "path", "rule", "verdict", "listed"])

    return arrow_pass(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), run, "page_id long, host string, path string, rule string, verdict string, listed boolean", 4096)


def op8_urls(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)


def op8_listed(pages: DataFrame, customers: DataFrame) -> DataFrame:
    """pages by rules and a list of hosts that come from tables: hosts and starts of paths of every fifth page, and a
    list of every third page's host and of a host for each customer. Rules and list grow with the tables."""
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/?#]*([^?#]*)", 1)
    named = pages.select("page_id", host.alias("host"), path.alias("path")).filter("host <> ''")
    verdict = F.when(F.col("page_id") % 2 == 0, "block").otherwise("allow")
    rules = named.filter("page_id % 5 = 0").select(verdict.alias("verdict"), F.substring_index("host", ".", -2).alias("host"), F.substring("path", 1, 5).alias("path"))
    listed = named.filter("page_id % 3 = 0").select("host").unionByName(customers.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.org")).alias("host")))
    return filter_urls(pages, rules, listed)


def op8_listed_sql() -> str:
    lower = "translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH p AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    rules AS (
      SELECT host, path, min(CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END) AS allow
      FROM (SELECT page_id, array_to_string(string_split(host, '.')[-2:], '.') AS host, substr(path, 1, 5) AS path FROM p WHERE host <> '' AND page_id % 5 = 0) GROUP BY ALL),
    listed AS (SELECT DISTINCT host FROM (SELECT host FROM p WHERE host <> '' AND page_id % 3 = 0 UNION ALL SELECT 'c' || c_custkey || '.example.org' FROM customer)),
    ends AS (SELECT page_id, array_to_string(parts[i:], '.') AS suffix FROM (SELECT page_id, string_split(host, '.') AS parts FROM p WHERE host <> ''), unnest(range(1, len(parts) + 1)) t(i)),
    fit AS (
      SELECT page_id, arg_max(r.host || r.path, encode(r.host || r.path).octet_length()) AS rule, arg_max(allow, encode(r.host || r.path).octet_length()) AS allow
      FROM ends JOIN rules r ON r.host = suffix JOIN p USING (page_id) WHERE starts_with(p.path, r.path) GROUP BY page_id),
    l AS (SELECT DISTINCT page_id FROM ends JOIN listed ON listed.host = suffix)
    SELECT page_id, host, path, rule, CASE WHEN coalesce(1 - allow, (l.page_id IS NOT NULL)::INT) = 1 THEN 'block' ELSE 'allow' END AS verdict, l.page_id IS NOT NULL AS listed
    FROM p LEFT JOIN fit USING (page_id) LEFT JOIN l USING (page_id)
    """


def op8_sql() -> str:
    lower = "translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda host, path: f"((host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    listed = " OR ".join(f"host = '{x}' OR host LIKE '%.{x}'" for x in LISTED)
    return f"""
    WITH p AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r AS (SELECT *, CASE {' '.join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)} END AS rule,
      CASE {' '.join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)} END AS ruled, {listed} AS listed FROM p)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r
    """
