"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each failed rule.
A policy is a named, versioned set of rules, so a verdict is one bitwise AND, and any other policy, or a policy less
one rule (an ablation), is answered from the ledger alone by counting its distinct bitmasks.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import BLANK_WORD, BLANKS, arrow_pass, written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Rule -> bit. A rule keeps its bit for ever; new rules take new bits.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "duplicate_lines": 3, "capitals": 4, "word_length": 5, "exclamations": 6}
#: Versioned policies: the rules that reject. Thresholds belong to the rules.
POLICIES = {
    "base-v1": ("few_words", "repeated_words"),
    "prose-v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "word_length", "exclamations"),
}
POLICY = "prose-v1"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
MAX_CAPITAL_PERCENT = 50
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 40
MAX_EXCLAMATION_PERCENT = 25

LEDGER = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_exclamations long, fail_bits long"


def mask(rules: tuple[str, ...]) -> int:
    """Bits of these rules."""
    return sum(1 << RULES[r] for r in rules)


def repeat_words(words: list) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, then its failure bits. A null text is an empty one."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII blanks alone
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    capitals = sum(1 for w in words if w.isupper() and len(w) > 1)
    shouts = text.count("!")
    failed = {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * repeats > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * symbols > MAX_SYMBOL_PERCENT * n,
        "duplicate_lines": 100 * dups > MAX_DUP_LINE_PERCENT * len(lines),
        "capitals": 100 * capitals > MAX_CAPITAL_PERCENT * n,
        "word_length": not MIN_WORD_CHARS * n <= chars <= MAX_WORD_CHARS * n,
        "exclamations": 100 * shouts > MAX_EXCLAMATION_PERCENT * n,
    }
    return n, chars, symbols, dups, repeats, len(lines), capitals, shouts, sum(1 << RULES[r] for r, bad in failed.items() if bad)


def ledger(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """One row for each row of df: the columns in keep, the measurements and fail_bits.

    Null and empty texts fail few_words; repeated rows get equal entries; an empty table gives an empty ledger.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [LEDGER])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(measure, batch.column(len(fields)).to_pylist()))) or [()] * (len(RULES) + 2)
        names = [f.name for f in fields] + [x.split()[0] for x in LEDGER.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(fields))] + [pa.array(c, pa.int64()) for c in cols], names)

    return arrow_pass(df.select(*[F.col(f.name) for f in fields], F.col(text_col).alias("_text_")), score, schema)


def verdict(policy: str = POLICY) -> F.Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def kept_documents(df: DataFrame, policy: str = POLICY, text_col: str = "text") -> DataFrame:
    """The rows of df that a policy keeps, with df's own columns.

    Rules and verdict run in the same pass as the rows, so texts are not shuffled; what the rules measured is dropped.
    """
    bits = mask(POLICIES[policy])
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not measure(t)[-1] & bits for t in batch.column(at).to_pylist()], pa.bool_()))

    return arrow_pass(df, judge, df.schema)


def ablations(entries: DataFrame, policy: str = POLICY, held: str | None = None) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it rejects.

    The ledger is first counted by bitmask (at most 2 ** rules rows), so no other pass reads documents; held names a
    column of counts, where entries are counted already.
    """
    rules = POLICIES[policy]
    n = F.count(F.lit(1)) if held is None else F.sum(held)
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(n.alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return masks.select("bits", "n", each).groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op2_quality(documents: DataFrame) -> DataFrame:
    """The contract's columns, then the ledger's bits and the policy that judged."""
    rows = ledger(documents, ["doc_id"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base-v1"]))) != 0).alias("base_failed"),
        verdict().alias("kept"), "fail_bits", F.lit(POLICY).alias("policy"),
    )


def op2_ablations(documents: DataFrame) -> DataFrame:
    """What each rule of each policy fails, and what it alone rejects, from one ledger."""
    entries = ledger(documents, ["doc_id"])
    masks = written(entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("held")), "bitmasks")  # at most 2 ** rules rows
    out = None
    for policy in POLICIES:
        one = ablations(masks, policy, "held")
        out = one if out is None else out.unionByName(one)
    return out


def op2_ablations_sql() -> str:
    """The same from the ledger's SQL."""
    parts = [
        f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER (fail_bits & {1 << RULES[rule]} <> 0) AS n_failed, count(*) FILTER (fail_bits & {mask(rules)} = {1 << RULES[rule]}) AS n_only FROM ledger"
        for policy, rules in POLICIES.items() for rule in rules
    ]
    return f"WITH ledger AS ({op2_sql()}) {' UNION ALL '.join(parts)}"


def op2_sql() -> str:
    """The ledger in DuckDB."""
    blanks = r"[\x20\x09-\x0D]"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w FROM documents),
    win AS (SELECT id, i, (w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT id, count(DISTINCT i + k) AS n FROM rep, range(3) t(k) GROUP BY id),
    lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
    dup AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '{BLANK_WORD}') GROUP BY id),
    m AS (
      SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{blanks}', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND octet_length(encode(x)) > 1)) AS n_capitals,
        len(regexp_extract_all(text, '!')) AS n_shouts
      FROM d LEFT JOIN cov USING (id) LEFT JOIN dup USING (id)),
    f AS (SELECT *, (n_words < {MIN_WORDS})::BIGINT + 2 * (100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)::BIGINT
        + 4 * (100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words)::BIGINT + 8 * (100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines)::BIGINT
        + 16 * (100 * n_capitals > {MAX_CAPITAL_PERCENT} * n_words)::BIGINT
        + 32 * (word_chars < {MIN_WORD_CHARS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words)::BIGINT
        + 64 * (100 * n_shouts > {MAX_EXCLAMATION_PERCENT} * n_words)::BIGINT AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, '{POLICY}' AS policy FROM f
    """
