"""License scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser reads licence expressions.

One automaton holds the base phrases, more notice phrases and the identifier tag; it runs once over the words of a
whole text joined by single spaces. What follows an identifier tag, up to the next tag or the line's end, is an
expression of identifiers, AND, OR, WITH and brackets, of any length; the parser turns it into postfix form, from which
its licences, its alternatives and whether all of it is permissive are evaluated.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass, texts_as_bytes

#: Fixed values of the contract: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More notice phrases, as words between spaces.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Identifiers that a tag may name, and the label of each family.
FAMILIES = {
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache-2.0", "Apache-1.1"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"),
    "cc-by": ("CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "isc": ("ISC",),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT", "MIT-0"),
    "mpl": ("MPL-2.0",),
    "public-domain": ("CC0-1.0", "Unlicense"),
}
LABEL_OF = {name.lower(): label for label, names in FAMILIES.items() for name in names}
PERMISSIVE = ("apache", "bsd", "bsd-2-clause", "bsd-3-clause", "bsl", "cc-by", "isc", "mit", "public-domain")

_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 32 for c in range(256))
_TAG = re.compile(rb"SPDX-License-Identifier[ \t]*:", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_LINE_END = re.compile(r"[\r\n]")
_ORDER = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases with a space at both ends, over the bytes of a text as Latin-1 characters."""
    out = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, TAG):
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: identifiers and operators in postfix order; None for what is no expression."""
    out, held, operand = [], [], True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            held.append("(")
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif low in _ORDER:
            if operand:
                return None
            while held and held[-1] != "(" and _ORDER[held[-1]] >= _ORDER[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def leading(text: str, start: int = 0, stop: int | None = None) -> tuple[list[str], int, int] | None:
    """(tokens, start, end) of the longest leading run of tokens that is an expression, in one pass; None without one."""
    tokens, whole, first, end = [], 0, 0, 0
    depth, operand = 0, True
    for m in _TOKEN.finditer(text, start, len(text) if stop is None else stop):
        token = m[0]
        if token == ")" or token.lower() in _ORDER:
            if operand or (token == ")" and not depth):
                break
            depth -= token == ")"
            operand = token != ")"
        else:
            if not operand:
                break
            depth += token == "("
            operand = token == "("
        if not tokens:
            first = m.start()
        tokens.append(token)
        if not operand and not depth:
            whole, end = len(tokens), m.end()
    return (tokens[:whole], first, end) if whole else None


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """(labels, permissive) of an expression: AND needs both sides permissive, OR one, WITH keeps its licence's side.

    Words after the longest leading run that is an expression are ignored, as in a comment's closing mark.
    """
    found = leading(expression)
    return None if found is None else _value(postfix(found[0]))


def _value(order: list[str]) -> tuple[set[str], bool]:
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token in _ORDER:
            (right, ok2), (left, ok1) = stack.pop(), stack.pop()
            stack.append((left, ok1) if token == "with" else (left | right, ok1 and ok2 if token == "and" else ok1 or ok2))
        else:
            label = LABEL_OF.get(token.lower().rstrip("+"))
            stack.append(({label} if label else set(), label in PERMISSIVE))
    return stack[0]


def scan(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, str, float, bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, expression, score, permissive of one text."""
    plain = (text or b"").lower().translate(_WORD_BYTES)
    found = plain.split()
    line = b" " + b" ".join(found) + b" "
    hits = [(end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(line.decode("latin-1"))]
    base = sorted(at for at, phrase in hits if phrase in BASE)
    base_labels = {BASE[p] for _, p in hits if p in BASE}
    labels = base_labels | {NOTICES[p] for _, p in hits if p in NOTICES}
    expressions, permissive = [], None
    spaces = None
    if any(p == TAG for _, p in hits):
        # a phrase's place among the words is its tag's place in the text, if the text has the tag's own marks there
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        letters = np.frombuffer(b" " + plain, np.uint8) != 32
        starts = np.flatnonzero(letters[1:] & ~letters[:-1])
        words = np.searchsorted(spaces, sorted(at for at, p in hits if p == TAG))
        tags = [m for m in (_TAG.match(text, int(starts[w])) for w in words) if m]
        # an expression ends before the next tag and the line's end
        for tag, stop in zip(tags, [*(t.start() for t in tags[1:]), len(text)]):
            said = text[tag.end() : stop].decode("utf-8", "replace")
            line_end = _LINE_END.search(said)
            run = leading(said, 0, line_end.start() if line_end else len(said))
            if run is not None:
                value = _value(postfix(run[0]))
                labels |= value[0]
                expressions.append(said[run[1] : run[2]])
                permissive = value[1] and permissive is not False
    ends: tuple[int | None, int | None] = (None, None)
    if base:
        # the number of a word is that of the spaces before it
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if spaces is None else spaces
        ends = tuple(int(np.searchsorted(spaces, at)) for at in (base[0], base[-1]))
    score = 1.0 if base or expressions else 0.5 if labels else 0.0
    return len(found), len(base), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), "; ".join(expressions), score, permissive


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expression string, score double, permissive boolean"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())


def _scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = list(map(scan, texts_as_bytes(batch.column(1))))
    cols = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], ["doc_id", *(x.split()[0] for x in _SCHEMA.split(", "))])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id as doc_id, and what scan() finds in its whole text.

    expression has each tag's expression as it stands, with "; " between them; permissive is null
    without a tag that has one, and else whether all of them are. Null and empty texts have no words and no labels;
    repeated rows and null ids are scanned like any other, each by its own text, so equal texts have equal results. An
    empty table gives an empty table. Other columns of df are not read.
    """
    return arrow_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _scan_batch, f"doc_id long, {_SCHEMA}")


def op5_licenses(documents: DataFrame) -> DataFrame:
    """The contract's columns for all documents, then expression and permissive."""
    return scan_licenses(documents)


#: Identifiers of the expressions that op5_expressions writes; the last two are in no family.
WRITTEN = ("MIT", "GPL-3.0-only", "Apache-2.0", "LGPL-2.1+", "BSD-3-Clause", "AGPL-3.0", "ISC", "MPL-2.0", "Proprietary", "LicenseRef-own")
#: Shapes of these expressions; a, b and c are operands, p and q operators.
SHAPES = ("{a} {p} {b} {q} {c}", "({a} {p} {b}) {q} {c}", "{a} {p} ({b} {q} {c})", "(({a}) {p} {b} with Classpath-exception-2.0) {q} {c}", "{a} {p} ({b} {q} {c}) and or")


def op5_expressions(documents: DataFrame) -> DataFrame:
    """Licence expressions made from each document's id and length, as a tag in its own text: what they evaluate to."""
    n = F.coalesce(F.col("doc_id"), F.lit(0)) * 31 + F.coalesce(F.length("text"), F.lit(0))
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in WRITTEN]), (F.pmod(F.floor(n / k), F.lit(len(WRITTEN))) + 1).cast("int"))
    word = lambda k: F.element_at(F.array(F.lit("AND"), F.lit("or")), (F.pmod(F.floor(n / k), F.lit(2)) + 1).cast("int"))
    made = {"a": name(1), "b": name(7), "c": name(41), "p": word(3), "q": word(5)}
    shapes = [F.concat(*[made[x[1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w\})", shape) if x]) for shape in SHAPES]
    said = F.element_at(F.array(*shapes), (F.pmod(n, F.lit(len(SHAPES))) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n// spdx-License-Identifier: "), said, F.lit(" */\n"))
    return scan_licenses(documents.select("doc_id", text.alias("text"))).select("doc_id", "expression", "permissive", F.col("labels"))


def op5_expressions_sql() -> str:
    """The truth of each shape by hand: AND binds closer than OR, and WITH keeps its licence's side. BSD-3-Clause is also
    a phrase of notices."""
    names = ", ".join(f"'{x}'" for x in WRITTEN)
    families = " ".join(f"WHEN '{x}' THEN '{LABEL_OF[x.lower().rstrip('+')]}'" for x in WRITTEN if x.lower().rstrip("+") in LABEL_OF)
    free = ", ".join(f"'{x}'" for x in WRITTEN if LABEL_OF.get(x.lower().rstrip("+")) in PERMISSIVE)
    item = lambda k: f"([{names}])[((n // {k}) % {len(WRITTEN)} + 1)::INT]"
    word = lambda k: f"(['AND', 'or'])[((n // {k}) % 2 + 1)::INT]"
    label = lambda x: f"CASE {x} {families} END"
    return f"""
    WITH base AS (SELECT doc_id, labels AS own, base_labels FROM ({op5_sql()})),
    m AS (SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, 0) * 31 + coalesce(length(text), 0) AS n FROM documents),
    e AS (SELECT *, {item(1)} AS a, {item(7)} AS b, {item(41)} AS c, {word(3)} AS p, {word(5)} AS q, n % {len(SHAPES)} AS shape FROM m),
    t AS (SELECT *, a IN ({free}) AS ta, b IN ({free}) AS tb, c IN ({free}) AS tc FROM e),
    v AS (
      SELECT *, CASE WHEN p = 'AND' THEN ta AND tb ELSE ta OR tb END AS ab, CASE WHEN q = 'AND' THEN tb AND tc ELSE tb OR tc END AS bc FROM t),
    w AS (
      SELECT *, CASE WHEN shape IN (1, 3) OR (shape = 0 AND NOT (p = 'or' AND q = 'AND')) THEN CASE WHEN q = 'AND' THEN ab AND tc ELSE ab OR tc END
          ELSE CASE WHEN p = 'AND' THEN ta AND bc ELSE ta OR bc END END AS permissive,
        CASE shape WHEN 0 THEN concat_ws(' ', a, p, b, q, c) WHEN 1 THEN concat_ws(' ', '(' || a, p, b || ')', q, c) WHEN 3 THEN concat_ws(' ', '((' || a || ')', p, b, 'with Classpath-exception-2.0)', q, c)
          ELSE concat_ws(' ', a, p, '(' || b, q, c || ')') END AS expression
      FROM v)
    SELECT w.doc_id, expression, permissive, array_to_string(list_sort(list_distinct(list_filter([{label('a')}, {label('b')}, {label('c')}, CASE WHEN 'BSD-3-Clause' IN (a, b, c) THEN 'bsd-3-clause' END] || string_split(own, ','), lambda x: x IS NOT NULL AND x <> ''))), ',') AS labels
    FROM w JOIN base ON base.doc_id = w.doc_id
    """


def op5_sql() -> str:
    """Phrases by position, and the longest leading run of tokens after each tag that is an expression, token by token."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}', {str(p in BASE).lower()})" for p, label in (BASE | NOTICES).items())
    families = ", ".join(f"('{name}', '{label}')" for name, label in LABEL_OF.items())
    free = ", ".join(f"'{name}'" for name, label in LABEL_OF.items() if label in PERMISSIVE)
    mark, other = r"spdx-license-identifier[ \t]*:", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"  # a tag begins a word
    return rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all({low}, '{word}') AS w FROM documents),
    phrase(said, k, label, base) AS (VALUES {phrases}),
    hits AS (
      SELECT id, pos - 1 AS pos, label, base FROM (SELECT id, w, said, k, label, base, unnest(range(1, len(w) - k + 2)) AS pos FROM d, phrase WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || said || ' '))
      WHERE array_to_string(w[pos : pos + k - 1], ' ') = said),
    p AS (
      SELECT id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels
      FROM hits GROUP BY id),
    piece AS (
      SELECT id, unnest(parts[2:]) AS said, unnest(range(2, len(parts) + 1)) AS no
      FROM (SELECT id, string_split_regex(regexp_replace(regexp_replace(text, '(?i):(spdx-license-identifier)', ': \1', 'g'), '(?i)(^|{other})({mark})', '\1 \2', 'g'), '(?i)(?:^|{other}){mark}') AS parts FROM d WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' {TAG} '))),
    tokens AS (SELECT id, no, said, regexp_extract_all(regexp_extract(said, '^[^\r\n]*'), '[()]|[A-Za-z0-9.+-]+') AS t FROM piece),
    walk AS (
      SELECT id, no, said, t, 0 AS i, 0 AS depth, TRUE AS operand, 0 AS whole, TRUE AS going FROM tokens
      UNION ALL
      SELECT id, no, said, t, i + 1, depth + CASE WHEN NOT ok THEN 0 WHEN x = '(' THEN 1 WHEN x = ')' THEN -1 ELSE 0 END, after,
        CASE WHEN ok AND NOT after AND depth + CASE WHEN x = '(' THEN 1 WHEN x = ')' THEN -1 ELSE 0 END = 0 THEN i + 1 ELSE whole END, ok
      FROM (SELECT *, CASE WHEN x = ')' THEN NOT operand AND depth > 0 WHEN lower(x) IN ('and', 'or', 'with') THEN NOT operand ELSE operand END AS ok, x = '(' OR lower(x) IN ('and', 'or', 'with') AS after
        FROM (SELECT *, t[i + 1] AS x FROM walk WHERE going AND i < len(t)))),
    runs AS (SELECT id, no, any_value(said) AS said, any_value(t) AS t, max(whole) AS whole FROM walk GROUP BY id, no HAVING max(whole) > 0),
    used AS (SELECT id, unnest(t[1:whole]) AS x, unnest(list_prepend('', t[1:whole - 1])) AS before FROM runs),
    family(name, label) AS (VALUES {families}),
    named AS (
      SELECT DISTINCT id, label FROM hits
      UNION SELECT id, label FROM used JOIN family ON rtrim(lower(x), '+') = name WHERE lower(before) <> 'with'),
    l AS (SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY id),
    -- truth by rewriting: WITH first, then AND, then brackets around one value, then OR, until one letter is left
    truth AS (
      SELECT id, no, 0 AS step, array_to_string(list_transform(t[1:whole], lambda x: CASE lower(x) WHEN 'and' THEN 'A' WHEN 'or' THEN 'O' WHEN 'with' THEN 'W' WHEN '(' THEN '(' WHEN ')' THEN ')'
        ELSE CASE WHEN rtrim(lower(x), '+') IN ({free}) THEN 'T' ELSE 'F' END END), '') AS e FROM runs
      UNION ALL
      SELECT id, no, step + 1, CASE WHEN regexp_matches(e, '[TF]W[TF]') THEN regexp_replace(e, '([TF])W[TF]', '\1') WHEN regexp_matches(e, '[TF]A[TF]') THEN
          CASE WHEN regexp_matches(regexp_extract(e, '[TF]A[TF]'), 'F') THEN regexp_replace(e, '[TF]A[TF]', 'F') ELSE regexp_replace(e, '[TF]A[TF]', 'T') END
        WHEN regexp_matches(e, '\([TF]\)') THEN regexp_replace(e, '\(([TF])\)', '\1')
        WHEN regexp_matches(e, '(^|\(|O)FOF($|\)|O)') THEN regexp_replace(e, '(^|\(|O)FOF($|\)|O)', '\1F\2') ELSE regexp_replace(e, '(^|\(|O)[TF]O[TF]($|\)|O)', '\1T\2') END
      FROM truth WHERE length(e) > 1),
    said AS (
      SELECT r.id, string_agg(regexp_replace(regexp_extract(said, '([^()A-Za-z0-9.+-]*([()]|[A-Za-z0-9.+-]+)){{' || whole || '}}'), '^[^()A-Za-z0-9.+-]+', ''), '; ' ORDER BY r.no) AS expression, bool_and(e = 'T') AS permissive
      FROM runs r JOIN (SELECT id, no, e FROM truth WHERE length(e) = 1) USING (id, no) GROUP BY r.id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CASE WHEN coalesce(n_base, 0) > 0 OR id IN (SELECT id FROM runs) THEN 1e0 WHEN labels IS NOT NULL THEN 0.5e0 ELSE 0e0 END AS score,
      coalesce(expression, '') AS expression, permissive
    FROM d LEFT JOIN p USING (id) LEFT JOIN l USING (id) LEFT JOIN said USING (id)
    """
