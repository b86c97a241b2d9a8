"""Language ID of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts, for each language, hashed byte trigrams of words and the scripts of words, over labelled texts: a
sample of about SAMPLE texts of each language, chosen by a hash of doc_id, so its size is bounded whatever the table's.
Executors send one count for each (language, feature), a number fixed by the languages and FEATURES.

Prediction reads the text alone. A word's script is told from its code points, and languages that were not seen in that
script are out for that word. Each word has a log-likelihood for each language; Viterbi finds the labelling of the
words with the best sum less PENALTY for each switch, and runs of equal labels are the spans. Where no stretch of
words favours any language over the best single one by more than half the penalty, no labelling with switches can win:
k runs need k - 1 switches, which is at least k / 2. Where none does by more than two thirds of it, only two runs over
the whole text could, and the best two are looked up. The single one is then taken without the walk; this is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import arrow_pass, texts_as_bytes

#: Labelled texts for each language that training reads, about.
SAMPLE = 2000
FEATURES = 1 << 13
PENALTY = 12.0
SMOOTHING = 0.5
#: Most languages of a model; more is an error.
MAX_LANGS = 1000
#: A language is a candidate for a script that at least this share of its training words has.
SCRIPT_SHARE = 0.002
FOLDS = 5
UNKNOWN = "und"

_GAP = bytes(32 if c < 0x80 and not (chr(c).isalpha() or chr(c) in "'") else c for c in range(256))
#: A letter: Unicode's category L, which numerals and marks are not of.
_LETTER = regex.compile(r"\p{L}")


#: Fixed values: (first code point, script) of Unicode's ranges; a range ends where the next begins. 0 says nothing:
#: digits, punctuation, symbols and marks. 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Indic,
#: 8 Thai, 9 Georgian, 10 Hangul, 11 Kana, 12 Han, 13 other.
RANGES = (
    (0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0),
    (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 13), (0x750, 6), (0x780, 13), (0x8A0, 6), (0x900, 7), (0xE00, 8), (0xE80, 13), (0x10A0, 9), (0x1100, 10), (0x1200, 13),
    (0x1C80, 3), (0x1C90, 9), (0x1CC0, 13), (0x1D00, 1), (0x1DC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 13), (0x2C60, 1), (0x2C80, 13), (0x2DE0, 3), (0x2E00, 0),
    (0x2E80, 12), (0x2FF0, 0), (0x3005, 12), (0x3008, 0), (0x3040, 11), (0x3100, 12), (0x3130, 10), (0x3190, 12), (0x31F0, 11), (0x3200, 0), (0x3400, 12), (0xA000, 13), (0xA640, 3), (0xA6A0, 13),
    (0xA720, 1), (0xA800, 13), (0xA960, 10), (0xA980, 13), (0xAB30, 1), (0xAB70, 13), (0xAC00, 10), (0xD800, 0), (0xF900, 12), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 11), (0xFFA0, 10), (0xFFE0, 0), (0x10000, 13), (0x1F000, 0), (0x20000, 12), (0x32000, 0),
)
N_SCRIPTS = 14


def _script_table() -> np.ndarray:
    """Script of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for (low, script), (high, _) in zip(RANGES, [*RANGES[1:], (0x110000, 0)]):
        table[low:high] = script
    return table


_SCRIPTS = _script_table()


def _scripts(b: np.ndarray) -> np.ndarray:
    """Script of the code point that begins at each byte of UTF-8; 0 at the bytes that continue one."""
    if b.max(initial=0) < 0x80:
        return _SCRIPTS[b]
    out = _SCRIPTS[np.where(b < 0x80, b, 0)]
    lead = np.flatnonzero(b >= 0xC2)  # the other bytes of a code point say nothing
    c = np.r_[b, np.zeros(3, b.dtype)]
    first, one, two, three = b[lead], c[lead + 1] & 0x3F, c[lead + 2] & 0x3F, c[lead + 3] & 0x3F
    long = ((first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three)
    points = np.where(first < 0xE0, (first & 0x1F) << 6 | one, np.where(first < 0xF0, *long))
    out[lead] = _SCRIPTS[np.minimum(points, 0x10FFFF)]
    return out


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram features, first feature of each word, script of each word); words are runs of letters."""
    raw = b" " + b" ".join(text.lower().translate(_GAP).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * 40503 >> 4) & (FEATURES - 1)
    starts = np.flatnonzero(b[:-1] == 32)  # the trigram that begins with a word's blank is its first
    starts = starts[starts < len(grams)]
    scripts = np.maximum.reduceat(_scripts(b)[: len(grams) + 1], starts).astype(np.int64) if len(starts) else np.empty(0, np.int64)
    return grams, starts, scripts


@dataclass(frozen=True)
class Model:
    """Languages in order, log-probability of each feature, and which languages each script leaves."""

    langs: tuple[str, ...]
    logp: np.ndarray
    allowed: np.ndarray
    prior: int

    def scores(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages scores, characters of each word)."""
        grams, starts, scripts = features(text)
        if not len(starts):
            return np.empty((0, len(self.langs))), np.empty(0)
        lengths = np.diff(np.r_[starts, len(grams)])
        out = np.add.reduceat(self.logp[grams], starts, axis=0)
        open_to = self.allowed[scripts]
        out = np.where(open_to, out, out.min(axis=1, keepdims=True) - 8.0 * lengths[:, None])
        out[~open_to.any(axis=1)] = 0.0  # no language is known in this script
        return out, lengths

    def labels(self, scores: np.ndarray) -> np.ndarray:
        """The best labelling of the words."""
        total = scores.sum(axis=0)
        best = int(total.argmax())
        gain = np.cumsum(np.vstack([np.zeros(len(self.langs)), scores - scores[:, best : best + 1]]), axis=0)
        most = (gain - np.minimum.accumulate(gain, axis=0)).max()
        if most <= PENALTY / 2 or (most <= PENALTY * 2 / 3 and (gain.max(axis=1) + (gain[-1] - gain).max(axis=1)).max() <= PENALTY):
            return np.full(len(scores), best)
        # few languages: plain lists are faster than arrays here
        rows = scores.tolist()
        at = rows[0]
        held = [at]
        for row in rows[1:]:
            low = max(at) - PENALTY
            at = [(a if a >= low else low) + s for a, s in zip(at, row)]
            held.append(at)
        out = np.empty(len(rows), np.int64)
        out[-1] = now = at.index(max(at))
        for i in range(len(rows) - 1, 0, -1):
            before = held[i - 1]
            top = max(before)
            if before[now] < top - PENALTY:
                now = before.index(top)
            out[i - 1] = now
        return out

    def predict(self, text: bytes | None) -> tuple[str, float, int]:
        """(language with the most characters, its share of them, number of spans)."""
        if not text or not self.langs or not _LETTER.search(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, 0
        scores, lengths = self.scores(text)
        if not len(scores):
            return self.langs[self.prior], 0.0, 0
        labels = self.labels(scores)
        held = np.bincount(labels, weights=lengths, minlength=len(self.langs))
        best = int(held.argmax())
        return self.langs[best], float(held[best] / held.sum()), int(1 + np.count_nonzero(np.diff(labels)))

    def spans(self, text: bytes | None) -> list[tuple[str, int, int]]:
        """(language, first word, end word) of each run of equal labels."""
        if not text or not self.langs:
            return []
        scores, _ = self.scores(text)
        if not len(scores):
            return []
        labels = self.labels(scores)
        cuts = np.r_[0, np.flatnonzero(np.diff(labels)) + 1, len(labels)]
        return [(self.langs[labels[a]], int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo FOLDS; 0, the held-out one, is null's too."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS, F.lit(0))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows of folds other than 0 with a language and a text. No such rows: a model of no languages."""
    rows = df.filter((fold(F.col(id_col)) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MAX_LANGS + 1).collect()}  # one row for each language
    if not counts:
        return Model((), np.zeros((FEATURES, 0)), np.zeros((N_SCRIPTS, 0), bool), 0)
    langs = sorted(counts)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; a model is given to every task and holds {FEATURES} numbers for each, for at most {MAX_LANGS}")
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(2**31, 2**31 * sample // counts[lang]))])[F.col(lang_col)]
    chosen = rows.filter(F.crc32(F.encode(F.concat(F.col(id_col).cast("string"), F.lit("sample")), "UTF-8")) % 2**31 < share)
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.zeros((len(langs), FEATURES + N_SCRIPTS), np.int64)
        for lang, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
            grams, _, scripts = features(text)
            table[index[lang], :FEATURES] += np.bincount(grams, minlength=FEATURES)
            table[index[lang], FEATURES:] += np.bincount(scripts, minlength=N_SCRIPTS)
        where = np.nonzero(table)
        return pa.RecordBatch.from_arrays([pa.array(where[0]), pa.array(where[1]), pa.array(table[where])], ["lang", "feature", "n"])

    counted = arrow_pass(chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), count, "lang long, feature long, n long")
    table = np.zeros((len(langs), FEATURES + N_SCRIPTS))
    for lang, feature, n in counted.groupBy("lang", "feature").agg(F.sum("n")).collect():  # at most languages x features rows
        table[lang, feature] = n
    grams = table[:, :FEATURES] + SMOOTHING
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T
    scripts = table[:, FEATURES:]
    allowed = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE).T
    allowed[0] = True  # a script that says nothing rules nothing out
    return Model(tuple(langs), np.ascontiguousarray(logp), allowed, int(np.argmax([counts[x] for x in langs])))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of every row; `und` for a null text and one without a letter.

    Repeated rows and rows without an id are predicted each by its text alone; equal texts get equal predictions. Of
    languages that score the same, the first by name wins. An empty table gives an empty table, and a model of no
    languages gives `und`. Other columns of df are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers for each of MAX_LANGS languages at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(shared.value.predict, texts_as_bytes(batch.column(1))))) or [()] * 3
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    return arrow_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double, n_spans long")


def op6_language(documents: DataFrame) -> DataFrame:
    """Predictions for all documents by a model of the folds other than 0."""
    found = identify(documents, train(documents))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "n_spans")
