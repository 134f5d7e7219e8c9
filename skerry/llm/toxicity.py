"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, full-width and look-alike letters, digits and
signs that stand for letters, invisible characters. The lexicon holds word
stems, with a log-odds weight each, learned from labelled documents, beside a
short fixed list. One automaton finds stems and exception phrases in one pass
over the folded text; a stem inside an exception phrase doesn't count. The
summed weight is normalised by the length of the text.

Rows: null text counts as empty (score 0). Texts of any length are scored whole.
Repeated rows get equal scores. A label that is null, or whose document is
absent, teaches nothing. Without labels only the fixed list is used. An empty
table gives an empty one; columns named as results are replaced, and reject()
leaves all columns as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.textops import append, bounded, cut, nested, restored, slices, tidy

#: Letters that look like Latin ones, and signs read as letters inside words.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "ε": "e", "η": "n",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits read as letters, signs read as letters before a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Stems that need no labels, and phrases in which a stem is harmless.
STEMS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "loser", "imbecile", "dumbass")
EXCEPTIONS = ("not stupid", "no idiot", "not an idiot", "stupid question", "idiot proof", "foolproof", "trash can", "trash bin", "clown fish", "sore loser", "pond scum")

INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD = INVISIBLE | {ord(k): v for k, v in LOOK_ALIKES.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)} | {ord(k): v for k, v in DIGITS.items()}
_ASCII_FOLD = {k: v for k, v in _FOLD.items() if k < 128}
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words joined by single spaces, with a space at both ends."""
    text = text.lower()
    text = text.translate(_ASCII_FOLD if text.isascii() else _FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """weights: stem to weight. scale: the evidence at which a short text scores 0.5."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: float = 3.0
    words: float = 500.0
    seeds: tuple[str, ...] = field(default=STEMS)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for stem, w in self.weights.items():
            a.add_word(f" {fold(stem).strip()}", (len(fold(stem).strip()) + 1, w))
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (len(fold(phrase)), 0.0))
        a.make_automaton()
        return a

    def score(self, text: str, automaton) -> tuple[int, int, float]:
        """Words, counted stems, score between 0 and 1."""
        folded = fold(text)
        n = folded.count(" ") - 1 if len(folded) > 2 else 0
        hits, spared = [], []
        for end, (size, w) in automaton.iter(folded):
            if w:
                hits.append((end - size + 1, end, w))
            else:
                spared.append((end - size + 1, end))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        best: dict[int, float] = {}  # one word counts once, with its heaviest stem
        for start, _, w in hits:
            best[start] = max(w, best.get(start, 0.0))
        evidence = sum(best.values())
        return n, len(best), evidence / (evidence + self.scale * math.sqrt(1 + n / self.words)) if evidence else 0.0


def held_out(doc_id: str = "doc_id"):
    """True for rows whose label may not be used: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches):
    for batch in batches:
        counts: Counter = Counter()
        for part in slices(batch):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                terms = {w[:k] for w in set(fold(text or "").split()) for k in range(4, min(len(w), 9) + 1)}
                counts.update((t, toxic) for t in terms)
                counts["", toxic] += 1
        terms = sorted({t for t, _ in counts})
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[t, 1] for t in terms], pa.int64()), pa.array([counts[t, 0] for t in terms], pa.int64())], ["term", "bad", "good"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Lexicon:
    """Learn a lexicon from labelled documents.

    sample: how many labelled rows are used at most, the bound of the fit: those with the smallest hash of
    doc_id. A stem must be toxic four times in five, and its log-likelihood ratio must be beyond what the best
    of as many random stems would reach. Rows that held_out() marks are never used; documents with both labels
    teach nothing.
    """
    bounded(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").alias("id_"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("id_").isNotNull() & ~held_out("id_"))
        .groupBy("id_").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
        .orderBy(F.xxhash64("id_"), "id_").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id_")).select("text", "toxic")
    counts = rows.mapInArrow(tidy(_features), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = cut(counts.where("bad >= 3 or term = ''"))
    total = counts.where("term = ''").select("bad", "good").first()
    weights = dict.fromkeys(STEMS, 4.0)
    if total is None or not total[0] or not total[1]:
        return Lexicon(weights)
    bad, good = map(float, total)
    # the log-likelihood ratio of presence against label, all cells smoothed by a half
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    c, d = F.lit(bad + 1) - a, F.lit(good + 1) - b
    n = bad + good + 2
    part = lambda x, row, col: x * F.log(x * n / (row * col))
    g2 = 2 * (part(a, a + b, bad + 1) + part(b, a + b, good + 1) + part(c, c + d, bad + 1) + part(d, c + d, good + 1))
    seen = counts.where("term != ''").select("term", "bad", g2.alias("g2"), F.log(a / b).alias("odds"))
    tried = seen.count()
    found = seen.where((F.col("g2") >= 2 * math.log(max(tried, 1)) + 3) & (F.col("odds") >= math.log(4)))
    rows = found.orderBy(F.desc("g2"), "term").collect()  # as many as the sample supports
    # of stems found in the same documents the longest
    support = {r["term"]: r["bad"] for r in rows}
    shadowed = {t[:k] for t in support for k in range(4, len(t)) if support.get(t[:k], 0) and support[t] >= 0.95 * support[t[:k]]}
    top = {r["term"]: r["odds"] for r in rows if r["term"] not in shadowed}
    for term in sorted(top, key=len):  # a longer stem adds nothing to one of its beginnings that is as telling
        if not any(term[:k] in weights and weights[term[:k]] >= top[term] - 0.7 for k in range(4, len(term))):
            weights[term] = max(weights.get(term, 0.0), top[term])
    return Lexicon(weights)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with n_words, n_hits and toxicity (0 to 1)."""
    state: dict = {}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        a = state.setdefault("automaton", None) or state.update(automaton=lexicon.automaton()) or state["automaton"]
        rows = [lexicon.score(t or "", a) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        n, hits, scores = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64())]

    return append(docs, "n_words long, n_hits long, toxicity double", run)


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    return restored(score(nested(docs), lexicon).where(F.col("toxicity") < threshold), docs.columns)
