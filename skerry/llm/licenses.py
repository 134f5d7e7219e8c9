"""Licence scans: fuzzy search for short notices by pigeonhole seeds.

Texts are reduced to lower-cased words joined by single spaces. A notice that
may differ in ``e`` edits is split into e + 1 pieces: whatever the edits, one
piece stands there exactly. One Aho-Corasick pass finds the pieces; around
each hit the regex library's bounded-error matching verifies the notice and
gives its span and edits. Beside these, phrases are counted exactly where
their words stand one after another.

Rows: a null text counts as empty. Repeated rows get equal results. Of
notices at overlapping spans the one with the fewest edits counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skerry.llm.textops import LOWER, append, column_bytes, find_words

#: A word is a run of digits, a-z (after lower-casing A-Z) and bytes beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Phrases that are counted exactly, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under the eclipse public license": "epl",
    "licensed under the boost software license version 1 0": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def edits_allowed(notice: str) -> int:
    """One edit for each twelve characters: pieces keep nine or more."""
    return max(1, len(notice) // 12)


class Scanner:
    def __init__(self, notices: dict[str, str]):
        import ahocorasick
        import regex

        self.notices = [(n, label, edits_allowed(n)) for n, label in notices.items()]
        self.exact = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={e}}}") for n, _, e in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, e) in enumerate(self.notices):
            edge = [len(n) * k // (e + 1) for k in range(e + 2)]
            for a, b in zip(edge, edge[1:]):
                seeds.setdefault(n[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, edits, start, end) of each notice; of overlapping ones the one with the fewest edits."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, a in places:
                n, _, e = self.notices[i]
                at = end - size + 1 - a
                w = [max(0, at - 2 * e), min(len(text), at + len(n) + 2 * e)]
                have = windows.setdefault(i, [])
                if have and w[0] <= have[-1][1]:
                    have[-1] = [min(have[-1][0], w[0]), max(have[-1][1], w[1])]
                else:
                    have.append(w)
        found = []
        for i, spans in windows.items():
            while spans:
                a, b = spans.pop()
                if m := self.exact[i].search(text, a, b):  # the best of the window; others stand before and behind it
                    found.append((i, sum(m.fuzzy_counts), m.start(), m.end()))
                    spans += [[a, m.start()], [m.end(), b]]
        kept: list[tuple[int, int, int, int]] = []
        for f in sorted(found, key=lambda f: (f[1], f[2] - f[3], f[0], f[2])):
            if not any(f[2] < k[3] and k[2] < f[3] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[2:])


@lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(notices))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word (of exact phrases), base_labels, labels, score
    (1 for an exact find, less by its edits for a fuzzy one) and spans (label, edits, words first to last)."""
    fixed, exact = tuple((notices or NOTICES).items()), dict(phrases or PHRASES)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scanner = _scanner(fixed)
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
        data = LOWER[data]
        starts, ends, first = find_words(data, offsets, WORD)
        inside = WORD[data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        shift = np.cumsum(~keep, dtype=np.int32)
        text = np.where(inside, data, np.uint8(32))[keep].tobytes().decode("latin-1")
        starts, ends = starts - shift[starts], ends - shift[ends - 1]
        n = len(offsets) - 1
        base: list[list[int]] = [[] for _ in range(n)]
        base_labels: list[set] = [set() for _ in range(n)]
        # words of a phrase one after another: the phrase in the text of single spaces, at word borders
        for phrase, label in exact.items():
            i = text.find(phrase)
            while i >= 0:
                w = int(np.searchsorted(starts, i))
                last = w + phrase.count(" ")
                if w < len(starts) and starts[w] == i and last < len(ends) and ends[last] == i + len(phrase):
                    d = int(np.searchsorted(first, w, "right")) - 1
                    if last < first[d + 1]:
                        base[d].append(w - int(first[d]))
                        base_labels[d].add(label)
                i = text.find(phrase, i + 1)
        labels, scores, spans = [], [], []
        for d in range(n):
            own, best, where = set(base_labels[d]), 1.0 if base[d] else 0.0, []
            a, b = int(first[d]), int(first[d + 1])
            at = int(starts[a]) if b > a else 0
            for i, edits, lo, hi in scanner(text[at : ends[b - 1]]) if b > a else ():
                notice, label, _ = scanner.notices[i]
                own.add(label)
                best = max(best, 1 - edits / len(notice))
                where.append({"label": label, "edits": edits, "first": int(np.searchsorted(ends, at + lo, "right")) - a, "last": int(np.searchsorted(starts, at + hi)) - 1 - a})
            labels.append(",".join(sorted(own)))
            scores.append(best)
            spans.append(where)
        kind = pa.list_(pa.struct([("label", pa.string()), ("edits", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
        return [
            pa.array(np.diff(first), pa.int64()), pa.array([len(x) for x in base], pa.int64()),
            pa.array([min(x) if x else None for x in base], pa.int64()), pa.array([max(x) if x else None for x in base], pa.int64()),
            pa.array([",".join(sorted(x)) for x in base_labels]), pa.array(labels), pa.array(scores, pa.float64()), pa.array(spans, kind),
        ]

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,edits:int,first:long,last:long>>"
    return append(docs, fields, run)
