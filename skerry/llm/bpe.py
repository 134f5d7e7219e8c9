"""Byte-pair encoding and decoding, exact for byte-level vocabularies.

Two encoders give the ids of the vocabulary's own tokeniser:

* PrefixEncoder, by dynamic programming over prefixes. For every prefix of a
  pre-token the last token of its encoding is unique. The tokens that end at a
  place are found with a suffix automaton over the vocabulary, longest first;
  the first one that is compatible with the last token of the prefix before it
  is stored, and the ids are read off by following the stored lengths back.
* MergeEncoder, which applies merges to many pre-tokens at once, for operators
  that only need ids.

Texts are first split into runs that the pre-tokeniser can't look across, by
byte-level lookup tables; each distinct run is encoded once a slice.

Null texts count as empty and have no ids. Special tokens in a text are cut
out first, as the tokeniser does by default.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from skerry.llm.textops import KEPT, hash_spans, ragged

#: Fixed value: the pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_split = regex.compile(PATTERN)
#: Bytes beyond which a pre-token is encoded by itself; what fills rows of ids.
LONG, PAD = 48, 0xFFFF


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level tokenizers file: bytes of each id, the pair each was merged from, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.uint32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.pairs: list[tuple[int, int, int]] = []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        if any(y[2] <= x[2] for x, y in zip(self.pairs, self.pairs[1:])):  # both encoders compare ids instead of ranks
            raise ValueError("ids must be in the order of merges")
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixEncoder:
    """Encodes one pre-token at a time: the last token of every prefix, then back-pointers."""

    def __init__(self, vocab: Vocabulary, memo: int = 400_000):
        import ahocorasick

        self.vocab, self.memo = vocab, memo
        special = set(vocab.special.values())
        index = {b: i for i, b in enumerate(vocab.bytes) if b and i not in special}
        self.length = [len(b) for b in vocab.bytes]
        self.joined = {(a, b): c for a, b, c in vocab.pairs}
        self.left, self.right = list(range(len(vocab.bytes))), list(range(len(vocab.bytes)))
        for a, b, c in vocab.pairs:
            self.left[c], self.right[c] = a, b
        # the suffix automaton: tokens as latin-1 strings; of each token the longest proper suffix that is a token
        self.automaton = ahocorasick.Automaton()
        for b, i in index.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.suffix = [-1] * len(vocab.bytes)
        for b, i in index.items():
            for k in range(1, len(b)):
                if b[k:] in index:
                    self.suffix[i] = index[b[k:]]
                    break
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _pair_holds(self, a: int, b: int) -> bool:
        """Whether merging would leave a and b side by side: undo merges at the border, newest first, and see
        that no merge across it would have come earlier."""
        joined, left, right = self.joined, self.left, self.right
        bound = 1 << 62
        while True:
            c = joined.get((a, b))
            if c is not None and c < bound:
                return False
            if a > b:
                bound, a = a, right[a]
                if a == bound:  # a single byte
                    bound, b0 = b + 1, b
                    b = left[b]
                    if b == b0:
                        return True
            else:
                bound, b0 = b + 1, b
                b = left[b]
                if b == b0:
                    bound, a0 = a, a
                    a = right[a]
                    if a == a0:
                        return True

    def __call__(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is not None:
            return found
        n, length, suffix, holds = len(word), self.length, self.suffix, self.compatible
        longest = [-1] * n
        for end, i in self.automaton.iter(word.decode("latin-1")):
            if longest[end] < 0 or length[i] > length[longest[end]]:
                longest[end] = i
        last = [0] * n
        for end in range(n):
            t = longest[end]
            while True:
                before = end - length[t]
                if before < 0:
                    break
                pair = (last[before], t)
                ok = holds.get(pair)
                if ok is None:
                    ok = holds[pair] = self._pair_holds(*pair)
                if ok:
                    break
                t = suffix[t]
            last[end] = t
        ids, end = [], n - 1
        while end >= 0:
            ids.append(last[end])
            end -= length[last[end]]
        out = tuple(reversed(ids))
        if len(holds) > self.memo:
            holds.clear()
        if n <= LONG:
            if len(self.known) > self.memo // 4:
                self.known.clear()
            self.known[word] = out
        return out

    def many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens at the given places of data, one after another, and how many each has."""
        raw = data.tobytes()
        ids = [self(raw[a : a + n]) if n else () for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


class MergeEncoder:
    """Encodes many pre-tokens at once: in each round every one makes its earliest merge, leftmost first.

    The work of a pre-token grows with the square of its length; those over LONG bytes go to PrefixEncoder,
    whose work grows with the length. Ids must be below PAD.
    """

    BITS = 20

    def __init__(self, vocab: Vocabulary):
        if len(vocab.bytes) > PAD:
            raise ValueError(f"MergeEncoder takes vocabularies of at most {PAD} ids")
        self.vocab, self.long = vocab, None
        a, b, c = (np.array(x, np.uint32) for x in zip(*vocab.pairs, strict=True))
        keys = a << np.uint32(16) | b
        size, rng = 1 << self.BITS, np.random.default_rng(5)
        while True:  # two tables: keys that clash in the first must not in the second
            self.factors = [np.uint32(int(x) | 1) for x in rng.integers(0, 2**32, 2)]
            at = self._slot(keys, 0)
            _, first = np.unique(at, return_index=True)
            rest = np.setdiff1d(np.arange(len(keys)), first)
            to = self._slot(keys[rest], 1)
            if len(np.unique(to)) == len(to):
                break
        self.keys, self.values = np.full((2, size), 0xFFFFFFFF, np.uint32), np.zeros((2, size), np.uint32)
        self.keys[0, at[first]], self.values[0, at[first]] = keys[first], c[first]
        self.keys[1, to], self.values[1, to] = keys[rest], c[rest]

    def _slot(self, keys: np.ndarray, table: int) -> np.ndarray:
        return (keys ^ keys >> np.uint32(15)) * self.factors[table] >> np.uint32(32 - self.BITS)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << np.uint32(16) | right
        out = np.full(keys.shape, 0xFFFFFFFF, np.uint32)
        for t in range(2):
            at = self._slot(keys, t)
            hit = self.keys[t][at] == keys
            out[hit] = self.values[t][at[hit]]
        return out

    def many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens at the given places of data, one after another, and how many each has."""
        none, pad = np.uint32(0xFFFFFFFF), np.uint32(PAD)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, how many ids each, the ids

        def store(rows: np.ndarray, ids: np.ndarray) -> None:
            real = ids != pad
            done.append((rows, real.sum(axis=1), ids[real]))

        long = np.flatnonzero(lengths > LONG)
        if len(long):
            self.long = self.long or PrefixEncoder(self.vocab)
            ids, n = self.long.many(data, starts[long], lengths[long])
            done.append((long, n, ids))
        for size in np.unique(lengths[(lengths > 0) & (lengths <= LONG)]).tolist():
            which = np.flatnonzero(lengths == size)
            step = max(1, (1 << 18) // size)
            for lo in range(0, len(which), step):
                rows = which[lo : lo + step]
                ids = self.vocab.of_byte[data[starts[rows][:, None] + np.arange(size)]]
                while ids.shape[1] > 1:
                    width = ids.shape[1]
                    to = self._merged(ids[:, :-1], ids[:, 1:])
                    to[ids[:, 1:] == pad] = none
                    at = to.argmin(axis=1)
                    best = to[np.arange(len(rows)), at]
                    idle = best == none
                    if idle.any():
                        store(rows[idle], ids[idle])
                        go = ~idle
                        rows, ids, at, best = rows[go], ids[go], at[go], best[go]
                        if not len(rows):
                            break
                    shifted = np.concatenate([ids[:, 1:], np.full((len(rows), 1), pad, np.uint32)], axis=1)
                    col = np.arange(width)
                    ids = np.where(col[None, :] <= at[:, None], ids, shifted)
                    ids[np.arange(len(rows)), at] = best
                    full = int((ids != pad).sum(axis=1).max())
                    ids = ids[:, :full]
                if len(rows):
                    store(rows, ids)
        counts = np.zeros(len(lengths), np.int64)
        for rows, n, _ in done:
            counts[rows] = n
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for rows, n, ids in done:
            out[ragged(begin[rows], n)] = ids
        return out, counts


def run_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs start that the pre-tokeniser can't look across: words with one space before them, and
    the white space between that it keeps apart. Only 0x20 and 0x09-0x0D count as white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin = begin[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = space[:-1]
    edge = begin | (space & ~before)  # documents, and runs of white space
    word = np.flatnonzero(~space & before & ~begin)
    edge[word - 1] = True
    edge[word[data[word - 1] != 32]] = True
    return np.flatnonzero(edge)


def _odd_documents(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Documents with white space beyond ASCII or special tokens, which take the slower way."""
    at = [np.zeros(0, np.int64)]
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        tail = np.append(np.flatnonzero(data[-2:-1] == 0xC2) + len(data) - 2, [])
        if len(tail) and data[-1] in (0x85, 0xA0):
            at.append(tail.astype(np.int64))
        two = np.flatnonzero(a == 0xC2)
        at.append(two[(b[two] == 0x85) | (b[two] == 0xA0)])
        three = np.flatnonzero((a >= 0xE1) & (a <= 0xE3))
        x, y, z = a[three], b[three], c[three]
        at.append(three[((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))])
    elif len(data) == 2 and data[0] == 0xC2 and data[1] in (0x85, 0xA0):
        at.append(np.zeros(1, np.int64))
    raw = None
    for token in special:
        if token[:1] and (data == token[0]).any():
            raw = raw if raw is not None else data.tobytes()
            i = raw.find(token)
            while i >= 0:
                at.append(np.array([i]))
                i = raw.find(token, i + 1)
    found = np.concatenate(at).astype(np.int64)
    return np.unique(np.searchsorted(offsets, found, "right") - 1) if len(found) else found


#: Classes of bytes in a run: white space, letters, digits, others; above OTHER what the pattern must see.
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[_SPACE] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[39] = HARD
_CLASS[128:] = HARD


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pre-tokens of runs: the runs' bytes together, starts and ends there, and the first one of each run.

    Where a run has ASCII (without apostrophes) and Latin-1 letters only, they are what lies between changes of
    class; others are given to the pattern.
    """
    sizes = ends - starts
    data = data[ragged(starts, sizes)]
    edge = np.cumsum(sizes) - sizes
    kind = _CLASS[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    first = np.empty(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[edge] = True
    led = edge[(data[edge] == 32) & (sizes > 1)]
    first[led + 1] = False
    hard = np.flatnonzero(np.maximum.reduceat(kind, edge) == HARD)
    if len(hard):
        first[ragged(edge[hard], sizes[hard])] = False
        first[edge[hard]] = True
        raw, more = data.tobytes(), []
        for a, n in zip(edge[hard].tolist(), sizes[hard].tolist(), strict=True):
            text = raw[a : a + n].decode()
            if not (text[1:] if text[0] == " " else text).isalpha():
                for p in _split.findall(text):
                    more.append(a)
                    a += len(p) if p.isascii() else len(p.encode())
        first[np.array(more, np.int64)] = True
    at = np.flatnonzero(first)
    return data, at, np.append(at[1:], len(data)), np.searchsorted(at, edge)


class TextEncoder:
    """Encodes the documents of a slice. many: encodes distinct pre-tokens; memo: runs whose ids are kept."""

    def __init__(self, vocab: Vocabulary, many: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], memo: int = 300_000):
        self.vocab, self.many, self.memo = vocab, many, memo
        # known runs by their sorted hashes: where their ids begin in flat, and how many they are
        self.hashes, self.begin, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of (not empty) runs, one after another, and how many each has."""
        data, at, end, head = pieces(data, starts, ends)
        _, one, which = np.unique(hash_spans(data, at, end), return_index=True, return_inverse=True)
        ids, n = self.many(data, at[one], (end - at)[one])
        begin, own = (np.cumsum(n) - n)[which], n[which]
        return ids[ragged(begin, own)], np.add.reduceat(own, head)

    def _slowly(self, text: str) -> np.ndarray:
        out = []
        for part in self.vocab.special_split.split(text) if self.vocab.special_split else [text]:
            if part in self.vocab.special:
                out.append(np.array([self.vocab.special[part]], np.uint32))
            elif part:
                words = [p.encode() for p in _split.findall(part)]
                n = np.array([len(w) for w in words])
                out.append(self.many(np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n, n)[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents one after another, and where each document's begin (n + 1 entries)."""
        odd = _odd_documents(data, offsets, [s.encode() for s in self.vocab.special])
        starts = run_edges(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        distinct, at, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        held = self.hashes[place] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        begin, count, flat = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64), self.flat
        begin[held], count[held] = self.begin[place[held]], self.count[place[held]]
        if not held.all():  # runs that need a document's context stand in odd documents only, which are done anew below
            fresh = np.flatnonzero(~held)
            ids, n = self._runs(data, starts[at[fresh]], ends[at[fresh]])
            begin[fresh], count[fresh] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate((flat, ids))
            self._remember(distinct, begin, count, flat, fresh)
        own = count[inverse]
        total = np.concatenate(([0], np.cumsum(own)))
        edges = total[np.searchsorted(starts, offsets)]
        out = flat[ragged(begin[inverse], own)]
        if len(odd):
            docs = [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for i in odd.tolist():
                docs[i] = self._slowly(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            out = np.concatenate(docs)
            edges = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        return out, edges

    def _remember(self, hashes: np.ndarray, begin: np.ndarray, count: np.ndarray, flat: np.ndarray, fresh: np.ndarray) -> None:
        """Adds the fresh ones among the runs of a slice; where that would be too many, only the slice's own stay."""
        if len(self.hashes) + len(fresh) > self.memo:
            own = ragged(begin, count)
            self.hashes, self.begin, self.count, self.flat = hashes, np.cumsum(count) - count, count, flat[own]
            return
        at = np.searchsorted(self.hashes, hashes[fresh])
        self.hashes, self.begin, self.count = (np.insert(a, at, b[fresh]) for a, b in ((self.hashes, hashes), (self.begin, begin), (self.count, count)))
        self.flat = flat


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> TextEncoder:
    """The encoder of a vocabulary file, one for each Python worker. kind: prefix or merge."""
    vocab = vocabulary(path)
    return TextEncoder(vocab, (PrefixEncoder if kind == "prefix" or len(vocab.bytes) > PAD else MergeEncoder)(vocab).many)


def forget() -> None:
    """Drops what this module keeps in a worker."""
    for f in (encoder, vocabulary, _decimals):
        f.cache_clear()


KEPT["bpe"] = forget


def tokenised(docs, path: str, kind: str = "prefix"):
    """docs with ids (array of int) and decoded (the text that the ids decode to)."""
    import pyarrow as pa

    from skerry.llm.textops import append, column_bytes

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        encode = encoder(path, kind)
        ids, edges = encode(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
        decoded = [encode.vocab.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())]

    return append(docs, "ids array<int>, decoded string", run, own="bpe")


def digests(docs, path: str, kind: str = "prefix"):
    """docs with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, computed
    where the ids are, which therefore never leave the Python worker."""
    import hashlib

    import pyarrow as pa

    from skerry.llm.textops import append, column_bytes

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        encode = encoder(path, kind)
        decimal = _decimals(len(encode.vocab.bytes))
        ids, edges = encode(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
        n, of_ids, of_text = np.diff(edges), [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = ids[a:b].tolist()
            of_ids.append(hashlib.sha256(b",".join(map(decimal.__getitem__, own))).hexdigest())
            of_text.append(hashlib.sha256(encode.vocab.decode(own).decode("utf-8", "replace").encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)]

    return append(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", run, own="bpe")


@lru_cache(maxsize=2)
def _decimals(n: int) -> list[bytes]:
    return [str(i).encode() for i in range(n)]
