"""Lossless WebP: a complete VP8L decoder, an encoder, and byte payloads stored as 8-bit samples.

The decoder reads prefix codes, back-references, the colour cache and meta
prefix images, and inverts the predictor, cross-colour, subtract-green and
palette transforms. Where only green varies and there is neither cache nor
meta codes, the symbols at all bit positions are looked up at once before the
stream is walked; any other image goes symbol by symbol. The encoder takes
the transform that the entropy of its result speaks for, and back-references
and a colour cache where they save bits.

Payloads are one or more images of 64 columns, each row 64 bytes, at most
16384 rows an image; a longer payload is a sequence of images.

Rows: a null text counts as empty. Repeated rows get equal results. Text of
any length is stored whole. Null media have null frames. Columns of the input
that are named as results are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skerry.llm.textops import append, column_bytes, run_starts

WIDTH, MOST_ROWS = 64, 16384
#: The order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The places (columns to the left, rows above) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + (n + 14 >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image ends early")
        out = self.peek(n)
        self.at += n
        return out


class Code:
    """A canonical prefix code, as a table over the next ``depth`` bits of the stream."""

    def __init__(self, lengths: np.ndarray | None = None, only: int = 0):
        if lengths is None:  # one symbol
            self.depth, self.only = 0, only
            return
        used = np.flatnonzero(lengths)
        if len(used) < 2:  # no bits are read
            self.depth, self.only = 0, int(used[0]) if len(used) else 0
            return
        self.only = None
        sizes = lengths[used].astype(np.int64)
        if (2.0**-sizes).sum() != 1:
            raise ValueError("the prefix code is not complete")
        self.depth = depth = int(sizes.max())
        order = np.lexsort((used, sizes))
        # the table in the order of codes is each symbol repeated; the stream has a code's first bit lowest
        symbol = np.repeat(used[order], 1 << (depth - sizes[order]))
        size = np.repeat(sizes[order], 1 << (depth - sizes[order]))
        turned = MIRROR[: 1 << depth] >> (15 - depth)
        self.symbols, self.sizes = symbol[turned].astype(np.int32), size[turned].astype(np.uint8)
        self.pairs: list[tuple[int, int]] = []

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        x = bits.peek(self.depth)
        if not self.pairs:
            self.pairs = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        symbol, size = self.pairs[x]
        bits.at += size
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        return symbol


def _mirror() -> np.ndarray:
    out, x = np.zeros(1 << 15, np.int64), np.arange(1 << 15)
    for i in range(15):
        out |= ((x >> i) & 1) << (14 - i)
    return out


#: The 15-bit numbers with their bits in reverse.
MIRROR = _mirror()


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        one = bits.read(8 if wide else 1)
        other = bits.read(8) if two else one
        if max(one, other) >= alphabet:
            raise ValueError("a symbol beyond its alphabet")
        if one == other:
            return Code(only=one)
        lengths = np.zeros(alphabet, np.uint8)
        lengths[[one, other]] = 1
        return Code(lengths)
    lengths = np.zeros(alphabet, np.uint8)
    inner = np.zeros(19, np.uint8)
    for i in LENGTH_ORDER[: 4 + bits.read(4)]:
        inner[i] = bits.read(3)
    code = Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # the lengths' own symbols have 14 bits at most
    first = bits.at
    x = int.from_bytes(bits.data[first >> 3 : (first + 14 * alphabet >> 3) + 2], "little") >> (first & 7)
    symbols, sizes = ([code.only], b"\0") if code.only is not None else (code.symbols.tolist(), code.sizes.tobytes())
    mask, used = len(symbols) - 1, 0
    values: list[int] = []
    before = 8
    while len(values) < alphabet and left:
        left -= 1
        s = symbols[x & mask]
        n = sizes[x & mask]
        x >>= n
        used += n
        if s < 16:
            values.append(s)
            before = s or before
            continue
        n = 2 if s == 16 else 3 if s == 17 else 7
        values += [before if s == 16 else 0] * ((11 if s == 18 else 3) + (x & ((1 << n) - 1)))
        x >>= n
        used += n
    if len(values) > alphabet:
        raise ValueError("more code lengths than symbols")
    bits.at = first + used
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    lengths[: len(values)] = values
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tile, meta = 1, 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = ((_read_image(bits, -(-width // (1 << tile)), -(-height // (1 << tile)), False) >> 8) & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]) and codes[0][0].only is None and n > 32:
        return _read_green(bits, codes[0], n, width)
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else None
    across = -(-width // (1 << tile)) if meta else 0
    at = cached = 0
    green, red, blue, alpha, distance = codes[0]

    def remember(to: int) -> None:
        nonlocal cached
        while cached < to:
            p = out[cached]
            cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached += 1

    while at < n:
        if meta:
            green, red, blue, alpha, distance = codes[meta[(at // width >> tile) * across + (at % width >> tile)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _value(bits, s - 256)
            d = _distance(_value(bits, distance.read(bits)), width)
            if d > at or at + length > n:
                raise ValueError("a reference leaves the image")
            out[at : at + length] = _copied(out, at - d, d, length, at)
            at += length
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _distance(value: int, width: int) -> int:
    if value > 120:
        return value - 120
    x, y = NEAR[value - 1]
    return max(1, x + y * width)


def _copied(out: list[int], start: int, d: int, length: int, end: int) -> list[int]:
    """What a reference stands for; one longer than its distance repeats what it writes."""
    return out[start : start + length] if d >= length else (out[start:end] * (length // d + 1))[:length]


def _read_green(bits: Bits, codes: list[Code], n: int, width: int) -> np.ndarray:
    """The pixels of an image whose other channels are constant and that has neither cache nor meta codes.

    What a symbol that starts at each bit of the stream would be, and how long with its extra bits and its
    distance, is found for all bits at once. A walk then gives the bits where symbols do start; the places
    that references copy from are followed back to literals.
    """
    green, distance = codes[0], codes[4]
    start = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=start)
    count = 8 * len(raw)
    raw = np.concatenate((raw, np.zeros(16, np.uint8))).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)  # 25 bits and more from each bit of the first byte

    def peek(at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (words[at >> 3] >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << np.asarray(size, np.uint32)) - np.uint32(1))

    window = np.empty((count >> 3, 8), np.uint16)
    mask = np.uint32((1 << green.depth) - 1)
    for k in range(8):
        window[:, k] = (words[: count >> 3] >> np.uint32(k)) & mask
    window = window.ravel()
    symbols, sizes = green.symbols[window], green.sizes[window]
    refs = np.flatnonzero(symbols >= 256)
    length, far = np.ones(count, np.int64), None
    if len(refs):
        at = np.minimum(refs + sizes[refs], count)
        s = symbols[refs].astype(np.int64) - 256
        extra = np.maximum((s - 2) >> 1, 0)
        length[refs] = np.where(s < 4, s, ((2 + (s & 1)) << extra) + peek(at, extra)) + 1
        at = np.minimum(at + extra, count)
        if distance.only is None:
            y = peek(at, distance.depth)
            s, size = distance.symbols[y].astype(np.int64), distance.sizes[y]
        else:
            s, size = np.full(len(refs), distance.only), np.zeros(len(refs), np.int64)
        at = np.minimum(at + size, count)
        extra = np.maximum((s - 2) >> 1, 0)
        d = np.where(s < 4, s, ((2 + (s & 1)) << extra) + peek(at, extra)) + 1
        far = np.zeros(count, np.int64)
        near = np.array(_near(width))
        far[refs] = np.where(d > 120, d - 120, near[np.minimum(d, 120)])
        sizes[refs] = np.minimum(at + extra, count + 8) - refs
    # the walk goes 16 symbols a step; those between are filled in afterwards
    hops = [np.minimum(np.arange(count + 1) + np.append(sizes, 0), count)]
    for _ in range(4):
        hops.append(hops[-1][hops[-1]])
    far_hop, at, places = memoryview(hops[4]), bits.at & 7, []
    while at < count and len(places) << 4 < n:  # a symbol is a pixel at least
        places.append(at)
        at = far_hop[at]
    places = np.array(places, np.int64)[:, None]
    for hop in reversed(hops[:4]):
        places = np.stack((places, hop[places]), axis=-1).reshape(len(places), -1)
    places = places.ravel()
    places = places[: np.searchsorted(places, count)]
    length = length[places]
    total = np.cumsum(length)
    used = int(np.searchsorted(total, n)) + 1
    if used > len(places) or total[used - 1] != n:
        raise ValueError("a reference leaves the image" if used <= len(places) else "the image ends early")
    places, length = places[:used], length[:used]
    bits.at = (start << 3) + int(places[-1]) + int(sizes[places[-1]])
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    values = symbols[places].astype(np.uint32)
    if far is None or not far[places].any():
        pixels = values
    else:
        back = np.repeat(far[places], length)
        source = np.arange(n) - back
        if source.min() < 0 or (back > np.repeat(total[:used] - length, length)).any():
            raise ValueError("a reference leaves the image")
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
        pixels = np.repeat(values, length)[source]
    return np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only) | pixels << np.uint32(8)


@lru_cache(maxsize=64)
def _near(width: int) -> list[int]:
    """The distance that each of the 120 short codes (from 1) stands for."""
    return [0] + [max(1, x + y * width) for x, y in NEAR]


def _channels(argb: np.ndarray, width: int) -> np.ndarray:
    """(rows, columns, A R G B) of small integers."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64).reshape(-1, width, 4)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32).reshape(-1, 4)
    return c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | c[:, 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from the neighbours left, above, above right and above left (channels last)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        step = mean - corner
        return np.clip(mean + (np.abs(step) >> 1) * np.sign(step), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


def _modes(data: np.ndarray, tile: int, width: int, height: int) -> np.ndarray:
    grid = ((data >> np.uint32(8)) & np.uint32(15)).astype(np.int64).reshape(-(-height // (1 << tile)), -1)
    return np.repeat(np.repeat(grid, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width]


def _undo_predictor(argb: np.ndarray, width: int, height: int, tile: int, data: np.ndarray) -> np.ndarray:
    c, modes = _channels(argb, width), _modes(data, tile, width, height)
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    for y in range(1, height):
        row, up = c[y], c[y - 1]
        row[0] = (row[0] + up[0]) & 255
        right = np.concatenate([up[1:], row[:1]])
        own = modes[y, 1:]
        if own.size and (own == own[0]).all() and int(own[0]) in (0, 1, 2, 3, 4, 8, 9, 14, 15):  # nothing, or only the sum of a row, depends on the row itself
            m = int(own[0])
            if m == 1:
                row[:] = np.cumsum(row, axis=0) & 255
            else:
                if m in (3, 9):  # the last pixel's right neighbour is this row's first
                    right[-1] = row[0]
                row[1:] = (row[1:] + predict(m, row[:-1], up[1:], right[1:], up[:-1])) & 255
            continue
        for x in range(1, width):
            row[x] = (row[x] + predict(int(modes[y, x]), row[x - 1], up[x], right[x], up[x - 1])) & 255
    return _joined(c)


def _cross(c: np.ndarray, width: int, height: int, tile: int, data: np.ndarray, sign: int) -> np.ndarray:
    e = _channels(data, -(-width // (1 << tile)))
    e = np.repeat(np.repeat(e, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width]
    signed = lambda x: ((x & 255) ^ 128) - 128
    delta = lambda t, x: (signed(t) * signed(x)) >> 5
    out = c.copy()
    red = c[..., 1] + sign * delta(e[..., 3], c[..., 2])
    out[..., 1] = red
    out[..., 3] = c[..., 3] + sign * (delta(e[..., 2], c[..., 2]) + delta(e[..., 1], red if sign > 0 else c[..., 1]))
    return out & 255


def _undo_palette(argb: np.ndarray, width: int, table: np.ndarray, packed: int) -> np.ndarray:
    """width: of the result; each stored pixel holds 2 ** packed indices in green, the first lowest."""
    green = ((argb >> np.uint32(8)) & np.uint32(255)).reshape(-1, -(-width // (1 << packed)))
    if packed:
        size = 8 >> packed
        green = np.stack([(green >> np.uint32(k * size)) & np.uint32((1 << size) - 1) for k in range(1 << packed)], axis=-1).reshape(len(green), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[green.ravel()]


def _packed_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode_vp8l(data: bytes) -> np.ndarray:
    """The pixels of a VP8L stream: (rows, columns) of ARGB values."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            undo.append((kind, inner, tile, _read_image(bits, -(-inner // (1 << tile)), -(-height // (1 << tile)), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, inner, 0, None))
        else:
            n = bits.read(8) + 1
            table = _joined(np.cumsum(_channels(_read_image(bits, n, 1, False), n)[0], axis=0))
            undo.append((kind, inner, _packed_bits(n), table))
            inner = -(-inner // (1 << _packed_bits(n)))
    argb = _read_image(bits, inner, height, True)
    for kind, wide, tile, extra in reversed(undo):
        if kind == PREDICTOR:
            argb = _undo_predictor(argb, wide, height, tile, extra)
        elif kind == CROSS_COLOUR:
            argb = _joined(_cross(_channels(argb, wide), wide, height, tile, extra, 1))
        elif kind == SUBTRACT_GREEN:
            green = (argb >> np.uint32(8)) & np.uint32(255)
            rb = (argb & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green)
            argb = (argb & np.uint32(0xFF00FF00)) | (rb & np.uint32(0xFF00FF))
        else:
            argb = _undo_palette(argb, wide, extra, tile)
    return argb.reshape(height, width)


class BitWriter:
    """Collects small fields in one number, and arrays of fields as they come."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_fields(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Fields of at most 63 bits each."""
        at = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        out = np.zeros((total >> 6) + 2, np.uint64)
        word, off = at >> 6, (at & 63).astype(np.uint64)
        np.add.at(out, word, values << off)
        np.add.at(out, word + 1, (values >> np.uint64(1)) >> (np.uint64(63) - off))
        self.put(int.from_bytes(out.tobytes(), "little"), total)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 3:
        out[used] = 1
        return out
    own = counts[used].astype(np.int64)
    while True:
        order = np.argsort(own, kind="stable")
        n = len(order)
        # leaves and inner nodes are both taken in ascending order
        weight, parent = own[order].tolist(), [0] * (2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    i, leaf = leaf, leaf + 1
                else:
                    i, inner = inner, inner + 1
                parent[i] = new
                total += weight[i]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            out[used[order]] = depth[:n]
            return out
        own = own // 2 + 1


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol as it stands in the stream, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    top = int(sizes.max())
    first = np.cumsum(1 << (top - sizes)) - (1 << (top - sizes))
    codes[order] = MIRROR[first >> (top - sizes)] >> (15 - sizes)
    return codes


def write_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        used = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1)
    tokens = []  # (code, extra value, extra bits)
    end = int(used[-1]) + 1
    heads = run_starts(lengths[:end])
    for value, run in zip(lengths[heads].tolist(), np.diff(np.append(heads, end)).tolist(), strict=True):
        while value == 0 and run >= 3:
            step = min(run, 138)
            tokens.append((18, step - 11, 7) if step >= 11 else (17, step - 3, 3))
            run -= step
        tokens += [(value, 0, 0)] * run
    inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    last = max(i for i, s in enumerate(LENGTH_ORDER) if inner[s])
    w.put(max(0, last + 1 - 4), 4)
    for s in LENGTH_ORDER[: max(4, last + 1)]:
        w.put(int(inner[s]), 3)
    n = len(tokens)
    if end < len(lengths):
        if n < 2:
            tokens.append((0, 0, 0)) if inner[0] else None
            n = len(tokens)
        w.put(1, 1)
        size = 8
        w.put((size - 2) // 2, 3) if n - 2 < 256 else w.put(4, 3)
        w.put(n - 2, size if n - 2 < 256 else 10)
    else:
        w.put(0, 1)
    codes = canonical(inner)
    single = np.count_nonzero(inner) < 2
    codes, sizes = codes.tolist(), [0] * 19 if single else inner.tolist()
    bits = used = 0
    for t, value, size in tokens:
        bits |= (codes[t] | value << sizes[t]) << used
        used += sizes[t] + size
    w.put(bits, used)


def _write_one(w: BitWriter, symbol: int) -> None:
    """A code of one symbol."""
    wide = symbol > 1
    w.put(1 | wide << 2 | symbol << 3, 11 if wide else 4)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and extra bits of lengths or distance codes (from 1)."""
    x = values - 1
    high = np.maximum(np.frexp(x.astype(np.float64))[1] - 1, 1)
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + ((x >> (high - 1)) & 1)), np.where(x < 4, 0, x & ((1 << extra) - 1)), extra


@lru_cache(maxsize=64)
def _short_codes(width: int) -> np.ndarray:
    """By distance: the short code that stands for it, or 0."""
    near = _near(width)
    out = np.zeros(max(near) + 1, np.int64)
    for code in range(120, 0, -1):
        out[near[code]] = code
    return out


def references(flat: np.ndarray, least: int = 6, reach: int = (1 << 20) - 121, longest: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (places, lengths, distances), taken greedily: each four pixels are looked up where they
    last stood. Shorter ones than ``least`` would save next to nothing."""
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < 8:
        return none, none, none
    low = np.uint64(n.bit_length())
    exact = _green_only(flat) and n < 1 << 31
    if exact:  # four bytes are a key
        x = ((flat >> np.uint32(8)) & np.uint32(255)).astype(np.uint64)
        key = (x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24)) << low
    else:
        x = flat.astype(np.uint64)
        key = x[:-3] * np.uint64(0x9E3779B97F4A7C15) + x[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:-1] * np.uint64(0x165667B19E3779F9) + x[3:] * np.uint64(0x27D4EB2F165667C5)
        key = key >> low << low
    ordered = np.sort(key | np.arange(n - 3, dtype=np.uint64))
    place, key = (ordered & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), ordered >> low
    same = np.flatnonzero(key[1:] == key[:-1])
    i, before = place[same + 1], place[same]
    real = i - before <= reach
    for k in range(0 if exact else 4):
        real &= flat[i + k] == flat[before + k]
    d = np.zeros(n - 2, np.int64)
    d[i[real]] = (i - before)[real]
    start = np.flatnonzero((d[1:] != 0) & (d[1:] != d[:-1])) + 1  # place 0 has nothing before it
    stop = np.flatnonzero((d[:-1] != 0) & (d[1:] != d[:-1])) + 1
    fit = stop - start + 3 >= least
    places, lengths, distances, at = [], [], [], 0
    for a, b, far in zip(start[fit].tolist(), stop[fit].tolist(), d[start[fit]].tolist(), strict=True):
        if a < at:
            a = at
        size = b - a + 3
        if size < least or a >= b:
            continue
        while size >= least:
            step = size if size < longest else longest
            places.append(a)
            lengths.append(step)
            distances.append(far)
            a += step
            size -= step
        at = a
    return np.array(places, np.int64), np.array(lengths, np.int64), np.array(distances, np.int64)


def _entropy(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at best."""
    if counts.max() < len(_NLOGN):
        n = int(counts.sum())
        return n * math.log2(n) - float(_NLOGN[counts].sum()) if n else 0.0
    c = counts[counts > 0].astype(np.float64)
    return float(-(c * np.log2(c / c.sum())).sum())


_NLOGN = np.arange(1 << 14) * np.log2(np.maximum(np.arange(1 << 14), 1))


def _cost(argb: np.ndarray) -> float:
    return sum(_entropy(np.bincount((argb >> np.uint32(s)) & np.uint32(255), minlength=256)) for s in (0, 8, 16, 24))


def _green_only(flat: np.ndarray) -> bool:
    return not int(np.bitwise_or.reduce(flat ^ flat[0])) & 0xFFFF00FF


def _cache_hits(flat: np.ndarray, bits: int) -> np.ndarray:
    """For each pixel its cache index if the cache holds it then, else -1."""
    slot = ((flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.full(len(flat), -1, np.int64)
    same = np.flatnonzero((slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]]))
    hit[order[same + 1]] = slot[order[same + 1]]
    return hit


def _write_image(w: BitWriter, flat: np.ndarray, width: int, main: bool, gray: bool) -> None:
    """Writes pixels with references where they save bits, and with a colour cache if it does."""
    n = len(flat)
    place, length, far = references(flat) if main else (np.zeros(0, np.int64),) * 3
    refs = len(place) > 0
    hits, cache_bits = None, 0
    if main and not gray and n > 64:
        found = _cache_hits(flat, 7)
        saved = _cost(flat[found >= 0]) - 8 * int((found >= 0).sum())
        if saved > 256:
            hits, cache_bits = found, 7
    covered = np.zeros(n + 1, np.int64)
    if refs:
        covered[place] += 1
        np.add.at(covered, place + length, -1)
    literal = np.cumsum(covered[:n]) == 0
    green = ((flat >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    symbol = green if hits is None else np.where(hits >= 0, 280 + hits, green)
    pixel = literal if hits is None else literal & (hits < 0)
    used = np.bincount(symbol[literal], minlength=280 + (1 << cache_bits if cache_bits else 0))
    distances = np.zeros(40, np.int64)
    if refs:
        table = _short_codes(width)
        code = np.where(far < len(table), table[np.minimum(far, len(table) - 1)], 0)
        code = np.where(code > 0, code, far + 120)
        (ls, lx, lb), (ds, dx, db) = _prefixes(length), _prefixes(code)
        with_refs = used + np.bincount(256 + ls, minlength=len(used))
        distances = np.bincount(ds, minlength=40)
        if _entropy(with_refs) + _entropy(distances) + int((lb + db).sum()) + 120 >= _entropy(np.bincount(symbol, minlength=len(used))) + (0 if gray else _cost(flat) - _cost(flat[literal])):
            refs, literal, distances = False, np.ones(n, bool), np.zeros(40, np.int64)
            pixel = literal if hits is None else hits < 0
            used = np.bincount(symbol, minlength=len(used))
        else:
            used = with_refs
    others = [] if gray else [((flat[pixel] >> np.uint32(s)) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of codes
    # in gray images the other channels have one symbol each, which takes no bits
    ones = [(int(flat[0]) >> s) & 255 for s in (16, 0, 24)] if gray else []
    lengths = [code_lengths(used), *(code_lengths(np.bincount(o, minlength=256)) for o in others), *([code_lengths(distances)] if refs else [])]
    write_code(w, lengths[0])
    for x in lengths[1:4] if others else ():
        write_code(w, x)
    for only in ones:
        _write_one(w, only)
    write_code(w, lengths[-1]) if refs else _write_one(w, 0)
    codes = [canonical(x).astype(np.uint64) for x in lengths]
    sizes = [x.astype(np.int64) if np.count_nonzero(x) > 1 else np.zeros(len(x), np.int64) for x in lengths]
    values, bits = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    values[literal], bits[literal] = codes[0][symbol[literal]], sizes[0][symbol[literal]]
    if not gray:
        at = np.flatnonzero(pixel)
        for k, o in enumerate(others, 1):
            values[at] |= codes[k][o] << bits[at].astype(np.uint64)
            bits[at] += sizes[k][o]
    if refs:
        v, b = codes[0][256 + ls], sizes[0][256 + ls]
        for value, size in ((lx, lb), (codes[-1][ds], sizes[-1][ds]), (dx, db)):
            v = v | value.astype(np.uint64) << b.astype(np.uint64)
            b = b + size
        values[place], bits[place] = v, b
        literal[place] = True
    at = np.flatnonzero(literal)
    w.put_fields(values[at], bits[at])


def _predictions(c: np.ndarray, mode: int) -> np.ndarray:
    """What a mode predicts for all pixels but the first row and column, from the image itself."""
    right = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1)
    return predict(mode, c[1:, :-1], c[:-1, 1:], right, c[:-1, :-1])


def _residuals(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[0, 1:] -= c[0, :-1]
    out[0, 0] -= [255, 0, 0, 0]
    out[1:, 0] -= c[:-1, 0]
    for m in np.unique(modes[1:, 1:]).tolist() if min(c.shape[:2]) > 1 else ():
        at = modes[1:, 1:] == m
        out[1:, 1:][at] -= _predictions(c, m)[at]
    return out & 255


def _best_modes(c: np.ndarray, tile: int, choices: range) -> np.ndarray:
    """For each tile the mode whose residuals are smallest."""
    height, width = c.shape[:2]
    size, down, across = 1 << tile, -(-height // (1 << tile)), -(-width // (1 << tile))
    costs = []
    for m in choices:
        r = np.zeros((down * size, across * size), np.int64)
        r[1:height, 1:width] = np.abs(((c[1:, 1:] - _predictions(c, m)) + 128 & 255) - 128).sum(axis=-1)
        costs.append(r.reshape(down, size, across, size).sum(axis=(1, 3)))
    return np.argmin(costs, axis=0) + choices[0]


def _slope(of: np.ndarray, by: np.ndarray) -> int:
    """The colour transform element that takes most of ``by`` out of ``of``."""
    signed = lambda x: ((x & 255) ^ 128) - 128.0
    x, y = signed(by).ravel(), signed(of).ravel()
    return int(np.clip(np.rint(32 * (x * y).sum() / max((x * x).sum(), 1)), -128, 127)) & 255


def encode(argb: np.ndarray) -> bytes:
    """A VP8L stream of an image (rows, columns) of ARGB values.

    Of no transform, a palette, subtracted green, a predictor for each tile, and a predictor with the
    colour transform, the one whose result needs the fewest bits by entropy is taken; back-references and
    a colour cache are used where they save bits.
    """
    height, width = argb.shape
    flat = np.ascontiguousarray(argb, np.uint32).ravel()
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int((flat >> np.uint32(24)).min() < 255), 1), (0, 3)):
        w.put(value, n)
    gray = _green_only(flat)
    green = (flat >> np.uint32(8)) & np.uint32(255)
    counts = np.bincount(green, minlength=256)
    plain = _entropy(counts) if gray else _cost(flat)
    colours = np.flatnonzero(counts).astype(np.uint32) << np.uint32(8) | flat[0] & np.uint32(0xFFFF00FF) if gray else np.unique(flat)
    table_bits = (8 if gray else 26) * len(colours) + 40
    if len(colours) <= (16 if gray else 256) and len(flat) > 1:
        index = np.searchsorted(colours, flat).reshape(height, width)
        packed = _packed_bits(len(colours))
        across = -(-width // (1 << packed))
        wide = np.zeros((height, across << packed), np.int64)
        wide[:, :width] = index
        size = 8 >> packed
        joined = (wide.reshape(height, across, 1 << packed) << (size * np.arange(1 << packed))).sum(axis=-1).astype(np.uint32).ravel()
        if _entropy(np.bincount(joined, minlength=256)) + table_bits < plain:
            w.put(1, 1)
            w.put(PALETTE, 2)
            w.put(len(colours) - 1, 8)
            steps = _channels(colours, len(colours))[0]
            _write_image(w, _joined(np.diff(steps, axis=0, prepend=0)), len(colours), False, False)
            w.put(0, 1)
            _write_image(w, joined << np.uint32(8) | np.uint32(0xFF000000), across, True, True)
            return w.bytes()
    best, undo, chosen = plain, [], flat
    if height > 1 and width > 1 and len(flat) > 64:
        c = None
        if gray:  # two modes tell whether neighbours say anything
            g = green.astype(np.uint8).reshape(height, width)
            likely = min(_entropy(np.bincount(r.ravel(), minlength=256)) for r in (g[:, 1:] - g[:, :-1], g[1:] - g[:-1])) < 0.95 * plain
        else:
            likely = True
            less = _joined(_channels(flat, width) - _channels(flat, width)[..., 2:3] * np.array([0, 1, 0, 1]))
            if (cost := _cost(less)) < best:
                best, undo, chosen = cost, [(SUBTRACT_GREEN, 0, None)], less
        if likely:
            tile = 4
            c = _channels(flat, width)
            modes = _best_modes(c, tile, range(1, 14))
            full = np.repeat(np.repeat(modes, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width]
            left = _residuals(c, full)
            modes = modes.astype(np.uint32).ravel() << np.uint32(8) | np.uint32(0xFF000000)
            extra = _entropy(np.bincount((modes >> np.uint32(8)) & np.uint32(255))) + 60
            if (cost := _cost(_joined(left)) + extra) < best:
                best, undo, chosen = cost, [(PREDICTOR, tile, modes)], _joined(left)
            if not gray:
                e = np.array([255, _slope(left[..., 3], left[..., 1]), _slope(left[..., 3], left[..., 2]), _slope(left[..., 1], left[..., 2])])
                grid = np.repeat(_joined(e), -(-width // 512) * -(-height // 512))
                less = _joined(_cross(left, width, height, 9, grid, -1))
                if (cost := _cost(less) + extra + 60) < best:
                    best, undo, chosen = cost, [(PREDICTOR, tile, modes), (CROSS_COLOUR, 9, grid)], less
    for kind, tile, data in undo:
        w.put(1, 1)
        w.put(kind, 2)
        if data is not None:
            w.put(tile - 2, 3)
            _write_image(w, data, -(-width // (1 << tile)), False, False)
    w.put(0, 1)
    _write_image(w, chosen, width, True, _green_only(chosen))
    return w.bytes()


def encode_samples(rows: np.ndarray) -> bytes:
    """A VP8L stream whose green channel holds 8-bit samples."""
    return encode(rows.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000))


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def streams(data: bytes) -> list[bytes]:
    """The VP8L streams of the containers that follow one another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP container")
        end, i = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12
        while i + 8 <= end:
            size = struct.unpack_from("<I", data, i + 4)[0]
            if data[i : i + 4] == b"VP8L":
                out.append(data[i + 8 : i + 8 + size])
            i += 8 + size + (size & 1)
        at = end
    return out


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as WebP."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(container(encode_samples(rows[i : i + MOST_ROWS])) for i in range(0, len(rows), MOST_ROWS))


def load(media: bytes) -> np.ndarray:
    """The samples of stored media: (rows, 64)."""
    return np.concatenate([((decode_vp8l(s) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8) for s in streams(media)])


def feature(samples: np.ndarray) -> str:
    """Size, mean, distinct samples and the mean step between neighbours in a row."""
    step = np.abs(np.diff(samples.astype(np.int16), axis=1))
    return f"{samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} distinct={np.count_nonzero(np.bincount(samples.ravel(), minlength=256))} step={step.mean():.4f}"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """docs with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and media
    (the stored bytes). All but n_bytes and the media's own come from what is read back."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
        raw = data.tobytes()
        cols: list[list] = [[] for _ in range(8)]
        seen: dict[bytes, tuple] = {}  # equal texts have equal values
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            row = seen.get(raw[a:b])
            if row is None:
                stored = store(padded(raw[a:b]))
                samples = load(stored)
                back = samples.tobytes()
                row = seen[raw[a:b]] = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples), stored)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 8 if keep_media else 7]

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return append(docs, fields + ", media binary" * keep_media, run)


def frames(df: DataFrame, column: str = "media") -> DataFrame:
    """df with frames: the images of the stored bytes in ``column``, each with width, height and its pixels as
    ARGB values (signed 32 bits), row by row."""
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.list_(pa.int32()))]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for media in batch.column(batch.schema.get_field_index(column)).to_pylist():
            images = [decode_vp8l(s) for s in streams(media)] if media is not None else None
            out.append(None if images is None else [{"width": i.shape[1], "height": i.shape[0], "argb": i.ravel().view(np.int32)} for i in images])
        return [pa.array(out, kind)]

    return append(df, "frames array<struct<width: int, height: int, argb: array<int>>>", run)


def images(df: DataFrame, column: str = "frames") -> DataFrame:
    """df with media: the images of ``column`` (as frames() gives them) stored losslessly."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for row in batch.column(batch.schema.get_field_index(column)).to_pylist():
            of = lambda f: np.array(f["argb"], np.int64).astype(np.uint32).reshape(f["height"], f["width"])
            out.append(None if row is None else b"".join(container(encode(of(f))) for f in row))
        return [pa.array(out, pa.binary())]

    return append(df, "media binary", run)
