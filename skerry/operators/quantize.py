"""Quantisers: fit on the base, transform base and queries alike."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.metrics import bit_words
from skerry.operators.ranks import at_rank


def _double(vec: str) -> Column:
    return F.transform(F.col(vec), lambda x: x.cast("double"))


def rounded(x: np.ndarray) -> np.ndarray:
    """Halves away from zero, as round() of SQL does."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def packed_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, the first flag lowest: bit_words() of arrays."""
    wide = np.pad(flags, ((0, 0), (0, -flags.shape[1] % 64)))
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


@dataclass(frozen=True)
class Scalar:
    """clip(round(x * slope) - offset) to 0 .. 2^bits - 1."""

    slope: float
    offset: float
    bits: int

    @staticmethod
    def fit(df: DataFrame, bits: int = 8, vec: str = "vec") -> Scalar:
        lo, hi, whole = df.select(
            F.least(F.lit(0.0), F.min(F.array_min(_double(vec)))), F.greatest(F.lit(0.0), F.max(F.array_max(_double(vec)))),
            F.min(F.forall(_double(vec), lambda x: (x >= 0) & (x == F.floor(x)))),
        ).first()
        if whole:
            lo, hi = 0.0, 255.0 if bits == 8 else 65536.0
        slope = ((1 << bits) - 1) / (hi - lo) if hi > lo else 1.0
        return Scalar(slope, float(np.floor(abs(lo * slope) + 0.5) * np.sign(lo)), bits)

    def transform(self, v: Column) -> Column:
        return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float((1 << self.bits) - 1)), F.round(x.cast("double") * self.slope) - self.offset)).cast("int"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(rounded(x * self.slope) - self.offset, 0, (1 << self.bits) - 1)


@dataclass(frozen=True)
class Symmetric:
    """clip(round(x * scale)) to +- half the range, for inner products."""

    scale: float
    bits: int

    @staticmethod
    def fit(df: DataFrame, bits: int = 8, vec: str = "vec", trim: bool = False) -> Symmetric:
        if trim:  # exact ranks of the smallest and largest coordinate of each vector
            n = df.count()
            lo = at_rank(df, F.array_min(_double(vec)), int(1e-4 * n))
            hi = at_rank(df, F.array_max(_double(vec)), min(n - 1, int((1 - 1e-4) * n)))
        else:
            lo, hi = df.select(F.min(F.array_min(_double(vec))), F.max(F.array_max(_double(vec)))).first()
        bound = max(hi, -lo, 0.0) or 1.0
        return Symmetric(((1 << bits) - 1) // 2 / bound, bits)

    def transform(self, v: Column) -> Column:
        most = float(((1 << self.bits) - 1) // 2)
        return F.transform(v, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.round(x.cast("double") * self.scale))).cast("int"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        most = ((1 << self.bits) - 1) // 2
        return np.clip(rounded(x * self.scale), -most, most)


def quantile(df: DataFrame, rank: int, vec: str = "vec") -> float:
    """The coordinate of an exact rank (from 0) among all coordinates."""
    return at_rank(df.select(F.explode(_double(vec)).alias("x")), "x", rank)


@dataclass(frozen=True)
class Ternary:
    """-1, 0 or 1 by a cut: the larger of the 70th percentile and minus the 30th."""

    cut: float

    @staticmethod
    def fit(df: DataFrame, vec: str = "vec") -> Ternary:
        n = df.select(F.sum(F.size(vec))).first()[0]
        return Ternary(max(quantile(df, int(0.7 * n), vec), -quantile(df, int(0.3 * n), vec)))

    def transform(self, v: Column) -> Column:
        return F.transform(v, lambda x: F.when(x.cast("double") > self.cut, 1).when(x.cast("double") < -self.cut, -1).otherwise(0))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x > self.cut).astype(float) - (x < -self.cut)


@dataclass(frozen=True)
class Bits:
    """One bit a coordinate: above the threshold (0 for inner products, the median for Euclidean distance)."""

    threshold: float = 0.0

    @staticmethod
    def fit_median(df: DataFrame, vec: str = "vec") -> Bits:
        n = df.select(F.sum(F.size(vec))).first()[0]
        return Bits(quantile(df, n // 2, vec))

    def transform(self, v: Column, dim: int) -> Column:
        return bit_words(F.transform(v, lambda x: x.cast("double") > self.threshold), dim)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return packed_bits(x > self.threshold)


@dataclass(frozen=True)
class SparseSketch:
    """Signs of sums over few coordinates: plus the first half of the drawn ones, minus the rest."""

    places: tuple[tuple[int, ...], ...]
    signs: tuple[tuple[int, ...], ...]

    @staticmethod
    def draw(dim: int, bits: int = 1024, nonzero: int = 6, random_signs: bool = False, seed: int = 5489) -> SparseSketch:
        rng = np.random.default_rng(seed)
        places = rng.integers(0, dim, (bits, nonzero))
        signs = rng.choice([-1, 1], (bits, nonzero)) if random_signs else np.tile([1] * (nonzero // 2) + [-1] * (nonzero - nonzero // 2), (bits, 1))
        return SparseSketch(tuple(map(tuple, places.tolist())), tuple(map(tuple, signs.tolist())))

    def transform(self, v: Column) -> Column:
        """Sums by a table, one literal that is folded from JSON, so that the expression doesn't grow with the bits."""
        rows = [[{"p": p + 1, "s": s} for p, s in zip(ps, ss, strict=True)] for ps, ss in zip(self.places, self.signs, strict=True)]
        table = F.from_json(F.lit(json.dumps(rows)), "array<array<struct<p:int,s:double>>>")
        total = lambda row: F.aggregate(row, F.lit(0.0), lambda t, e: t + F.element_at(v, e["p"]).cast("double") * e["s"])
        return bit_words(F.transform(table, lambda row: total(row) > 0), len(self.places))

    def encode(self, x: np.ndarray) -> np.ndarray:
        places, signs = np.array(self.places), np.array(self.signs, float)
        total = np.zeros((len(x), len(places)))
        for j in range(places.shape[1]):
            total += x[:, places[:, j]] * signs[:, j]
        return packed_bits(total > 0)


class DenseSketch:
    """A random +-1 matrix: signs of the projection (``bits``), or the projection at unit length in eight bits (``bytes``)."""

    def __init__(self, dim: int, out: int = 128, seed: int = 5489):
        self.matrix = np.random.default_rng(seed).choice([-1.0, 1.0], (dim, out))

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix

    def bits(self, x: np.ndarray) -> np.ndarray:
        return packed_bits(self.project(x) > 0)

    def bytes(self, x: np.ndarray, bound: float = 0.3) -> np.ndarray:
        y = self.project(x)
        n = np.linalg.norm(y, axis=1, keepdims=True)
        y = y / np.where(n == 0, 1, n)
        return np.clip(np.sign(y) * np.floor(np.abs(y * 127 / bound) + 0.5), -127, 127).astype(np.int8)


#: The codes an index can be searched in, by its metric.
CODES = {"l2sq": ("16", "8", "bits", "sketch"), "mips": ("16", "8", "4", "ternary", "bits", "sketch", "dense8"), "cosine": ()}


@dataclass(frozen=True)
class Coder:
    """A fitted quantiser as plain numbers, which tasks and saved indexes carry. encode() gives arrays, ``measure``
    the distance among them."""

    kind: str
    metric: str
    dim: int
    numbers: tuple[float, ...] = ()

    @staticmethod
    def fit(kind: str, df: DataFrame, metric: str, dim: int, vec: str = "vec") -> Coder:
        """Aggregates over all of df; a few numbers reach the driver."""
        if kind not in CODES[metric]:
            raise ValueError(f"no codes {kind!r} for {metric}")
        if kind in ("16", "8") and metric == "l2sq":
            q = Scalar.fit(df, int(kind), vec)
            numbers = (q.slope, q.offset)
        elif kind in ("16", "8", "4"):
            numbers = (Symmetric.fit(df, int(kind), vec).scale,)
        elif kind == "ternary":
            numbers = (Ternary.fit(df, vec).cut,)
        elif kind == "bits":
            numbers = (Bits.fit_median(df, vec).threshold if metric == "l2sq" else 0.0,)
        else:
            numbers = ()
        return Coder(kind, metric, dim, numbers)

    @property
    def measure(self) -> str:
        return "hamming" if self.kind in ("bits", "sketch") else self.metric

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "dense8":
            return DenseSketch(self.dim).bytes(x).astype(float)
        if self.kind == "sketch":
            mips = self.metric == "mips"
            return SparseSketch.draw(self.dim, nonzero=5 if mips else 6, random_signs=mips).encode(x)
        if self.kind in ("16", "8") and self.metric == "l2sq":
            return Scalar(*self.numbers, int(self.kind)).encode(x)
        if self.kind in ("16", "8", "4"):
            return Symmetric(*self.numbers, int(self.kind)).encode(x)
        return (Ternary if self.kind == "ternary" else Bits)(*self.numbers).encode(x)
