"""Distances as column expressions, in double precision, folded from left to right.

``l2sq`` is the squared Euclidean distance, ``mips`` the negated inner product,
``cosine`` one minus the cosine. All stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, step) -> Column:
    zero = F.lit(0.0).cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: step(x.cast("double"), y.cast("double"))), zero, lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def mips(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2sq_u16(a: Column, b: Column) -> Column:
    """The 16-bit integer form: an exact sum, then eight bits dropped."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.shiftright(total, 8)


def code_dot(a: Column, b: Column, bits: int) -> Column:
    """The negated integer dot product of codes; four-bit codes count 256-fold, as both carry their high nibble."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return -total * (256 if bits == 4 else 1)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def weighted_hamming(a: Column, b: Column, norm: Column) -> Column:
    return hamming(a, b) * norm


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = F.array(F.when(norm(v) == 0, 1.0).otherwise(norm(v)))  # bound to a variable, so that it's computed once
    return F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def bit_words(flags: Column, dim: int) -> Column:
    """An array of booleans as 64-bit words, the first flag lowest, padded with zeros."""
    starts = F.array(*(F.lit(lo + 1) for lo in range(0, dim, 64)))
    word = lambda f, lo: F.aggregate(F.reverse(F.slice(f, lo, 64)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("long")))
    return F.transform(F.array(flags), lambda f: F.transform(starts, lambda lo: word(f, lo)))[0]  # flags are computed once


def ternary_dot(nonzero_a: Column, negative_a: Column, nonzero_b: Column, negative_b: Column) -> Column:
    """The negated inner product of codes -1, 0, 1 held as two arrays of words: which aren't 0 and which are negative."""
    used = F.zip_with(nonzero_a, nonzero_b, lambda x, y: x.bitwiseAND(y))
    unlike = F.zip_with(F.zip_with(negative_a, negative_b, lambda x, y: x.bitwiseXOR(y)), used, lambda x, y: x.bitwiseAND(y))
    count = lambda words: F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x))
    return 2 * count(unlike) - count(used)


METRICS = {"l2sq": l2sq, "euclidean": l2sq, "mips": mips, "cosine": cosine}
#: Whether the measure is a metric after a square root; graph pruning with alpha > 1 needs it.
IS_METRIC = {"l2sq": True, "euclidean": True, "mips": False, "cosine": False}


def translate_radius(radius: float, metric: str, scale: float = 1.0, wide: bool = False) -> float:
    """A radius in the space of codes."""
    if metric in ("l2sq", "euclidean"):
        return radius * scale * scale / (256 if wide else 1)
    return radius * scale * scale
