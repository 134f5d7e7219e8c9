"""Vectorised text primitives over Arrow columns.

The operators of this subpackage work on whole Arrow batches: the text column
is seen as one byte buffer plus document offsets, words are found with lookup
tables, and each word gets a 64-bit hash without a Python object per word.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy step covers at most (a single longer word or document may exceed it).
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

#: A-Z lower-cased, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space is 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes each, or of one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal runs of word bytes, which no document border crosses,
    and for each document the number of the first word (n + 1 entries)."""
    inside = is_word[data]
    first = np.empty(len(inside), bool)
    if len(inside):
        first[0] = inside[0]
        np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(inside))]
        first[borders] = inside[borders]
        last = np.empty(len(inside), bool)
        last[-1] = inside[-1]
        np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
        last[borders - 1] = inside[borders - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(n, U64(_BASE if kind == "up" else _BASE_INV))
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * BLOCK:
            _powers[kind] = have
    return have


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the given ascending byte ranges."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        up, down = _power("up", max(BLOCK, hi - lo) + 1), _power("down", max(BLOCK, hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def hash_rows(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of several hash columns; the order of the columns matters."""
    out = np.zeros(len(parts[0]), np.uint64)
    for k, p in enumerate(parts):
        out = out + p * U64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        out ^= out >> U64(29)
    return mix64(out)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of ranges that begin at starts, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def bounded(spark: SparkSession) -> None:
    """Lets Spark hand at most 4 MB (or one row) at a time to Python, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(4 * BLOCK))


#: By name: what drops the state that a module keeps in a worker between tasks.
KEPT: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives unused memory of this process back."""
    import ctypes

    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, own: str = ""):
    """A function for mapInArrow that gives unused memory back when its task ends, and first drops what other
    modules than ``own`` keep: workers live on, and executors of several operators in turn would otherwise
    hold the largest share of each."""

    def go(batches):
        for name, forget in KEPT.items():
            if name != own:
                forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage in the folder that the cluster shares (spark.checkpoint.dir).

    Without that setting a session on one machine (a local master) gets a folder in /tmp; on a cluster it is
    an error. Shuffle files that only led here are removed: the written rows replace them.
    """
    session = df.sparkSession
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = session.conf.get(key, "false")
    session.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting
    finally:
        session.conf.set(key, before)


def nested(docs: DataFrame) -> DataFrame:
    """doc_id, text, and row_ with all columns of docs, so that an operator's own columns can't clash with them."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))


def restored(found: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns that nested() put away, those in new with other values."""
    return found.select(*[new.get(c, F.col(f"row_.`{c}`")).alias(c) for c in columns])


def append(df: DataFrame, fields: str, fn, keep: list[str] | None = None, own: str = "", only=None) -> DataFrame:
    """The rows of df with columns computed from each Arrow batch.

    fields: the new columns as a DDL string; a column of df with the same name is replaced.
    fn: takes a RecordBatch of at most about BLOCK * 8 bytes of text, returns a list of arrays.
    keep: the columns of df to hand on (default: all). own: see tidy. only: tells of a batch which rows count.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(fields)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    kept_names = [f.name for f in kept]
    schema = T.StructType([*kept, *new])
    to = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for part in slices(batch if only is None else batch.filter(pa.array(only(batch)))):
                arrays = [part.column(part.schema.get_field_index(n)) for n in kept_names]
                yield pa.RecordBatch.from_arrays([*arrays, *fn(part)], to)

    bounded(df.sparkSession)
    return df.mapInArrow(tidy(run, own), schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text (a longer document is a slice of its own)."""
    i = batch.schema.get_field_index(column)
    if i < 0 or batch.num_rows < 2 or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    _, offsets = column_bytes(batch.column(i))
    for a, b in blocks(offsets, most):
        yield batch.slice(a, b - a)


class IdFilter:
    """A bitmap of hashed ids, of a bounded size, that tells ids which can't be in a set from those that may be.

    It spares the rows that a join wouldn't touch their shuffle. Its size follows the number of ids up to
    2 ** most bits (8 MB); beyond, it lets more rows through, which the exact join then handles.
    """

    def __init__(self, ids: DataFrame, most: int = 26):
        name = ids.columns[0]
        n = ids.count()
        self.bits = min(most, max(16, (16 * n).bit_length()))
        words = ids.where(f"`{name}` is not null").select(ids[name].cast("long").alias("id")).mapInArrow(self._build, "word long, bits long")
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)
        if n:
            rows = words.groupBy("word").agg({"bits": "bit_or"}).toArrow()  # at most 2 ** (most - 6) rows
            self.table[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)

    def _place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = mix64(ids.astype(np.int64).view(np.uint64)) >> U64(64 - self.bits)
        return (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63))

    def _build(self, batches):
        table = np.zeros(1 << (self.bits - 6), np.uint64)
        for batch in batches:
            word, bit = self._place(batch.column(0).to_numpy())
            np.bitwise_or.at(table, word, bit)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(table[used].view(np.int64))], ["word", "bits"])

    def may_hold(self, column: pa.Array) -> np.ndarray:
        """Nulls are never held."""
        word, bit = self._place(column.fill_null(0).to_numpy(zero_copy_only=False))
        return ((self.table[word] & bit) != 0) & column.is_valid().to_numpy(zero_copy_only=False)

    def rows(self, df: DataFrame, column: str, held: bool) -> DataFrame:
        """The rows of df whose id may be held, or those whose id can't be."""

        def run(batches):
            for batch in batches:
                own = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
                yield batch.filter(pa.array(self.may_hold(own) == held))

        return df.mapInArrow(tidy(run), df.schema)
