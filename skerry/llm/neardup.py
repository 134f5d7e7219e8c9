"""Near-duplicates by min-max hashing.

A document's set holds its distinct word shingles as 64-bit hashes. Under each
of ``hashes`` permutations both the smallest and the largest value are kept,
so a signature of 2 * hashes values costs half the hash evaluations. Bands of
``rows`` values find candidates; links are confirmed on the full sets.

All work is linear in the documents and bands:

1. equal sets form classes, and one document stands for each;
2. in every bucket of a band each member is compared with the smallest one
   (a star), and confirmed links are joined to components;
3. all that the stars join, confirmed or not, is a family, so that every pair
   sharing a bucket is within one. Members linked with the family's commonest
   centre need no more; where others are left, pairs between them and the
   former, and among them, are looked at: in blocks of bounded size, on full
   sets. A block returns at most one edge a member. No pair is dropped by a cap.

With the default of 32 bands of 4 values two sets of similarity 0.8 miss each
other in all bands with probability 5e-8.

Rows: null or empty texts have an empty set and are linked with nothing. A
null doc_id takes part in no link. Repeated rows of one id form one document
for the links; each keeps its own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.textops import BLOCK, LOWER, U64, IdFilter, bounded, column_bytes, cut, find_words, hash_rows, hash_spans, mix64, restored, slices, tidy


#: Parts of a group that a join on the group is dealt by, and the mean shingles of a block's members beyond which it has fewer.
SALTS, SHINGLES = 16, 4096


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; with fewer words, its whole sequence as one."""
    data = LOWER[data]
    starts, ends, first = find_words(data, offsets)
    words = hash_spans(data, starts, ends)
    n = len(words) - width + 1
    shingles = hash_rows([words[i : n + i] for i in range(width)]) if n > 0 else words[:0]
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            sets.append(hash_rows([words[i : i + 1] for i in range(a, b)]) ^ U64(b - a))
        else:
            sets.append(words[:0])
    return sets


def signature(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """A row of len(multipliers) minima and as many maxima for each (not empty) set."""
    lengths = np.array([len(s) for s in sets])
    edge = np.cumsum(lengths) - lengths
    values = mix64(np.concatenate(sets))
    out = np.empty((len(sets), 2 * len(multipliers)), np.uint64)
    for k, a in enumerate(multipliers):
        own = values * a
        out[:, 2 * k] = np.minimum.reduceat(own, edge)
        out[:, 2 * k + 1] = np.maximum.reduceat(own, edge)
    return out


def _sign(width: int, hashes: int, rows: int):
    multipliers = _multipliers(hashes)

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=2 * BLOCK):
                sets = shingle_sets(*column_bytes(part.column("text")), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                n = pa.array([len(s) for s in sets], pa.int64())
                bands = [None] * len(sets)
                c1, c2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if full:
                    sig = signature([sets[i] for i in full], multipliers)
                    keys = np.stack([hash_rows([sig[:, b + r] for r in range(rows)]) for b in range(0, sig.shape[1] - rows + 1, rows)], axis=1).view(np.int64)
                    for x, i in enumerate(full):
                        bands[i] = keys[x]
                        s = sets[i]
                        c1[i] = np.bitwise_xor.reduce(mix64(s)).view(np.int64)
                        c2[i] = np.add.reduce(mix64(s ^ U64(0x5DEECE66D))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(c1), pa.array(c2), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "c1", "c2", "bands"])

    return run


def _set_rows(width: int, wanted: IdFilter):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(batch.column("doc_id"))))
            for part in slices(batch, most=2 * BLOCK):
                sets = shingle_sets(*column_bytes(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "items"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good_a, good_b = [], []
            held: dict = {}
            for x, y, p, q in zip(a, b, batch.column("items_a"), batch.column("items_b"), strict=True):
                if x not in held:
                    held = {x: np.frombuffer(p.as_py(), np.uint64)}
                s, t = held[x], np.frombuffer(q.as_py(), np.uint64)
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                    continue
                both = len(s) + len(t) - len(np.union1d(s, t)) if len(s) + len(t) < 64 else int((np.diff(np.sort(np.concatenate((s, t)), kind="stable")) == 0).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    good_a.append(x)
                    good_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], ["a", "b"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, items: the packed shingle sets of the documents whose ids wanted holds, and a few others."""
    return cut(docs.mapInArrow(tidy(_set_rows(width, IdFilter(wanted))), "id long, items binary").dropDuplicates(["id"]))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union on the full sets."""
    sa, sb = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    return cut(pairs.join(sb, "b").join(sa, "a").mapInArrow(tidy(_confirm(percent)), "a long, b long"))


def _forest(batches, most: int = 1 << 20):
    """For every ``most`` edges of a task: each node with the smallest one that these edges connect it to."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("a", "b"))
        nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = number[: len(a)], number[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for end in (a, b, label[a], label[b]):
                np.minimum.at(new, end, low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[far]]), pa.array(nodes[far])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def _labels(batches):
    """Each node of all edges of the task with the smallest one that it is connected to."""
    for part in _forest(batches, most=1 << 62):
        own = pa.array(np.unique(part.column("a").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([own, part.column("b")]), pa.concat_arrays([own, part.column("a")])], ["node", "label"])


def components(edges: DataFrame, most: int = 1 << 18) -> DataFrame:
    """node, label: the smallest node reachable, for all nodes of the edges (a, b).

    Tasks first replace their own edges by a forest of stars that connects the same nodes. While more than
    ``most`` edges are left, a round replaces each node by the one of itself and its neighbours that comes
    first in a random order, which leaves about half the nodes in expectation; the rest, 4 MB at most, is
    joined in one task. Nothing but a count reaches the driver.
    """
    forest = lambda df: df.where("a != b").mapInArrow(tidy(_forest), "a long, b long").distinct()
    edges = cut(forest(edges.select("a", "b")))
    rounds = []
    while edges.count() > most:
        turn = F.lit(len(rounds))
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), "b")).alias("low"))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("b"))
        to = cut(first.select(F.col("a").alias("node"), F.least("low", own)["b"].alias("to")))
        rounds.append(to)
        ends = [to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = cut(forest(moved))
    labels = edges.coalesce(1).mapInArrow(tidy(_labels), "node long, label long")
    if not rounds:
        return cut(labels)
    for to in reversed(rounds):
        labels = to.join(labels.select(F.col("node").alias("to"), "label"), "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("low"))  # the random order has named the groups
    return cut(labels.join(smallest, "label").select("node", F.col("low").alias("label")))


def _closed(percent: int):
    """For each block of a family: which members the links on full sets connect, as one edge a member."""

    def block(ids: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        sizes = np.array([len(s) for s in sets], np.float64)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        shared = counts[inverse] > 1  # the others are in no intersection
        column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((n, n), np.float64)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [lo, lo + width])
            there = np.zeros((n, width), np.float32)
            there[owner[i:j], column[i:j] - lo] = 1
            both += there @ there.T
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(linked, True)
        label = np.arange(n)
        while True:
            low = np.where(linked, label[None, :], n).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        far = np.flatnonzero(label != np.arange(n))
        ids = np.array(ids)
        return ids[label[far]], ids[far]

    def run(batches):
        now, ids, sets = None, [], []

        def done():
            a, b = block(ids, sets)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("family", "block", "rep")), batch.column("items"), strict=True)
            for family, blk, rep, items in rows:
                if (family, blk) != now and ids:
                    yield done()
                    ids, sets = [], []
                now = (family, blk)
                ids.append(rep)
                sets.append(np.frombuffer(items.as_py(), np.uint64))
        if ids:
            yield done()

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, hashes: int = 64, rows: int = 4, part: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    width: words in a shingle. percent: the least similarity of a link. part: members of each side of a block.
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(tidy(_sign(width, hashes, rows)), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"))
    real = signed.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # one document for each class, with its bands
    reps = real.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])
    members = reps.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("i", "key")).select("rep", F.xxhash64("i", "key").alias("band"))
    # a bucket's smallest member reaches the others in parts of the bucket, so that a hot one is no single task's
    lows = members.groupBy("band").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    lows = lows.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    stars = cut(dealt.join(lows, ["band", "salt"]).where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct())
    sets = sets_of(docs, stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct(), width)
    links = confirmed(stars, sets, percent)
    labels = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))  # each member's smallest confirmed centre

    # families are what the stars join, confirmed or not: every pair that shares a bucket is in one family
    families = components(stars).select(F.col("node").alias("rep"), F.col("label").alias("family"))
    weights = sets.select(F.col("id").alias("rep"), (F.octet_length("items") / 8).cast("long").alias("w"))
    tagged = families.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(weights, "rep").select("rep", "family", F.coalesce("label", "rep").alias("label"), "w")
    parties = tagged.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    most = F.max(F.struct("n", "label", "w")).alias("most")
    open_ = parties.groupBy("family").agg(most, F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1")
    # pairs of those linked with the commonest centre and the rest, and within the rest, in blocks of a part of each:
    # of ``part`` members, and fewer where their sets are large
    size = lambda n, w: F.greatest(F.ceil(n / part), F.ceil(w / (part * SHINGLES)), F.lit(1)).cast("int")
    open_ = open_.select("family", F.col("most.label").alias("most"), size(F.col("most.n"), F.col("most.w")).alias("km"), size(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("kr"))
    open_ = open_.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    rows = tagged.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(open_, ["family", "salt"])
    rows = rows.select("family", "rep", (F.col("label") == F.col("most")).alias("main"), "km", "kr")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), F.when(F.col("main"), F.col("km")).otherwise(F.col("kr"))).cast("int"))
    across = rows.select("family", "rep", "main", "kr", "own", F.explode(F.expr("sequence(0, if(main, kr, km) - 1)")).alias("other"))
    across = across.select("family", "rep", F.when(F.col("main"), F.col("own") * F.col("kr") + F.col("other")).otherwise(F.col("other") * F.col("kr") + F.col("own")).alias("block"))
    within = rows.where("not main and kr > 1").select("family", "rep", "kr", "own", F.explode(F.expr("sequence(0, kr - 1)")).alias("other")).where("own != other")
    within = within.select("family", "rep", (-1 - (F.least("own", "other") * F.col("kr") + F.greatest("own", "other"))).alias("block"))
    blocks = across.unionByName(within).join(sets.withColumnRenamed("id", "rep"), "rep")
    spread = blocks.repartition("family", "block").sortWithinPartitions("family", "block")
    more = cut(spread.mapInArrow(tidy(_closed(percent)), "a long, b long"))
    labels = components(links.union(more))

    same = real.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    groups = same.join(labels, F.col("rep") == F.col("node"), "left").select("c1", "c2", "n_shingles", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "c1", "c2").join(groups, ["c1", "c2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with the smallest id. Documents without words or id stay.

    Rows that share an id are one document and stay or go together. Only rows whose id may be among
    those that go are shuffled.
    """
    gone = cut(near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("gone_")).distinct())
    bits = IdFilter(gone)
    asked = bits.rows(docs, "doc_id", True).select(F.col("doc_id").cast("long").alias("gone_"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    return bits.rows(docs, "doc_id", False).union(restored(asked.join(gone, "gone_", "left_anti"), docs.columns))
