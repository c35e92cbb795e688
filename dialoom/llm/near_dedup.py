"""MinHash near-dedup with an LSH forest.

A document's signature holds, for each of 64 hash functions, the least hash over its word pairs. Each tree
of the forest is one order of the signatures: the signature rotated to start at the tree's own slots and
sorted. Documents that share a long common prefix in an order stand next to each other there, so that the
candidates are the neighbours in each order: linear in the documents, with no cap on a group's size.
Documents with equal signatures are joined first and stand in the orders as one, so that copies don't fill a window.
A pair in a window, however long the prefix it shares, is a candidate if its whole signatures agree in `threshold` of the slots, less
three standard deviations of that estimate. It counts if the Jaccard similarity of the word pairs, taken from both texts, is `threshold` or more.
Connected documents form a group; the least doc_id stands for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, slices, words

SLOTS = 64
TREES = 8
THRESHOLD = 0.5
#: Neighbours on each side in an order.
REACH = 3
#: Signatures in a range task, about.
TASK_ROWS = 400_000

_SEEDS = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _pair_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the word pairs of all texts that have a word, and the number of words of each text."""
    import xxhash

    offsets, at, distinct = words(texts)
    size = np.diff(offsets)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(distinct))[at]
    pair = h.copy()
    pair[:-1] = mix64(h[:-1] * np.uint64(31) + h[1:])
    # The last word of a text with others would pair with the next text: it repeats the pair before instead.
    ends = offsets[1:][size > 1] - 1
    pair[ends] = pair[ends - 1]
    alone = offsets[:-1][size == 1]
    pair[alone] = h[alone]
    return pair, size


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its signature (SLOTS values of 16 bits, big-endian) and whether it has any word."""
    pair, size = _pair_hashes(texts)
    out = np.zeros((len(size), SLOTS), dtype=">u2")
    if not len(pair):
        return out, size > 0
    some = size > 0
    starts = (np.cumsum(size) - size)[some]
    low = np.empty((int(some.sum()), SLOTS), dtype=np.uint64)
    for j in range(SLOTS):
        x = pair * _SEEDS[j]
        x ^= x >> np.uint64(32)
        low[:, j] = np.minimum.reduceat(x, starts)
    out[some] = (mix64(low.ravel()).reshape(low.shape) >> np.uint64(48)).astype(np.uint16)
    return out, some


def _sign(batches):
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            sig, some = signatures_of(part.column("text"))
            ids = part.column("doc_id").filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in sig[some]], pa.binary())], names=["doc_id", "sig"])


def _shingles(batches):
    """The distinct word pairs of each text, as sorted hashes."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            pair, size = _pair_hashes(part.column("text"))
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([np.unique(pair[e - n : e]).tobytes() for n, e in zip(size, ends)], pa.binary())], names=["id", "shingles"])


def _verify(threshold: float):
    """Pairs whose Jaccard similarity is the threshold or more."""

    def alike(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= threshold * (len(x) + len(y) - both) - 1e-9

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ok = [alike(x.as_py(), y.as_py()) for x, y in zip(part.column("sa"), part.column("sb"))]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(pairs: DataFrame, docs: DataFrame, *, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts in docs (doc_id, text) reach the threshold; of an id with several texts any of them may."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.where("text is not null").join(ids, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    sets = cut(texts.select(F.col("doc_id").alias("id"), F.explode("texts").alias("text")).mapInArrow(_shingles, "id long, shingles binary"))
    of = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_verify(threshold), "a long, b long").distinct()


def _least(threshold: float) -> int:
    """Equal slots from which a pair is a candidate: an estimate at the threshold falls short of it once in a thousand times."""
    return max(1, int(np.ceil(threshold * SLOTS - 3 * np.sqrt(threshold * (1 - threshold) * SLOTS) - 1e-9)))


def _walk(need: int, reach: int):
    def pairs(sig: np.ndarray, tree: np.ndarray, ids: np.ndarray, fresh: int):
        """Candidate pairs of rows at most `reach` apart, of which the later one is at `fresh` or after."""
        for d in range(1, min(reach, len(ids) - 1) + 1):
            ok = ((sig[:-d] == sig[d:]).sum(1) >= need) & (tree[:-d] == tree[d:])
            ok[: max(0, fresh - d)] = False
            i = np.flatnonzero(ok)
            yield from zip(ids[i].tolist(), ids[i + d].tolist())

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        keep = None
        found: set[tuple[int, int]] = set()
        head = None

        def flush():
            n = len(found)
            a, b = zip(*found)
            got = pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * n, pa.binary())], names=_NAMES)
            found.clear()
            return got

        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=">u2").reshape(-1, SLOTS).astype(np.uint16)
                tree, ids = np.asarray(part.column("tree")), np.asarray(part.column("doc_id"))
                fresh = 0
                if keep is not None:
                    fresh = len(keep[2])
                    sig, tree, ids = np.concatenate([keep[0], sig]), np.concatenate([keep[1], tree]), np.concatenate([keep[2], ids])
                if head is None or len(head[2]) < reach:
                    head = sig[:reach].copy(), tree[:reach].copy(), ids[:reach].copy()
                found.update((min(x, y), max(x, y)) for x, y in pairs(sig, tree, ids, fresh))
                keep = sig[-reach:].copy(), tree[-reach:].copy(), ids[-reach:].copy()
                if len(found) > 200_000:
                    yield flush()
        if found:
            yield flush()
        if keep is not None:
            # The rows at both edges of the task, for pairs that lie across two tasks.
            for side, (s, t, i) in ((1, head), (2, keep)):
                k = len(i)
                yield pa.RecordBatch.from_arrays([pa.array([pid] * k, pa.int32()), pa.array([side] * k, pa.int32()), pa.array(t.astype(np.int32)), pa.array(np.arange(k) if side == 1 else np.arange(k) - k, pa.int64()), pa.array(i.astype(np.int64)), pa.array([r.astype(">u2").tobytes() for r in s], pa.binary())], names=_NAMES)

    return run


_NAMES = ["pid", "side", "tree", "a", "b", "sig"]
_FOUND = "pid int, side int, tree int, a long, b long, sig binary"


def edges(docs: DataFrame, *, id_col: str, text_col: str, trees: int, threshold: float, reach: int) -> DataFrame:
    """(a, b), a < b: pairs that reach the threshold, and copies with the least id of their signature."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = cut(texts.mapInArrow(_sign, "doc_id long, sig binary"))
    need = _least(threshold)
    # Of each signature the least id stands in the orders; the others are joined to it here.
    kinds = cut(signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    copies = signed.join(kinds.withColumnRenamed("doc_id", "first"), "sig").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    step = SLOTS // trees * 2
    spread = kinds.select(F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), "doc_id", "sig").select(
        "tree", F.concat(F.expr(f"substring(sig, tree * {step} + 1)"), F.expr(f"substring(sig, 1, tree * {step})")).alias("sig"), "doc_id"
    )
    n = kinds.count() * trees
    ranged = spread.repartitionByRange(max(1, min(12, -(-n // 20_000)) if n <= 12 * TASK_ROWS else -(-n // TASK_ROWS)), "tree", "sig", "doc_id").sortWithinPartitions("tree", "sig", "doc_id")
    found = cut(ranged.mapInArrow(_walk(need, reach), _FOUND))
    inner = found.where("side = 0").select("a", "b")
    # Edge rows: the last rows of a task against the first ones of the next task that has any. Two small rows a task.
    rim = found.where("side > 0")
    tasks = rim.select("pid").distinct().withColumn("next", F.lead("pid").over(Window.orderBy("pid")))
    left = rim.where("side = 2").join(tasks, "pid").select("next", F.col("a").alias("lk"), F.col("tree").alias("lt"), F.col("b").alias("la"), F.col("sig").alias("ls"))
    right = rim.where("side = 1").select(F.col("pid").alias("next"), F.col("a").alias("rk"), F.col("tree").alias("rt"), F.col("b").alias("ra"), F.col("sig").alias("rs"))
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    equal = F.size(F.filter(slots, lambda i: F.substring(F.hex("ls"), i * 4 + 1, F.lit(4)) == F.substring(F.hex("rs"), i * 4 + 1, F.lit(4))))
    across = left.join(right, "next").where("lt = rt and la <> ra").where(F.col("rk") - F.col("lk") <= reach).where(equal >= need)
    across = across.select(F.least("la", "ra").alias("a"), F.greatest("la", "ra").alias("b"))
    candidates = cut(inner.unionByName(across).where("a <> b").distinct())
    # Equal signatures need no look at the texts: at a similarity of 0.5 they have a chance of 2^-64.
    return verified(candidates, texts, threshold=threshold).unionByName(copies.where("a <> b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(member, root) for every id in the pairs (a, b): root is the least id that it is connected to.

    Alternates large-star and small-star steps, each one shuffle, until nothing changes; every step is
    written to the shared folder, so that a lost executor costs one step at most.
    """
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by = Window.partitionBy("a")
        large = both.withColumn("m", F.least("a", F.min("b").over(by))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.withColumn("m", F.min("b").over(by))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = cut(small)
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            return now.select(F.col("a").alias("member"), F.col("b").alias("root"))
        before = mark


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """(doc_id, duplicate_of): one row for each document that is not the one kept of its group.

    - duplicate_of is the least id of the group; groups are the connected components of pairs that reach the threshold.
    - Rows with a null id, and texts that are null or have no word, belong to no group.
    - Rows that repeat an id are one document. An empty table gives an empty result.
    - Texts count whole, whatever their length; a text of one word has that word as its only shingle.
    - Other columns are ignored, whatever their names. Pairs are sought by one rule within and across tasks, so that their number changes nothing.
    """
    found = edges(docs, id_col=id_col, text_col=text_col, trees=trees, threshold=threshold, reach=reach)
    return components(found).select(F.col("member").alias(id_col), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs without the rows that near_duplicates names; columns stay as they are, whatever their names.

    Rows with a null id stay, and rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).select(F.col(id_col).alias("__gone"))
    d = docs.select(F.col(id_col).cast("long").alias("__id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    left = d.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
