"""Interpolated modified Kneser-Ney language model over characters.

Characters are symbols of 12 bits: code points below 2,048 stand for themselves, others are hashed into 2,046 more; two
symbols mark the start and the end of a text. So characters of Han, kana, Hangul and other scripts share symbols, and texts of them may be
taken for each other. A 5-gram is 60 bits, and the stored hash of an n-gram of symbols (a bijection of those bits) never collides. Tasks count the 5-grams of their texts, Spark adds them up; lower orders hold continuation
counts: the number of different symbols before an n-gram; n-grams that begin with a text's start hold raw counts. Three discounts an order come from the counts of counts.

The model is stored as arrays sorted by hash in the folder that all workers share: for each order the discounted probabilities
of the n-grams, and the weights that their contexts leave to the next lower order. Workers map the files into memory.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, new_folder, slices

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
START, END = SYMBOLS - 2, SYMBOLS - 1
#: n-grams in a file, about.
FILE_ROWS = 2_000_000
#: n-grams that a counting task holds before it emits them.
HOLD = 3_000_000


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of symbols, each with ORDER-1 starts before and an end after it; and the length of each with its end."""
    codes = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, count=len(texts))
    ids = np.where(codes < 2048, codes, 2048 + (mix64(codes.astype(np.uint64)) % np.uint64(SYMBOLS - 2050)).astype(np.int64))
    ends = np.cumsum(size)
    ids[ends - 1] = END
    pad = ORDER - 1
    out = np.full(len(ids) + pad * len(texts), START, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(1, len(texts) + 1) * pad, size)] = ids
    return out, size


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character and at each text's end, and the number of them in each text."""
    ids, size = symbols(texts)
    n = len(ids) - ORDER + 1
    key = np.zeros(n, np.int64)
    for j in range(ORDER):
        key = key << BITS | ids[j : j + n]
    # Windows that end within a text's starts belong to none.
    keep = ids[ORDER - 1 :] != START
    return key[keep], size


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _count(batches):
    keys, counts, held = [], [], 0

    def emit(k, c):
        for at in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 100_000]), pa.array(c[at : at + 100_000])], names=["key", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t for t in part.column("text").to_pylist() if t is not None]
            if not texts:
                continue
            k = np.sort(keys_of(texts)[0])
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys.append(k[first])
            counts.append(np.diff(np.concatenate([first, [len(k)]])))
            held += len(first)
            if held > HOLD:
                k, c = _sum(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > HOLD // 2:
                    yield from emit(k, c)
                    keys, counts, held = [], [], 0
    if keys:
        yield from emit(*_sum(keys, counts))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts; 0.5, 1, 1.5 where there are too few to estimate them."""
    got = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [0, got.n1, got.n2, got.n3, got.n4]
    if not all(n[1:]):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [max(0.01, min(k, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3)]


def _write(folder: str, name: str, bits: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        parts = [(np.asarray(b.column("key")), np.asarray(b.column("v"))) for b in batches if b.num_rows]
        if not parts:
            return
        h = mix64(np.concatenate([k for k, _ in parts]).astype(np.uint64))
        v = np.concatenate([x for _, x in parts]).astype(np.float32)
        order = np.argsort(h)
        stem = f"{name}-{int(h[0] >> np.uint64(64 - bits)) if bits else 0:06d}"
        for what, a in (("hash", h[order]), ("value", v[order])):
            # Written aside and renamed: a second attempt at the task puts the same file in the same place.
            aside = os.path.join(folder, f".{stem}.{what}.{task.taskAttemptId()}")
            with open(aside, "wb") as f:
                np.save(f, a)
            os.replace(aside, os.path.join(folder, f"{stem}.{what}.npy"))
        yield pa.RecordBatch.from_pydict({"stem": [stem], "n": [len(h)]}, schema=pa.schema([("stem", pa.string()), ("n", pa.int64())]))

    return run


def _store(df: DataFrame, folder: str, name: str, n: int) -> list[str | None]:
    """Writes (key, v) as files sorted by hash, a power of two of them: the file is named by the leading bits of its keys' hashes."""
    bits = max(0, (max(1, -(-n // FILE_ROWS)) - 1).bit_length())
    got = df.mapInArrow(_lead(bits), "key long, v double, lead int").repartitionById(1 << bits, "lead").mapInArrow(_write(folder, name, bits), "stem string, n long").collect()
    stems = {int(r.stem.rpartition("-")[2]): r.stem for r in got}
    return [stems.get(i) for i in range(1 << bits)]


def _lead(bits: int):
    def run(batches):
        for b in batches:
            h = mix64(np.asarray(b.column("key")).astype(np.uint64))
            lead = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(b.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(lead)], names=["key", "v", "lead"])

    return run


def train(docs: DataFrame, *, text_col: str = "text") -> str:
    """Counts the texts of docs and stores the model; returns its folder.

    Null texts don't count; an empty text is one end. Repeated rows count each. A table without texts gives a uniform model.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    counts = cut(docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")))
    meta = {"order": ORDER, "files": {}}
    for n in range(ORDER, 0, -1):
        d = _discounts(counts)
        cost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        kept = counts.withColumn("h", F.shiftright("key", BITS))
        contexts = cut(kept.groupBy("h").agg(F.sum("c").alias("total"), F.sum(cost).alias("lost")))
        grams = kept.join(contexts, "h").select("key", ((F.col("c") - cost) / F.col("total")).alias("v"))
        size = counts.count()
        meta["files"][f"p{n}"] = _store(grams, folder, f"p{n}", size)
        meta["files"][f"g{n}"] = _store(contexts.select(F.col("h").alias("key"), (F.col("lost") / F.col("total")).alias("v")), folder, f"g{n}", contexts.count())
        if n > 1:
            mask = (1 << BITS * (n - 1)) - 1
            lower = F.col("key").bitwiseAND(F.lit(mask))
            # Nothing stands before a text's start: n-grams that begin there keep their raw counts.
            first = F.shiftright(lower, BITS * (n - 2)) == START
            counts = cut(counts.select(lower.alias("key"), F.when(first, F.col("c")).otherwise(1).alias("c")).groupBy("key").agg(F.sum("c").alias("c")))
    with open(os.path.join(folder, "model.json"), "w") as f:
        json.dump(meta, f)
    return folder


class Table:
    """Sorted hash arrays in mapped files. The leading bits of a key's hash name its file, so that each key is sought in one."""

    def __init__(self, folder: str, stems: list[str | None]):
        self.bits = len(stems).bit_length() - 1
        self.parts = [s and tuple(np.load(os.path.join(folder, f"{s}.{w}.npy"), mmap_mode="r") for w in ("hash", "value")) for s in stems]

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        h = mix64(keys.astype(np.uint64))
        order = np.argsort(h)
        sorted_h = h[order]
        found = np.full(len(h), default, np.float64)
        edges = np.searchsorted(sorted_h, np.arange(1, len(self.parts), dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else []
        for part, a, b in zip(self.parts, [0, *edges], [*edges, len(h)]):
            if part is None or a == b:
                continue
            hashes, values = part
            own = sorted_h[a:b]
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            hit = hashes[at] == own
            found[order[a:b][hit]] = values[at[hit]]
        return found


class Model:
    def __init__(self, folder: str):
        meta = json.load(open(os.path.join(folder, "model.json")))
        self.tables = {k: Table(folder, stems) for k, stems in meta["files"].items()}
        # Log probabilities of ORDER-grams met before, by a part of their hash.
        self.slots = np.full(1 << 20, -1, np.int64)
        self.known = np.zeros(1 << 20, np.float64)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """ln p(last symbol | the symbols before) of each ORDER-gram."""
        p = np.full(len(keys), 1.0 / SYMBOLS)
        for n in range(1, ORDER + 1):
            part = keys & ((1 << BITS * n) - 1)
            p = self.tables[f"p{n}"].get(part, 0.0) + self.tables[f"g{n}"].get(part >> BITS, 1.0) * p
        return np.log(p)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ln probability and number of symbols of each text."""
        keys, size = keys_of(texts)
        slot = (mix64(keys.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        value = self.known[slot]
        miss = np.flatnonzero(self.slots[slot] != keys)
        if len(miss):
            fresh, back = np.unique(keys[miss], return_inverse=True)
            got = self.log_probability(fresh)
            value[miss] = got[back]
            s = (mix64(fresh.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.slots[s], self.known[s] = fresh, got
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        return np.add.reduceat(value, starts), size


def _score(folder: str):
    def run(batches):
        model = Model(folder)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None]
                logp, n = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
                if some:
                    logp[some], n[some] = model.score([texts[i] for i in some])
                null = np.isnan(logp)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(np.round(logp, 4), mask=null), pa.array(np.round(np.exp(-logp / np.maximum(n, 1)), 6), mask=null)], names=["doc_id", "n_symbols", "log_prob", "perplexity"])

    return run


def perplexities(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) of every row under the model in folder.

    A null text has no symbols and null scores; an empty one has its end. Repeated rows are scored each; whole texts count. An empty table gives an
    empty result; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(folder), "doc_id long, n_symbols long, log_prob double, perplexity double")


def corpus_perplexities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document under the model of all documents."""
    return perplexities(docs, train(docs, text_col=text_col), id_col=id_col, text_col=text_col)
