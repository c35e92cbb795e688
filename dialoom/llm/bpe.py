"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a slice of texts are laid out in one array of symbols. An index maps each adjacent pair to
all its positions in the array. Active ranks, those of pairs that occur, are taken in ascending order: all positions
of the pair merge at once, and the lists of the pairs to the left and right are updated. A merge can only make pairs of
higher rank (checked as the vocabulary is read), so that each rank is taken once.
Pieces that a worker has already encoded are kept in a table.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PATTERN, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Encoded pieces that a worker remembers.
REMEMBER = 400_000
UNKNOWN = "\ufffd".encode()


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Vocabulary:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.byte_id = np.array([ids[letters[b]] for b in range(256)], np.int64)
        # All tokens' bytes in one array, so that lists of ids are spelled without a step in Python for each; the last stands for unknown ids.
        parts = [self.bytes.get(i, UNKNOWN) for i in range(max(self.bytes, default=-1) + 1)] + [UNKNOWN]
        self.size = np.array([len(p) for p in parts], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.letters = np.frombuffer(b"".join(parts), np.uint8)
        self.merges: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = ids[a], ids[b], ids[a + b]
            if max(made.get(x, -1), made.get(y, -1)) >= r:
                raise ValueError(f"merge {r} uses a token that a later merge makes")
            made.setdefault(z, r)
            self.rank[x << 32 | y] = r
            self.merges[r] = x << 32 | y, z

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The token ids of each piece."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter((len(p) for p in pieces), np.int64, count=len(pieces))
        ends = np.cumsum(size)
        sym = self.byte_id[data].tolist()
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for e in ends.tolist():
            if e < n:
                before[e] = -1
            after[e - 1] = -1
        index: dict[int, list[int]] = {}
        rank, heap = self.rank, []

        def note(i: int, j: int) -> None:
            r = rank.get(sym[i] << 32 | sym[j])
            if r is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(heap, r)

        # The first index: all adjacent pairs, ranked with one lookup for each distinct pair.
        keys = np.array(sym[:-1], np.int64) << 32 | np.array(sym[1:], np.int64)
        whole = np.ones(n - 1, bool) if n > 1 else np.zeros(0, bool)
        whole[ends[:-1] - 1] = False
        at = np.flatnonzero(whole)
        if len(at):
            order = at[np.argsort(keys[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for group in np.split(order, cuts):
                r = rank.get(int(keys[group[0]]))
                if r is not None:
                    index[r] = group.tolist()
                    heapq.heappush(heap, r)
        while heap:
            r = heapq.heappop(heap)
            key, made = self.merges[r]
            a, b = key >> 32, key & 0xFFFFFFFF
            for i in sorted(index.pop(r)):
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # the pair has gone into another merge
                sym[i], sym[j] = made, -1
                k = after[j]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    note(i, k)
                h = before[i]
                if h >= 0:
                    note(h, i)
        ids = np.array(sym)
        kept = ids >= 0
        counts = np.add.reduceat(kept.astype(np.int64), ends - size)
        return [x.tolist() for x in np.split(ids[kept], np.cumsum(counts)[:-1])]

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids in a row, and the offsets of each id's among them. An id that isn't in the vocabulary is spelled U+FFFD."""
        ids = np.where((ids < 0) | (ids >= len(self.size)), len(self.size) - 1, ids)
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.arange(upto[-1], dtype=np.int32) + np.repeat(self.start[ids] - upto[:-1].astype(np.int32), size)
        return self.letters[at].tobytes(), upto


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, and keeps the tokens of pieces it has met in one growing array."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and token ids of the texts."""
        if len(self.number) > REMEMBER:
            self.forget()
        number = self.number
        pieces = [self.split(t) for t in texts]
        new = {p for row in pieces for p in row if p not in number}
        if new:
            fresh = sorted(new)
            got = self.vocabulary.encode_pieces([p.encode("utf-8") for p in fresh])
            for p in fresh:
                number[p] = len(number)
            self.flat = np.concatenate([self.flat, np.fromiter((x for g in got for x in g), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(g) for g in got])])
        at = np.fromiter((number[p] for row in pieces for p in row), np.int64)
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
        rows = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        return upto[rows], self.flat[take]


def _encode(path: str):
    def run(batches):
        code = Encoder(path)
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                texts = part.column("text")
                offsets, ids = code.encode([t or "" for t in texts.to_pylist()])
                rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), rows], names=["doc_id", "n_tokens", "token_ids"])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row.

    A null text gives null ids and no tokens, an empty one an empty list. Texts are encoded whole; strings that name
    special tokens are ordinary text. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(path), "doc_id long, n_tokens long, token_ids array<int>")


def _decode(path: str):
    def run(batches):
        words = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = []
                for i in range(part.num_rows):
                    ids = part.column("token_ids")[i]
                    flat = None if ids.values is None else np.asarray(ids.values.fill_null(-1))
                    # Bytes that aren't UTF-8 give U+FFFD.
                    texts.append(None if flat is None else words.spell(flat)[0].decode("utf-8", errors="replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids).

    A null list gives a null text, an empty one an empty text; ids that the vocabulary hasn't, and nulls in a list, give U+FFFD each. Repeated rows give
    repeated rows, lists of any length are decoded whole; an empty table gives an empty result. Other columns are ignored.
    """
    return tokens.select("doc_id", "token_ids").mapInArrow(_decode(path), "doc_id long, text string")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, gives_back) of every row: encode, and whether the ids decode to the text; null for a null text."""

    def run(batches):
        code, words = Encoder(path), vocabulary(path)
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                texts = part.column("text")
                offsets, ids = code.encode([t or "" for t in texts.to_pylist()])
                rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)
                spelled, upto = words.spell(ids)
                ends = upto[offsets].tolist()
                same = [None if t is None else spelled[a:z] == t for t, a, z in zip(texts.cast(pa.binary()).to_pylist(), ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), rows, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "token_ids", "gives_back"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, gives_back boolean")
