"""Vector bin packing of training examples.

Every example has three sizes: tokens, segments and loss-bearing tokens; a pack has a limit on the sum of each.
Packs are filled one at a time: of the remaining examples that still fit, the one whose sizes (as shares of the limits)
have the largest dot product with what is left of the pack goes in, so that a pack short of tokens but rich in loss
budget draws the examples that match. Pieces are spread by the hash of their id over groups of about `group_rows`, each packed by
itself, so that the work is linear in the examples. Packs that a group could not fill are opened again and their pieces meet those of other groups, until one group holds all that is left.

An example that exceeds a limit is cut where the limit is reached; no token is lost. The sizes of the pieces are counted from its turns.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PATTERN, cut, slices

TOKENS, SEGMENTS, LOSS = 4096, 24, 3072
GROUP_ROWS = 5_000
#: Turn numbers that are gathered in one row.
TURNS = 4_096
#: Share of a limit from which a pack counts as filled; packs below it in all three are opened again.
FULL = 0.8
#: Rows of too large groups that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _counter(path: str):
    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        code = tiktoken.Encoding("count", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            for part in slices(b, "text"):
                n = [len(code.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64())], names=[*part.schema.names[1:], "n_tokens"])

    return run


def count_tokens(df: DataFrame, text: Column, *columns: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns and n_tokens, the number of tokens of the text; 0 for null."""
    seen = df.select(text.alias("text"), *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema[1:])
    return seen.mapInArrow(_counter(tokenizer), f"{schema}, n_tokens long")


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The pack number of each row of sizes; every row must fit an empty pack. Ties go to the earlier row."""
    share = sizes / limits
    left = np.arange(len(sizes))
    out = np.full(len(sizes), -1)
    pack = 0
    while len(left):
        room, used = limits.astype(np.int64).copy(), np.zeros(len(left), bool)
        own_sizes, own_share = sizes[left], share[left]
        fits = (own_sizes <= room).all(1)
        while True:
            if not fits.any():
                break
            score = np.where(fits, own_share @ (room / limits), -1.0)
            best = int(score.argmax())
            used[best] = True
            room -= own_sizes[best]
            fits &= (own_sizes <= room).all(1)
            fits[best] = False
        out[left[used]] = pack
        left = left[~used]
        pack += 1
    return out


def _packer(limits: tuple[int, int, int]):
    limit = np.array(limits, dtype=np.int64)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("__order", "piece", "first_token", "n_tokens", "n_segments", "n_loss")])
        sizes = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in ("n_tokens", "n_segments", "n_loss")], axis=1)
        packs = fill(sizes, limit)
        sums = np.stack([np.bincount(packs, sizes[:, k]) for k in range(3)], axis=1)
        # What no limit stopped may still take pieces of other groups.
        full = (sums >= FULL * limit).any(1)
        return t.append_column("pack", pa.array(packs, pa.int64())).append_column("full", pa.array(full[packs])).select([*_OUT, "full"])

    return run


_OUT = ["group", "pack", "example", "piece", "first_token", "n_tokens", "n_segments", "n_loss"]
_OUT_SCHEMA = "group long, pack long, example long, piece long, first_token long, n_tokens long, n_segments long, n_loss long"


def cut_turns(turns: Iterable[tuple[int, bool]], limits: tuple[int, int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(first token, tokens, segments, loss tokens) of each piece of an example with the turns (tokens, loss).

    A piece ends where the next token or turn would exceed a limit; a turn that is cut is a segment of each piece that it reaches into.
    """
    tokens, segments, loss = limits
    first, n, s, k = 0, 0, 0, 0
    for size, own in turns:
        rest = size
        while True:
            take = min(rest, tokens - n, loss - k if own else rest)
            if s < segments and (take or not rest):
                n, s, k, rest = n + take, s + 1, k + take * own, rest - take
                if not rest:
                    break
            yield first, n, s, k
            first, n, s, k = first + n, 0, 0, 0
    yield first, n, s, k


def _cutter(limits: tuple[int, int, int]):
    def rows(batches):
        for b in batches:
            for example, piece, first, turns in zip(*[b.column(c).to_pylist() for c in ("example", "piece", "first_token", "turns")]):
                every = ((max(0, t["n_tokens"] or 0), bool(t["loss"])) for t in turns or [] for _ in range(t["times"]))
                for i, (at, *sizes) in enumerate(cut_turns(every, limits)):
                    yield example, piece + i, first + at, *sizes

    def run(batches):
        got = rows(batches)
        while part := list(islice(got, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=_PIECE)

    return run


_PIECE = ["example", "piece", "first_token", "n_tokens", "n_segments", "n_loss"]


def pack(examples: DataFrame, *, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Packs (example, turns) or (example, n_tokens, n_segments, n_loss): (group, pack, example, piece, first_token, sizes), one row a piece.

    - (group, pack) names a pack. The sizes of a pack's rows stay within the limits in sum.
    - turns are structs (n_tokens, loss, times) in order, each taken `times` times. An example that exceeds a limit is cut where it is reached, and each piece
      has the loss tokens and the segments of the turns that it spans; a cut turn counts as a segment in each of its pieces.
    - Without turns it isn't known where the loss lies: an example over a limit becomes equal pieces, of which each has an equal share of
      the loss and the segments that it touches if they are of equal length.
    - Null sizes count as 0; n_loss is at most n_tokens; examples without tokens take their segments and no more.
    - Repeated examples are packed each; a null example id is an id like others. An empty table gives an empty result. Other columns are ignored.
    - Ties in the heuristic go to the example with the lesser hash of its id, then to the lesser piece and sizes.
    - However many pieces an example of any length has, each is a row of its own.
    """
    limits = tokens, segments, loss
    if min(limits) < 1:
        raise ValueError("every limit of a pack must be 1 or more")
    if "turns" in examples.columns:
        zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in examples.columns else F.lit(0).cast("long")
        turns = F.transform("turns", lambda t: F.struct(t["n_tokens"].alias("n_tokens"), t["loss"].alias("loss"), t["times"].alias("times")))
        pieces = examples.select(F.col("example").cast("long").alias("example"), zero("piece").alias("piece"), zero("first_token").alias("first_token"), turns.alias("turns")).mapInArrow(_cutter(limits), ", ".join(f"{c} long" for c in _PIECE))
    else:
        pieces = _even(examples, limits)
    left, done, base = cut(pieces), [], 0
    while True:
        # Texts were read and tokenized above; from here on rows are six numbers.
        n = left.count()
        groups = max(1, -(-n // group_rows))
        packed = cut(_grouped(left, groups, group_rows).groupBy("group").applyInArrow(_packer(limits), f"{_OUT_SCHEMA}, full boolean")).withColumn("group", F.col("group") + base)
        open_rows = packed.where("not full").count() if groups > 1 else 0
        # Without a group less than in this round there is nothing to gain from another.
        if -(-open_rows // group_rows) >= groups or not open_rows:
            parts = [*done, packed.drop("full")]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        done.append(packed.where("full").drop("full"))
        left, base = packed.where("not full").select(*_PIECE), base + (1 << 40)


def _grouped(pieces: DataFrame, groups: int, group_rows: int) -> DataFrame:
    """Adds __order, the hash of the id, and group. A group that repeated or null ids make too large is split by the rows' places in the written table."""
    hashed = pieces.withColumn("__order", F.xxhash64(F.coalesce("example", F.lit(-1)), "piece")).withColumn("group", F.pmod(F.col("__order"), F.lit(groups)))
    large = hashed.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 2 * group_rows).select(F.col("group").alias("__g"), F.ceil(F.col("n") / group_rows).alias("__parts"))
    large = cut(large)  # groups by hash are of a size: only ids that repeat make one large, so that there are at most rows / (2 x group_rows) of them
    count = large.count()
    if not count:
        return hashed
    if count <= BROADCAST_ROWS:
        large = F.broadcast(large)
    split = hashed.withColumn("__at", F.monotonically_increasing_id()).join(large, F.col("group") == F.col("__g"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("__at"), F.col("__parts")), F.lit(0))
    return split.withColumn("group", F.col("group") + part * groups).drop("__at", "__g", "__parts")


def _even(examples: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """Pieces of examples of which only the sizes are known."""
    tokens, segments, loss = limits
    n = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    e = examples.select(F.col("example").cast("long").alias("example"), n("n_tokens").alias("n_tokens"), n("n_segments").alias("n_segments"), F.least(n("n_loss"), n("n_tokens")).alias("n_loss"))
    up = lambda c, most: F.ceil(F.col(c) / most)
    e = e.withColumn("parts", F.greatest(F.lit(1), up("n_tokens", tokens), up("n_loss", loss), up("n_segments", segments)))
    # A piece may touch one segment more than its share.
    e = e.withColumn("parts", F.when(F.col("parts") > 1, F.greatest("parts", up("n_segments", max(1, segments - 1)))).otherwise(F.col("parts")))
    e = e.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Piece k has the k-th share of each size; shares differ by one at most, so that none exceeds its limit.
    at = lambda c, k: F.floor(F.col(c) * k / F.col("parts"))
    share = lambda c: (at(c, F.col("piece") + 1) - at(c, F.col("piece"))).alias(c)
    touched = F.least(F.lit(segments), F.ceil(F.col("n_segments") * (F.col("piece") + 1) / F.col("parts")) - at("n_segments", F.col("piece"))).alias("n_segments")
    return e.select("example", "piece", at("n_tokens", F.col("piece")).alias("first_token"), share("n_tokens"), touched, share("n_loss"))


def conversation_examples(conversations: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(example, piece, first_token, turns) of each conversation: its turns in order; a segment a turn, and the assistant's tokens as loss-bearing ones.

    - Null texts have no tokens; a null role bears no loss. A turn with a null conv_id is a conversation of its own; a null turn number comes first.
    - Turns are gathered by runs of TURNS turn numbers, each a row with the number of its first piece and its first token, so that no conversation, however
      long, is one row; equal turns that repeat are counted, not listed. An empty table gives an empty result.
    """
    own = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns = count_tokens(conversations, F.col("text"), F.col("conv_id").cast("long").alias("example"), F.col("turn").cast("long").alias("turn"), own.alias("own"), tokenizer=tokenizer)
    counted = turns.withColumn("alone", F.when(F.col("example").isNull(), F.monotonically_increasing_id())).groupBy("example", "alone", "turn", "n_tokens", "own").agg(F.count("*").alias("times"))
    run = counted.withColumn("run", F.floor(F.coalesce("turn", F.lit(0)) / TURNS)).groupBy("example", "alone", "run").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "n_tokens", F.col("own").alias("loss"), "times"))).alias("turns")
    )
    before = Window.partitionBy("example", "alone").orderBy("run")
    return run.select(
        "example", (F.row_number().over(before).cast("long") - 1).alias("k"), (F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first_token"), "turns"
    ).select("example", (F.col("k") * (1 << 32)).alias("piece"), "first_token", "turns")


def document_examples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One example a document: a single segment whose tokens all bear loss.

    Null and empty texts have no tokens. Null ids are ids like others, repeated rows are examples each; an empty table gives an empty result.
    """
    counted = count_tokens(docs, F.col(text_col), F.col(id_col).cast("long").alias("example"), tokenizer=tokenizer)
    return counted.select("example", F.array(F.struct("n_tokens", F.lit(True).alias("loss"), F.lit(1).alias("times"))).alias("turns"))
