"""Nearest neighbours of a set of queries with a permutation index.

Pivots are drawn from the vectors by the hash of their id, about two for each root of the number of vectors and at most PIVOTS. A vector is
represented by its nearest pivots in order. It is posted in the inverted files of its first `post` pivots, and a query visits those of its first
`visit` pivots. Within a file each posting is ranked by the footrule distance of its order to the query's; those within the
region's footrule bound are reranked by their cosine. A pair that shares several files is looked at in one of them only.

post, and visit and the footrule bound by region, which is the set of vectors with the same nearest pivot, are set on the data: some queries of every
region are compared with all vectors, in one linear pass, and the settings are such that the true neighbours of every region
are found as often as `recall` asks, with something to spare. No number of candidates is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 10
#: Queries are the rows whose id is divisible by it.
EVERY = 20
RECALL = 0.95
#: Bound on the pivots, the only thing that is drawn from a sample.
PIVOTS = 2_048
#: Places of an order that are kept.
LENGTH = 64
#: Queries of each region that are compared with all vectors for the settings.
TRIALS = 3
#: Postings of a file, and queries of it, that a task handles at once; a file with more is split, by blocks of postings and lots of queries.
BLOCK, LOT = 16_384, 2_048
POSTS = (4, 8, 16)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _places(column: pa.Array) -> np.ndarray:
    """Orders as they are stored: big-endian, so that Spark can read them too."""
    return np.frombuffer(b"".join(column.to_pylist()), ">i2").astype(np.int16).reshape(len(column), -1)


def _normal(batches):
    """Unit vectors as bytes; rows with nulls, values that aren't finite, or length 0 go."""
    for b in batches:
        ids, out = [], []
        for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
            if v and i is not None and None not in v:
                x = np.array(v, np.float64)
                size = np.sqrt((x * x).sum())
                if np.isfinite(size) and size > 0:
                    ids.append(i)
                    out.append((x / size).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first; of equally near ones (to six digits) the lesser number first."""
    m = len(pivots)
    key = np.rint(-1e6 * (x @ pivots.T)).astype(np.int64) * m + np.arange(m)
    if length < m:
        key = np.partition(key, length - 1, axis=1)[:, :length]
    return (np.sort(key, axis=1) % m).astype(np.int16)


def ranks(order: np.ndarray, pivots: int) -> np.ndarray:
    """Place of each pivot in an order; its length for those that aren't in it."""
    out = np.full(pivots, len(order), np.int16)
    out[order] = np.arange(len(order), dtype=np.int16)
    return out


def footrule(rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Footrule distance of each order (a row of places) to the one that the ranks are of, over the places of the row."""
    return np.abs(rank.take(places) - np.arange(places.shape[1], dtype=np.int16)).sum(1, dtype=np.int32)


def _order(pivots: np.ndarray, length: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = orders(_vectors(part.column("v"), pivots.shape[1]), pivots, length)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(got[:, 0].astype(np.int32)), pa.array([r.tobytes() for r in got.astype(">i2")], pa.binary())], names=["id", "v", "region", "places"])

    return run


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best, best first; ties go to the lesser id."""
    keep = np.arange(len(score))
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def _lists(queries: list, far: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """(query, best): best are structs that sort best first."""
    size = np.array([len(x) for x in ids], np.int32)
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    pairs = pa.StructArray.from_arrays([pa.array(flat(far, np.float64)), pa.array(flat(ids, np.int64))], names=["far", "id"])
    best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pairs)
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), best], names=["query", "best"])


_LIST_SQL = "array<struct<far:double,id:bigint>>"


def _exact(trial_ids: np.ndarray, trials: np.ndarray, k: int):
    def run(batches):
        for b in batches:
            step = max(64, min(8192, 8_000_000 // len(trials)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = np.asarray(part.column("id"))
                score = trials @ _vectors(part.column("v"), trials.shape[1]).T
                far, near = [], []
                for i, s in zip(trial_ids, score):
                    s = np.round(s[ids != i].astype(np.float64), 6)
                    others = ids[ids != i]
                    t = _top(s, others, k)
                    far.append(-s[t])
                    near.append(others[t])
                yield _lists(trial_ids, far, near)

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """(query, best) from partial lists: the k best."""
    return lists.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _visit(k: int, pivots: int, post: int):
    def run(key, posted: pa.Table, queries: pa.Table) -> pa.Table:
        done, far, near = [], [], []
        if posted.num_rows and queries.num_rows:
            pivot = key[0].as_py()
            ids, places = np.asarray(posted.column("id")), _places(posted.column("places"))
            x = _vectors(posted.column("v"), len(posted.column("v")[0].as_py()) // 4)
            q = _vectors(queries.column("v"), x.shape[1])
            bounds, visits = np.asarray(queries.column("bound")), np.asarray(queries.column("visit"))
            for i, order, v, bound, visit in zip(np.asarray(queries.column("id")).tolist(), _places(queries.column("places")), q, bounds, visits):
                rank = ranks(order, pivots)
                # Of the files that both are in, the first in the query's order is the one that counts.
                visited = np.where(rank < visit, rank, np.int16(len(order)))
                here = np.flatnonzero((visited.take(places[:, :post]).min(1) == rank[pivot]) & (ids != i))
                if len(here):
                    d = footrule(rank, places[here])
                    # However small the bound, the k nearest of a file by footrule are looked at.
                    here = here[d <= max(bound, np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])]
                    s = np.round((x[here] @ v).astype(np.float64), 6)
                    t = _top(s, ids[here], k)
                    done.append(i)
                    far.append(-s[t])
                    near.append(ids[here[t]])
        return pa.Table.from_batches([_lists(done, far, near)])

    return run


def settings(ordered: DataFrame, wanted: DataFrame, k: int, recall: float, pivots: int) -> tuple[int, list[tuple[int, int, int]]]:
    """post, and (region, visit, footrule bound) of each region that has queries."""
    spark = ordered.sparkSession
    sizes = {r.region: r["count"] for r in ordered.groupBy("region").count().collect()}  # PIVOTS rows at most
    asked = {r.region: r["count"] for r in wanted.groupBy("region").count().collect()}
    drawn = Window.partitionBy("region").orderBy(F.xxhash64("id", F.lit(7)), "id")
    trials = wanted.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= TRIALS).collect()  # TRIALS a pivot at most
    if not trials:
        return POSTS[0], []
    vectors = np.stack([np.frombuffer(r.v, np.float32) for r in trials])
    true = _merged(ordered.select("id", "v").mapInArrow(_exact(np.array([r.id for r in trials]), vectors, k), f"query long, best {_LIST_SQL}"), k).collect()
    near = {r.query: [x.id for x in r.best] for r in true}
    ids = sorted({i for v in near.values() for i in v})  # k for each trial
    found = {r.id: np.frombuffer(r.places, ">i2").astype(np.int16) for r in ordered.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id long")), "id").select("id", "places").collect()}
    length = len(trials[0].places) // 2
    posts = sorted({min(p, length) for p in POSTS})
    # For each post the places of its order that a query must visit to meet each of its true neighbours (length + 1: it doesn't); and their footrule.
    needs: dict[int, list[np.ndarray]] = {r: [] for r in asked}
    apart: dict[int, list[int]] = {r: [] for r in asked}
    for t in trials:
        rank = ranks(np.frombuffer(t.places, ">i2").astype(np.int16), pivots)
        for i in near.get(t.id, []):
            needs[t.region].append(np.array([int(rank[found[i][:p]].min()) + 1 for p in posts]))
            apart[t.region].append(int(footrule(rank, found[i][None, :])[0]))
    spare = 1 - (1 - recall) / 2
    top = lambda x: np.quantile(x, spare, axis=0, method="higher").astype(int)
    visit = {r: top(np.stack(x)) if x else np.full(len(posts), length) for r, x in needs.items()}
    bound = {r: int(top(np.array(x))) if x else length * length for r, x in apart.items()}
    # First of all few queries in regions where even the longest visit falls short, then little work: postings met by queries, and postings made.
    rows = sum(sizes.values())
    short = [sum(asked[r] for r in asked if visit[r][j] > length) for j in range(len(posts))]
    work = [p * rows + sum(asked[r] * min(int(visit[r][j]), length) * p * rows // pivots for r in asked) for j, p in enumerate(posts)]
    j = min(range(len(posts)), key=lambda j: (short[j], work[j]))
    return posts[j], [(r, int(min(length, visit[r][j])), bound[r]) for r in asked]


def neighbours(vectors: DataFrame, *, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, pivots: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbour, similarity): of every vector whose id is divisible by `every` the k nearest of all vectors by cosine, approximately.

    - Vectors that are null, empty, of length zero, hold a null or a value that isn't finite, or have not the commonest number of
      dimensions take no part; nor do rows with a null id. Of rows that repeat an id the one with the least bytes counts.
    - Equal vectors under different ids are each other's neighbours with similarity 1. Ties go to the lesser id.
    - A table of one vector or none, or without an id to ask for, gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    unit = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_normal, "id long, v binary")
    unit = cut(unit.groupBy("id").agg(F.min("v").alias("v")))
    sizes = unit.groupBy(F.length("v").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    empty = spark.createDataFrame([], "vec_id long, rank int, neighbour long, similarity double")
    if sizes is None or sizes["count"] < 2:
        return empty
    unit = unit.where(F.length("v") == sizes.bytes)
    n = sizes["count"]
    m = min(n, PIVOTS, pivots or int(2 * n**0.5) + 8)
    # A hash range with some four times as many rows as there are pivots, so that no task sends many to the driver.
    drawn = unit if n <= 8 * m else unit.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 32)) < int((1 << 32) * 4 * m / n))
    chosen = np.stack([np.frombuffer(r.v, np.float32) for r in drawn.orderBy(F.xxhash64("id"), "id").limit(m).collect()])
    m = len(chosen)
    ordered = cut(unit.mapInArrow(_order(chosen, min(LENGTH, m)), "id long, v binary, region int, places binary"))
    wanted = ordered.where(F.col("id") % every == 0)
    post, regions = settings(ordered, wanted, k, recall, m)
    if not regions:
        return empty
    # One row a region: of the size of the pivots that the driver holds anyway.
    rule = F.broadcast(spark.createDataFrame(regions, "region int, visit int, bound int"))
    place = lambda j: F.conv(F.hex(F.substring("places", j * 2 + 1, F.lit(2))), 16, 10).cast("int")
    first = lambda size: F.explode(F.transform(F.sequence(F.lit(0), size - 1), place)).alias("pivot")
    posted = ordered.select(first(F.lit(post)), "id", "v", "places")
    queries = wanted.join(rule, "region").select(first(F.col("visit")), "id", "v", "places", "visit", "bound")
    parts = lambda df, most: df.groupBy("pivot").agg(F.ceil(F.count("*") / most).alias("parts"))
    files = parts(posted, BLOCK).select("pivot", F.col("parts").alias("blocks")).join(parts(queries, LOT).select("pivot", F.col("parts").alias("lots")), "pivot")
    files = F.broadcast(cut(files))  # one row a pivot
    some = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    # Both sides come from one table: the queries' columns get identities of their own.
    queries = queries.join(files, "pivot").select("pivot", some("blocks").alias("block"), own("lots").alias("lot"), *[F.col(c).alias(c) for c in ("id", "v", "places", "visit", "bound")])
    posted = posted.join(files, "pivot").select("pivot", own("blocks").alias("block"), some("lots").alias("lot"), "id", "v", "places")
    met = posted.groupBy("pivot", "block", "lot").cogroup(queries.groupBy("pivot", "block", "lot")).applyInArrow(_visit(k, m, post), f"query long, best {_LIST_SQL}")
    return _merged(met, k).select(F.col("query").alias("vec_id"), F.posexplode("best").alias("rank", "b")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("neighbour"), F.round(-F.col("b.far"), 5).alias("similarity"))
