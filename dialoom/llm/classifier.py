"""Quality classifier: a sparse rule ensemble over text statistics.

Small regression trees are boosted on labelled documents; every path from a root to a node is a rule, a conjunction of
comparisons of statistics. A logistic model with an L1 penalty weighs the rules; those that keep a weight are compiled into one
Spark column expression, so that scoring runs in the JVM over the statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import measured

NAMES = ("symbols", "capitals", "repeats", "digits", "word_size", "chars", "words", "lines")
#: Bound on the labelled documents for the fit, chosen by the hash of their id; all that is fitted on a sample.
SAMPLE = 20_000
TREES, DEPTH, LEAF, RATE = 40, 3, 5, 0.2
PENALTY = 0.002
THRESHOLD = 0.5


def _grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: list, pred: np.ndarray) -> None:
    """Splits rows by least squares of g; appends each node's path to rules and writes the leaves' means to pred."""
    if path:
        rules.append(path)
    best = (1e-12, None)
    if depth and len(rows) >= 2 * LEAF:
        total, n = g[rows].sum(), len(rows)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(g[order])
            k = np.arange(1, n)
            gain = c[:-1] ** 2 / k + (total - c[:-1]) ** 2 / (n - k) - total**2 / n
            gain[(v[1:] == v[:-1]) | (k < LEAF) | (n - k < LEAF)] = -1
            i = int(gain.argmax()) if n > 1 else 0
            if n > 1 and gain[i] > best[0]:
                best = (gain[i], (f, (int(v[i]) + int(v[i + 1])) // 2))
    if best[1] is None:
        pred[rows] = g[rows].mean() if len(rows) else 0.0
        return
    f, at = best[1]
    left = x[rows, f] <= at
    _grow(x, g, rows[left], depth - 1, (*path, (f, "<=", at)), rules, pred)
    _grow(x, g, rows[~left], depth - 1, (*path, (f, ">", at)), rules, pred)


def tighten(path: tuple) -> tuple:
    """The path with one comparison for each statistic and direction."""
    least: dict = {}
    for f, op, at in path:
        key = f, op
        least[key] = at if key not in least else (min if op == "<=" else max)(least[key], at)
    return tuple(sorted((f, op, at) for (f, op), at in least.items()))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, at in rule:
        ok &= x[:, f] <= at if op == "<=" else x[:, f] > at
    return ok


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty on the weights, by accelerated proximal gradient."""
    n, m = r.shape
    a = np.concatenate([np.ones((n, 1)), r], axis=1)
    # The largest eigenvalue of the Gram matrix bounds the curvature.
    v = np.ones(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(1e-9, v @ (a.T @ (a @ v)))
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        u = z - step * (a.T @ (p - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = u + (t - 1) / s * (u - w), u, s
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, penalty: float = PENALTY, seed: int = 0) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) from statistics x and labels y. With one class only, no rules and an intercept that says so."""
    if len(y) == 0 or y.min() == y.max():
        return (3.0 if len(y) == 0 or y[0] else -3.0), []
    rng = np.random.default_rng(seed)
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        step = np.zeros(len(y))
        found: list = []
        _grow(x, g, rows, DEPTH, (), found, step)
        paths += found
        # Rows that weren't drawn take their leaf's mean by its rule.
        leaves = [p for p in found if not any(q[: len(p)] == p and len(q) > len(p) for q in found)]
        for p in leaves:
            inside = holds(p, x)
            drawn = inside[rows]
            if drawn.any():
                f[inside] += RATE * 4 * g[rows][drawn].mean()
    rules = list(dict.fromkeys(tighten(p) for p in paths))
    r = np.stack([holds(q, x) for q in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    varied = (r.mean(0) > 0) & (r.mean(0) < 1)
    rules, r = [q for q, k in zip(rules, varied) if k], r[:, varied]
    intercept, weights = lasso(r, y.astype(np.float64), penalty)
    return intercept, [(q, float(w)) for q, w in zip(rules, weights) if abs(w) > 1e-6]


def compiled(intercept: float, rules: list[tuple[tuple, float]]) -> Column:
    """The probability of good quality as a Spark column over the statistics."""
    total = F.lit(intercept)
    for rule, w in rules:
        ok = F.lit(True)
        for f, op, at in rule:
            ok = ok & ((F.col(NAMES[f]) <= at) if op == "<=" else (F.col(NAMES[f]) > at))
        total = total + F.when(ok, F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score) of every document whose probability of good quality is `threshold` or more.

    - The model is fitted on at most `sample` labelled documents; labels that are null or neither 0 nor 1 don't count, nor do
      labels of unknown documents. Without labels every document is kept.
    - A null text counts as an empty one. Repeated rows are scored each, and a repeated label counts once (the greatest).
    - An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(measured(docs, F.col(text_col), F.col(id_col).cast("long").alias("doc_id"), names=NAMES))
    mark = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = mark.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so small enough to broadcast
    # One row a labelled document, the least by its statistics, so that rows that repeat an id don't come to the driver.
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*NAMES)).alias("s"))
    got = one.select("doc_id", "y", "s.*").toPandas().sort_values("doc_id", ignore_index=True)
    intercept, rules = fit(got[list(NAMES)].to_numpy(dtype=np.int64), got["y"].to_numpy(dtype=np.float64))
    return rows.select("doc_id", F.round(compiled(intercept, rules), 6).alias("score")).where(F.col("score") >= threshold)
