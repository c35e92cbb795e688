"""Line dedup: range-partitioned line hashes, streamed in order, give a keep bitmap for each document.

Every text is split at line feeds. A line counts as its text without leading and trailing white space;
empty lines are always kept. Of all equal lines the first by (doc_id, content key, position) is kept.
Lines travel as 128-bit hashes with document and position, never as text. Rows are range-partitioned by
the whole sort key, so that a line which millions of documents share is spread over many tasks; a task
streams its rows once and remembers one hash. Whether the first row of a task continues the line of the
task before is settled afterwards from two rows a task.

The bitmap is run-length coded: "5,1,3" keeps 5 lines, drops 1, keeps 3. It starts with a kept run, which may be 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WHITE = "[ \\t\\r\\x0b\\x0c\\u00a0]+"
#: Lines in a range task, about.
TASK_LINES = 2_000_000

_FOUND = "pid int, edge int, h1 long, h2 long, k1 long, k2 long, pos int, drop boolean"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def bare(line: Column) -> Column:
    return F.regexp_replace(line, f"^{WHITE}|{WHITE}$", "")


def _stream(batches):
    """Marks each row whose hash equals that of the row before. One output row a dropped line, and two edge rows a task."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    last = None
    tail = None

    def out(rows: pa.RecordBatch, edge: int) -> pa.RecordBatch:
        # Columns stay Arrow's: ids may be null, and NumPy would make floats of them.
        n = rows.num_rows
        kept = [rows.column(c) for c in ("h1", "h2", "k1", "k2", "pos")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, edge, np.int32)), *kept, pa.array(np.full(n, edge == 0))], schema=_SCHEMA)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = (np.asarray(b.column(c)) for c in ("h1", "h2"))
        same = np.empty(len(h1), bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        same[0] = last is not None and last == (h1[0], h2[0])
        last = (h1[-1], h2[-1])
        if tail is None:
            yield out(b.slice(0, 1), 1)
        tail = b.slice(b.num_rows - 1)
        if same.any():
            yield out(b.filter(pa.array(same)), 0)
    if tail is not None:
        yield out(tail, 2)


_SCHEMA = pa.schema([("pid", pa.int32()), ("edge", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("drop", pa.bool_())])


def _runs(drops: Column, n: Column) -> Column:
    """Run lengths, kept first, from sorted dropped positions."""
    starts = F.filter(drops, lambda x, i: (i == 0) | (F.get(drops, i - 1) != x - 1))
    ends = F.filter(drops, lambda x, i: (i == F.size(drops) - 1) | (F.get(drops, i + 1) != x + 1))
    pairs = F.transform(starts, lambda s, i: F.concat_ws(",", s - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1), F.get(ends, i) - s + 1))
    rest = n - F.when(F.size(drops) > 0, F.element_at(drops, -1) + 1).otherwise(0)
    return F.concat_ws(",", pairs, F.when((rest > 0) | (F.size(drops) == 0), rest.cast("string")))


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", task_lines: int = TASK_LINES) -> DataFrame:
    """(doc_id, text_key, n_lines, n_kept, keep_runs) for every distinct (doc_id, text).

    - A null text counts as an empty one: one empty line, kept.
    - Rows that repeat both id and text are one document, and give one result row; rows that share an id
      but not the text are ordered by text_key. A null id sorts first and is an id like any other.
    - An empty table gives an empty result. Other columns are ignored, whatever their names.
    - Lines of any length are hashed whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("k1"), F.xxhash64(text).alias("k2"), split_lines(text).alias("lines"))
    lines = (
        base.select("k1", "k2", F.posexplode("lines").alias("pos", "line"))
        .select("k1", "k2", "pos", bare(F.col("line")).alias("line"))
        .where("line <> ''")
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "k1", "k2", "pos")
    )
    order = ["h1", "h2", "k1", "k2", "pos"]
    # Written once: texts are split and hashed here, and neither the count nor the sampling of ranges nor the shuffle does it again.
    lines = cut(lines)
    n = lines.count()
    ranged = lines.repartitionByRange(max(1, -(-n // task_lines)) if n > task_lines else max(1, min(8, -(-n // 50_000))), *order).sortWithinPartitions(*order)
    found = cut(ranged.mapInArrow(_stream, _FOUND))
    # The head of a task is dropped if the same line stands at an edge of an earlier task.
    edges = found.where("edge > 0").withColumn("least", F.min("pid").over(Window.partitionBy("h1", "h2")))
    heads = edges.where("edge = 1 and least < pid").select("k1", "k2", "pos")
    # Repeated rows make equal (k1, k2, pos); as one document they drop a position only if each of its copies but the first would be dropped by another document.
    dropped = found.where("edge = 0").select("k1", "k2", "pos").unionByName(heads)
    copies = base.groupBy("k1", "k2").agg(F.first(F.size("lines")).alias("n_lines"), F.count("*").alias("copies"))
    per_doc = dropped.groupBy("k1", "k2", "pos").agg(F.count("*").alias("times")).groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "times")).alias("hits"))
    c, d = copies.alias("c"), per_doc.alias("d")
    joined = c.join(d, F.col("c.k1").eqNullSafe(F.col("d.k1")) & (F.col("c.k2") == F.col("d.k2")), "left").select("c.*", "d.hits")
    joined = joined.withColumn("drops", F.array_sort(F.transform(F.filter(F.coalesce("hits", F.array().cast("array<struct<pos:int,times:bigint>>")), lambda h: h.times >= F.col("copies")), lambda h: h.pos)))
    return joined.select(F.col("k1").alias(id_col), F.col("k2").alias("text_key"), "n_lines", (F.col("n_lines") - F.size("drops")).alias("n_kept"), _runs(F.col("drops"), F.col("n_lines")).alias("keep_runs"))


def keep_lines(text: Column, runs: Column) -> Column:
    """The text without the lines that the bitmap drops."""
    lengths = F.transform(F.split(runs, ","), lambda x: x.cast("int"))
    lines = split_lines(text)
    # The lines are part of the state, so that they are split once and not for each run.
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"), lines.alias("all"))
    kept = F.aggregate(
        F.transform(lengths, lambda n, i: F.struct(n.alias("n"), i.alias("i"))),
        state,
        lambda s, r: F.struct((s.at + r.n).alias("at"), F.when(r.i % 2 == 0, F.concat(s.out, F.slice(s["all"], s.at, r.n))).otherwise(s.out).alias("out"), s["all"].alias("all")),
        lambda s: F.array_join(s.out, "\n"),
    )
    return F.when(F.instr(runs, ",") == 0, text).otherwise(kept)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their text; a document that loses all of them goes.

    Columns stay as they are, whatever their names. A document without dropped lines keeps its text untouched, null included. Rows that repeat a
    document stay or go together, with equal texts. Of equal lines the first by id, text key and position is kept. An empty table gives an empty result.
    """
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    bitmaps = line_bitmaps(docs, id_col=id_col, text_col=text_col).where("n_kept < n_lines")
    b = bitmaps.select(F.col(id_col).alias("__k1"), F.col("text_key").alias("__k2"), F.col("n_kept").alias("__kept"), F.col("keep_runs").alias("__runs"))
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"), *inner)
    joined = d.join(b, F.col("__id").eqNullSafe(F.col("__k1")) & (F.col("__key") == F.col("__k2")), "left").where("__kept is null or __kept > 0")
    text = f"c{docs.columns.index(text_col)}"
    short = F.when(F.col("__runs").isNull(), F.col(text)).otherwise(keep_lines(F.col(text), F.col("__runs")))
    return joined.select(*[(short if f"c{i}" == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
