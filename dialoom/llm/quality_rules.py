"""Quality rules whose cut-offs come from the data: quantile sketches for each language and source.

Statistics of a text are integers. Each goes into a log-linear bucket (16 buckets an octave, so that a
bucket's bounds differ by at most 1/16); the counts of the buckets are the sketch. Sketches merge by adding
counts: Spark combines them on the map side. The sketch that a group's quartiles come from is its own merged with those of its language and of
the whole table, which weigh as much as PRIOR documents each: the more documents a group has, the less they count, without any switch.

A fence lies `reach` interquartile ranges beyond a quartile, and at least a statistic's own least width away.
Documents outside any fence go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, new_path, row_key, slices

#: name -> (least width of the upper fence, of the lower fence); None: no such fence.
STATS = {"symbols": (40, None), "capitals": (150, None), "repeats": (100, None), "digits": (150, None), "word_size": (400, 250)}
REACH = 3
#: Documents that the sketch of a group's language counts as beside its own, and that of the whole table.
PRIOR = 50
#: Parts of a document in which merged counts are kept, as whole numbers.
PARTS = 10_000
#: Threshold rows that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Characters by class. Bytes are counted with NumPy tables: measured here, regular expressions in the JVM took 30 times as long.
SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~"
CAPITALS = "A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f"
SPACE = " \n\t\r"

_LUT = np.zeros(256, np.uint8)
for _bit, _chars in ((1, SYMBOLS), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, "0123456789"), (8, SPACE)):
    for _c in _chars:
        _LUT[ord(_c)] |= _bit
_LUT[0x80:0xC0] |= 16  # continues a character
#: Lead byte, first and last continuation byte of capitals beyond ASCII.
_WIDE = ((0xC3, 0x80, 0x96), (0xC3, 0x98, 0x9E), (0xCE, 0x91, 0xA9), (0xD0, 0x90, 0xAF))
_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
_POWER = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Integer statistics of each text; a few characters or words are added below each line, so that tiny texts aren't extreme."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    # One line feed after each text, so that none is empty and no word crosses two texts.
    data = np.frombuffer(b"\n".join(texts.to_pylist()) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    kind = _LUT[data]
    count = lambda flags: np.add.reduceat(flags.astype(np.int32), starts).astype(np.int64)
    capital = (kind & 2) > 0
    if (kind & 16).any():
        for lead, low, high in _WIDE:
            capital[:-1] |= (data[:-1] == lead) & (data[1:] >= low) & (data[1:] <= high)
    space = (kind & 8) > 0
    chars = count((kind & 16) == 0) - 1
    n_words = count(space)  # with the added line feed
    ends = np.flatnonzero(space)
    begins = np.concatenate([[0], ends[:-1] + 1])
    long = ends - begins
    at = np.arange(len(data)) - np.repeat(begins, long + 1)
    h = np.add.reduceat(np.where(space, np.uint64(0), _CODE[data] * _POWER[at % len(_POWER)]), begins)
    again = np.zeros(len(data), bool)
    twice = np.flatnonzero((h[1:] == h[:-1]) & (long[1:] == long[:-1]) & (long[1:] > 0)) + 1
    first = np.zeros(len(data), bool)
    first[starts] = True
    again[begins[twice[~first[begins[twice]]]]] = True
    return {
        "symbols": count((kind & 1) > 0) * 1000 // (chars + 50),
        "capitals": count(capital) * 1000 // (chars + 50),
        "repeats": count(again) * 1000 // (n_words + 10),
        "digits": count((kind & 4) > 0) * 1000 // (chars + 50),
        "word_size": (chars - n_words + 51) * 100 // (n_words + 10),
        "chars": chars,
        "words": n_words,
        "lines": count(data == 10),
    }


def _measure(names):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                got = statistics(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(got[s], pa.int64()) for s in names]], names=[*part.schema.names[1:], *names])

    return run


def measured(docs: DataFrame, text: Column, *carry: Column, names=tuple(STATS)) -> DataFrame:
    """The carried columns and a column for each statistic of the text."""
    seen = docs.select(text.alias("__text"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema[1:])
    return seen.mapInArrow(_measure(names), f"{schema}, " + ", ".join(f"{s} long" for s in names))


def bucket(value: Column) -> Column:
    """Number of the log-linear bucket: values below 32 have their own, then 16 an octave."""
    octave = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise((octave + 1) * 16 + F.call_function("shiftright", value, octave.cast("int")) - 16).cast("long")


def bucket_floor(number: Column) -> Column:
    """The least value of a bucket."""
    octave = F.floor(number / 16) - 1
    return F.when(number < 32, number).otherwise((number % 16 + 16) * F.pow(F.lit(2.0), octave)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, stat, bucket, n) from columns lang, source and the statistics."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), bucket(F.col(s)).alias("bucket")) for s in STATS])).alias("p")
    return measured.select("lang", "source", pairs).groupBy("lang", "source", "p.stat", "p.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, *, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """(lang, source, and <stat>_lo, <stat>_hi for each statistic): the fences of each group that has a document."""
    own = sketch.withColumn("g", row_key(F.col("lang"), F.col("source"))).withColumn("l", row_key(F.col("lang")))
    groups = own.groupBy("g", "l").agg(F.first("lang").alias("lang"), F.first("source").alias("source"))
    share = lambda n, of: F.expr(f"(`{n}` * {prior * PARTS}L) div sum(`{n}`) over (partition by {', '.join(of)})")
    lang = own.groupBy("l", "stat", "bucket").agg(F.sum("n").alias("n")).select("l", "stat", "bucket", share("n", ["l", "stat"]).alias("ln"))
    whole = own.groupBy("stat", "bucket").agg(F.sum("n").alias("n")).select("stat", "bucket", share("n", ["stat"]).alias("wn"))
    # The buckets of a statistic are bounded: 16 an octave.
    every = groups.select("*", F.explode(F.array(*map(F.lit, STATS))).alias("stat")).join(F.broadcast(whole), "stat")
    merged = every.join(own.select("g", "stat", "bucket", "n"), ["g", "stat", "bucket"], "left").join(lang, ["l", "stat", "bucket"], "left")
    mass = F.coalesce("n", F.lit(0)) * PARTS + F.coalesce("ln", F.lit(0)) + F.col("wn")
    group = ["g", "lang", "source", "stat"]
    by = Window.partitionBy(*group)
    run = merged.withColumn("m", mass).withColumn("total", F.sum("m").over(by)).withColumn("upto", F.sum("m").over(by.orderBy("bucket")))
    reached = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = run.groupBy(*group).agg(bucket_floor(reached(1)).alias("q1"), bucket_floor(reached(3)).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * reach
    table = lambda k: F.create_map(*[x for s, w in STATS.items() for x in (F.lit(s), F.lit(w[k]).cast("long"))])[F.col("stat")]
    fences = quartiles.select(*group, (F.col("q3") + F.greatest(spread, table(0))).alias("hi"), F.when(table(1).isNotNull(), F.col("q1") - F.greatest(spread, table(1))).alias("lo"))
    return fences.groupBy("g", "lang", "source").agg(*[F.max(F.when(F.col("stat") == s, F.col(c))).alias(f"{s}_{c}") for s in STATS for c in ("lo", "hi")]).drop("g")


def _fits() -> Column:
    ok = F.lit(True)
    for s, (_, low) in STATS.items():
        ok = ok & (F.col(s) <= F.col(f"__{s}_hi"))
        if low is not None:
            ok = ok & (F.col(s) >= F.col(f"__{s}_lo"))
    return ok


def _inside(rows: DataFrame, reach: int, prior: int) -> DataFrame:
    """The measured rows, with lang and source, that lie inside all fences."""
    limits = cut(thresholds(cut(sketches(rows)), reach=reach, prior=prior))
    limits = limits.select(row_key(F.col("lang"), F.col("source")).alias("__g"), *[F.col(f"{s}_{c}").alias(f"__{s}_{c}") for s in STATS for c in ("lo", "hi")])
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    return rows.withColumn("__g", row_key(F.col("lang"), F.col("source"))).join(limits, "__g").where(_fits())


def quality_kept(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """The rows of docs that pass all rules, with their columns as they are.

    - A null text counts as an empty one; its ratios are 0 and it passes the upper fences.
    - Null languages and sources are groups like others. Repeated rows each count. Ties can't matter: fences are inclusive.
    - A group's fences come from its own sketch merged with those of its language and of the whole table, which count as `prior` documents each.
    - An empty table gives an empty result. Other columns travel along untouched, whatever their names.
    """
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    # Texts pass once: they are written with their statistics, of which the sketches read only the statistics.
    path = new_path(docs.sparkSession, "measured")
    measured(docs, F.col(text_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), *inner).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    return _inside(rows, reach, prior).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """Kept documents with their statistics: id, lang, source and one column a statistic. See quality_kept."""
    rows = cut(measured(docs, F.col(text_col), F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")))
    return _inside(rows, reach, prior).select("doc_id", "lang", "source", *STATS)


def _sql() -> str:
    white = "chr(32) || chr(10) || chr(9) || chr(13)"
    signs = SYMBOLS.replace("'", "''")
    values = {
        "symbols": f"(length(t) - length(translate(t, '{signs}', ''))) * 1000 // (length(t) + 50)",
        "capitals": f"length(regexp_replace(t, '[^{CAPITALS}]+', '', 'g')) * 1000 // (length(t) + 50)",
        "repeats": "len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda p: p[1] = p[2] AND p[1] <> '')) * 1000 // (len(ws) + 10)",
        "digits": "(length(t) - length(translate(t, '0123456789', ''))) * 1000 // (length(t) + 50)",
        "word_size": f"(length(translate(t, {white}, '')) + 50) * 100 // (len(ws) + 10)",
    }
    b = "CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 4) * 16 + (v >> (length(bin(v)) - 5)) - 16 END"
    floor = lambda x: f"CASE WHEN {x} < 32 THEN {x} ELSE CAST(({x} % 16 + 16) * pow(2.0, {x} // 16 - 1) AS BIGINT) END"
    wide = "CASE stat " + " ".join(f"WHEN '{s}' THEN {w[0]}" for s, w in STATS.items()) + " END"
    low = "CASE stat " + " ".join(f"WHEN '{s}' THEN {w[1]}" for s, w in STATS.items() if w[1] is not None) + " END"
    fits = "f.hi >= p.v AND coalesce(f.lo <= p.v, true)"
    return f"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, string_split(translate(t, chr(10) || chr(9) || chr(13), '   '), ' ') AS ws FROM base),
m AS (SELECT doc_id, lang, source, {", ".join(f"CAST({e} AS BIGINT) AS {s}" for s, e in values.items())} FROM cut),
p AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{s}' AS stat, {s} AS v FROM m" for s in STATS)}),
b AS (SELECT lang, source, stat, {b} AS bucket, count(*) AS n FROM p GROUP BY ALL),
lg AS (SELECT lang, stat, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, stat) AS total FROM b GROUP BY lang, stat, bucket),
wh AS (SELECT stat, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY stat) AS total FROM b GROUP BY stat, bucket),
g AS (SELECT DISTINCT lang, source FROM b),
k AS (SELECT g.lang, g.source, wh.stat, wh.bucket, coalesce(b.n, 0) * {PARTS} + coalesce(lg.n * {PRIOR * PARTS} // lg.total, 0) + wh.n * {PRIOR * PARTS} // wh.total AS mass FROM g CROSS JOIN wh
  LEFT JOIN b ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source AND b.stat = wh.stat AND b.bucket = wh.bucket
  LEFT JOIN lg ON lg.lang IS NOT DISTINCT FROM g.lang AND lg.stat = wh.stat AND lg.bucket = wh.bucket),
r AS (SELECT *, sum(mass) OVER (PARTITION BY lang, source, stat) AS total, sum(mass) OVER (PARTITION BY lang, source, stat ORDER BY bucket) AS upto FROM k),
qb AS (SELECT lang, source, stat, min(CASE WHEN upto * 4 >= total THEN bucket END) AS b1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS b3 FROM r GROUP BY ALL),
q AS (SELECT lang, source, stat, {floor("b1")} AS q1, {floor("b3")} AS q3 FROM qb),
f AS (SELECT lang, source, stat, q3 + greatest({REACH} * (q3 - q1), {wide}) AS hi, CASE WHEN {low} IS NOT NULL THEN q1 - greatest({REACH} * (q3 - q1), {low}) END AS lo FROM q),
bad AS (SELECT DISTINCT p.doc_id FROM p JOIN f ON f.stat = p.stat AND f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source WHERE NOT ({fits}))
SELECT doc_id, lang, source, {", ".join(STATS)} FROM m WHERE doc_id NOT IN (SELECT doc_id FROM bad)"""


SQL = _sql()
