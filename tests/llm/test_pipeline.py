"""The pipeline: all rows of run() against plain Python and DuckDB, stage by stage; odd rows and empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialoom.llm import bpe, common, packing, quality_rules

from .test_brute_force import least_of_groups, plain_toxic
from .test_llm import _by_hand, _by_tokens

DIR = "/root/testdata/sf0.001"


def plain_lines(docs):
    """Rows with the lines that came before taken out; those that lose all go."""
    seen, out = set(), []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        kept, dropped = [], False
        for line in (r["text"] or "").split("\n"):
            bare = line.strip(" \t\r\x0b\x0c\xa0")
            if not bare or bare not in seen:
                kept.append(line)
            else:
                dropped = True
            seen.add(bare)
        if kept:
            out.append({**r, "text": "\n".join(kept) if dropped else r["text"]})
    return out


class Row(dict):
    __getattr__ = dict.__getitem__


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = [Row(r.asDict()) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    good = {r[0] for r in db.execute(quality_rules.SQL).fetchall()}
    docs = [r for r in docs if r.doc_id in good]
    bad = {x[0] for x in plain_toxic(spark, docs, labels)}
    docs = plain_lines([r for r in docs if r.doc_id not in bad])
    gone = least_of_groups({r["doc_id"]: r["text"] for r in docs})
    texts = {r["doc_id"]: r["text"] for r in docs if r["doc_id"] not in gone}
    assert bad and gone and 50 < len(texts) < len(good)

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    limits = (packing.TOKENS, packing.SEGMENTS, packing.LOSS)
    pieces = {}
    for i, text in texts.items():
        for k, p in enumerate(_by_tokens([(len(t.encode(text or "", add_special_tokens=False).ids), True)], limits)):
            pieces[i, k] = p
    order = {(r.i, r.k): r.h for r in spark.createDataFrame(list(pieces), "i long, k long").select("i", "k", F.xxhash64("i", "k").alias("h")).collect()}
    packs = _by_hand([((order[x], *x), p[1:]) for x, p in pieces.items()], limits)
    want = sorted((0, n, i, k, *pieces[i, k]) for n, rows in enumerate(packs) for (_, i, k), _ in rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == want


def test_stages_keep_rows_as_they_are(spark):
    """Filters keep whole rows of what they got; line dedup changes the text alone; what a stage wrote is removed."""
    docs = common.table(spark, DIR, "documents")
    first = docs.columns
    made = len(common.MADE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame((x := stage(spark, docs, DIR)).collect(), x.schema)
        assert docs.columns == first and 0 < docs.count() <= before.count()
        if name != "line dedup":
            assert docs.exceptAll(before).count() == 0
        else:
            assert docs.drop("text").exceptAll(before.drop("text")).count() == 0
    common.remove(spark, *common.MADE[made:])
    made = len(common.MADE)
    corpus_pipeline.run(spark, DIR).count()
    assert len(common.MADE) == made + 1


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of tables with nulls in every column, empty and long texts, repeated rows and extra columns with names that operators use."""

    def write(rows, labels=()):
        d = str(tmp_path / f"t{len(rows)}")
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, c0 string, __runs string, pack long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return d

    return write


def test_odd_documents(spark, odd):
    long = "one two three four five. " * 9_000
    x = ("c", "r", 3)
    rows = [(1, "a line\nown words here", "en", "s", 9, *x), (2, "a line\nmore of other kind", "en", None, None, *x), (2, "a line\nmore of other kind", "en", None, None, *x), (3, None, None, None, None, None, None, None), (4, "", "en", "s", 0, *x), (None, "nobody owns this text", "en", "s", 1, *x), (5, long, "en", "s", 1, *x)]
    d = odd(rows, [(1, None, None), (None, 1, 1), (3, 0, 0)])
    got = corpus_pipeline.run(spark, d).toPandas()
    by = got.groupby("example", dropna=False).n_tokens.agg(["count", "sum"])
    assert set(got.example.dropna()) == {1, 2, 3, 4, 5} and got.example.isna().sum() == 1
    # Rows that repeat a document stay together; null and empty texts are pieces without tokens; the long one is cut, whole.
    assert by.loc[2.0, "count"] == 2 and by.loc[3.0, "sum"] == 0 and by.loc[4.0, "sum"] == 0 and by.loc[5.0, "sum"] > 40_000 and by.loc[5.0, "count"] >= 14
    assert corpus_pipeline.run(spark, odd([])).collect() == []
