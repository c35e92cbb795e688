"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, as written to Parquet and read again. All stages but the last return the columns of documents, whatever
they are. Null and empty texts pass the filters: they are no worse than others by any rule, and have no line to drop, no near copy and no tokens. Texts
count whole, whatever their length. Rows that repeat an id are treated as the stages' operators say; none is dropped for repeating one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import common, line_dedup, near_dedup, packing, quality_rules, toxicity
from dialoom.llm.common import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source; fences are inclusive, so that ties stay. See quality_rules.quality_kept."""
    return quality_rules.quality_kept(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject; its terms are learnt from the labelled ones among docs. See toxicity.drop_toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; without any line left, a document goes. See line_dedup.dedup_lines."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. See near_dedup.drop_near_duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, placed in packs, one row a piece with its span of tokens; long ones in pieces. See packing.pack."""
    return packing.pack(packing.document_examples(docs))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("line dedup", lines), ("near dedup", near), ("packing", packed)]

#: Neither the grammar, MinHash nor packing can be put in SQL; tests/llm/test_pipeline.py holds all rows of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of all documents that the stages keep: (group, pack, example, piece, first_token, n_tokens, n_segments, n_loss), one row a piece.

    An empty table gives an empty result. Only the last stage's table stays in the shared folder; what a stage wrote goes once the next is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = len(common.MADE)
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        used = common.MADE[before:]
        path = new_path(spark, f"pipeline-{k}")
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        common.remove(spark, *used)
    return docs
