"""Cleaning of training examples: removal reasons, duplicates, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T


def reasons(examples: DataFrame) -> DataFrame:
    """Adds reason: why an example goes, the first that holds; "duplicate" for all but the first of equal ones in a dialog; or null."""
    target = T.strip(F.coalesce("target_reply", F.lit("")))
    meaningful = F.exists("context", lambda t: (t.role == "user") & T.meaningful(t.text))
    reason = (
        F.when(target == "", "empty_target")
        .when(~F.coalesce("is_human_authored", F.lit(False)), "not_human_authored")
        .when(target.rlike(T.URL_ONLY), "link_only_target")
        .when(target.rlike(T.COMMAND), "bot_command_target")
        .when(F.coalesce("target_is_forwarded", F.lit(False)), "forwarded_target")
        .when(~F.coalesce(meaningful, F.lit(False)), "no_meaningful_incoming_context")
    )
    turns = F.transform("context", lambda t: F.struct(t.role, T.collapse(t.text)))
    marked = examples.withColumn("reason", reason).withColumn("__key", F.sha2(F.to_json(F.struct(turns.alias("c"), T.collapse(F.col("target_reply")).alias("t"))), 256))
    # Only examples that stay so far compete for being the first.
    first = F.row_number().over(Window.partitionBy("dialog_id", "__key", F.col("reason").isNull()).orderBy("seq"))
    return marked.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason"))).drop("__key")


def clean(examples: DataFrame, *, redact: bool = True) -> DataFrame:
    kept = reasons(examples).where("reason is null").drop("reason")
    if not redact:
        return kept
    return kept.withColumn("context", F.transform("context", lambda t: F.struct(t.role.alias("role"), T.redact(t.text).alias("text")))).withColumn("target_reply", T.redact(F.col("target_reply")))


def removal_histogram(examples: DataFrame) -> DataFrame:
    return reasons(examples).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def redaction_totals(texts: DataFrame, column: str = "text") -> DataFrame:
    """(category, n) over all texts; a text that occurs twice counts twice."""
    counts = T.redaction_counts(F.col(column))
    one = texts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in counts])).alias("x")).select("x.*")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by a stated order; never an arbitrary one."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")


def union_ordered(*parts: DataFrame) -> DataFrame:
    """All rows, with src_ord: the number of the part."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("src_ord", F.lit(i)) for i, p in enumerate(parts)])
