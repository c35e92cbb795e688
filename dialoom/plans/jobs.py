"""Whole jobs: training export, feedback export, and the steps of a live stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import clean, extract, feedback, live
from dialoom.sources import files, tables

#: Example fields that exports hold, keys in order.
EXPORTED = ("context", "created_at", "dialog_id", "example_id", "is_human_authored", "source_message_ids", "target_reply")


def training_examples(history: DataFrame, known_ai: DataFrame | None = None, **limits) -> DataFrame:
    return extract.examples(extract.fragments(extract.classify(history, known_ai)), **limits)


def training_summary(classified: DataFrame, groups: DataFrame, examples: DataFrame, *, redact: bool = True) -> DataFrame:
    """One row a dialog: messages by why they were left out, replies found, examples exported and removed by reason, and redactions by category."""
    judged = clean.reasons(examples)
    removed = judged.where("reason is not null").groupBy("dialog_id", "reason").agg(F.count("*").alias("n")).groupBy("dialog_id").agg(F.sum("n").alias("examples_removed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("removal_reasons"))
    kept = judged.where("reason is null")
    texts = kept.select("dialog_id", F.explode(F.concat(F.col("context.text"), F.array("target_reply"))).alias("text"))
    found = T.redaction_counts(F.col("text"))
    redacted = texts.groupBy("dialog_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"redacted_{k}") for k, c in found.items()])
    exported = kept.groupBy("dialog_id").agg(F.count("*").alias("examples_exported"))
    got = extract.extraction_stats(classified, groups).join(exported, "dialog_id", "left").join(removed, "dialog_id", "left").join(redacted, "dialog_id", "left")
    none = F.lit(0).cast("long")
    return got.withColumns({c: F.coalesce(F.col(c), none) if redact or not c.startswith("redacted_") else none for c in ("examples_exported", "examples_removed", *[f"redacted_{k}" for k in found])})


def export_training(history: DataFrame, out: str, known_ai: DataFrame | None = None, *, limit: int = extract.LIMIT, context_limit: int = extract.CONTEXT_LIMIT, redact: bool = True) -> None:
    """Raw and cleaned examples as JSON lines, keys sorted and nulls written, and a summary by dialog. Of each dialog the newest messages that the limit asks for are read."""
    classified = extract.classify(tables.newest(history, limit), known_ai)
    groups = extract.fragments(classified)
    # Both branches and the summary start from what is written first.
    extract.examples(groups, context_limit=context_limit, limit=limit).write.parquet(f"{out}/examples")
    examples = history.sparkSession.read.parquet(f"{out}/examples")
    in_order = lambda df: df.repartition("dialog_id").sortWithinPartitions("dialog_id", "seq").select(*EXPORTED)
    in_order(examples).write.json(f"{out}/raw", ignoreNullFields=False)
    in_order(clean.clean(examples, redact=redact)).write.json(f"{out}/cleaned", ignoreNullFields=False)
    training_summary(classified, groups, examples, redact=redact).write.json(f"{out}/summary", ignoreNullFields=False)


def export_feedback(replies: DataFrame, out: str, *, redact: bool = True) -> None:
    """Reviewed replies as JSON lines: all, the positive ones with their target, the negative ones; and a summary. Replies are read and redacted once."""
    rows = feedback.export_rows(replies, redact=redact)
    rows.write.partitionBy("part").parquet(f"{out}/rows")
    spark = replies.sparkSession
    written = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    keyed = lambda df: df.select(*sorted(set(df.columns) - {"part"})).sortWithinPartitions("reply_id")
    keyed(written).write.json(f"{out}/reviewed", ignoreNullFields=False)
    keyed(written.where("part = 'positive'").withColumn("target_reply", F.col("preferred_reply"))).write.json(f"{out}/positive", ignoreNullFields=False)
    keyed(written.where("part = 'negative'")).write.json(f"{out}/negative", ignoreNullFields=False)
    feedback.export_summary(replies, redact=redact).write.json(f"{out}/summary", ignoreNullFields=False)


def answer(events: DataFrame, batch_id: int, log: str, *, allowed_id: int) -> None:
    """One micro-batch of a live stream, for foreachBatch: what was made is on disk before anything counts as delivered.

    The rows that record the replies are written first, below the batch's number: a batch that is tried again replaces its own rows. If that fails, nothing of the batch is delivered.
    """
    done = live.outcomes(events, allowed_id=allowed_id)
    rows = live.log_rows(done)
    rows.where("kind = 'created'").write.mode("overwrite").parquet(f"{log}/created/batch={batch_id}")
    rows.where("kind <> 'created'").write.mode("overwrite").parquet(f"{log}/delivered/batch={batch_id}")


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log that `answer` wrote, a reply once, however often its event came."""
    rows = spark.read.parquet(f"{log}/created").unionByName(spark.read.parquet(f"{log}/delivered")).drop("batch")
    return clean.keep_first(rows, [F.col("reply_id"), F.col("seq")], [F.col("kind"), F.col("text"), F.col("delivery_status")])


def stop_when(query, path: str, *, every: float = 5.0) -> None:
    """Stops a streaming query once a file appears; the file goes. Returns when the query has ended."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    while query.isActive:
        if files.exists(spark, path):
            query.stop()
            files.remove(spark, path)
        query.awaitTermination(every)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published below root; none if nothing is."""
    text = files.read_text(spark, f"{root}/CURRENT")
    return json.loads(text) if text else None
