"""From message history to training examples, for all dialogs at once: one shuffle, by dialog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T

GAP_MICROS = 180_000_000
CONTEXT_LIMIT = 10
LIMIT = 500


def classify(history: DataFrame, known_ai: DataFrame | None = None, *, own_id: int = 42) -> DataFrame:
    """Adds role and excl: why a message is left out (service, media, blank, known_ai; the first that holds), or null.

    known_ai: (dialog_id, sent_message_id) of replies that the machine sent; without it the column known_ai of history counts.
    """
    if known_ai is not None:
        ids = known_ai.where("sent_message_id is not null").select(F.col("dialog_id").alias("__d"), F.col("sent_message_id").alias("__m"), F.lit(True).alias("known_ai")).distinct()
        history = history.drop("known_ai").join(ids, (F.col("dialog_id") == F.col("__d")) & (F.col("id") == F.col("__m")), "left").drop("__d", "__m")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    excl = F.when(yes("is_service"), "service").when(yes("has_media"), "media").when(blank, "blank").when(yes("known_ai"), "known_ai")
    role = F.when(yes("outgoing") | F.coalesce(F.col("sender_id") == own_id, F.lit(False)), "assistant").otherwise("user")
    return history.withColumn("role", role).withColumn("excl", excl)


def _ordered():
    return Window.partitionBy("dialog_id").orderBy(F.col("date").asc_nulls_last(), "id")


def fragments(classified: DataFrame) -> DataFrame:
    """(dialog_id, grp, role, text, message_ids, last_date, is_forwarded): runs of messages of one role, no gap over 180 s.

    The message before is sought among all messages: one that is left out ends a run.
    """
    w = _ordered()
    gap = F.unix_micros("date") - F.unix_micros(F.lag("date").over(w))
    # row_number tells the first row from one whose predecessor merely isn't excluded
    fresh = (F.row_number().over(w) == 1) | F.lag("excl").over(w).isNotNull() | (F.lag("role").over(w) != F.col("role")) | F.coalesce(~gap.between(0, GAP_MICROS), F.lit(False))
    marked = classified.withColumn("__new", fresh.cast("int")).withColumn("__pos", F.row_number().over(w))
    grouped = marked.withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("excl is null")
    parts = F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("pos"), T.strip(F.col("text")).alias("text"), "id")))
    return (
        grouped.groupBy("dialog_id", "grp", "role")
        .agg(parts.alias("p"), F.max_by("date", "__pos").alias("last_date"), F.bool_or(F.coalesce("is_forwarded", F.lit(False))).alias("is_forwarded"))
        .select("dialog_id", "grp", "role", F.array_join(F.col("p.text"), "\n").alias("text"), F.col("p.id").alias("message_ids"), "last_date", "is_forwarded")
    )


def examples(groups: DataFrame, *, context_limit: int = CONTEXT_LIMIT, limit: int = LIMIT) -> DataFrame:
    """One training example a group of the assistant, with the groups before it as context; the last `limit` of each dialog."""
    w = Window.partitionBy("dialog_id").orderBy("grp")
    context = F.collect_list(F.struct("role", "text")).over(w.rowsBetween(-context_limit, -1))
    made = groups.withColumn("context", context).where("role = 'assistant'")
    last = F.row_number().over(Window.partitionBy("dialog_id").orderBy(F.desc("grp")))
    key = F.concat_ws(":", F.col("dialog_id").cast("string"), F.array_join(F.col("message_ids").cast("array<string>"), ","))
    return made.withColumn("__last", last).where(F.col("__last") <= limit).select(
        "dialog_id", F.col("grp").alias("seq"), F.substring(F.sha2(key, 256), 1, 24).alias("example_id"), "context", F.col("text").alias("target_reply"),
        F.col("message_ids").alias("source_message_ids"), T.iso(F.col("last_date")).alias("created_at"), F.lit(True).alias("is_human_authored"), F.col("is_forwarded").alias("target_is_forwarded"),
    )


def extraction_stats(classified: DataFrame, groups: DataFrame) -> DataFrame:
    """Six counters for each dialog; targets are counted before any limit."""
    n = lambda e: F.count_if(F.coalesce(F.col("excl") == e, F.lit(False)))
    scanned = classified.groupBy("dialog_id").agg(F.count("*").alias("messages_scanned"), n("service").alias("service_excluded"), n("media").alias("media_excluded"), n("blank").alias("empty_excluded"), n("known_ai").alias("ai_excluded"))
    targets = groups.where("role = 'assistant'").groupBy("dialog_id").agg(F.count("*").alias("human_target_replies"))
    return scanned.join(targets, "dialog_id", "left").fillna(0, "human_target_replies")


def live_context(history: DataFrame, current: DataFrame, *, allowed_id: int = 1001, own_id: int = 42, limit: int = 30) -> DataFrame:
    """(dialog_id, current_id, id, role, text): the newest messages before the current one, ascending, the current one last.

    Of max(3 x limit, limit + 5) newest messages, those without text or a role don't count. current: (dialog_id, id, text).
    """
    c = current.select(F.col("dialog_id").alias("__d"), F.col("id").alias("current_id"), F.col("text").alias("__text"))
    newest = Window.partitionBy("dialog_id", "current_id").orderBy(F.desc("id"))
    role = F.when(F.col("sender_id") == allowed_id, "user").when((F.col("sender_id") == own_id) | F.col("outgoing"), "assistant")
    seen = history.join(c, F.col("dialog_id") == F.col("__d")).where("id <= current_id").withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max(3 * limit, limit + 5))
    kept = seen.withColumn("role", role).where((F.col("id") != F.col("current_id")) & (T.strip(F.col("text")) != "") & F.col("role").isNotNull())
    kept = kept.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit - 1).select("dialog_id", "current_id", "id", "role", "text")
    return kept.unionByName(c.select(F.col("__d").alias("dialog_id"), "current_id", F.col("current_id").alias("id"), F.lit("user").alias("role"), F.col("__text").alias("text")))


def history_budget(messages: DataFrame, *, max_chars: int) -> DataFrame:
    """The newest messages whose characters fit, the last one always. messages: (dialog_id, seq, text)."""
    w = Window.partitionBy("dialog_id").orderBy(F.desc("seq"))
    total = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("__n", F.row_number().over(w)).withColumn("suffix_chars", total.cast("long")).where((F.col("suffix_chars") <= max_chars) | (F.col("__n") == 1)).drop("__n")


def human_replied_after(history: DataFrame, *, window: int = 10) -> DataFrame:
    """(dialog_id, id, replied) for each incoming message: whether the newest `window` messages after it hold one of the owner with text."""
    later = Window.partitionBy("dialog_id").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    newest = F.row_number().over(Window.partitionBy("dialog_id").orderBy(F.desc("id")))
    own = F.when(F.col("outgoing") & (T.strip(F.col("text")) != "") & (F.col("__n") <= window), 1).otherwise(0)
    got = history.withColumn("__n", newest).withColumn("__own", own)
    return got.withColumn("replied", F.coalesce(F.max("__own").over(later), F.lit(0)) > 0).where(~F.col("outgoing")).select("dialog_id", "id", "replied")
