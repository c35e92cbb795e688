"""Live replies: which events are answered, from what context, and what becomes of each reply. The model's and the messenger's answers are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.functions import text as T

#: What can become of an event, in the order in which it is found out.
OUTCOMES = ("ignored", "generation_failed", "empty_reply", "storage_failed", "cancelled_manual", "failed", "sent")


def admitted(*, allowed_id: int) -> Column:
    """Whether an event (out, is_private, sender_id, text) is answered: incoming, in private, from the allowed sender, with text."""
    no = F.lit(False)
    return ~F.coalesce("out", no) & F.coalesce("is_private", no) & F.coalesce(F.col("sender_id") == allowed_id, no) & (T.strip(F.coalesce("text", F.lit(""))) != "")


def provenance(history: DataFrame, known_ai: DataFrame, *, allowed_id: int) -> DataFrame:
    """history with provenance: contact, ai_generated (a message that the machine sent) or human."""
    ids = known_ai.select(F.col("dialog_id").alias("__d"), F.col("sent_message_id").alias("__m")).distinct().withColumn("__ai", F.lit(True))
    got = history.join(ids, (F.col("dialog_id") == F.col("__d")) & (F.col("id") == F.col("__m")), "left")
    kind = F.when(F.coalesce(F.col("sender_id") == allowed_id, F.lit(False)), "contact").when(F.coalesce("__ai", F.lit(False)), "ai_generated").otherwise("human")
    return got.withColumn("provenance", kind).drop("__d", "__m", "__ai")


def context_payload(context: DataFrame) -> DataFrame:
    """(dialog_id, current_id, context_json) from the rows of a live context (dialog_id, current_id, id, role, text, provenance), in order of id."""
    turns = F.array_sort(F.collect_list(F.struct(F.col("id").alias("message_id"), "provenance", "role", "text")))
    return context.groupBy("dialog_id", "current_id").agg(C.encode_context(turns).alias("context_json"))


def chat_messages(context: DataFrame) -> DataFrame:
    """(dialog_id, current_id, messages): what a chat model is sent, (role, content) in order of id."""
    turns = F.array_sort(F.collect_list(F.struct("id", "role", "text")))
    return context.groupBy("dialog_id", "current_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


def outcomes(events: DataFrame, *, allowed_id: int) -> DataFrame:
    """Events with outcome, the first that holds; those that were answered carry what is to be stored.

    events: (dialog_id, id, sender_id, out, is_private, text, reply, reply_error, stored, replied, send_error, sent_message_id). reply_error and send_error are names or null; stored: whether the
    reply could be recorded before it was sent; replied: whether the owner wrote meanwhile. An event is recorded (`recorded`) if a reply was made and could be stored, whatever
    became of it after; it is announced (`announced`) only if it was sent.
    """
    reply = T.strip(F.coalesce("reply", F.lit("")))
    outcome = (
        F.when(~admitted(allowed_id=allowed_id), "ignored")
        .when(F.col("reply_error").isNotNull(), "generation_failed")
        .when(reply == "", "empty_reply")
        .when(~F.coalesce("stored", F.lit(True)), "storage_failed")
        .when(F.coalesce("replied", F.lit(False)), "cancelled_manual")
        .when(F.col("send_error").isNotNull(), "failed")
        .otherwise("sent")
    )
    got = events.withColumn("outcome", outcome).withColumn("reply", reply)
    return got.withColumn("recorded", F.col("outcome").isin("cancelled_manual", "failed", "sent")).withColumn("announced", F.col("outcome") == "sent")


def log_rows(answered: DataFrame) -> DataFrame:
    """Rows of the append-only log of recorded events: created (seq 0), delivery (1) and, for what was sent, a pending notification (2), to be written in this order.

    (reply_id, seq, kind, dialog_id, incoming_message_id, text, delivery_status, sent_message_id, notification_status): reply_id is a hash of dialog and message.
    """
    some = answered.where("recorded").withColumn("reply_id", F.xxhash64("dialog_id", "id"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda seq, kind, text=none("string"), status=none("string"), sent=none("long"), note=none("string"): F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), status.alias("delivery_status"), sent.alias("sent_message_id"), note.alias("notification_status"))
    went = F.col("outcome") == "sent"
    rows = F.array(row(0, "created", F.col("reply")), row(1, "delivery", status=F.col("outcome"), sent=F.when(went, F.col("sent_message_id"))), row(2, "notification", note=F.when(went, "pending")))
    return some.select("reply_id", "dialog_id", F.col("id").alias("incoming_message_id"), F.explode(rows).alias("r")).select("reply_id", "r.seq", "r.kind", "dialog_id", "incoming_message_id", "r.text", "r.delivery_status", "r.sent_message_id", "r.notification_status").where("kind <> 'notification' or notification_status is not null")
