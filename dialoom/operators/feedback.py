"""Review log: an append-only event table folded into the latest state of each reply, what is read from it, and the life of an announcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.functions import text as T

MAX_ATTEMPTS = 3
FEEDBACK = ("feedback_status", "feedback_category", "feedback_comment", "corrected_reply_text", "feedback_updated_at", "feedback_source", "feedback_trainer_user_id")
DELIVERY = ("delivery_status", "sent_message_id", "sent_at")
NOTIFICATION = ("notification_status", "notification_last_attempt_at", "notification_error")


def migrate(replies: DataFrame) -> DataFrame:
    """A log of an earlier version with the columns that were added since; feedback without a source came from saved messages."""
    added = {
        "incoming_message_text": F.lit(""), "feedback_source": F.lit(None).cast("string"), "feedback_trainer_user_id": F.lit(None).cast("long"), "review_chat_id": F.lit(None).cast("long"),
        "review_message_id": F.lit(None).cast("long"), "notification_status": F.lit("not_requested"), "notification_attempts": F.lit(0), "notification_last_attempt_at": F.lit(None).cast("timestamp"), "notification_error": F.lit(None).cast("string"),
    }
    got = replies.withColumns({c: v for c, v in added.items() if c not in replies.columns})
    return got.withColumn("feedback_source", F.when((F.col("feedback_status") != "unreviewed") & F.col("feedback_source").isNull(), "saved_messages").otherwise(F.col("feedback_source")))


def state(events: DataFrame) -> DataFrame:
    """Latest state by reply from events (reply_id, seq, kind, and the columns that the kind sets).

    A delivery or a feedback event replaces all columns of its kind, with nulls too; a notification event replaces status, time and error, and
    keeps the ids of the chat and the message where it has none; a claim counts an attempt and clears the error. One shuffle, with partial aggregation.
    """
    columns = set(events.columns)
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("seq"))
    whole = lambda kind, cols: F.max_by(F.struct(*[F.col(c) for c in cols if c in columns]), at(kind))
    parts = [whole("delivery", DELIVERY).alias("d"), whole("feedback", FEEDBACK).alias("f")]
    out = [F.coalesce("d.delivery_status", F.lit("generated")).alias("delivery_status"), *[F.col(f"d.{c}") for c in DELIVERY[1:] if c in columns], F.coalesce("f.feedback_status", F.lit("unreviewed")).alias("feedback_status"), *[F.col(f"f.{c}") for c in FEEDBACK[1:] if c in columns]]
    if "notification_status" in columns:
        parts += [F.max_by(F.struct(*NOTIFICATION), at("notification", "claim")).alias("n"), F.count_if(F.col("kind") == "claim").cast("int").alias("notification_attempts")]
        out += [F.coalesce("n.notification_status", F.lit("not_requested")).alias("notification_status"), "notification_attempts", *[F.col(f"n.{c}") for c in NOTIFICATION[1:]]]
    for c in ("review_chat_id", "review_message_id"):
        if c in columns:
            parts.append(F.max_by(c, F.when(F.col(c).isNotNull(), at("notification"))).alias(c))
            out.append(F.col(c))
    return events.groupBy("reply_id").agg(*parts).select("reply_id", *out)


def point(replies: DataFrame, reply_id: int) -> DataFrame:
    """The reply with this id; the filter reaches the scan."""
    return replies.where(F.col("id") == reply_id)


def counts(replies: DataFrame) -> DataFrame:
    """One row of six counts; total covers replies that weren't delivered, too."""
    n = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    return replies.agg(F.count("*").alias("total"), *[n("feedback_status", s).alias(s) for s in ("unreviewed", "approved", "rejected", "corrected")], n("delivery_status", "failed").alias("delivery_failures"))


def reviewed(replies: DataFrame, *, redact: bool = False) -> DataFrame:
    """Reviewed replies with the preferred one: the original if approved, the correction if corrected."""
    own, fixed = F.col("generated_reply_text"), F.col("corrected_reply_text")
    if redact:
        own, fixed = T.redact(own), T.redact(fixed)
    preferred = F.when(F.col("feedback_status") == "approved", own).when(F.col("feedback_status") == "corrected", fixed)
    source = F.coalesce(F.nullif("feedback_source", F.lit("")), F.lit("saved_messages"))
    return replies.where("feedback_status <> 'unreviewed'").withColumn("preferred_reply", preferred).withColumn("feedback_source", source)


def split(reviewed_replies: DataFrame) -> DataFrame:
    """Adds part: positive (approved, corrected) or negative (rejected)."""
    return reviewed_replies.withColumn("part", F.when(F.col("feedback_status").isin("approved", "corrected"), "positive").when(F.col("feedback_status") == "rejected", "negative"))


def export_rows(replies: DataFrame, *, redact: bool = True) -> DataFrame:
    """One row a reviewed reply, as exported: context without provenance where it is redacted, the original and the preferred reply, and part.

    A context that can't be read raises: an export must not lose it silently.
    """
    hide = T.redact if redact else (lambda c: c)
    context = F.transform(C.strict_context(F.col("context_json")), lambda t: F.struct(t["role"].alias("role"), hide(t["text"]).alias("text")))
    rows = split(reviewed(replies, redact=redact)).withColumn("context", context).withColumn("original_generated_reply", hide(F.col("generated_reply_text")))
    wanted = ("dialog_id", "incoming_message_id", "sent_message_id", "prompt_version", "model", "context", "original_generated_reply", "preferred_reply", "feedback_status", "feedback_category", "feedback_comment", "feedback_source", "feedback_trainer_user_id", "created_at", "part")
    return rows.select(F.col("id").alias("reply_id"), *[c for c in wanted if c in rows.columns])


def export_summary(replies: DataFrame, *, redact: bool = True) -> DataFrame:
    """One row: reviewed, positive, negative and corrected replies, and redactions by category over contexts, originals and corrections."""
    rows = replies.where("feedback_status <> 'unreviewed'")
    n = lambda *s: F.count_if(F.col("feedback_status").isin(*s))
    texts = F.concat(F.transform(C.decode_context(F.col("context_json")), lambda t: t["text"]), F.array("generated_reply_text", "corrected_reply_text"))
    found = {k: F.coalesce(F.sum(F.aggregate(F.transform(texts, lambda t: F.coalesce(T.redaction_counts(t)[k], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)) if redact else F.lit(0).cast("long") for k, _ in T.STAGES}
    return rows.agg(F.count("*").alias("reviewed_replies"), n("approved", "corrected").alias("positive_examples"), n("rejected").alias("negative_examples"), n("corrected").alias("corrected_examples"), *[c.alias(f"redacted_{k}") for k, c in found.items()])


def recent(replies: DataFrame, *, unreviewed: bool = False, limit: int = 5) -> DataFrame:
    got = replies.where("delivery_status = 'sent'")
    return (got.where("feedback_status = 'unreviewed'") if unreviewed else got).orderBy(F.desc("id")).limit(limit)


def claimable() -> Column:
    """Whether an announcement may be claimed now."""
    return F.col("review_message_id").isNull() & F.col("notification_status").isin("not_requested", "pending", "failed") & (F.col("notification_attempts") < MAX_ATTEMPTS) & (F.col("delivery_status") == "sent")


def claim(replies: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """replies with the claims of ids (id) applied where they are allowed, and `claimed`."""
    asked = replies.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    ok = F.coalesce(F.col("__id").isNotNull() & claimable(), F.lit(False))
    got = asked.withColumn("claimed", ok).drop("__id")
    put = lambda c, v: F.when(F.col("claimed"), v).otherwise(F.col(c))
    return got.withColumns({
        "notification_status": put("notification_status", F.lit("sending")), "notification_attempts": put("notification_attempts", F.col("notification_attempts") + 1),
        "notification_last_attempt_at": put("notification_last_attempt_at", at), "notification_error": put("notification_error", F.lit(None).cast("string")),
    })


def pending_notifications(replies: DataFrame, *, limit: int = 20) -> DataFrame:
    """Delivered replies whose announcement is due: none was made, the last try failed or none was begun, and tries are left; the least ids first."""
    due = F.col("review_message_id").isNull() & F.col("notification_status").isin("pending", "failed") & (F.col("notification_attempts") < MAX_ATTEMPTS)
    return replies.where((F.col("delivery_status") == "sent") & due).orderBy("id").limit(limit)


def requeue_stale(replies: DataFrame, as_of: Column, *, minutes: int = 5) -> DataFrame:
    """Announcements underway for more than `minutes` without a message failed, as interrupted; times are compared as such, not as strings."""
    late = F.col("notification_last_attempt_at") < as_of - F.make_interval(mins=F.lit(minutes))
    stale = F.coalesce((F.col("notification_status") == "sending") & late & F.col("review_message_id").isNull(), F.lit(False))
    return replies.withColumns({"notification_status": F.when(stale, "failed").otherwise(F.col("notification_status")), "notification_error": F.when(stale, "interrupted").otherwise(F.col("notification_error"))})


def notification_fold(replies: DataFrame, tries: DataFrame) -> DataFrame:
    """Replies after their tries (reply_id, seq, at, error, message_id), in order of seq: outcome of each try, and the state behind it.

    A try is claimed if the reply may be announced and no try before it went through; tries are counted on from the reply's own. An error (a name)
    fails a claimed try with its category, a message ends it. As nothing but success or the third try ends claiming, windows suffice: no fold in Python.
    (reply_id, seq, outcome, attempt, notification_status, notification_error, backoff): outcome is sent, failed or refused; backoff, in seconds, is what the next try waits.
    """
    known = replies.select(F.col("id").alias("__id"), F.coalesce(claimable(), F.lit(False)).alias("__open"), F.col("notification_attempts").alias("__before"), F.col("notification_status").alias("__status"), F.col("notification_error").alias("__error"))
    w = Window.partitionBy("reply_id").orderBy("seq")
    got = tries.join(known, F.col("reply_id") == F.col("__id")).withColumn("attempt", F.col("__before") + F.row_number().over(w))
    went = F.max(F.when(F.col("error").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    claimed = F.col("__open") & (F.col("attempt") <= MAX_ATTEMPTS) & (F.coalesce(went, F.lit(0)) == 0)
    got = got.withColumn("outcome", F.when(~claimed, "refused").when(F.col("error").isNull(), "sent").otherwise("failed"))
    did = lambda c: F.last(F.when(F.col("outcome") != "refused", c), ignorenulls=True).over(w)
    last = did(F.struct(F.col("outcome").alias("s"), F.when(F.col("outcome") == "failed", T.error_category(F.col("error"))).alias("e")))
    got = got.withColumn("__last", last).withColumn("attempt", F.least("attempt", F.coalesce(did(F.col("attempt")), F.col("__before"))))
    return got.select(
        "reply_id", "seq", "outcome", F.col("attempt").cast("long").alias("attempt"), F.coalesce("__last.s", "__status").alias("notification_status"),
        F.when(F.col("__last").isNull(), F.col("__error")).otherwise(F.col("__last.e")).alias("notification_error"),
        F.when((F.col("outcome") == "failed") & (F.col("attempt") < MAX_ATTEMPTS), F.least(F.pow(F.lit(2.0), F.col("attempt") - 1 - F.col("__before")), F.lit(2.0)).cast("long")).alias("backoff"),
    )


def known_ai(replies: DataFrame) -> DataFrame:
    """(dialog_id, sent_message_id) of the delivered replies of the machine."""
    return replies.where("delivery_status = 'sent' and sent_message_id is not null").select("dialog_id", "sent_message_id").distinct()


def duplicate_sent_ids(replies: DataFrame) -> DataFrame:
    """Sent ids that break uniqueness; empty if all is well."""
    return replies.where("sent_message_id is not null").groupBy("dialog_id", "sent_message_id").agg(F.count("*").alias("n")).where("n > 1")


def status_label() -> Column:
    """What a card says of a reply's review."""
    status, category = F.col("feedback_status"), F.col("feedback_category")
    return (
        F.when(status == "approved", "Approved")
        .when(status == "corrected", "Corrected")
        .when((status == "rejected") & F.coalesce(category == "should_not_reply", F.lit(False)), "Should not have replied")
        .when(status == "rejected", F.concat(F.lit("Rejected ("), F.coalesce(F.nullif(category, F.lit("")), F.lit("unspecified")), F.lit(")")))
        .otherwise("Awaiting review")
    )


def cascade(pending: DataFrame, replies: DataFrame) -> DataFrame:
    """Pending interactions whose reply still exists."""
    return pending.join(replies.select(F.col("id").alias("reply_id")), "reply_id", "left_semi")
