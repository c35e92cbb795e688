"""Review by people: authorization, cards and keyboards, and the interaction that waits for a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.functions import text as T

from .feedback import status_label

TTL_MINUTES = 15
MAX_CORRECTION, MAX_COMMENT = 4000, 1000
#: Reasons that a reviewer may choose; should_not_reply has a button of its own.
REASONS = tuple(c for c in T.CATEGORIES if c != "should_not_reply")
OUTCOMES = "user_id long, event_id long, action string, reply_id long, outcome string, feedback_status string, feedback_category string, feedback_comment string, corrected_reply_text string"


def authorized(*, user_id: int, chat_id: int) -> Column:
    """Whether a row (user_id, chat_id, chat_type) is the reviewer's, in the review chat, in private."""
    return F.coalesce((F.col("user_id") == user_id) & (F.col("chat_id") == chat_id) & (F.col("chat_type") == "private"), F.lit(False))


def actions(events: DataFrame) -> DataFrame:
    """Events (user_id, event_id, ts, payload, text) with action, reply_id and value: of a button's payload, or "text" or "command"."""
    call = T.parse_callback(F.col("payload"))
    bare = T.strip(F.coalesce("text", F.lit("")))
    chosen = F.col("call.action")
    reason = F.col("call.value").isin(*REASONS)
    action = (
        F.when(F.col("payload").isNull(), F.when(F.lower(bare) == "/cancel", "command").otherwise("text"))
        .when(F.col("call").isNull(), "unknown")
        .when(chosen.isin("details", "bad", "fix", "no_reply", "good", "cancel"), chosen)
        .when((chosen == "cat") & reason, F.when(F.col("call.value") == "other", "ask").otherwise("cat"))
        .otherwise("unknown")
    )
    got = events.withColumn("call", call).withColumn("action", action).withColumn("bare", bare)
    return got.withColumn("reply_id", F.col("call.reply_id")).withColumn("value", F.col("call.value")).drop("call")


def interactions(events: DataFrame, replies: DataFrame, *, minutes: int = TTL_MINUTES) -> DataFrame:
    """The outcome of each review event, and the feedback that it saves: OUTCOMES.

    A correction or a reason of one's own opens an interaction of the user, in place of one that is open. The next text ends it if it is in time
    (saved) or too late (expired); an empty one, one that begins with "/" or one that is too long leaves it open. Cancelling ends it. So what is open at a text depends on
    the last opening or cancelling, and on whether a text after that ended it: two windows over the user's events, no fold in Python.
    """
    known = replies.select(F.col("id").alias("__id")).distinct()
    a = actions(events).join(known, F.col("reply_id") == F.col("__id"), "left")
    a = a.withColumn("action", F.when(F.col("payload").isNotNull() & F.col("__id").isNull(), "unknown").otherwise(F.col("action"))).drop("__id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("action").isin("fix", "ask", "cancel", "command")
    a = a.withColumn("__segment", F.sum(sets.cast("int")).over(w)).withColumn("__set", F.last(F.when(sets, F.struct("action", "reply_id", "ts")), ignorenulls=True).over(w))
    a = a.withColumn("__kind", F.col("__set.action")).withColumn("__open", F.coalesce(F.col("__kind").isin("fix", "ask"), F.lit(False)))
    late = F.col("__set.ts") + F.make_interval(mins=F.lit(minutes)) <= F.col("ts")
    limit = F.when(F.col("__kind") == "fix", MAX_CORRECTION).otherwise(MAX_COMMENT)
    plain = (F.col("bare") != "") & ~F.startswith("bare", F.lit("/"))
    verdict = F.when(late, "expired").when(~plain, "needs_text").when(F.length("bare") > limit, "too_long").otherwise("saved")
    a = a.withColumn("__text", F.when((F.col("action") == "text") & F.col("__open"), verdict))
    ends = F.max(F.when(F.col("__text").isin("expired", "saved"), 1).otherwise(0)).over(Window.partitionBy("user_id", "__segment").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("__ended", F.coalesce(ends, F.lit(0)) == 1).withColumn("__left", F.col("__open") & ~F.col("__ended"))
    # What was open before a cancelling: that of the row before it, unless that row is a text that ended it.
    was = F.lag(F.col("__left") & ~F.coalesce(F.col("__text").isin("expired", "saved"), F.lit(False))).over(w)
    outcome = (
        F.when(F.col("action") == "text", F.when(F.col("__left"), F.col("__text")).otherwise("nothing_pending"))
        .when(F.col("action").isin("fix", "ask"), "opened")
        .when(F.col("action") == "cancel", "cancelled")
        .when(F.col("action") == "command", F.when(F.coalesce(was, F.lit(False)), "cancelled").otherwise("nothing_pending"))
        .when(F.col("action").isin("good", "no_reply", "cat"), "saved")
        .when(F.col("action") == "bad", "asked_reason")
        .when(F.col("action") == "details", "details")
        .otherwise("unavailable")
    )
    a = a.withColumn("outcome", outcome)
    saved, mine = F.col("outcome") == "saved", F.col("action") == "text"
    fixed = mine & (F.col("__kind") == "fix")
    status = F.when(saved, F.when(F.col("action") == "good", "approved").when(fixed, "corrected").otherwise("rejected"))
    category = F.when(saved, F.when(F.col("action") == "no_reply", "should_not_reply").when(F.col("action") == "cat", F.col("value")).when(mine & ~fixed, "other"))
    target = F.when(mine, F.when(F.col("__left"), F.col("__set.reply_id"))).when(F.col("action") != "command", F.col("reply_id"))
    return a.select(
        "user_id", "event_id", "action", target.alias("reply_id"), "outcome", status.alias("feedback_status"), category.alias("feedback_category"),
        F.when(saved & mine & ~fixed, F.col("bare")).alias("feedback_comment"), F.when(saved & fixed, F.col("bare")).alias("corrected_reply_text"),
    )


def command_feedback(commands: DataFrame, replies: DataFrame, *, own_chat: int) -> DataFrame:
    """Feedback by commands (chat_id, out, event_id, text) in the owner's chat with themselves: the update, or why there is none.

    (event_id, reply_id, status, category, comment, corrected_reply_text, answer): answer is saved, help, unknown_reply, or the error of the command. Rows of
    other chats, of others, and texts that are no command of review aren't answered.
    """
    some = commands.where((F.col("chat_id") == own_chat) & F.col("out")).withColumn("c", T.parse_command(F.col("text"))).where("c.error is null or c.error <> 'unknown_command'")
    known = replies.select(F.col("id").alias("__id")).distinct()
    got = some.join(known, F.col("c.reply_id") == F.col("__id"), "left")
    answer = F.when(F.col("c.error").isNotNull(), F.col("c.error")).when(F.col("c.name") == "help", "help").when(F.col("__id").isNull(), "unknown_reply").otherwise("saved")
    status = F.create_map(*[F.lit(x) for x in ("good", "approved", "bad", "rejected", "fix", "corrected")])[F.col("c.name")]
    return got.select("event_id", F.col("c.reply_id").alias("reply_id"), F.when(answer == "saved", status).alias("status"), F.col("c.category").alias("category"), F.col("c.comment").alias("comment"), F.col("c.correction").alias("corrected_reply_text"), answer.alias("answer"))


def _cut(text: Column, limit: int) -> Column:
    bare = T.strip(F.coalesce(text, F.lit("")))
    return T.escape_html(T.truncate(bare, limit))


def card() -> Column:
    """A reply's review card in HTML; the incoming text falls back to the last of the stored context."""
    incoming = F.coalesce(F.nullif("incoming_message_text", F.lit("")), C.last_user_text(C.decode_context(F.col("context_json"))))
    field = lambda name, value: F.concat(F.lit(f"<b>{name}:</b>"), value)
    own = lambda c: F.concat(F.lit(" "), T.escape_html(F.col(c).cast("string")))
    block = lambda c, limit: F.concat(F.lit("\n"), _cut(c, limit))
    fixed = (F.col("feedback_status") == "corrected") & (F.coalesce("corrected_reply_text", F.lit("")) != "")
    return F.concat_ws(
        "\n\n", F.lit("<b>Reply review</b>"), field("Reply ID", own("id")), field("From", own("dialog_id")), field("Incoming", block(incoming, 1100)), field("Reply", block(F.col("generated_reply_text"), 1500)),
        field("Delivery", own("delivery_status")), field("Review", F.concat(F.lit(" "), T.escape_html(status_label()))), field("Model", own("model")), field("Prompt", own("prompt_version")), field("Generated", own("created_at")),
        F.when(fixed, field("Correction", block(F.col("corrected_reply_text"), 700))),
    )


def details() -> Column:
    """A reply's data line by line, "-" for what it lacks."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    rows = {"Reply ID": "id", "Incoming message ID": "incoming_message_id", "Sent message ID": "sent_message_id", "Delivery": "delivery_status", "Review": "feedback_status", "Category": "feedback_category", "Source": "feedback_source", "Model": "model", "Prompt": "prompt_version", "Generated": "created_at"}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), dash(c)) for k, c in rows.items()])


def _button(label: str, action: str, value: str | None = None) -> Column:
    return F.struct(F.lit(label).alias("label"), T.callback(F.lit(action), F.col("id"), F.lit(value).cast("string")).alias("payload"))


def keyboard() -> Column:
    """Rows of a card's buttons (label, payload)."""
    return F.array(F.array(_button("Good", "good"), _button("Bad", "bad"), _button("Fix", "fix")), F.array(_button("Should not reply", "no_reply"), _button("Details", "details")))


def reason_keyboard() -> Column:
    """Rows of two reasons each, and one to cancel."""
    rows = [F.array(*[_button(c.replace("_", " "), "cat", c) for c in REASONS[i : i + 2]]) for i in range(0, len(REASONS), 2)]
    return F.array(*rows, F.array(_button("Cancel", "cancel")))


def rerendered(outcomes: DataFrame, replies: DataFrame) -> DataFrame:
    """(reply_id, card, keyboard) of the replies whose card changes: those that outcomes saved or cancelled, with the state in replies."""
    changed = outcomes.where("outcome in ('saved', 'cancelled') and reply_id is not null").select(F.col("reply_id").alias("__r")).distinct()
    return replies.join(changed, F.col("id") == F.col("__r"), "left_semi").select(F.col("id").alias("reply_id"), card().alias("card"), keyboard().alias("keyboard"))
