"""Review interactions and announcements as stateful streams; each gives what its batch form in operators gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoom.functions import text as T
from dialoom.operators import feedback, review

#: Rows that are given back at once.
PART = 10_000
_STATE = "kind string, reply_id long, expires long"


def _review(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        # Long expired: a text that still comes would only be told so once, and is told that nothing is pending instead.
        state.remove()
        return
    kind, open_id, expires = state.get if state.exists else (None, None, 0)
    names = [c.split()[0] for c in review.OUTCOMES.split(", ")]
    # A user's rows may come in several parts, in no order: they are sorted as a whole.
    rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: (r.us, r.event_id))
    for k in range(0, len(rows), PART):
        out = []
        for r in rows[k : k + PART]:
            known, action = bool(r.known), r.action
            if not r.is_text and not known:
                action = "unknown"
            reply = None if pd.isna(r.reply_id) else int(r.reply_id)
            outcome, status, category, comment, fixed = "unavailable", None, None, None, None
            if action == "text":
                reply = open_id
                if kind is None:
                    outcome, reply = "nothing_pending", None
                elif expires <= r.us:
                    outcome, kind = "expired", None
                elif not r.bare or r.bare.startswith("/"):
                    outcome = "needs_text"
                elif len(r.bare) > (review.MAX_CORRECTION if kind == "fix" else review.MAX_COMMENT):
                    outcome = "too_long"
                else:
                    outcome, status, category = "saved", "corrected" if kind == "fix" else "rejected", None if kind == "fix" else "other"
                    comment, fixed = (None, r.bare) if kind == "fix" else (r.bare, None)
                    kind = None
            elif action == "command":
                outcome, kind, reply = "nothing_pending" if kind is None else "cancelled", None, None
            elif action in ("fix", "ask"):
                outcome, kind, open_id, expires = "opened", action, reply, int(r.us) + review.TTL_MINUTES * 60_000_000
            elif action == "cancel":
                outcome, kind = "cancelled", None
            elif action in ("good", "no_reply", "cat"):
                outcome, status = "saved", "approved" if action == "good" else "rejected"
                category = {"no_reply": "should_not_reply", "cat": r.value}.get(action)
            elif action == "bad":
                outcome = "asked_reason"
            elif action == "details":
                outcome = "details"
            out.append((key[0], r.event_id, action, reply, outcome, status, category, comment, fixed))
        yield pd.DataFrame(out, columns=names).astype({"reply_id": "Int64"})
    if kind is None:
        state.remove()
    else:
        state.update((kind, open_id, expires))
        # A day after it expired the entry goes, so that state doesn't grow with all users that there ever were.
        state.setTimeoutTimestamp(max(expires // 1000, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)


def interactions(events: DataFrame, replies: DataFrame) -> DataFrame:
    """Streaming form of operators.review.interactions; a user's events come in order from one micro-batch to the next, and those more than a day behind the newest are dropped. replies is a static table."""
    known = replies.select(F.col("id").alias("__id")).distinct().withColumn("known", F.lit(True))
    a = review.actions(events.withWatermark("ts", "1 day")).join(known, F.col("reply_id") == F.col("__id"), "left")
    rows = a.select("user_id", "ts", "event_id", "action", "reply_id", "value", "bare", F.col("payload").isNull().alias("is_text"), F.coalesce("known", F.lit(False)).alias("known"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_review, review.OUTCOMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_TRIED = "reply_id long, seq long, outcome string, attempt long, notification_error string"


def _notify(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, attempt = state.get if state.exists else (False, -1)
    rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.seq)
    for k in range(0, len(rows), PART):
        out = []
        for r in rows[k : k + PART]:
            attempt = max(attempt, int(r.before))
            if done or not r.claimable or attempt >= feedback.MAX_ATTEMPTS:
                outcome = "refused"
            else:
                attempt += 1
                done = r.category is None
                outcome = "sent" if done else "failed"
            out.append((key[0], r.seq, outcome, attempt, r.category if outcome == "failed" else None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _TRIED.split(", ")])
    state.update((done, attempt))


def notifications(tries: DataFrame, replies: DataFrame) -> DataFrame:
    """Streaming form of operators.feedback.notification_fold, as far as the outcome of each try: at most one message a reply, three tries in all.

    tries: (reply_id, seq, error). replies is a static table with the state before the stream.
    """
    known = replies.select(F.col("id").alias("__id"), F.coalesce(feedback.claimable(), F.lit(False)).alias("claimable"), F.col("notification_attempts").cast("long").alias("before"))
    rows = tries.join(known, F.col("reply_id") == F.col("__id")).select("reply_id", "seq", "claimable", "before", F.when(F.col("error").isNotNull(), T.error_category(F.col("error"))).alias("category"))
    return rows.groupBy("reply_id").applyInPandasWithState(_notify, _TRIED, "done boolean, attempt long", "append", GroupStateTimeout.NoTimeout)


def feedback_commands(commands: DataFrame, replies: DataFrame, *, own_chat: int) -> DataFrame:
    """operators.review.command_feedback over a stream of commands: it holds no state."""
    return review.command_feedback(commands, replies, own_chat=own_chat)
