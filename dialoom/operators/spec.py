"""Inbox, audit pages, sequence gaps, quality rates, memory and draft checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T


def keyset_page(df: DataFrame, *, sort: str, key: str, after: tuple | None = None, limit: int = 50, descending: bool = False) -> DataFrame:
    """The next `limit` rows behind the cursor (sort value, key), with has_more; no offset is scanned."""
    if after is not None:
        s, k = F.lit(after[0]), F.lit(after[1])
        df = df.where(((F.col(sort) < s) if descending else (F.col(sort) > s)) | ((F.col(sort) == s) & ((F.col(key) < k) if descending else (F.col(key) > k))))
    order = [F.desc(sort), F.desc(key)] if descending else [F.asc(sort), F.asc(key)]
    page = df.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)  # of limit + 1 rows at most
    return page.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def sorted_by(df: DataFrame, sort: str, *, allowed: set[str], key: str = "id") -> DataFrame:
    """df in the order that a request asks for: a column, "-" before it for descending; ties by the key in the same direction."""
    name, down = sort.removeprefix("-"), sort.startswith("-")
    if name not in allowed:
        raise ValueError(f"no such sort: {name}")
    return df.orderBy(*[(F.desc if down else F.asc)(c) for c in (name, key)])


def history_before(messages: DataFrame, dialog_id: int, *, before: int | None = None, limit: int = 50) -> DataFrame:
    """The `limit` messages of a dialog before one, newest first, with has_more."""
    own = messages.where(F.col("dialog_id") == dialog_id)
    got = (own if before is None else own.where(F.col("id") < before)).orderBy(F.desc("id")).limit(limit + 1)
    w = Window.orderBy(F.desc("id"))  # of limit + 1 rows at most
    return got.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def inbox(messages: DataFrame) -> DataFrame:
    """(dialog_id, last_id, last_role, last_text, n_messages, unread): unread are messages of the other one after the owner's last."""
    own = F.max(F.when(F.col("outgoing"), F.col("id"))).over(Window.partitionBy("dialog_id"))
    return messages.withColumn("__own", own).groupBy("dialog_id").agg(
        F.max("id").alias("last_id"), F.max_by("outgoing", "id").alias("last_outgoing"), F.max_by("text", "id").alias("last_text"), F.count("*").alias("n_messages"),
        F.count_if(~F.col("outgoing") & (F.col("id") > F.coalesce("__own", F.lit(-1)))).alias("unread"),
    )


def sequence_gaps(events: DataFrame, *, by: str, order: list[str], sequence: str) -> DataFrame:
    """Rows whose sequence number doesn't follow that of the row before, with how many are missing."""
    before = F.lag(sequence).over(Window.partitionBy(by).orderBy(*order))
    return events.withColumn("missing", F.col(sequence) - before - 1).where("missing > 0")


def quality_rates(replies: DataFrame, by: Column) -> DataFrame:
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    s = F.col("feedback_status")
    return replies.groupBy(by.alias("grp")).agg(F.count("*").alias("n"), share(s == "approved").alias("approval_rate"), share(s == "corrected").alias("edit_rate"), share(s == "rejected").alias("rejection_rate"), share(F.col("delivery_status") != "sent").alias("no_response_rate"))


def idempotent(commands: DataFrame) -> DataFrame:
    """Adds outcome: first, replay (same payload as the first of its key) or conflict. commands: (key, seq, payload)."""
    w = Window.partitionBy("key").orderBy("seq")
    first = F.first(F.sha2("payload", 256)).over(w)
    return commands.withColumn("outcome", F.when(F.row_number().over(w) == 1, "first").when(first == F.sha2("payload", 256), "replay").otherwise("conflict"))


def idempotent_for(commands: DataFrame, *, hours: int = 24) -> DataFrame:
    """idempotent, with a record kept for `hours` from the command that made it: a later one with the key is first again. commands: (key, seq, at, payload).

    A period begins at its first command and ends `hours` after it, so that periods don't follow from gaps between neighbours: they are folded over each key's distinct period starts.
    """
    w = Window.partitionBy("key").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    span = hours * 3_600_000_000
    # The start of the period of each command, by a fold over the times so far; a key has few commands, as it names one action.
    times = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.unix_micros("at").alias("us"))).over(whole)), lambda t: t["us"])
    start = F.aggregate(times, F.lit(None).cast("long"), lambda s, t: F.when(s.isNull() | (t - s >= span), t).otherwise(s))
    kept = commands.withColumn("__start", start)
    inside = Window.partitionBy("key", "__start").orderBy("seq")
    first = F.first(F.sha2("payload", 256)).over(inside)
    return kept.withColumn("outcome", F.when(F.row_number().over(inside) == 1, "first").when(first == F.sha2("payload", 256), "replay").otherwise("conflict")).drop("__start")


#: Why a draft no longer counts, the first that holds.
STALE = ("manual_invalidation", "conversation_blocked", "conversation_paused", "human_takeover", "agent_changed", "critical_configuration_changed", "human_message_sent", "new_incoming_message")


def stale_drafts(drafts: DataFrame, dialogs: DataFrame, messages: DataFrame) -> DataFrame:
    """Drafts with stale_reason, one of STALE, or null.

    drafts: (draft_id, dialog_id, based_on_id, agent_id, config_version, invalidated); dialogs: (dialog_id, status, agent_id, config_version); messages: (dialog_id, id, outgoing).
    """
    last = messages.groupBy("dialog_id").agg(F.max("id").alias("last_id"), F.max(F.when(F.col("outgoing"), F.col("id"))).alias("last_own"))
    d = dialogs.select("dialog_id", F.col("status").alias("__status"), F.col("agent_id").alias("__agent"), F.col("config_version").alias("__config"))
    both = drafts.join(d, "dialog_id", "left").join(last, "dialog_id", "left")
    status = F.col("__status")
    holds = [F.col("invalidated"), status == "blocked", status == "paused", status == "human_active", F.col("__agent") != F.col("agent_id"), F.col("__config") != F.col("config_version"), F.col("last_own") > F.col("based_on_id"), F.col("last_id") > F.col("based_on_id")]
    reason = F.coalesce(*[F.when(c, r) for c, r in zip(holds, STALE)])
    return both.withColumn("stale_reason", reason).drop("__status", "__agent", "__config", "last_id", "last_own")


def decisions(commands: DataFrame, drafts: DataFrame) -> DataFrame:
    """Outcome of each command over drafts, in order: (draft_id, seq, action, outcome, status, draft_version).

    commands: (draft_id, seq, action: approve | edit | reject, expected_draft_version, expected_dialog_version); drafts: (draft_id, status, version, dialog_version, stale_reason). A stale draft answers
    DRAFT_STALE, another version than the expected VERSION_CONFLICT, a draft that isn't pending NOT_PENDING. A command that holds raises the draft's version by one: approve and reject
    close it, an edit leaves it open. Commands of a draft are few: they are folded in one array.
    """
    known = drafts.select("draft_id", F.col("status").alias("__status"), F.col("version").cast("long").alias("__version"), F.col("dialog_version").cast("long").alias("__dialog"), "stale_reason")
    asked = commands.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", F.col("expected_draft_version").cast("long").alias("dv"), F.col("expected_dialog_version").cast("long").alias("cv")))).alias("cs"))
    both = asked.join(known, "draft_id")
    row = lambda c, outcome, status, version: F.struct(c["seq"].alias("seq"), c["action"].alias("action"), outcome.alias("outcome"), status.alias("status"), version.alias("draft_version"))

    def fold(s: Column, c: Column) -> Column:
        outcome = (
            F.when(F.col("stale_reason").isNotNull(), "DRAFT_STALE")
            .when((c["dv"] != s["version"]) | (c["cv"] != F.col("__dialog")), "VERSION_CONFLICT")
            .when(~s["status"].isin("pending_approval", "edited"), "NOT_PENDING")
            .otherwise("ok")
        )
        ok = outcome == "ok"
        status = F.when(ok, F.when(c["action"] == "approve", "approved").when(c["action"] == "reject", "rejected").otherwise("edited")).otherwise(s["status"])
        version = s["version"] + ok.cast("long")
        return F.struct(status.alias("status"), version.alias("version"), F.concat(s["out"], F.array(row(c, outcome, status, version))).alias("out"))

    start = F.struct(F.col("__status").alias("status"), F.col("__version").alias("version"), F.array().cast("array<struct<seq:bigint,action:string,outcome:string,status:string,draft_version:bigint>>").alias("out"))
    return both.select("draft_id", F.explode(F.aggregate("cs", start, fold, lambda s: s["out"])).alias("r")).select("draft_id", "r.*")


def versioned(commands: DataFrame) -> DataFrame:
    """Updates (key, seq, expected_version) of rows that begin at version 0, with outcome applied or VERSION_CONFLICT, and the version behind it."""
    steps = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("expected_version").cast("long").alias("v"))))
    start = F.struct(F.lit(0).cast("long").alias("version"), F.array().cast("array<struct<seq:bigint,outcome:string,version:bigint>>").alias("out"))

    def fold(s: Column, c: Column) -> Column:
        ok = c["v"] == s["version"]
        now = s["version"] + ok.cast("long")
        return F.struct(now.alias("version"), F.concat(s["out"], F.array(F.struct(c["seq"].alias("seq"), F.when(ok, "applied").otherwise("VERSION_CONFLICT").alias("outcome"), now.alias("version")))).alias("out"))

    return commands.groupBy("key").agg(steps.alias("cs")).select("key", F.explode(F.aggregate("cs", start, fold, lambda s: s["out"])).alias("r")).select("key", "r.*")


def inbox_filter(rows: DataFrame, *, search: str | None = None, low_confidence: bool | None = None, unresolved: bool | None = None, has_warnings: bool | None = None, threshold: float = 0.5, **equal) -> DataFrame:
    """Rows of an inbox that meet all given filters; what isn't given filters nothing.

    equal: account_id, agent_id, contact_id, status, pending_action, operator_id. low_confidence: below `threshold`; unresolved: no status of resolved or archived; has_warnings:
    a warning at least; search: in the contact's name or the last text, without regard to case.
    """
    unknown = set(equal) - {"account_id", "agent_id", "contact_id", "status", "pending_action", "operator_id"}
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    no = F.lit(False)
    for given, held in ((low_confidence, F.coalesce(F.col("confidence") < threshold, no)), (unresolved, ~F.coalesce(F.col("status").isin("resolved", "archived"), no)), (has_warnings, F.coalesce(F.size("warnings") > 0, no))):
        if given is not None:
            rows = rows.where(held == F.lit(given))
    if search:
        low = F.lit(search.lower())
        rows = rows.where(F.contains(F.lower(F.coalesce("contact_name", F.lit(""))), low) | F.contains(F.lower(F.coalesce("last_text", F.lit(""))), low))
    return rows


def audit_filter(events: DataFrame, *, since=None, until=None, at: str = "ts", **equal) -> DataFrame:
    """Audit events with the given values, from `since` on and before `until`; the range reaches the scan."""
    for c, v in equal.items():
        if v is not None:
            events = events.where(F.col(c) == F.lit(v))
    if since is not None:
        events = events.where(F.col(at) >= F.lit(since).cast("timestamp"))
    return events if until is None else events.where(F.col(at) < F.lit(until).cast("timestamp"))


def queue_health(jobs: DataFrame, as_of: Column, *, stuck_minutes: int = 10) -> DataFrame:
    """One row of counts over jobs (status, run_at, started_at): pending, delayed (pending, but not due), failed, and stuck (running for too long)."""
    due = F.coalesce(F.col("run_at") <= as_of, F.lit(True))
    late = F.coalesce(F.col("started_at") < as_of - F.make_interval(mins=F.lit(stuck_minutes)), F.lit(False))
    s = F.col("status")
    return jobs.agg(F.count_if((s == "pending") & due).alias("pending"), F.count_if((s == "pending") & ~due).alias("delayed"), F.count_if(s == "failed").alias("failed"), F.count_if((s == "running") & late).alias("stuck"))


def quality_trends(replies: DataFrame, *, day: Column, by: list[str]) -> DataFrame:
    """Rates and mean latency by day and by each of `by`, with subtotals: a null in a group's column (its grouping flag is 1) is the total over it.

    replies: (feedback_status, delivery_status, handed_off, latency_seconds, and the columns of by). One shuffle: sums are added up before rates are taken.
    """
    s = F.col("feedback_status")
    yes = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    keys = ["day", *by]
    grouped = replies.withColumn("day", day).rollup(*keys).agg(
        F.count("*").alias("n"), yes(s == "approved").alias("approved"), yes(s == "corrected").alias("corrected"), yes(s == "rejected").alias("rejected"), yes(F.col("delivery_status") != "sent").alias("unanswered"),
        yes(F.col("handed_off")).alias("handed_off"), F.sum("latency_seconds").alias("latency"), F.count("latency_seconds").alias("timed"), F.grouping_id().alias("level"),
    )
    rate = lambda c, name: F.round(F.col(c) / F.col("n"), 6).alias(name)
    return grouped.select(*keys, "level", "n", rate("approved", "approval_rate"), rate("corrected", "edit_rate"), rate("rejected", "rejection_rate"), rate("unanswered", "no_response_rate"), rate("handed_off", "handoff_rate"), F.round(F.col("latency") / F.col("timed"), 6).alias("mean_latency"))


def contradictions(memory: DataFrame) -> DataFrame:
    """Facts of one account, agent, contact and key with more than one value."""
    return memory.groupBy("account", "agent", "contact", "key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def remembered(memory: DataFrame, as_of: Column, *, days: int = 90) -> DataFrame:
    """The newest of each fact's equal values, with stale (not confirmed for `days`) and contradicted; memory: (account, agent, contact, key, value, at, source).

    Values that differ in case or white space alone are one. Facts of other accounts, agents or contacts never meet.
    """
    scope = ["account", "agent", "contact", "key"]
    same = F.sha2(T.collapse(F.lower("value")), 256)
    newest = F.row_number().over(Window.partitionBy(*scope, "__value").orderBy(F.desc("at"), "source"))
    one = memory.withColumn("__value", same).withColumn("__at", newest).where("__at = 1")
    several = F.count("*").over(Window.partitionBy(*scope)) > 1
    return one.withColumn("contradicted", several).withColumn("stale", F.col("at") < as_of - F.make_interval(days=F.lit(days))).drop("__value", "__at")


EVENT_TYPES = (
    "message.received", "message.queued", "message.sent", "message.failed", "message.edited", "message.deleted", "draft.created", "draft.updated", "draft.stale", "draft.rejected", "typing.started", "typing.stopped",
    "conversation.updated", "conversation.takeover", "conversation.returned_to_agent", "account.connected", "account.disconnected", "account.error", "system.emergency_stopped", "system.emergency_resumed", "system.health_changed",
)


def typed_events(events: DataFrame) -> DataFrame:
    """Events with entity and verb of their type, and `known`: whether the type is one of EVENT_TYPES."""
    parts = F.split("event_type", "\\.", 2)
    return events.withColumn("known", F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))).withColumn("entity", F.when(F.col("known"), parts[0])).withColumn("verb", F.when(F.col("known"), parts[1]))
