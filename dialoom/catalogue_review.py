"""Queries of the live side: review, announcements, replies, their streams; with DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.catalogue import _OBJECTS, FEEDBACK_EXAMPLES, MSG, REPLIES, _history, _replies, _strip, query
from dialoom.functions import codecs as C
from dialoom.functions import text as T
from dialoom.operators import extract, feedback, live, review
from dialoom.sources import tables as S
from dialoom.streaming import fragments as fragment_stream
from dialoom.streaming import review as review_stream

#: Review events from the events table, a twentieth as far apart in time, so that some texts come in time and some too late.
_EVENTS = (
    "user_id, event_id, {us} AS us, CASE event_id % 9 WHEN 0 THEN concat('fix:', event_id % 1000) WHEN 1 THEN concat('cat:', event_id % 1000, ':other') WHEN 2 THEN concat('good:', event_id % 1000) WHEN 3 THEN concat('cat:', event_id % 1000, ':too_long') "
    "WHEN 4 THEN CASE event_id % 4 WHEN 0 THEN concat('cancel:', event_id % 1000) WHEN 1 THEN concat('details:', event_id % 1000) WHEN 2 THEN concat('no_reply:', event_id % 1000) ELSE 'cat:x:nothing' END END AS payload, "
    "CASE WHEN event_id % 9 > 4 THEN CASE event_id % 13 WHEN 0 THEN '  ' WHEN 1 THEN '/help' WHEN 2 THEN '/cancel' WHEN 3 THEN repeat('x', 1001) WHEN 4 THEN repeat('y', 4001) ELSE concat(' answer ', event_id, ' ') END END AS text"
)


def _review_events(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").selectExpr(*S._split(_EVENTS.format(us="unix_micros(cast(ts AS timestamp)) div 20"))).withColumn("ts", F.timestamp_micros("us")).drop("us")


#: One event after the other by recursion: state is (kind, reply, expires).
INTERACTIONS = f"""WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM labels JOIN documents USING (doc_id)), e AS (SELECT {_EVENTS.format(us="epoch_us(ts) // 20")} FROM events),
p AS (SELECT *, split_part(payload, ':', 1) AS act, TRY_CAST(split_part(payload, ':', 2) AS BIGINT) AS rid, split_part(payload, ':', 3) AS val, trim(coalesce(text, '')) AS bare, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e),
a AS (SELECT p.*, CASE WHEN payload IS NULL THEN CASE WHEN lower(bare) = '/cancel' THEN 'command' ELSE 'text' END WHEN ids.id IS NULL THEN 'unknown' WHEN act = 'cat' THEN CASE WHEN val = 'other' THEN 'ask' WHEN val = 'too_long' THEN 'cat' ELSE 'unknown' END ELSE act END AS action FROM p LEFT JOIN ids ON ids.id = p.rid),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::BIGINT AS rid, NULL::VARCHAR AS bare, NULL::VARCHAR AS val, NULL::VARCHAR AS kind, NULL::BIGINT AS open_id, 0::BIGINT AS expires, NULL::VARCHAR AS outcome, NULL::VARCHAR AS was, NULL::BIGINT AS was_id FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL SELECT user_id, n, event_id, action, rid, bare, val,
    CASE WHEN action IN ('fix', 'ask') THEN action WHEN action IN ('cancel', 'command') OR o IN ('expired', 'saved') AND action = 'text' THEN NULL ELSE kind END, CASE WHEN action IN ('fix', 'ask') THEN rid ELSE open_id END, CASE WHEN action IN ('fix', 'ask') THEN us + 900000000 ELSE expires END, o, kind, open_id
  FROM (SELECT a.user_id, a.n, a.event_id, a.action, a.rid, a.bare, a.val, a.us, s.kind, s.open_id, s.expires, CASE WHEN a.action = 'text' THEN CASE WHEN s.kind IS NULL THEN 'nothing_pending' WHEN s.expires <= a.us THEN 'expired' WHEN a.bare = '' OR a.bare LIKE '/%' THEN 'needs_text' WHEN length(a.bare) > CASE s.kind WHEN 'fix' THEN 4000 ELSE 1000 END THEN 'too_long' ELSE 'saved' END
    WHEN a.action IN ('fix', 'ask') THEN 'opened' WHEN a.action = 'cancel' THEN 'cancelled' WHEN a.action = 'command' THEN CASE WHEN s.kind IS NULL THEN 'nothing_pending' ELSE 'cancelled' END WHEN a.action IN ('good', 'no_reply', 'cat') THEN 'saved' WHEN a.action = 'details' THEN 'details' WHEN a.action = 'bad' THEN 'asked_reason' ELSE 'unavailable' END AS o
    FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1))
SELECT user_id, event_id, action, CASE WHEN action = 'text' THEN CASE WHEN was IS NOT NULL THEN was_id END WHEN action <> 'command' THEN rid END AS reply_id, outcome,
  CASE WHEN outcome = 'saved' THEN CASE WHEN action = 'good' THEN 'approved' WHEN action = 'text' AND was = 'fix' THEN 'corrected' ELSE 'rejected' END END AS feedback_status,
  CASE WHEN outcome = 'saved' THEN CASE action WHEN 'no_reply' THEN 'should_not_reply' WHEN 'cat' THEN val WHEN 'text' THEN CASE WHEN was = 'ask' THEN 'other' END END END AS feedback_category,
  CASE WHEN outcome = 'saved' AND action = 'text' AND was = 'ask' THEN bare END AS feedback_comment, CASE WHEN outcome = 'saved' AND action = 'text' AND was = 'fix' THEN bare END AS corrected_reply_text FROM s WHERE n > 0"""


@query(INTERACTIONS)
def review_interactions(spark, d):
    return review.interactions(_review_events(spark, d), _replies(spark, d))


def _streamed(spark: SparkSession, rows: DataFrame, transform, *sort: str, files: int = 3) -> DataFrame:
    """The result of a stream over rows that come in `files` micro-batches, in the order of sort."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="dialoom-") if spark.sparkContext.master.startswith("local") else None)
    if shared is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    parts = rows.repartitionByRange(files, *sort).withColumn("__part", F.spark_partition_id())
    parts.write.partitionBy("__part").parquet(f"{at}/rows")
    # A micro-batch takes one file, the oldest first: files are written one after the other.
    written = spark.read.parquet(f"{at}/rows")
    for k in range(files):
        written.where(F.col("__part") == k).drop("__part").coalesce(1).sortWithinPartitions(*sort).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = transform(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(INTERACTIONS)
def stream_review_interactions(spark, d):
    replies = _replies(spark, d)
    return _streamed(spark, _review_events(spark, d), lambda e: review_stream.interactions(e, replies), "ts", "event_id")


_TRIES = "event_id % 997 AS reply_id, event_id AS seq, CASE event_id % 4 WHEN 1 THEN concat(CASE event_type WHEN 'view' THEN 'RetryAfter' WHEN 'signup' THEN 'TimedOutTimeout' WHEN 'click' THEN 'Network' WHEN 'error' THEN 'Forbidden' ELSE 'Other' END, 'Error') WHEN 2 THEN 'NetworkError' WHEN 3 THEN 'BadRequest' END AS error"
NOTIFIED = REPLIES.replace("WITH r", "WITH RECURSIVE r", 1) + f""", t AS (SELECT {_TRIES} FROM events), k AS (SELECT t.*, row_number() OVER (PARTITION BY reply_id ORDER BY seq) AS n FROM t),
s AS (SELECT id AS reply_id, 0::BIGINT AS n, NULL::BIGINT AS seq, notification_status AS st, notification_attempts AS tr, notification_error AS er, review_message_id IS NOT NULL AS done, delivery_status = 'sent' AS ok, NULL::VARCHAR AS outcome, NULL::BIGINT AS backoff, 0::BIGINT AS mine FROM r
  UNION ALL SELECT reply_id, n, seq, CASE WHEN NOT go THEN st WHEN error IS NULL THEN 'sent' ELSE 'failed' END, CASE WHEN go THEN tr + 1 ELSE tr END,
    CASE WHEN NOT go THEN er WHEN error IS NULL THEN NULL WHEN error ILIKE '%retryafter%' THEN 'rate_limited' WHEN error ILIKE '%timeout%' THEN 'timeout' WHEN error ILIKE '%network%' THEN 'network' WHEN error ILIKE '%forbidden%' OR error ILIKE '%unauthorized%' THEN 'authorization' ELSE 'api_error' END,
    done OR go AND error IS NULL, ok, CASE WHEN NOT go THEN 'refused' WHEN error IS NULL THEN 'sent' ELSE 'failed' END, CASE WHEN go AND error IS NOT NULL AND tr + 1 < 3 THEN least(2 ^ mine, 2) END::BIGINT, mine + 1
  FROM (SELECT s.*, k.n AS kn, k.seq AS kseq, k.error, NOT s.done AND s.ok AND s.st IN ('not_requested', 'pending', 'failed') AND s.tr < 3 AS go FROM s JOIN k ON k.reply_id = s.reply_id AND k.n = s.n + 1) q(reply_id, n0, seq0, st, tr, er, done, ok, o0, b0, mine, n, seq, error, go))
SELECT reply_id, seq, outcome, tr::BIGINT AS attempt, @COLUMNS@ FROM s WHERE n > 0"""


@query(NOTIFIED.replace("@COLUMNS@", "st AS notification_status, er AS notification_error, backoff"))
def notification_fold(spark, d):
    return feedback.notification_fold(_replies(spark, d), S.table(spark, d, "events").selectExpr(*S._split(_TRIES)))


@query(NOTIFIED.replace("@COLUMNS@", "CASE WHEN outcome = 'failed' THEN er END AS notification_error"))
def stream_notifications(spark, d):
    replies = _replies(spark, d)
    return _streamed(spark, S.table(spark, d, "events").selectExpr(*S._split(_TRIES)), lambda t: review_stream.notifications(t, replies), "seq")


_AT = "TIMESTAMP '2024-03-01 10:10:00'"


@query(REPLIES + f" SELECT id, CASE WHEN st THEN 'failed' ELSE notification_status END AS notification_status, CASE WHEN st THEN 'interrupted' ELSE notification_error END AS notification_error FROM (SELECT *, coalesce(notification_status = 'sending' AND notification_last_attempt_at < {_AT} - INTERVAL 5 MINUTE AND review_message_id IS NULL, false) AS st FROM r)")
def requeued_notifications(spark, d):
    return feedback.requeue_stale(_replies(spark, d), F.expr(_AT)).select("id", "notification_status", "notification_error")


@query(REPLIES + f" SELECT id, g AS claimed, CASE WHEN g THEN 'sending' ELSE notification_status END AS notification_status, notification_attempts + g::INT AS notification_attempts, CASE WHEN g THEN NULL ELSE notification_error END AS notification_error, CASE WHEN g THEN {_AT} ELSE notification_last_attempt_at END AS at FROM (SELECT *, id % 2 = 0 AND review_message_id IS NULL AND notification_status IN ('not_requested', 'pending', 'failed') AND notification_attempts < 3 AND delivery_status = 'sent' AS g FROM r)")
def notification_claims(spark, d):
    r = _replies(spark, d)
    return feedback.claim(r, r.where("id % 2 = 0").select("id"), F.expr(_AT)).select("id", "claimed", "notification_status", "notification_attempts", "notification_error", F.col("notification_last_attempt_at").alias("at"))


@query(REPLIES + " SELECT DISTINCT dialog_id, sent_message_id FROM r WHERE delivery_status = 'sent' AND sent_message_id IS NOT NULL")
def known_ai_ids(spark, d):
    return feedback.known_ai(_replies(spark, d))


@query(REPLIES + " SELECT dialog_id, s AS sent_message_id, count(*) AS n FROM (SELECT *, sent_message_id // 4000 AS s FROM r) WHERE s IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_sent_ids(spark, d):
    return feedback.duplicate_sent_ids(_replies(spark, d).withColumn("sent_message_id", F.expr("sent_message_id div 4000")))


@query(MSG + " SELECT dialog_id, id, excl FROM m")
def known_ai_flags(spark, d):
    """The exclusions by a join with the ids of the machine's messages, for the flag column of messages_classified."""
    h = _history(spark, d)
    known = h.where("known_ai").select("dialog_id", F.col("id").alias("sent_message_id"))
    return extract.classify(h.drop("known_ai"), known).select("dialog_id", "id", "excl")


_ESCAPE = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_TRUNCATE = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n - 14}), '[ \\t-\\r\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}]+$', '') || chr(10) || '[truncated]' END"
_LABEL = "CASE feedback_status WHEN 'approved' THEN 'Approved' WHEN 'corrected' THEN 'Corrected' WHEN 'rejected' THEN CASE WHEN feedback_category = 'should_not_reply' THEN 'Should not have replied' ELSE 'Rejected (' || coalesce(nullif(feedback_category, ''), 'unspecified') || ')' END ELSE 'Awaiting review' END"
_TURNS = f"list_filter(list_transform({_OBJECTS}, lambda x: struct_pack(role := coalesce(json_extract_string(x, '$.role'), ''), text := coalesce(json_extract_string(x, '$.text'), ''))), lambda t: t.role = 'user')"


@query(REPLIES + f""", x AS (SELECT *, {_strip(f"coalesce(nullif(incoming_message_text, ''), ({_TURNS})[-1].text, '')")} AS inc, {_strip("generated_reply_text")} AS gen, {_LABEL} AS label FROM r)
SELECT id, label AS status_label, '<b>Reply review</b>' || chr(10) || chr(10) || '<b>Reply ID:</b> ' || id || chr(10) || chr(10) || '<b>From:</b> ' || dialog_id || chr(10) || chr(10) || '<b>Incoming:</b>' || chr(10) || {_ESCAPE(_TRUNCATE("inc", 1100))} || chr(10) || chr(10) || '<b>Reply:</b>' || chr(10) || {_ESCAPE(_TRUNCATE("gen", 1500))}
  || chr(10) || chr(10) || '<b>Delivery:</b> ' || delivery_status || chr(10) || chr(10) || '<b>Review:</b> ' || label || chr(10) || chr(10) || '<b>Model:</b> ' || model || chr(10) || chr(10) || '<b>Prompt:</b> ' || prompt_version || chr(10) || chr(10) || '<b>Generated:</b> ' || created_at
  || CASE WHEN feedback_status = 'corrected' AND coalesce(corrected_reply_text, '') <> '' THEN chr(10) || chr(10) || '<b>Correction:</b>' || chr(10) || {_ESCAPE(_TRUNCATE("corrected_reply_text", 700))} ELSE '' END AS card,
  'Reply ID: ' || id || chr(10) || 'Incoming message ID: ' || incoming_message_id || chr(10) || 'Sent message ID: ' || coalesce(sent_message_id::VARCHAR, '-') || chr(10) || 'Delivery: ' || delivery_status || chr(10) || 'Review: ' || feedback_status || chr(10) || 'Category: ' || coalesce(nullif(feedback_category, ''), '-') || chr(10) || 'Source: ' || coalesce(nullif(feedback_source, ''), '-') || chr(10) || 'Model: ' || model || chr(10) || 'Prompt: ' || prompt_version || chr(10) || 'Generated: ' || created_at AS details,
  'good:' || id || ' bad:' || id || ' fix:' || id || ' no_reply:' || id || ' details:' || id AS payloads, 'cat:' || id || ':too_formal' AS first_reason, 7::BIGINT AS reason_rows FROM x""")
def review_cards(spark, d):
    payloads = F.array_join(F.transform(F.flatten(review.keyboard()), lambda b: b["payload"]), " ")
    reasons = review.reason_keyboard()
    return _replies(spark, d).select("id", feedback.status_label().alias("status_label"), review.card().alias("card"), review.details().alias("details"), payloads.alias("payloads"), reasons[0][0]["payload"].alias("first_reason"), F.size(reasons).cast("long").alias("reason_rows"))


@query(INTERACTIONS.replace("SELECT user_id, event_id, action, CASE", "SELECT DISTINCT CASE").split(", outcome,\n")[0] + " FROM s WHERE n > 0 AND outcome IN ('saved', 'cancelled') AND (CASE WHEN action = 'text' THEN CASE WHEN was IS NOT NULL THEN was_id END WHEN action <> 'command' THEN rid END) IN (SELECT id FROM ids)")
def rerendered_cards(spark, d):
    r = _replies(spark, d)
    return review.rerendered(review.interactions(_review_events(spark, d), r), r).select("reply_id")


@query("SELECT event_id, user_id = 7 AND chat = 7 AND kind = 'private' AS ok FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN user_id ELSE 7 END AS chat, CASE event_id % 5 WHEN 0 THEN 'group' ELSE 'private' END AS kind FROM events)")
def review_authorization(spark, d):
    e = S.table(spark, d, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN user_id ELSE 7 END AS chat_id", "CASE event_id % 5 WHEN 0 THEN 'group' ELSE 'private' END AS chat_type")
    return e.select("event_id", review.authorized(user_id=7, chat_id=7).alias("ok"))


_SAID = "CASE event_id % 6 WHEN 0 THEN concat('/good ', event_id % 1000) WHEN 1 THEN concat('/bad ', event_id % 1000, ' too_long') WHEN 2 THEN concat('/fix ', event_id % 1000, ' so') WHEN 3 THEN '/feedback_help' WHEN 4 THEN concat('/bad ', event_id % 1000) ELSE 'plain words' END"


@query(f"""SELECT event_id, rid AS reply_id, CASE WHEN answer = 'saved' THEN CASE k WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'corrected' END END AS status, CASE WHEN k = 1 THEN 'too_long' END AS category, NULL::VARCHAR AS comment, CASE WHEN k = 2 THEN 'so' END AS corrected_reply_text, answer
  FROM (SELECT *, CASE k WHEN 3 THEN 'help' WHEN 4 THEN 'detail_missing' ELSE CASE WHEN event_id % 1000 = 0 THEN 'reply_id_not_positive' WHEN EXISTS (SELECT 1 FROM labels JOIN documents USING (doc_id) WHERE doc_id = event_id % 1000) THEN 'saved' ELSE 'unknown_reply' END END AS answer0 FROM (SELECT *, event_id % 6 AS k FROM events WHERE user_id % 2 = 0 AND event_id % 5 <> 0 AND event_id % 6 < 5)) q,
  LATERAL (SELECT CASE WHEN k = 4 AND event_id % 1000 = 0 THEN 'reply_id_not_positive' ELSE answer0 END AS answer, CASE WHEN answer0 IN ('saved', 'unknown_reply') THEN event_id % 1000 END AS rid)""".replace("CASE WHEN k = 1 THEN 'too_long' END AS category", "CASE WHEN k = 1 AND answer <> 'reply_id_not_positive' THEN 'too_long' END AS category").replace("CASE WHEN k = 2 THEN 'so' END", "CASE WHEN k = 2 AND answer <> 'reply_id_not_positive' THEN 'so' END"))
def command_feedback(spark, d):
    c = S.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, 42).otherwise(F.col("user_id")).alias("chat_id"), (F.col("event_id") % 5 != 0).alias("out"), F.expr(_SAID).alias("text"))
    return review.command_feedback(c, _replies(spark, d), own_chat=42)


#: Incoming events from the messages, with what the model and the messenger answered.
_ANSWERS = "CASE WHEN id % 7 <> 3 THEN CASE WHEN id % 5 = 4 THEN '  ' ELSE concat(' reply ', id) END END AS reply, CASE WHEN id % 7 = 3 THEN 'TimeoutError' END AS reply_error, id % 6 <> 5 AS stored, CASE WHEN id % 8 = 6 THEN 'NetworkError' END AS send_error, id + 500000 AS sent_message_id"
_OUTCOME = f"""{MSG}, n AS (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY id DESC) AS back FROM m), e AS (SELECT *, dialog_id % 4 <> 0 AS is_private, {_ANSWERS}, EXISTS (SELECT 1 FROM n b WHERE b.dialog_id = n.dialog_id AND b.id > n.id AND b.back <= 10 AND b.outgoing AND b.text <> '') AS replied FROM n),
o AS (SELECT *, CASE WHEN outgoing OR NOT is_private OR text = '' THEN 'ignored' WHEN reply_error IS NOT NULL THEN 'generation_failed' WHEN trim(coalesce(reply, '')) = '' THEN 'empty_reply' WHEN NOT stored THEN 'storage_failed' WHEN replied THEN 'cancelled_manual' WHEN send_error IS NOT NULL THEN 'failed' ELSE 'sent' END AS outcome FROM e)"""


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d)
    e = h.select("*", F.col("outgoing").alias("out"), (F.col("dialog_id") % 4 != 0).alias("is_private"), *[F.expr(x) for x in S._split(_ANSWERS)])
    return e.join(extract.human_replied_after(h), ["dialog_id", "id"], "left")


@query(_OUTCOME + " SELECT dialog_id, id, outcome, outcome IN ('cancelled_manual', 'failed', 'sent') AS recorded, outcome = 'sent' AS announced FROM o")
def event_outcomes(spark, d):
    return live.outcomes(_incoming(spark, d), allowed_id=1001).select("dialog_id", "id", "outcome", "recorded", "announced")


@query(_OUTCOME + """ SELECT dialog_id, id AS incoming_message_id, u.seq, u.kind, u.text, u.delivery_status, u.sent_message_id, u.notification_status FROM o, LATERAL (SELECT unnest([{'seq': 0, 'kind': 'created', 'text': trim(reply), 'delivery_status': NULL, 'sent_message_id': NULL, 'notification_status': NULL},
  {'seq': 1, 'kind': 'delivery', 'text': NULL, 'delivery_status': outcome, 'sent_message_id': CASE WHEN outcome = 'sent' THEN sent_message_id END, 'notification_status': NULL}, {'seq': 2, 'kind': 'notification', 'text': NULL, 'delivery_status': NULL, 'sent_message_id': NULL, 'notification_status': 'pending'}]) AS u) WHERE outcome IN ('cancelled_manual', 'failed', 'sent') AND (u.seq < 2 OR outcome = 'sent')""")
def reply_log(spark, d):
    return live.log_rows(live.outcomes(_incoming(spark, d), allowed_id=1001)).drop("reply_id")


_CONTEXT = f"""{MSG}, cur AS (SELECT dialog_id, max(id) AS id FROM m GROUP BY 1), n1 AS (SELECT m.*, cur.id AS current_id FROM m JOIN cur USING (dialog_id) QUALIFY row_number() OVER (PARTITION BY m.dialog_id ORDER BY m.id DESC) <= 90),
n2 AS (SELECT * FROM n1 WHERE id <> current_id AND text <> '' QUALIFY row_number() OVER (PARTITION BY dialog_id ORDER BY id DESC) <= 29),
ctx AS (SELECT dialog_id, current_id, id AS message_id, CASE WHEN NOT outgoing THEN 'contact' WHEN id % 3 = 0 THEN 'ai_generated' ELSE 'human' END AS provenance, role, text FROM n2 UNION ALL SELECT m.dialog_id, m.id, m.id, 'contact', 'user', m.text FROM m JOIN cur ON m.dialog_id = cur.dialog_id AND m.id = cur.id)"""


@query(_CONTEXT + " SELECT dialog_id, current_id, '[' || string_agg('{\"message_id\":' || message_id || ',\"provenance\":' || to_json(provenance) || ',\"role\":' || to_json(role) || ',\"text\":' || to_json(text) || '}', ',' ORDER BY message_id) || ']' AS context_json, string_agg(role || '|' || text, chr(10) ORDER BY message_id) AS messages FROM ctx GROUP BY ALL")
def live_payloads(spark, d):
    h = _history(spark, d)
    current = h.groupBy("dialog_id").agg(F.max("id").alias("id"), F.max_by("text", "id").alias("text"))
    known = h.where("outgoing and id % 3 = 0").select("dialog_id", F.col("id").alias("sent_message_id"))
    kinds = live.provenance(h, known, allowed_id=1001).select("dialog_id", "id", "provenance")
    context = extract.live_context(h, current).join(kinds, ["dialog_id", "id"])
    # The current message is the contact's, whoever sent it.
    context = context.withColumn("provenance", F.when(F.col("id") == F.col("current_id"), "contact").otherwise(F.col("provenance")))
    said = live.chat_messages(context).select("dialog_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\n").alias("messages"))
    return live.context_payload(context).join(said, "dialog_id")


def _untimed(h: DataFrame) -> DataFrame:
    return h.where("date is not null")


_DATED = MSG.replace("FROM ex),", "FROM ex WHERE NOT (conv_id % 5 = 3 AND turn = 3)),")


@query(_DATED + " SELECT dialog_id, role, text, ids, fwd AS is_forwarded FROM gr")
def stream_fragments(spark, d):
    """The fragments of all messages with a date; a message of a dialog of its own, long after, moves the watermark past them."""
    rows = extract.classify(_untimed(_history(spark, d))).select("dialog_id", "id", "date", "role", "excl", "text", "is_forwarded")
    last = spark.createDataFrame([(-1, k, "user", None, "end", False) for k in (1, 2)], "dialog_id long, id long, role string, excl string, text string, is_forwarded boolean")
    newest = rows.agg(F.unix_micros(F.max("date")).alias("__us"))  # one row
    whole = rows.unionByName(last.crossJoin(newest).withColumn("date", F.timestamp_micros(F.col("__us") + F.col("id") * 86_400_000_000)).select(*rows.columns))
    got = _streamed(spark, whole, fragment_stream.fragments, "date", "id").where("dialog_id >= 0")
    return got.select("dialog_id", "role", "text", F.array_join(F.col("message_ids").cast("array<string>"), ",").alias("ids"), "is_forwarded")


@query(REPLIES + f""", o AS (SELECT *, {_OBJECTS} AS objs FROM r WHERE feedback_status <> 'unreviewed' AND context_json LIKE '[%')
SELECT id AS reply_id, dialog_id, incoming_message_id, sent_message_id, CASE feedback_status WHEN 'approved' THEN generated_reply_text WHEN 'corrected' THEN corrected_reply_text END AS preferred_reply, generated_reply_text AS original_generated_reply, coalesce(nullif(feedback_source, ''), 'saved_messages') AS feedback_source, CASE feedback_status WHEN 'rejected' THEN 'negative' ELSE 'positive' END AS part,
  coalesce(array_to_string(list_transform(objs, lambda x: coalesce(json_extract_string(x, '$.role'), '') || ':' || coalesce(json_extract_string(x, '$.text'), '')), chr(10)), '') AS context, created_at FROM o""")
def feedback_export_rows(spark, d):
    """Replies whose context is readable; any other makes an export fail, which tests hold."""
    got = feedback.export_rows(_replies(spark, d).where("context_json like '[%'"), redact=False)
    return got.select("reply_id", "dialog_id", "incoming_message_id", "sent_message_id", "preferred_reply", "original_generated_reply", "feedback_source", "part", F.array_join(F.transform("context", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("context"), "created_at")


@query(REPLIES + " SELECT count(*) AS reviewed_replies, count(*) FILTER (feedback_status IN ('approved', 'corrected')) AS positive_examples, count(*) FILTER (feedback_status = 'rejected') AS negative_examples, count(*) FILTER (feedback_status = 'corrected') AS corrected_examples, 0::BIGINT AS redacted_email, 0::BIGINT AS redacted_url, 0::BIGINT AS redacted_phone, 0::BIGINT AS redacted_secret FROM r WHERE feedback_status <> 'unreviewed'")
def feedback_export_summary(spark, d):
    return feedback.export_summary(_replies(spark, d), redact=False)


_NUMBERS = "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN '12.5' WHEN 3 THEN 'High' WHEN 4 THEN '-7' WHEN 5 THEN 'x' WHEN 6 THEN '1e2' WHEN 7 THEN ' weak' END AS v"


@query(f"""SELECT doc_id, coalesce(CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(v) AS BIGINT) END, 5) AS whole, coalesce(CASE lower(trim(v)) WHEN 'high' THEN 0.9 WHEN 'weak' THEN 0.5 END, TRY_CAST(CASE WHEN regexp_matches(trim(v), '^[0-9.e-]+$') THEN trim(v) END AS DOUBLE), 0.8)::DOUBLE AS number, trim(coalesce(nullif(nullif(v, ''), ''), source, '')) AS first_text, TRY_CAST(CASE WHEN regexp_matches(v, '^ *[0-9-]+ *$') THEN v END AS BIGINT) AS nullable
  FROM (SELECT doc_id, source, {_NUMBERS} FROM documents)""")
def coerced_values(spark, d):
    v = S.table(spark, d, "documents").selectExpr("doc_id", "source", _NUMBERS)
    return v.select("doc_id", C.safe_long(F.col("v"), 5).alias("whole"), C.safe_double(F.col("v")).alias("number"), C.first_text(F.col("v"), F.col("source")).alias("first_text"), C.optional(F.when(F.col("v").rlike("^ *[0-9-]+ *$"), F.col("v")), "long").alias("nullable"))


@query(FEEDBACK_EXAMPLES + " SELECT source_key, incoming_text, response_text, contact_id, array_to_string(list_transform(turns, lambda t: t.provenance || '|' || t.role || '|' || t.text), chr(10)) AS context FROM fe")
def example_codec(spark, d):
    """Style examples written in the form of the example bank and read again."""
    from dialoom.operators import style

    e = style.from_feedback(_replies(spark, d)).withColumn("content_hash", F.lit(""))
    back = e.select(C.encode(C.EXAMPLE).alias("line")).select(C.decode_example(F.col("line")).alias("e")).select("e.*")
    return back.select("source_key", "incoming_text", "response_text", "contact_id", F.array_join(F.transform("context", lambda t: F.concat_ws("|", t["provenance"], t["role"], t["text"])), "\n").alias("context"))


_PAYLOAD = "CASE doc_id % 4 WHEN 0 THEN concat('{\"rules\":[{\"text\":\"be brief\",\"confidence\":\"medium\",\"evidence_count\":\"', doc_id, '\"},{\"text\":\" \"},7,{\"text\":\"no emoji\",\"supporting_source_keys\":[\"k', doc_id, '\"]}]}') WHEN 1 THEN '{\"rules\":{}}' WHEN 2 THEN 'broken' ELSE '{\"rules\":[]}' END AS payload"


@query("SELECT doc_id, 'be brief' AS text, 0.7::DOUBLE AS confidence, doc_id AS evidence_count, '' AS keys FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'no emoji', 0.8, 1, 'k' || doc_id FROM documents WHERE doc_id % 4 = 0")
def parsed_rules(spark, d):
    r = S.table(spark, d, "documents").selectExpr("doc_id", _PAYLOAD).select("doc_id", F.explode(C.parse_rules(F.col("payload"))).alias("r"))
    return r.select("doc_id", "r.text", "r.confidence", "r.evidence_count", F.array_join("r.supporting_source_keys", ",").alias("keys"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 997) || '...' END AS compact, " + _TRUNCATE("text", 500) + " AS truncated, " + _ESCAPE("text") + " AS escaped FROM documents")
def shortened_texts(spark, d):
    t = F.col("text")
    return S.table(spark, d, "documents").select("doc_id", T.compact(t).alias("compact"), T.truncate(t, 500).alias("truncated"), T.escape_html(t).alias("escaped"))
