"""Queries of the specified interface: inbox, history, drafts, versions, audit, queues, trends, memory, events; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.catalogue import MSG, REPLIES, _collapse, _history, _replies, query
from dialoom.operators import spec
from dialoom.sources import tables as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def spec_sorted(spark, d):
    return spec.sorted_by(_events(spark, d), "-value", allowed={"value", "ts"}, key="event_id").limit(100).select("event_id", "value")


@query(MSG + ", t AS (SELECT id FROM m WHERE dialog_id = 3 AND id < 5000 ORDER BY id DESC LIMIT 6) SELECT id, (SELECT count(*) FROM t) > 5 AS has_more FROM t ORDER BY id DESC LIMIT 5")
def spec_history(spark, d):
    return spec.history_before(_history(spark, d), 3, before=5000, limit=5).select("id", "has_more")


_INBOX = "doc_id, doc_id % 3 AS account_id, doc_id % 5 AS agent_id, doc_id % 11 AS contact_id, CASE doc_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'archived' WHEN 2 THEN 'agent_active' ELSE 'paused' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'waiting_for_approval' END AS pending_action, doc_id % 7 AS operator_id, CASE WHEN doc_id % 13 > 0 THEN doc_id % 10 / 10.0 END AS confidence, source AS contact_name, text AS last_text"


@query(f"SELECT doc_id, set_no FROM (SELECT *, doc_id % 6 AS w FROM (SELECT {_INBOX} FROM documents)) x, (VALUES (1), (2), (3), (4)) s(set_no) WHERE set_no = 1 AND account_id = 1 AND agent_id = 2 AND status = 'paused' OR set_no = 2 AND coalesce(confidence < 0.5, false) AND status NOT IN ('resolved', 'archived') OR set_no = 3 AND w = 0 AND pending_action = 'none' AND operator_id = 3 OR set_no = 4 AND (contains(lower(coalesce(contact_name, '')), 'the') OR contains(lower(last_text), 'the')) AND contact_id = 4")
def spec_inbox_filters(spark, d):
    rows = S.table(spark, d, "documents").selectExpr(*S._split(_INBOX)).withColumn("warnings", F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")))
    sets = [dict(account_id=1, agent_id=2, status="paused"), dict(low_confidence=True, unresolved=True), dict(has_warnings=True, pending_action="none", operator_id=3), dict(search="The", contact_id=4)]
    parts = [spec.inbox_filter(rows, **s).select("doc_id", F.lit(i).alias("set_no")) for i, s in enumerate(sets, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def spec_audit_filter(spark, d):
    return spec.audit_filter(_events(spark, d), event_type="error", since="2024-01-10", until="2024-01-20").select("event_id")


_DRAFTS = "doc_id AS draft_id, doc_id % 90 AS dialog_id, CASE WHEN doc_id % 4 = 0 THEN 9999999 ELSE doc_id % 8 * 1000 END AS based_on_id, doc_id % 3 AS agent_id, doc_id % 5 AS config_version, doc_id % 17 = 0 AS invalidated"
_DIALOGS = "SELECT DISTINCT doc_id % 90 AS dialog_id, CASE doc_id % 90 % 9 WHEN 1 THEN 'blocked' WHEN 2 THEN 'paused' WHEN 3 THEN 'human_active' ELSE 'agent_active' END AS status, CASE WHEN doc_id % 90 % 2 = 0 THEN doc_id % 90 % 3 ELSE 1 END AS agent_id, doc_id % 90 % 5 AS config_version FROM documents"


@query(MSG + f""", d AS (SELECT {_DRAFTS} FROM documents), dg AS ({_DIALOGS}), lm AS (SELECT dialog_id, max(id) AS last_id, max(id) FILTER (outgoing) AS own FROM m GROUP BY 1)
SELECT draft_id, CASE WHEN invalidated THEN 'manual_invalidation' WHEN dg.status = 'blocked' THEN 'conversation_blocked' WHEN dg.status = 'paused' THEN 'conversation_paused' WHEN dg.status = 'human_active' THEN 'human_takeover' WHEN dg.agent_id <> d.agent_id THEN 'agent_changed'
  WHEN dg.config_version <> d.config_version THEN 'critical_configuration_changed' WHEN own > based_on_id THEN 'human_message_sent' WHEN last_id > based_on_id THEN 'new_incoming_message' END AS stale_reason FROM d LEFT JOIN dg USING (dialog_id) LEFT JOIN lm USING (dialog_id)""")
def spec_stale_drafts(spark, d):
    docs = S.table(spark, d, "documents")
    dialogs = docs.select((F.col("doc_id") % 90).alias("dialog_id")).distinct().selectExpr("dialog_id", "CASE dialog_id % 9 WHEN 1 THEN 'blocked' WHEN 2 THEN 'paused' WHEN 3 THEN 'human_active' ELSE 'agent_active' END AS status", "CASE WHEN dialog_id % 2 = 0 THEN dialog_id % 3 ELSE 1 END AS agent_id", "dialog_id % 5 AS config_version")
    return spec.stale_drafts(docs.selectExpr(*S._split(_DRAFTS)), dialogs, _history(spark, d)).select("draft_id", "stale_reason")


@query("""WITH RECURSIVE c AS (SELECT user_id AS draft_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'edit' END AS action, event_id % 3 AS dv, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS cv, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT draft_id, 0::BIGINT AS seq, '' AS action, 0::BIGINT AS n, 'pending_approval' AS status, 0::BIGINT AS version, '' AS outcome FROM c
  UNION ALL SELECT draft_id, seq, action, n, CASE WHEN o = 'ok' THEN CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'edited' END ELSE status END, CASE WHEN o = 'ok' THEN version + 1 ELSE version END, o
  FROM (SELECT c.draft_id, c.seq, c.action, c.n, s.status, s.version, CASE WHEN c.draft_id % 10 = 3 THEN 'DRAFT_STALE' WHEN c.dv <> s.version OR c.cv <> 0 THEN 'VERSION_CONFLICT' WHEN s.status NOT IN ('pending_approval', 'edited') THEN 'NOT_PENDING' ELSE 'ok' END AS o FROM s JOIN c ON c.draft_id = s.draft_id AND c.n = s.n + 1))
SELECT draft_id, seq, action, outcome, status, version AS draft_version FROM s WHERE n > 0""")
def spec_draft_decisions(spark, d):
    e = _events(spark, d)
    k = F.col("event_id")
    commands = e.select(F.col("user_id").alias("draft_id"), k.alias("seq"), F.when(k % 5 == 0, "approve").when(k % 5 == 1, "reject").otherwise("edit").alias("action"), (k % 3).alias("expected_draft_version"), F.when(k % 11 == 0, 1).otherwise(0).alias("expected_dialog_version"))
    drafts = e.select(F.col("user_id").alias("draft_id")).distinct().select("draft_id", F.lit("pending_approval").alias("status"), F.lit(0).alias("version"), F.lit(0).alias("dialog_version"), F.when(F.col("draft_id") % 10 == 3, "new_incoming_message").alias("stale_reason"))
    return spec.decisions(commands, drafts)


@query("""WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS seq, event_id % 4 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT key, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS version, '' AS outcome FROM c UNION ALL SELECT c.key, c.seq, c.n, CASE WHEN c.v = s.version THEN s.version + 1 ELSE s.version END, CASE WHEN c.v = s.version THEN 'applied' ELSE 'VERSION_CONFLICT' END FROM s JOIN c ON c.key = s.key AND c.n = s.n + 1)
SELECT key, seq, outcome, version FROM s WHERE n > 0""")
def spec_versions(spark, d):
    return spec.versioned(_events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("expected_version")))


@query("""WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS us, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT key, 0::BIGINT AS seq, 0::BIGINT AS n, NULL::BIGINT AS start, NULL::VARCHAR AS kept, '' AS outcome FROM c
  UNION ALL SELECT c.key, c.seq, c.n, CASE WHEN s.start IS NULL OR c.us - s.start >= 86400000000 THEN c.us ELSE s.start END, CASE WHEN s.start IS NULL OR c.us - s.start >= 86400000000 THEN c.payload ELSE s.kept END, CASE WHEN s.start IS NULL OR c.us - s.start >= 86400000000 THEN 'first' WHEN c.payload = s.kept THEN 'replay' ELSE 'conflict' END FROM s JOIN c ON c.key = s.key AND c.n = s.n + 1)
SELECT key, seq, outcome FROM s WHERE n > 0""")
def spec_idempotency_day(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("payload"))
    return spec.idempotent_for(e).select("key", "seq", "outcome")


@query("SELECT count(*) FILTER (event_type = 'view' AND ts <= TIMESTAMP '2024-01-15') AS pending, count(*) FILTER (event_type = 'view' AND ts > TIMESTAMP '2024-01-15') AS \"delayed\", count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 10 MINUTE) AS stuck FROM events")
def spec_queue_health(spark, d):
    status = F.create_map(*[F.lit(x) for x in ("view", "pending", "error", "failed", "click", "running", "signup", "done", "purchase", "done")])[F.col("event_type")]
    return spec.queue_health(_events(spark, d).select(status.alias("status"), F.col("ts").alias("run_at"), F.col("ts").alias("started_at")), F.expr("TIMESTAMP '2024-01-15'"))


_RATE = "round(avg(CAST({} AS INT)), 6)"


@query(REPLIES + f""", t AS (SELECT *, id % 4 AS account, substr(created_at, 1, 7) AS day, id % 6 = 0 AS handed, CASE WHEN id % 3 > 0 THEN id % 50 END AS lat FROM r)
SELECT day, account, grouping_id(day, account)::BIGINT AS level, count(*) AS n, {_RATE.format("feedback_status = 'approved'")} AS approval_rate, {_RATE.format("feedback_status = 'corrected'")} AS edit_rate, {_RATE.format("feedback_status = 'rejected'")} AS rejection_rate, {_RATE.format("delivery_status <> 'sent'")} AS no_response_rate, {_RATE.format("handed")} AS handoff_rate, round(avg(lat), 6) AS mean_latency FROM t GROUP BY ROLLUP (day, account)""")
def spec_quality_trends(spark, d):
    r = _replies(spark, d).withColumns({"account": F.col("id") % 4, "handed_off": F.col("id") % 6 == 0, "latency_seconds": F.when(F.col("id") % 3 > 0, F.col("id") % 50)})
    return spec.quality_trends(r, day=F.substring("created_at", 1, 7), by=["account"])


_MEMORY = "doc_id % 3 AS account, doc_id % 2 AS agent, doc_id % 20 AS contact, concat('k', doc_id % 4) AS key, CASE WHEN doc_id % 7 = 0 THEN ' Paris  city' WHEN doc_id % 7 = 1 THEN 'paris city' ELSE concat('v', doc_id % 7 % 3) END AS value, {at} AS seen, concat('s', doc_id) AS source"
_SPARK_AT, _DUCK_AT = "timestamp_seconds(1704067200 + doc_id * 7919 % 500 * 86400)", "TIMESTAMP '2024-01-01' + to_days((doc_id * 7919 % 500)::INT)"


@query(f"""WITH f AS (SELECT {_MEMORY.format(at=_DUCK_AT)} FROM documents), o AS (SELECT *, {_collapse("lower(value)")} AS v FROM f QUALIFY row_number() OVER (PARTITION BY account, agent, contact, key, v ORDER BY seen DESC, source) = 1)
SELECT account, agent, contact, key, value, source, count(*) OVER (PARTITION BY account, agent, contact, key) > 1 AS contradicted, seen < TIMESTAMP '2025-01-01' - INTERVAL 90 DAY AS stale FROM o""")
def spec_memory(spark, d):
    m = S.table(spark, d, "documents").selectExpr(*S._split(_MEMORY.format(at=_SPARK_AT)))
    return spec.remembered(m.withColumnRenamed("seen", "at"), F.expr("TIMESTAMP '2025-01-01'")).drop("at")


@query(f"WITH f AS (SELECT {_MEMORY.format(at=_DUCK_AT)} FROM documents) SELECT account, agent, contact, key, count(DISTINCT value) AS n_values FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1")
def spec_contradictions(spark, d):
    return spec.contradictions(S.table(spark, d, "documents").selectExpr(*S._split(_MEMORY.format(at=_SPARK_AT))))


_TYPES = "CASE event_type WHEN 'view' THEN 'message.received' WHEN 'signup' THEN 'draft.created' WHEN 'click' THEN 'conversation.returned_to_agent' WHEN 'error' THEN 'account.error' ELSE 'nothing.known' END"


@query(f"SELECT entity, verb, known, count(*) AS n FROM (SELECT CASE WHEN t <> 'nothing.known' THEN split_part(t, '.', 1) END AS entity, CASE WHEN t <> 'nothing.known' THEN split_part(t, '.', 2) END AS verb, t <> 'nothing.known' AS known FROM (SELECT {_TYPES} AS t FROM events)) GROUP BY ALL")
def spec_event_types(spark, d):
    typed = spec.typed_events(_events(spark, d).withColumn("event_type", F.expr(_TYPES)))
    return typed.groupBy("entity", "verb", "known").agg(F.count("*").alias("n"))
