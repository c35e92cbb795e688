"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import clean, compose, extract, feedback, retrieve, spec, style
from dialoom.plans import jobs
from dialoom.sources import tables as S

QUERIES: dict = {}
SQL: dict = {}
W = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"
_collapse = lambda x: _strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")

MSG = f"""
WITH raw AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations),
ex AS (SELECT conv_id, turn, role, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS frag FROM raw),
m AS (SELECT conv_id AS dialog_id, turn * 1000 + frag AS id, {_strip("t")} AS text,
  CASE WHEN NOT (conv_id % 5 = 3 AND turn = 3) THEN 1704067200 + conv_id * 86400 + turn * 3600 + frag * (CASE conv_id % 3 WHEN 0 THEN 180 WHEN 1 THEN 181 ELSE 20 END) END AS sec,
  role = 'assistant' AS outgoing, CASE WHEN role = 'system' THEN 'service' WHEN (turn * 1000 + frag) % 11 = 7 THEN 'media' WHEN {_strip("t")} = '' THEN 'blank'
  WHEN role = 'assistant' AND (conv_id + turn) % 9 = 4 THEN 'known_ai' END AS excl, (turn * 1000 + frag) % 13 = 5 AS fwd, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role FROM ex),
f AS (SELECT *, row_number() OVER w AS pos, CASE WHEN lag(id) OVER w IS NULL OR lag(excl) OVER w IS NOT NULL OR lag(role) OVER w <> role
  OR NOT coalesce(sec - lag(sec) OVER w BETWEEN 0 AND 180, true) THEN 1 ELSE 0 END AS nw FROM m WINDOW w AS (PARTITION BY dialog_id ORDER BY sec NULLS LAST, id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY dialog_id ORDER BY pos) AS grp FROM f),
gr AS (SELECT dialog_id, CAST(grp AS BIGINT) AS grp, role, string_agg(text, chr(10) ORDER BY pos) AS text, string_agg(id, ',' ORDER BY pos) AS ids, count(*) AS n_ids,
  list(sec ORDER BY pos DESC)[1] AS sec, bool_or(fwd) AS fwd FROM g WHERE excl IS NULL GROUP BY ALL)"""
_BAD = "regexp_matches({0}, '(?i)^https?://[^ \\t\\n\\r]+$') OR regexp_matches({0}, '^/[A-Za-z0-9_]+(@[A-Za-z0-9_]+)?([ \\t\\n\\r]|$)')"
EXAMPLES = MSG + f""",
e AS (SELECT *, count(*) OVER w AS n_context, coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '') AS context_text, string_agg(role || chr(1) || {_collapse("text")}, chr(2)) OVER w AS ckey,
  coalesce(max(CASE WHEN role = 'user' AND NOT ({_BAD.format("text")}) THEN 1 ELSE 0 END) OVER w, 0) AS ok,
  substr(sha256(dialog_id || ':' || ids), 1, 24) AS example_id, coalesce(strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%S+00:00'), '') AS created_at
  FROM gr WINDOW w AS (PARTITION BY dialog_id ORDER BY grp ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
t AS (SELECT * FROM e WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY dialog_id ORDER BY grp DESC) <= 500),
r AS (SELECT *, CASE WHEN text = '' THEN 'empty_target' WHEN regexp_matches(text, '(?i)^https?://[^ \\t\\n\\r]+$') THEN 'link_only_target'
  WHEN regexp_matches(text, '^/[A-Za-z0-9_]+(@[A-Za-z0-9_]+)?([ \\t\\n\\r]|$)') THEN 'bot_command_target' WHEN fwd THEN 'forwarded_target' WHEN ok = 0 THEN 'no_meaningful_incoming_context' END AS why FROM t),
rr AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY dialog_id, ckey, {_collapse("text")}, why IS NULL ORDER BY grp) > 1 THEN 'duplicate' ELSE why END AS reason FROM r)"""
REPLIES = f"WITH r AS (SELECT {S.REPLY_COLUMNS}, d.text AS generated_reply_text FROM labels JOIN documents d USING (doc_id))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _history(spark: SparkSession, d: str) -> DataFrame:
    return S.messages(S.table(spark, d, "conversations"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return S.replies(S.table(spark, d, "labels"), S.table(spark, d, "documents"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return jobs.training_examples(_history(spark, d))


def _context_text(c: str = "context") -> F.Column:
    return F.array_join(F.transform(c, lambda t: F.concat(t.role, F.lit(": "), t.text)), "\n")


@query(MSG + " SELECT dialog_id, id, role, excl, text FROM m")
def messages_classified(spark, d):
    return extract.classify(_history(spark, d)).select("dialog_id", "id", "role", "excl", "text")


@query(MSG + """ SELECT dialog_id, count(*) AS messages_scanned, count(*) FILTER (excl = 'service') AS service_excluded, count(*) FILTER (excl = 'media') AS media_excluded,
  count(*) FILTER (excl = 'blank') AS empty_excluded, count(*) FILTER (excl = 'known_ai') AS ai_excluded,
  coalesce(any_value(t.n), 0) AS human_target_replies FROM m LEFT JOIN (SELECT dialog_id, count(*) AS n FROM gr WHERE role = 'assistant' GROUP BY 1) t USING (dialog_id) GROUP BY dialog_id""")
def extraction_stats(spark, d):
    c = extract.classify(_history(spark, d))
    return extract.extraction_stats(c, extract.fragments(c))


@query(MSG + " SELECT dialog_id, grp, role, text, ids, fwd AS is_forwarded FROM gr")
def fragment_groups(spark, d):
    return extract.fragments(extract.classify(_history(spark, d))).select("dialog_id", "grp", "role", "text", F.array_join(F.col("message_ids").cast("array<string>"), ",").alias("ids"), "is_forwarded")


@query(EXAMPLES + " SELECT dialog_id, example_id, n_context, context_text, text AS target_reply, n_ids AS n_source_ids, created_at FROM t")
def training_examples(spark, d):
    return _examples(spark, d).select("dialog_id", "example_id", F.size("context").cast("long").alias("n_context"), _context_text().alias("context_text"), "target_reply", F.size("source_message_ids").cast("long").alias("n_source_ids"), "created_at")


@query(EXAMPLES + " SELECT reason, count(*) AS n FROM rr WHERE reason IS NOT NULL GROUP BY reason")
def removal_reasons(spark, d):
    return clean.removal_histogram(_examples(spark, d))


@query(EXAMPLES + " SELECT dialog_id, example_id, context_text, text AS target_reply FROM rr WHERE reason IS NULL")
def cleaned_examples(spark, d):
    return clean.clean(_examples(spark, d), redact=False).select("dialog_id", "example_id", _context_text().alias("context_text"), "target_reply")


@query(r"SELECT page_id, regexp_replace(url, 'https?://[^ \t\n\r?]*\?[^ \t\n\r]*', '<URL>', 'gi') AS url FROM pages")
def redact_urls(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.regexp_replace("url", T.QUERY_URL, "<URL>").alias("url"))


@query()
def redact_documents(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query()
def redaction_counts(spark, d):
    """Over every text of the documents; training_summary has the counts of an export."""
    return clean.redaction_totals(S.table(spark, d, "documents"))


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {_collapse('text')} ORDER BY doc_id) = 1")
def normalized_dedup(spark, d):
    return clean.keep_first(S.table(spark, d, "documents"), [F.sha2(T.collapse(F.col("text")), 256)], [F.col("doc_id")]).select("doc_id")


def _style_docs(spark, d):
    return S.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("contact_id"), F.col("source").alias("incoming_text"), F.col("text").alias("response_text"), F.lit("human").alias("source_type"), F.lit("positive").alias("polarity"), F.lit("human").alias("provenance"), F.lit("").alias("feedback_status"), F.lit("").alias("feedback_category"), F.concat(F.lit("doc:"), "doc_id").alias("source_key"), F.col("doc_id").alias("seq"), F.lit(0).alias("src_ord"))


_CANON = "nfc_normalize(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
_CANON = _strip("array_to_string(list_transform(string_split(" + _CANON + ", chr(10)), lambda x: " + _strip("regexp_replace(x, '[ \\t]+', ' ', 'g')") + "), chr(10))")
_canon = lambda x: _CANON.replace("{0}", x)


@query(f"""SELECT 'doc:' || doc_id AS source_key, sha256('{{"contact_id":' || doc_id % 50 || ',"context":[],"feedback_category":"","feedback_status":"","incoming_text":' || to_json({_canon("source")})
  || ',"polarity":"positive","provenance":"human","source_type":"human","target_reply":' || to_json({_canon("text")}) || '}}') AS content_hash FROM documents""")
def canonical_hash(spark, d):
    return style.canonicalize(_style_docs(spark, d)).select("source_key", "content_hash")


_LOG = (
    "user_id AS reply_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'delivery' WHEN 'signup' THEN 'feedback' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'notification' ELSE 'other' END AS kind, "
    "CASE event_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'cancelled_manual' END AS delivery_status, CASE WHEN event_id % 3 = 0 THEN event_id * 2 END AS sent_message_id, CASE WHEN event_id % 3 = 0 THEN 'at' END AS sent_at, "
    "CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'corrected' END AS feedback_status, CASE WHEN event_id % 4 = 1 THEN 'too_long' END AS feedback_category, CASE WHEN event_id % 8 = 1 THEN 'words' END AS feedback_comment, "
    "CASE WHEN event_id % 4 > 1 THEN concat('better ', event_id) END AS corrected_reply_text, concat('t', event_id) AS feedback_updated_at, CASE WHEN event_id % 5 > 0 THEN 'trainer_bot' END AS feedback_source, event_id % 3 AS feedback_trainer_user_id, "
    "CASE WHEN event_type = 'click' THEN 'sending' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'sent' END AS notification_status, ts AS notification_last_attempt_at, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'timeout' END AS notification_error, "
    "CASE WHEN event_id % 7 = 1 THEN 9 END AS review_chat_id, CASE WHEN event_id % 7 = 1 THEN event_id END AS review_message_id"
)


@query(f"""WITH e AS (SELECT {_LOG} FROM events) SELECT reply_id, coalesce((list(delivery_status ORDER BY seq DESC) FILTER (kind = 'delivery'))[1], 'generated') AS delivery_status,
  {", ".join(f"(list({c} ORDER BY seq DESC) FILTER (kind = 'delivery'))[1] AS {c}" for c in feedback.DELIVERY[1:])}, coalesce((list(feedback_status ORDER BY seq DESC) FILTER (kind = 'feedback'))[1], 'unreviewed') AS feedback_status,
  {", ".join(f"(list({c} ORDER BY seq DESC) FILTER (kind = 'feedback'))[1] AS {c}" for c in feedback.FEEDBACK[1:])},
  coalesce((list(notification_status ORDER BY seq DESC) FILTER (kind IN ('claim', 'notification')))[1], 'not_requested') AS notification_status, CAST(count(*) FILTER (kind = 'claim') AS INT) AS notification_attempts,
  (list(notification_error ORDER BY seq DESC) FILTER (kind IN ('claim', 'notification')))[1] AS notification_error,
  {", ".join(f"(list({c} ORDER BY seq DESC) FILTER (kind = 'notification' AND {c} IS NOT NULL))[1] AS {c}" for c in ("review_chat_id", "review_message_id"))} FROM e GROUP BY reply_id""")
def feedback_state(spark, d):
    return feedback.state(S.table(spark, d, "events").selectExpr(*S._split(_LOG))).drop("notification_last_attempt_at")


@query(REPLIES + " SELECT count(*) AS total, count(*) FILTER (feedback_status = 'unreviewed') AS unreviewed, count(*) FILTER (feedback_status = 'approved') AS approved, count(*) FILTER (feedback_status = 'rejected') AS rejected, count(*) FILTER (feedback_status = 'corrected') AS corrected, count(*) FILTER (delivery_status = 'failed') AS delivery_failures FROM r")
def feedback_counts(spark, d):
    return feedback.counts(_replies(spark, d))


@query(REPLIES + " SELECT id, feedback_status FROM r WHERE delivery_status = 'sent' ORDER BY id DESC LIMIT 5")
def recent_replies(spark, d):
    return feedback.recent(_replies(spark, d)).select("id", "feedback_status")


@query(REPLIES + " SELECT id, notification_attempts FROM r WHERE delivery_status = 'sent' AND review_message_id IS NULL AND notification_status IN ('pending', 'failed') AND notification_attempts < 3 ORDER BY id LIMIT 20")
def pending_notifications(spark, d):
    return feedback.pending_notifications(_replies(spark, d)).select("id", "notification_attempts")


@query(REPLIES + " SELECT id, CASE feedback_status WHEN 'rejected' THEN 'negative' ELSE 'positive' END AS part, CASE feedback_status WHEN 'approved' THEN generated_reply_text WHEN 'corrected' THEN corrected_reply_text END AS preferred_reply, coalesce(nullif(feedback_source, ''), 'saved_messages') AS feedback_source FROM r WHERE feedback_status <> 'unreviewed'")
def feedback_export_split(spark, d):
    return feedback.split(feedback.reviewed(_replies(spark, d))).select("id", "part", "preferred_reply", "feedback_source")


_COMMANDS = (
    "CASE doc_id % 12 WHEN 0 THEN concat('/good ', doc_id) WHEN 1 THEN concat('/bad ', doc_id, ' too_formal  be brief') WHEN 2 THEN concat('/fix ', doc_id, ' ', text) WHEN 3 THEN concat(' /BAD  ', doc_id, ' ', text) "
    "WHEN 4 THEN concat('/good x', doc_id) WHEN 5 THEN concat('/nope ', doc_id) WHEN 6 THEN concat('/good -', doc_id) WHEN 7 THEN concat('/fix ', doc_id) WHEN 8 THEN concat('/good ', doc_id, ' more') WHEN 9 THEN '/feedback_help' WHEN 10 THEN text ELSE '/good' END"
)
COMMANDS = f"""WITH t AS (SELECT doc_id, {_strip(_COMMANDS)} AS b FROM documents), p AS (SELECT doc_id, b, lower(regexp_extract(b, '^[^ \\n\\t]+')) AS name, regexp_extract(b, '^[^ \\n\\t]+[ \\n\\t]+([^ \\n\\t]+)', 1) AS num,
  {_strip("regexp_extract(b, '^[^ \\n\\t]+[ \\n\\t]+[^ \\n\\t]+[ \\n\\t]+((?s).+)$', 1)")} AS rest FROM t),
e AS (SELECT *, CASE WHEN regexp_matches(num, '^[+]?[0-9]+$') THEN TRY_CAST(num AS BIGINT) END AS n FROM p), x AS (SELECT *, CASE WHEN name NOT IN ('/good', '/bad', '/fix', '/feedback_help') THEN 'unknown_command' WHEN name = '/feedback_help' THEN CASE WHEN b <> name THEN 'help_takes_no_arguments' END
  WHEN num = '' THEN 'reply_id_missing' WHEN n IS NULL OR n <= 0 THEN 'reply_id_not_positive' WHEN name = '/good' AND rest <> '' THEN 'good_takes_an_id_only' WHEN name <> '/good' AND rest = '' THEN 'detail_missing' END AS error, split_part(rest, ' ', 1) AS f FROM e),
k AS (SELECT *, f IN ({", ".join(f"'{c}'" for c in T.CATEGORIES)}) AS known FROM x)
SELECT doc_id, CASE WHEN error IS NULL THEN CASE name WHEN '/feedback_help' THEN 'help' ELSE substr(name, 2) END END AS name, CASE WHEN error IS NULL AND name <> '/feedback_help' THEN n END AS reply_id, CASE WHEN error IS NULL AND name = '/bad' THEN CASE WHEN known THEN f ELSE 'other' END END AS category,
  CASE WHEN error IS NULL AND name = '/bad' THEN CASE WHEN known THEN nullif({_strip("substr(rest, length(f) + 2)")}, '') ELSE rest END END AS comment, CASE WHEN error IS NULL AND name = '/fix' THEN rest END AS correction, error FROM k"""


@query(COMMANDS)
def feedback_commands(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.parse_command(F.expr(_COMMANDS)).alias("c")).select("doc_id", "c.*")


_OBJECTS = "CASE WHEN json_valid(context_json) AND json_type(context_json) = 'ARRAY' THEN list_filter(json_extract(context_json, '$[*]'), lambda x: json_type(x) = 'OBJECT') ELSE [] END"
FEEDBACK_EXAMPLES = REPLIES + f""", o AS (SELECT *, {_OBJECTS} AS objs FROM r),
c AS (SELECT *, list_transform(objs, lambda x: struct_pack(provenance := coalesce(json_extract_string(x, '$.provenance'), ''), role := coalesce(json_extract_string(x, '$.role'), ''), text := coalesce(json_extract_string(x, '$.text'), ''))) AS turns FROM o),
i AS (SELECT *, coalesce(nullif(incoming_message_text, ''), {_strip("coalesce(list_filter(turns, lambda t: t.role = 'user')[-1].text, '')")}) AS incoming FROM c),
ty AS (SELECT *, CASE WHEN feedback_status = 'corrected' AND coalesce(corrected_reply_text, '') <> '' THEN 'fix' WHEN feedback_status = 'rejected' AND feedback_category = 'should_not_reply' THEN 'should_not_reply' WHEN feedback_status = 'rejected' THEN 'rejected' WHEN feedback_status = 'approved' THEN 'approved_ai' END AS st FROM i),
fe AS (SELECT 'feedback:' || id || ':' || CASE st WHEN 'approved_ai' THEN 'good' ELSE st END AS source_key, st AS source_type, CASE st WHEN 'fix' THEN 'positive' WHEN 'approved_ai' THEN 'evaluation' ELSE 'negative' END AS polarity, CASE st WHEN 'fix' THEN 'human_fix' ELSE 'ai_generated' END AS provenance,
  CASE st WHEN 'fix' THEN corrected_reply_text ELSE generated_reply_text END AS response_text, incoming AS incoming_text, coalesce(nullif(feedback_updated_at, ''), created_at) AS created_at, turns, feedback_status, coalesce(feedback_category, '') AS feedback_category, dialog_id AS contact_id, id AS seq FROM ty WHERE st IS NOT NULL AND incoming <> '')"""


@query(FEEDBACK_EXAMPLES + " SELECT source_key, source_type, polarity, provenance, response_text, incoming_text, created_at, len(turns)::BIGINT AS n_context, contact_id FROM fe")
def style_examples(spark, d):
    return style.from_feedback(_replies(spark, d)).select("source_key", "source_type", "polarity", "provenance", "response_text", "incoming_text", "created_at", F.size("context").cast("long").alias("n_context"), "contact_id")


_NOW = "SELECT concat('doc:', doc_id) AS source_key, sha256(text) AS content_hash, doc_id AS seq, CASE WHEN doc_id % 10 = 7 THEN 'evaluation' ELSE 'positive' END AS polarity FROM documents WHERE doc_id % 9 <> 0"
_THEN = "SELECT concat('doc:', doc_id) AS source_key, CASE WHEN doc_id % 5 = 0 THEN sha256(concat(text, ' before')) ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 7 <> 0"
PLAN = f"""WITH cur AS ({_NOW}), old AS ({_THEN}), known AS (SELECT DISTINCT content_hash FROM old WHERE source_key NOT LIKE '%3'),
ch AS (SELECT coalesce(cur.source_key, old.source_key) AS source_key, CASE WHEN old.source_key IS NULL THEN 'new' WHEN cur.source_key IS NULL THEN 'deleted' WHEN cur.content_hash = old.content_hash THEN 'unchanged' ELSE 'modified' END AS change_type FROM cur FULL OUTER JOIN old USING (source_key)),
pend AS (SELECT cur.*, CASE change_type WHEN 'new' THEN 0 ELSE 1 END AS phase FROM cur JOIN ch USING (source_key) WHERE change_type IN ('new', 'modified')),
ru AS (SELECT *, content_hash IN (SELECT content_hash FROM known) OR row_number() OVER (PARTITION BY content_hash ORDER BY phase, seq) > 1 AS reuse FROM pend),
an AS (SELECT *, NOT reuse AND polarity <> 'evaluation' AS due FROM ru)"""


def _snapshots(spark, d):
    docs = S.table(spark, d, "documents")
    key = F.concat(F.lit("doc:"), "doc_id").alias("source_key")
    current = docs.where("doc_id % 9 <> 0").select(key, F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 10 == 7, "evaluation").otherwise("positive").alias("polarity"))
    cached = docs.where("doc_id % 7 <> 0").select(key, F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return current, cached, cached.where(~F.endswith("source_key", F.lit("3"))).select("content_hash")


@query(PLAN + " SELECT source_key, change_type FROM ch")
def build_plan(spark, d):
    current, cached, _ = _snapshots(spark, d)
    return style.diff(current, cached).select("source_key", "change_type")


@query(PLAN + " SELECT source_key, phase, reuse, due AS fresh FROM an")
def build_pending(spark, d):
    return style.pending_hashes(*_snapshots(spark, d)).select("source_key", "phase", "reuse", F.col("analyze").alias("fresh"))


@query(PLAN + " SELECT content_hash, source_key, (row_number() OVER (ORDER BY phase, seq) - 1) // 50 + 1 AS batch_number FROM an WHERE due")
def build_batches(spark, d):
    return style.to_analyze(*_snapshots(spark, d))


@query(PLAN + """ SELECT (SELECT count(*) FROM cur) AS total, count(*) FILTER (change_type = 'unchanged') AS unchanged, count(*) FILTER (change_type = 'new') AS "new", count(*) FILTER (change_type = 'modified') AS modified, count(*) FILTER (change_type = 'deleted') AS deleted,
  (SELECT count(*) FROM an WHERE reuse) AS reusable, (SELECT count(*) FROM an WHERE due) AS to_analyze, CAST(ceil((SELECT count(*) FROM an WHERE due) / 50) AS BIGINT) AS batches, (SELECT count(*) FROM an WHERE due) > 0 AS analyzer_needed FROM ch""")
def plan_summary(spark, d):
    return style.plan_summary(*_snapshots(spark, d))


@query("""WITH r AS (SELECT lower(trim(coalesce(source, ''))) AS k1, 'write in ' || coalesce(lang, '?') AS k2, sha256(text) AS h, CAST(doc_id % 97 AS VARCHAR) AS k3, doc_id, 0.5 + doc_id % 40 / 100.0 AS c, CASE WHEN doc_id % 3 = 0 THEN 'fix' ELSE 'human' END AS st FROM documents)
SELECT substr(sha256(k1 || '|' || k2 || '|' || k3 || '|global|positive'), 1, 24) AS observation_id, count(*) AS evidence_count, CAST(round(least(0.99, max(c) + 0.03 * (count(*) - 1)), 4) AS DOUBLE) AS confidence,
  CASE WHEN count(DISTINCT st) = 1 THEN min(st) ELSE 'mixed' END AS source_type, CASE WHEN bool_or(st = 'fix') THEN 100 ELSE 80 END AS source_priority,
  'Write  in ' || substr(k2, 10) AS text, array_to_string(list_sort(list('doc:' || doc_id)), ',') AS keys, array_to_string(list_sort(list(DISTINCT h)), ',') AS hashes FROM r GROUP BY k1, k2, k3""")
def merged_rules(spark, d):
    docs = S.table(spark, d, "documents").withColumns({"lang": F.coalesce("lang", F.lit("?")), "source": F.coalesce("source", F.lit(""))})
    rules = docs.select(F.concat(F.lit("Write  in "), "lang").alias("text"), F.expr("cast(0.5 + doc_id % 40 / 100.0 as double)").alias("confidence"), F.expr("cast(doc_id % 97 as string)").alias("applicable_context"), F.lit("Global ").alias("scope"), F.col("source").alias("behavior_category"), F.lit("positive").alias("polarity"), F.when(F.col("doc_id") % 3 == 0, "fix").otherwise("human").alias("source_type"), F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), "doc_id").alias("source_key"), F.sha2("text", 256).alias("content_hash"))
    return style.merge(style.bind(rules)).select("observation_id", "evidence_count", "confidence", "source_type", "source_priority", "text", F.array_join("supporting_source_keys", ",").alias("keys"), F.array_join("supporting_source_hashes", ",").alias("hashes"))


@query(f"SELECT doc_id % 50 AS contact_id, count(*) AS positive_example_count, count(*) AS evidence_count, round_even(avg(length(text)), 2) AS average_response_chars, round_even(avg(CAST(regexp_matches(text, '^\\p{{Ll}}') AS INT)), 3) AS lowercase_start_ratio, round_even(avg(CAST(ends_with({_strip('text')}, '.') AS INT)), 3) AS final_period_ratio, round_even(avg(CAST(contains(text, '?') AS INT)), 3) AS question_ratio, round_even(avg(CAST(contains(text, '!') AS INT)), 3) AS exclamation_ratio FROM documents GROUP BY 1")
def contact_statistics(spark, d):
    return style.statistics(_style_docs(spark, d))


_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_'']+')"
_RUDE = "(" + " OR ".join(f"contains(lower({{0}}), '{m}')" for m in T.PROFANITY) + ")"
_INTENT = "CASE " + " ".join(f"WHEN list_has_any({_TOKENS}, {list(ws)}) THEN '{n}'" for n, ws in T.INTENTS) + f" WHEN {_RUDE} THEN 'aggressive_or_teasing' WHEN contains({{0}}, '?') THEN 'question' WHEN list_has_any({_TOKENS}, {list(T.BUSINESS)}) THEN 'business' ELSE 'general' END"


@query(f"SELECT role, {_INTENT.format('text')} AS intent, count(*) AS n FROM conversations GROUP BY 1, 2")
def intent_distribution(spark, d):
    return S.table(spark, d, "conversations").groupBy("role", T.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


_CANDIDATES = "doc_id AS seq, concat('doc-', doc_id) AS example_id, doc_id % 20 AS contact_id, text AS incoming_text, lang AS response_text, CASE doc_id % 5 WHEN 0 THEN 'fix' WHEN 3 THEN 'rejected' WHEN 4 THEN 'approved_ai' ELSE 'human' END AS source_type, CASE doc_id % 5 WHEN 3 THEN 'negative' WHEN 4 THEN 'evaluation' ELSE 'positive' END AS polarity, CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('2024-01-', CAST(doc_id % 19 + 10 AS {string})) END AS created_at"
RETRIEVAL = f"""WITH cand AS (SELECT {_CANDIDATES.format(string="VARCHAR")} FROM documents),
dd AS (SELECT * FROM cand WHERE polarity <> 'evaluation' QUALIFY row_number() OVER (PARTITION BY {_collapse("lower(incoming_text)")}, {_collapse("lower(response_text)")}, polarity ORDER BY seq) = 1),
tk AS (SELECT seq, unnest({_TOKENS.format("incoming_text")}) AS token FROM dd), tf AS (SELECT seq, token, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM dd), w AS (SELECT seq, token, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (token), n),
qt AS (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark), qw AS (SELECT item_id, token, count(*) * (ln((any_value(n) + 1) / (coalesce(any_value(df), 0) + 1)) + 1) AS qw FROM qt LEFT JOIN df USING (token), n GROUP BY ALL),
nd AS (SELECT seq, sqrt(sum(w * w)) AS nd FROM w GROUP BY 1), nq AS (SELECT item_id, sqrt(sum(qw * qw)) AS nq FROM qw GROUP BY 1),
dot AS (SELECT item_id, seq, sum(qw * w) AS dot FROM qw JOIN w USING (token) GROUP BY ALL),
b AS (SELECT seq, example_id, contact_id, source_type, created_at, {_RUDE.format("incoming_text")} AS rude, {_INTENT.format("incoming_text")} AS intent,
  CASE source_type WHEN 'fix' THEN 5.0::DOUBLE WHEN 'human' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN polarity = 'negative' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN created_at = '' THEN 0.0::DOUBLE ELSE 0.25::DOUBLE / (1 + date_diff('day', created_at::DATE, DATE '2024-03-01')::DOUBLE / 30) END AS own FROM dd),
q AS (SELECT item_id, item_id % 20 AS qc, {_RUDE.format("text")} AS qr, {_INTENT.format("text")} AS qi FROM benchmark),
s AS (SELECT q.item_id, b.*, round(coalesce(dot / (nd * nq), 0) + own + CASE WHEN contact_id = qc THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rude = qr THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN intent = qi THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END, 9) AS score
  FROM q CROSS JOIN b LEFT JOIN dot ON dot.item_id = q.item_id AND dot.seq = b.seq LEFT JOIN nd ON nd.seq = b.seq LEFT JOIN nq ON nq.item_id = q.item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_type = 'fix' DESC, created_at DESC, example_id DESC, seq) AS rank FROM s)
SELECT item_id AS query_id, CAST(rank AS INT) AS rank, example_id, round(score, 6) AS score FROM k WHERE rank <= 8"""


def _retrieved(spark, d):
    cand = S.table(spark, d, "documents").selectExpr(*S._split(_CANDIDATES.format(string="STRING")))
    q = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 20).alias("contact_id"))
    return retrieve.top_k(q, cand, as_of=F.to_timestamp(F.lit("2024-03-01"))), cand


@query(RETRIEVAL)
def retrieval_topk(spark, d):
    return _retrieved(spark, d)[0]


_PACKED = RETRIEVAL.replace("SELECT item_id AS query_id, CAST(rank AS INT) AS rank, example_id, round(score, 6) AS score FROM k WHERE rank <= 8", "") + """,
top AS (SELECT item_id AS query_id, k.rank, round(k.score, 6) AS score, c.* FROM k JOIN cand c USING (example_id) WHERE k.rank <= 8),
blk AS (SELECT query_id, rank, score, source_type, CASE WHEN polarity = 'positive' THEN 'POSITIVE ' || upper(source_type) || ' EVIDENCE' ELSE 'NEGATIVE ' || upper(source_type) || ' EVIDENCE - DO NOT COPY' END || chr(10) || 'CONTACT: ' || incoming_text || chr(10) || 'RESPONSE: ' || response_text AS block FROM top),
lst AS (SELECT query_id, list({'used': length(block), 'outs': [block]} ORDER BY source_type <> 'fix', score DESC, rank) AS bs, count(*) AS selected_count, count(*) FILTER (source_type = 'fix') AS selected_fix_count FROM blk GROUP BY 1),
pk AS (SELECT *, list_reduce(bs, lambda a, x: CASE WHEN a.used + x.used > 10000 THEN a ELSE {'used': a.used + x.used, 'outs': list_concat(a.outs, x.outs)} END, {'used': 0::BIGINT, 'outs': []::VARCHAR[]}) AS f FROM lst),
ev AS (SELECT query_id, len(f.outs)::BIGINT AS n_blocks, f.used::BIGINT AS used, CASE WHEN len(f.outs) > 0 THEN array_to_string(f.outs, chr(10) || chr(10)) ELSE '(no relevant evidence selected)' END AS evidence, selected_count, selected_fix_count FROM pk)"""


def _evidence(spark, d):
    top, cand = _retrieved(spark, d)
    return retrieve.evidence(top, cand)


@query(_PACKED + " SELECT query_id, n_blocks, used, evidence FROM ev")
def evidence_packing(spark, d):
    return compose.pack_evidence(_evidence(spark, d))


_RULES, _SECTION = "- be brief\n" * 1500, "chr(10) || chr(10) || "


@query(_PACKED + f""", msgs AS (SELECT item_id AS query_id, u.seq, u.role, u.text, u.provenance FROM benchmark, LATERAL (SELECT unnest([{{'seq': 1, 'role': 'user', 'text': repeat(text, 30), 'provenance': 'contact'}}, {{'seq': 2, 'role': 'assistant', 'text': 'fine', 'provenance': 'ai_generated'}}, {{'seq': 3, 'role': 'user', 'text': text, 'provenance': 'contact'}}]) AS u)),
sfx AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY seq DESC) AS upto FROM msgs), fit AS (SELECT query_id, string_agg(role || ':' || text, chr(10) ORDER BY seq) AS messages, sum(length(text)) AS chars FROM sfx WHERE upto <= 6000 OR seq = 3 GROUP BY 1),
ins AS (SELECT f.*, '[IDENTITY]' || chr(10) || '{compose.IDENTITY}' || {_SECTION} '[SAFETY]' || chr(10) || '{compose.SAFETY}' || {_SECTION} '[MANUAL OVERRIDES]' || chr(10) || 'never swear' || {_SECTION} '[RULES]' || chr(10) || (SELECT rtrim(substr(repeat('- be brief' || chr(10), 1500), 1, 11986), chr(10) || ' ')) || chr(10) || '[truncated]'
  || {_SECTION} '[CONTACT STYLE]' || chr(10) || CASE WHEN f.query_id % 2 = 0 THEN '{{"contact":' || f.query_id || '}}' ELSE '{{}}' END || {_SECTION} '[EXAMPLES]' || chr(10) || coalesce(evidence, '{compose.EMPTY}') || {_SECTION} '[FALLBACK]' || chr(10) || '{compose.FALLBACK}' || {_SECTION} '[TASK]' || chr(10) || '{compose.TASK}' AS instructions,
  coalesce(selected_count, 0) AS selected_count, coalesce(selected_fix_count, 0) AS selected_fix_count FROM fit f LEFT JOIN ev USING (query_id))
SELECT query_id, instructions, messages, CAST(length(instructions) + chars AS BIGINT) AS estimated_chars, selected_count, selected_fix_count, 'ai_generated:1,contact:2' AS provenances FROM ins""")
def composed_prompt(spark, d):
    b = S.table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    turn = lambda seq, role, text, p: F.struct(F.lit(seq).alias("seq"), F.lit(role).alias("role"), text.alias("text"), F.lit(p).alias("provenance"))
    messages = b.select("query_id", F.explode(F.array(turn(1, "user", F.repeat("text", F.lit(30)), "contact"), turn(2, "assistant", F.lit("fine"), "ai_generated"), turn(3, "user", F.col("text"), "contact"))).alias("m")).select("query_id", "m.*")
    contacts = b.where("query_id % 2 = 0").select("query_id", F.to_json(F.struct(F.col("query_id").alias("contact"))).alias("profile"))
    got = compose.compose(_evidence(spark, d), messages, contacts, rules=_RULES, overrides="never swear")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    counted = F.array_join(F.transform(F.array_sort(F.map_entries("provenance_counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return got.select("query_id", "instructions", said.alias("messages"), "estimated_chars", "selected_count", "selected_fix_count", counted.alias("provenances"))


_CUR = "cur AS (SELECT dialog_id, max(id) AS id FROM m GROUP BY 1)"
_LIVE = MSG.replace("WITH raw", "WITH RECURSIVE raw", 0) + f""", {_CUR}, n1 AS (SELECT m.*, cur.id AS current_id FROM m JOIN cur USING (dialog_id) QUALIFY row_number() OVER (PARTITION BY m.dialog_id ORDER BY m.id DESC) <= 90),
n2 AS (SELECT * FROM n1 WHERE id <> current_id AND text <> '' QUALIFY row_number() OVER (PARTITION BY dialog_id ORDER BY id DESC) <= 29)
SELECT dialog_id, current_id, id, role, text FROM n2 UNION ALL SELECT m.dialog_id, m.id, m.id, 'user', text FROM m JOIN cur ON m.dialog_id = cur.dialog_id AND m.id = cur.id"""


@query(_LIVE)
def context_recent(spark, d):
    h = _history(spark, d)
    current = h.groupBy("dialog_id").agg(F.max("id").alias("id"), F.max_by("text", "id").alias("text"))
    return extract.live_context(h, current)


@query("SELECT conv_id AS dialog_id, turn AS seq, suffix_chars FROM (SELECT *, CAST(sum(length(text)) OVER w AS BIGINT) AS suffix_chars, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE suffix_chars <= 1000 OR n = 1")
def history_budget(spark, d):
    return extract.history_budget(S.table(spark, d, "conversations").select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("seq"), "text"), max_chars=1000).select("dialog_id", "seq", "suffix_chars")


@query(MSG + " , n AS (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY id DESC) AS n FROM m) SELECT a.dialog_id, a.id, EXISTS (SELECT 1 FROM n b WHERE b.dialog_id = a.dialog_id AND b.id > a.id AND b.n <= 10 AND b.outgoing AND b.text <> '') AS replied FROM n a WHERE NOT a.outgoing")
def human_replied_after(spark, d):
    return extract.human_replied_after(_history(spark, d))


@query("SELECT item_id, v.variant FROM benchmark, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(variant)")
def scenario_variants(spark, d):
    return compose.scenario_variants(S.table(spark, d, "benchmark").select("item_id"))


@query("SELECT doc_id, length(text) AS length, " + " + ".join(f"CAST(contains(lower(text), '{p}') AS BIGINT)" for p in compose.GENERIC) + " AS generic_phrases, " + " OR ".join(f"contains(lower(text), '{m}')" for m in compose.RUDE) + " AS rude, length(text) - length(replace(text, '!', '')) AS exclamations, length(text) - length(replace(text, '?', '')) AS questions FROM documents")
def response_metrics(spark, d):
    return compose.response_metrics(S.table(spark, d, "documents")).select("doc_id", "length", "generic_phrases", "rude", "exclamations", "questions")


@query(MSG + " SELECT dialog_id, max(m.id) AS last_id, arg_max(outgoing, m.id) AS last_outgoing, arg_max(text, m.id) AS last_text, count(*) AS n_messages, count(*) FILTER (NOT outgoing AND m.id > coalesce(o.own, -1)) AS unread FROM m LEFT JOIN (SELECT dialog_id, max(id) AS own FROM m WHERE outgoing GROUP BY 1) o USING (dialog_id) GROUP BY dialog_id")
def spec_inbox(spark, d):
    return spec.inbox(_history(spark, d))


@query("SELECT event_id, user_id, count(*) OVER () > 50 AS has_more FROM (SELECT * FROM events WHERE user_id > 20 OR user_id = 20 AND event_id > 100 ORDER BY user_id, event_id LIMIT 51) QUALIFY row_number() OVER (ORDER BY user_id, event_id) <= 50")
def spec_audit_page(spark, d):
    return spec.keyset_page(S.table(spark, d, "events"), sort="user_id", key="event_id", after=(20, 100)).select("event_id", "user_id", "has_more")


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER w - 1 AS missing FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY event_id - lag(event_id) OVER w - 1 > 0")
def spec_sequence_gaps(spark, d):
    return spec.sequence_gaps(S.table(spark, d, "events"), by="user_id", order=["ts", "event_id"], sequence="event_id").select("user_id", "event_id", "missing")


@query(REPLIES + " SELECT dialog_id AS grp, count(*) AS n, round(avg(CAST(feedback_status = 'approved' AS INT)), 6) AS approval_rate, round(avg(CAST(feedback_status = 'corrected' AS INT)), 6) AS edit_rate, round(avg(CAST(feedback_status = 'rejected' AS INT)), 6) AS rejection_rate, round(avg(CAST(delivery_status <> 'sent' AS INT)), 6) AS no_response_rate FROM r GROUP BY 1")
def spec_quality_rates(spark, d):
    return spec.quality_rates(_replies(spark, d), F.col("dialog_id"))


@query("SELECT key, seq, CASE WHEN seq = min(seq) OVER (PARTITION BY key) THEN 'first' WHEN payload = first_value(payload) OVER (PARTITION BY key ORDER BY seq) THEN 'replay' ELSE 'conflict' END AS outcome FROM (SELECT user_id AS key, event_id AS seq, event_type AS payload FROM events)")
def spec_idempotency(spark, d):
    return spec.idempotent(S.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))).select("key", "seq", "outcome")


from dialoom import catalogue_build, catalogue_review, catalogue_spec  # noqa: E402, F401 - they add their queries
