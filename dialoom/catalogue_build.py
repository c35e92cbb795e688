"""Queries of the incremental build, retrieval at run time, exports' summaries and evaluation; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.catalogue import _CANON, EXAMPLES, FEEDBACK_EXAMPLES, RETRIEVAL, _examples, _history, _replies, _strip, query
from dialoom.operators import build, clean, compose, extract, feedback, retrieve, style
from dialoom.plans import jobs
from dialoom.sources import tables as S

_canon = lambda x: _CANON.replace("{0}", x)
_HASH = f"""sha256('{{"contact_id":' || contact_id || ',"context":[' || array_to_string(list_transform(turns, lambda t: '{{"provenance":' || to_json(t.provenance) || ',"role":' || to_json(t.role) || ',"text":' || to_json({_canon("t.text")}) || '}}'), ',')
  || '],"feedback_category":' || to_json(feedback_category) || ',"feedback_status":' || to_json(feedback_status) || ',"incoming_text":' || to_json({_canon("incoming_text")}) || ',"polarity":' || to_json(polarity) || ',"provenance":' || to_json(provenance) || ',"source_type":' || to_json(source_type) || ',"target_reply":' || to_json({_canon("response_text")}) || '}}')"""
#: The scan: feedback before a person's own replies (the cleaned examples), the first of each source, with other contents counted.
SCAN = FEEDBACK_EXAMPLES + EXAMPLES.replace("\nWITH raw AS", ", raw AS", 1).replace("r AS (SELECT *, CASE WHEN text = ''", "rz AS (SELECT *, CASE WHEN text = ''", 1).replace("END AS reason FROM r)", "END AS reason FROM rz)", 1).replace("\nr AS (", "\nrz AS (") + f""",
pre AS (SELECT *, list(struct_pack(provenance := '', role := role, text := text)) OVER (PARTITION BY dialog_id ORDER BY grp ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ctx FROM gr),
he AS (SELECT 'dialog:' || rr.dialog_id || ':' || rr.ids AS source_key, 'human' AS source_type, 'positive' AS polarity, 'human' AS provenance, rr.text AS response_text, {_strip("list_filter(ctx, lambda t: t.role = 'user')[-1].text")} AS incoming_text, ctx AS turns, '' AS feedback_status, '' AS feedback_category, rr.dialog_id AS contact_id, rr.grp AS seq, 1 AS src FROM rr JOIN pre USING (dialog_id, grp) WHERE reason IS NULL),
al AS (SELECT source_key, source_type, polarity, provenance, {_strip("response_text")} AS response_text, incoming_text, turns, feedback_status, feedback_category, contact_id, seq, src FROM he WHERE incoming_text <> '' UNION ALL SELECT source_key, source_type, polarity, provenance, response_text, incoming_text, turns, feedback_status, feedback_category, contact_id, seq, 0 FROM fe),
ha AS (SELECT *, {_HASH} AS content_hash FROM al), sc AS (SELECT * FROM ha QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY src, seq) = 1)"""


def _scan(spark: SparkSession, d: str) -> DataFrame:
    human = style.from_training(clean.clean(_examples(spark, d), redact=False))
    return build.sources(human, style.from_feedback(_replies(spark, d)))[0]


@query(SCAN + " SELECT source_key, source_type, polarity, content_hash FROM sc")
def style_sources(spark, d):
    return _scan(spark, d).select("source_key", "source_type", "polarity", "content_hash")


@query(SCAN + """, x AS (SELECT contact_id, source_type, count(*) AS n FROM sc WHERE polarity = 'positive' GROUP BY ALL) SELECT contact_id, source_type, n FROM x""")
def source_counts(spark, d):
    return style.source_counts(_scan(spark, d))


@query(SCAN + " SELECT count(DISTINCT content_hash) AS example_bank_count, count(*) FILTER (source_type = 'human') AS human_example_count, count(*) FILTER (source_type = 'fix') AS fix_example_count, count(*) FILTER (polarity = 'negative') AS negative_example_count, count(*) FILTER (source_type = 'approved_ai') AS approved_ai_evaluation_count, count(*) AS total, 'full' AS build_mode, count(*) AS \"new\", 0::BIGINT AS unchanged, 0::BIGINT AS prior_source_count FROM sc")
def build_summary(spark, d):
    none = lambda schema: spark.createDataFrame([], schema)
    got = build.summary(_scan(spark, d), none("source_key string, content_hash string"), none("content_hash string"), build_mode="full")
    return got.select("example_bank_count", "human_example_count", "fix_example_count", "negative_example_count", "approved_ai_evaluation_count", "total", "build_mode", "new", "unchanged", "prior_source_count")


#: Batches of documents, and observations of them: without hashes, with one document's hash, or with one that fits none of the batch.
_BATCH = "SELECT concat('doc:', doc_id) AS source_key, sha256(text) AS content_hash, doc_id div 10 AS batch_number FROM documents"
_OBSERVED = "SELECT doc_id div 10 AS batch_number, concat('rule ', doc_id) AS text, CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN 'no such hash' ELSE CASE WHEN doc_id % 20 = 5 THEN '' ELSE 'neither' END END AS h FROM documents WHERE doc_id % 10 IN (3, 4, 5) OR doc_id % 50 < 10 AND doc_id % 10 = 1"
MATCHED = f"""WITH b AS ({_BATCH.replace(" div ", " // ")}), o AS ({_OBSERVED.replace(" div ", " // ")}), j AS (SELECT b.*, o.text, o.h = '' OR o.h = b.content_hash AS fits FROM b JOIN o USING (batch_number)),
w AS (SELECT source_key, content_hash, text FROM (SELECT *, bool_or(fits) OVER (PARTITION BY source_key) AS found FROM j) WHERE fits OR NOT found)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    h = F.sha2("text", 256)
    batch = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("source_key"), h.alias("content_hash"), F.expr("doc_id div 10").alias("batch_number"))
    k = F.col("doc_id")
    hashes = F.when(k % 3 == 0, F.array(h)).when(k % 3 == 1, F.array(F.lit("no such hash"))).when(k % 20 == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("neither")))
    observed = docs.where("doc_id % 10 in (3, 4, 5) or doc_id % 50 < 10 and doc_id % 10 = 1").select(F.expr("doc_id div 10").alias("batch_number"), F.concat(F.lit("rule "), "doc_id").alias("text"), hashes.alias("supporting_source_hashes"))
    return style.match_observations(batch, observed)


@query(MATCHED + " SELECT source_key, text FROM w")
def observation_matches(spark, d):
    return _matched(spark, d).select("source_key", "text")


@query(MATCHED + """, t AS (SELECT DISTINCT content_hash, text FROM w), s AS (SELECT concat('doc:', doc_id) AS source_key, sha256(text) AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'fix' ELSE 'human' END AS source_type FROM documents WHERE doc_id % 10 <> 9)
SELECT source_key, content_hash, t.text, source_type, CASE source_type WHEN 'fix' THEN 100 ELSE 80 END AS source_priority, substr(sha256('style|' || t.text || '|any|global|' || content_hash), 1, 24) AS observation_id FROM s JOIN t USING (content_hash)""")
def bound_rules(spark, d):
    docs = S.table(spark, d, "documents")
    matched = _matched(spark, d).select("content_hash", "text").distinct()
    templates = matched.select("content_hash", "text", F.lit(0.8).alias("confidence"), F.lit("any").alias("applicable_context"), F.lit("global").alias("scope"), F.lit("style").alias("behavior_category"), F.array().cast("array<string>").alias("supporting_source_hashes"), F.lit(0).cast("long").alias("seq"))
    current = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("source_key"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 10 == 9, "evaluation").otherwise("positive").alias("polarity"), F.when(F.col("doc_id") % 5 == 0, "fix").otherwise("human").alias("source_type"), F.col("doc_id").alias("seq"))
    got = build.bound(current, templates, current.select("content_hash").distinct())
    return got.select(F.col("supporting_source_keys")[0].alias("source_key"), F.col("supporting_source_hashes")[0].alias("content_hash"), "text", "source_type", "source_priority", "observation_id")


@query("SELECT sha256(text) AS content_hash, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'new' ELSE 'old' END AS rule FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 GROUP BY 1")
def retained_analyses(spark, d):
    """Kept analyses united with those of this build, the new one of a content in place of the old."""
    docs = S.table(spark, d, "documents")
    rows = lambda where, rule: docs.where(where).select(F.sha2("text", 256).alias("content_hash"), F.lit(rule).alias("rule")).distinct()
    return build.retained(rows("doc_id % 2 = 0", "old"), rows("doc_id % 3 = 0", "new"))


@query("SELECT count(*) AS requests, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN sum(event_id) END AS input_tokens, sum(event_id)::BIGINT AS output_tokens FROM events")
def analyzer_usage(spark, d):
    e = S.table(spark, d, "events")
    return build.usage(e.select(F.when(F.col("event_type") != "error", F.col("event_id")).alias("input_tokens"), F.col("event_id").alias("output_tokens")))


@query(EXAMPLES + """, st AS (SELECT dialog_id, count(*) AS messages_scanned, count(*) FILTER (excl = 'service') AS service_excluded, count(*) FILTER (excl = 'media') AS media_excluded, count(*) FILTER (excl = 'blank') AS empty_excluded, count(*) FILTER (excl = 'known_ai') AS ai_excluded FROM m GROUP BY 1),
tg AS (SELECT dialog_id, count(*) AS n FROM gr WHERE role = 'assistant' GROUP BY 1), ex2 AS (SELECT dialog_id, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS gone FROM rr GROUP BY 1), why2 AS (SELECT dialog_id, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (SELECT dialog_id, reason, count(*) AS n FROM rr WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT st.*, coalesce(tg.n, 0) AS human_target_replies, coalesce(kept, 0) AS examples_exported, coalesce(gone, 0) AS examples_removed, coalesce(reasons, '') AS reasons FROM st LEFT JOIN tg USING (dialog_id) LEFT JOIN ex2 USING (dialog_id) LEFT JOIN why2 USING (dialog_id)""")
def training_summary(spark, d):
    c = extract.classify(_history(spark, d))
    g = extract.fragments(c)
    got = jobs.training_summary(c, g, extract.examples(g))
    why = F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("removal_reasons")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","), F.lit(""))
    return got.withColumn("reasons", why).drop("removal_reasons", "redacted_email", "redacted_url", "redacted_phone", "redacted_secret")


@query(EXAMPLES.replace("FROM (", "FROM (").split(", r AS (")[0].split(",\nr AS (")[0] + " SELECT dialog_id, id FROM m QUALIFY row_number() OVER (PARTITION BY dialog_id ORDER BY id DESC) <= 500")
def newest_messages(spark, d):
    return S.newest(_history(spark, d), 10).select("dialog_id", "id")


#: Live queries over feedback and the bank: immediate feedback first, both sides with their ids.
_RUN = FEEDBACK_EXAMPLES + """, bank AS (SELECT 'doc-' || doc_id AS example_id, doc_id % 50 AS contact_id, text AS incoming_text, coalesce(lang, '') AS response_text, 'human' AS source_type, 'positive' AS polarity, '' AS created_at FROM documents),
un AS (SELECT 0 AS src, 'feedback-' || seq AS example_id, contact_id, incoming_text, response_text, source_type, polarity, created_at FROM fe UNION ALL SELECT 1, * FROM bank)"""
_LIVE_TOP = RETRIEVAL.split("dd AS (")[1]


def _run_sql() -> str:
    body = "dd AS (" + _LIVE_TOP
    body = body.replace("ORDER BY seq) = 1)", "ORDER BY src, example_id) = 1)", 1).replace("SELECT * FROM cand", "SELECT *, src || ':' || example_id AS seq FROM un", 1).replace("item_id % 20 AS qc", "item_id % 50 AS qc")
    body = body.replace("date_diff('day', created_at::DATE, DATE '2024-03-01')::DOUBLE / 30", "greatest(epoch_us(TIMESTAMP '2024-03-01') - epoch_us(CAST(created_at AS TIMESTAMPTZ)), 0)::DOUBLE / 86400000000.0 / 30")
    return _RUN + ",\n" + body.replace("SELECT item_id AS query_id, CAST(rank AS INT) AS rank, example_id, round(score, 6) AS score FROM k WHERE rank <= 8", "SELECT item_id AS query_id, CAST(rank AS INT) AS rank, example_id, round(score, 6) AS score FROM k WHERE rank <= 8")


@query(_run_sql())
def runtime_retrieval(spark, d):
    bank = S.table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("example_id"), (F.col("doc_id") % 50).alias("contact_id"), F.col("text").alias("incoming_text"), F.coalesce("lang", F.lit("")).alias("response_text"), F.lit("human").alias("source_type"), F.lit("positive").alias("polarity"), F.lit("").alias("created_at"))
    q = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 50).alias("contact_id"))
    return retrieve.top_k(q, retrieve.runtime_candidates(style.from_feedback(_replies(spark, d)), bank), as_of=F.to_timestamp(F.lit("2024-03-01")))


@query("SELECT s.scenario, v.variant, length(x.text) AS length, length(x.text) - length(replace(x.text, '!', '')) AS exclamations, length(x.text) - length(replace(x.text, '?', '')) AS questions FROM (SELECT DISTINCT coalesce(source, '') || doc_id // 5 AS scenario FROM documents) s, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(variant) LEFT JOIN (SELECT coalesce(source, '') || doc_id // 5 AS scenario, substr('ABCDE', (doc_id % 5 + 1)::INT, 1) AS variant, text FROM documents) x ON x.scenario = s.scenario AND x.variant = v.variant")
def style_evaluation(spark, d):
    responses = S.table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.expr("cast(doc_id div 5 as string)")).alias("scenario"), F.substring(F.lit("ABCDE"), F.expr("cast(doc_id % 5 + 1 as int)"), F.lit(1)).alias("variant"), "text")
    return compose.evaluation(responses).select("scenario", "variant", "length", "exclamations", "questions")


_OLD = "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'unreviewed' ELSE 'approved' END AS feedback_status FROM labels"


@query(f"SELECT id, feedback_status, CASE WHEN feedback_status <> 'unreviewed' THEN 'saved_messages' END AS feedback_source, '' AS incoming_message_text, 'not_requested' AS notification_status, 0 AS notification_attempts FROM ({_OLD})")
def migrated_replies(spark, d):
    old = S.table(spark, d, "labels").selectExpr("doc_id AS id", "CASE WHEN doc_id % 7 = 0 THEN 'unreviewed' ELSE 'approved' END AS feedback_status")
    return feedback.migrate(old).select("id", "feedback_status", "feedback_source", "incoming_message_text", "notification_status", "notification_attempts")
