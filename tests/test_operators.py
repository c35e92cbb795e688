import datetime as dt
import re

from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import clean, compose, extract, retrieve, style

BASE = dt.datetime(2026, 7, 24, 10, tzinfo=dt.UTC)
HISTORY = "dialog_id long, id long, sender_id long, text string, date timestamp, outgoing boolean, is_service boolean, has_media boolean, is_forwarded boolean"


def history(spark, rows):
    return spark.createDataFrame([(1, i, 42 if out else 1001, t, None if s is None else BASE + dt.timedelta(seconds=s), out, svc, False, False) for i, t, s, out, svc in rows], HISTORY)


def groups(spark, rows):
    known = spark.createDataFrame([], "dialog_id long, sent_message_id long")
    return extract.fragments(extract.classify(history(spark, rows), known))


def test_fragments_make_one_example(spark):
    g = groups(spark, [(1, "are we meeting?", 0, False, False), (2, "tomorrow?", 20, False, False), (3, "yes", 40, True, False), (4, "at seven", 60, True, False)])
    (e,) = extract.examples(g).collect()
    assert e.source_message_ids == [3, 4] and e.target_reply == "yes\nat seven" and e.context[0].text == "are we meeting?\ntomorrow?"
    assert e.created_at == "2026-07-24T10:01:00+00:00"


def test_gap_is_inclusive_and_excluded_messages_part(spark):
    g = groups(spark, [(1, "a", 0, True, False), (2, "b", 180, True, False), (3, "c", 360.000001, True, False), (4, "", 361, True, True), (5, "d", 362, True, False), (6, "e", None, True, False)])
    assert sorted(r.text for r in g.collect()) == ["a\nb", "c", "d\ne"]


def test_removal_reasons(spark):
    rows = [(i, t, m) for i, (t, m) in enumerate([("", "q"), ("https://example.com", "q"), ("/start now", "q"), ("fine", "/help"), ("normal", "q"), (" normal ", "q ")])]
    e = spark.createDataFrame([(1, i, [("user", m)], t, True, False) for i, t, m in rows], "dialog_id long, seq long, context array<struct<role:string,text:string>>, target_reply string, is_human_authored boolean, target_is_forwarded boolean")
    got = {r.seq: r.reason for r in clean.reasons(e).collect()}
    assert got == {0: "empty_target", 1: "link_only_target", 2: "bot_command_target", 3: "no_meaningful_incoming_context", 4: None, 5: "duplicate"}


def test_redaction_matches_python(spark):
    texts = ["mail a.b@c.org or +380 67 123 45 67", "see https://x.org/p?a=1 and https://x.org/p", "sk-abcdefghijklmnop", "token: abc", "жмail@x.org", "a@b.com_c@d.com", "", "12345678x"]
    w = r"[\w]"
    steps = [(r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "<EMAIL>"), (r"(?i)https?://[^\s?]*\?\S*", "<URL>"), (rf"(?<!{w})\+?\d[\d ()-]{{6,}}\d(?!{w})", "<PHONE>"), (r"(?i)(?:\b(?:api[_-]?key|token|secret)\b\s*[:=]\s*\S+|\bsk-[A-Za-z0-9_-]{16,}\b)", "<SECRET>")]
    want, counts = [], []
    for t in texts:
        n = []
        for p, r in steps:
            t, k = re.subn(p, r, t)
            n.append(k)
        want.append(t)
        counts.append(n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", T.redact(F.col("text")).alias("r"), *[c.alias(k) for k, c in T.redaction_counts(F.col("text")).items()]).orderBy("i").collect()
    assert [r.r for r in got] == want and [[r.email, r.url, r.phone, r.secret] for r in got] == counts


def test_commands(spark):
    texts = ["/good 1", "/bad 1 too_formal", "/bad 1 free comment", "/fix 1 text", "/fix 1", "/good -1", "hello", "/feedback_help"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse_command(F.col("t")).alias("c")).collect()]
    assert [(c.name, c.category, c.comment, c.correction, c.error is None) for c in got] == [("good", None, None, None, True), ("bad", "too_formal", None, None, True), ("bad", "other", "free comment", None, True), ("fix", None, None, "text", True), (None, None, None, None, False), (None, None, None, None, False), (None, None, None, None, False), ("help", None, None, None, True)]


def test_evidence_is_first_fit(spark):
    rows = [(1, i, s, k, "positive", "in", t) for i, s, k, t in [(1, 9.0, "human", "x" * 200), (2, 8.0, "human", "short"), (3, 1.0, "fix", "first")]]
    df = spark.createDataFrame(rows, "query_id long, rank int, score double, source_type string, polarity string, incoming_text string, response_text string")
    (r,) = compose.pack_evidence(df, limit=140).collect()
    assert r.n_blocks == 2 and r.evidence.index("first") < r.evidence.index("short")


def test_fix_ranks_before_unrelated_human(spark):
    c = spark.createDataFrame([(1, "a", 7, "weather today", "ok", "human", "positive", ""), (2, "b", 7, "are you free", "yes", "fix", "positive", ""), (3, "c", 7, "are you free", "sure", "approved_ai", "evaluation", "")], "seq long, example_id string, contact_id long, incoming_text string, response_text string, source_type string, polarity string, created_at string")
    q = spark.createDataFrame([(1, "are you free tonight", 7)], "query_id long, text string, contact_id long")
    assert [r.example_id for r in retrieve.top_k(q, c, as_of=F.current_timestamp()).orderBy("rank").collect()] == ["b", "a"]


def test_equivalent_rules_merge(spark):
    rules = [("Be  brief", 0.7, "any", "global", "Length", "positive", "human", i, [f"k{i}"], [f"h{i}"], 80) for i in range(2)]
    (r,) = style.merge(spark.createDataFrame(rules, "text string, confidence double, applicable_context string, scope string, behavior_category string, polarity string, source_type string, seq long, supporting_source_keys array<string>, supporting_source_hashes array<string>, source_priority int")).collect()
    assert (r.evidence_count, r.confidence) == (2, 0.73)
