"""What only tables larger than the others here show."""

import datetime as dt
import math
import random
import re
import sys
import unicodedata

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from dialoom import catalogue
from dialoom.functions import text as T
from dialoom.operators import build, retrieve, style
from dialoom.streaming import review as review_stream


def test_batches_number_every_row_once_whatever_the_tasks(spark):
    """Small partitions, so that counting and numbering would each get tasks of their own."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    before = {c: spark.conf.get(c, None) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        got = [(r.seq, r.batch_number) for r in style.batched(rows, ["seq"], 50).collect()]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
        spark.catalog.clearCache()
    assert sorted(got) == [(i, i // 50 + 1) for i in range(20_000)]


def test_fragments_of_any_date_leave_the_stream(spark, tmp_path):
    """Dates beyond 2096, and beyond 2262, where times of pandas end."""
    rows = [(c, t, r, f"text {c} {t}\nmore") for c in (6, 30_000, 100_002) for t, r in enumerate(("user", "assistant", "user"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.dialog_id, r.role, r.text, r.ids, r.is_forwarded) for r in catalogue.QUERIES["stream_fragments"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.execute(catalogue.SQL["stream_fragments"]).fetchall()) and {r[0] for r in got} == {6, 30_000, 100_002}


class _State:
    """What a stateful function sees of its state."""

    exists, hasTimedOut, value = False, False, None

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        pass

    def getCurrentWatermarkMs(self):
        return 0


def test_a_stream_sorts_rows_that_come_in_parts():
    event = lambda n, action, bare: {"us": n, "event_id": n, "action": action, "reply_id": 5 if action == "fix" else None, "value": None, "bare": bare, "is_text": action == "text", "known": True}
    parts = [pd.DataFrame([event(2, "text", "so")]), pd.DataFrame([event(1, "fix", "")])]
    got = pd.concat(review_stream._review((7,), iter(parts), _State()))
    assert list(got.outcome) == ["opened", "saved"] and list(got.event_id) == [1, 2]
    tries = [pd.DataFrame([{"seq": s, "before": 0, "claimable": True, "category": c}]) for s, c in ((2, "network"), (1, None))]
    got = pd.concat(review_stream._notify((7,), iter(tries), _State()))
    assert list(got.outcome) == ["sent", "refused"] and list(got.seq) == [1, 2]


def test_only_texts_that_may_change_are_composed_in_python(spark):
    """What COMPOSED holds never changes in composition: each is composed, no mark, and never the second of a pair."""
    plain = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), T.COMPOSED) + "]")
    second = {ord(d[1]) for d in ([chr(int(x, 16)) for x in unicodedata.decomposition(chr(c)).split()] for c in range(sys.maxunicode) if unicodedata.decomposition(chr(c))[:1] not in ("", "<")) if len(d) == 2}
    held = [c for c in range(sys.maxunicode) if plain.match(chr(c))]
    assert len(held) > 30_000 and all(unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) for c in held) and not second & set(held)
    texts = ["plain", "e\u0301a", "\u0439 \u4e2d\U0001f600", "\uac00\u11a8", "\u212b", "", None, "\u0438\u0306"]
    df = spark.createDataFrame([(i, t, [t, "a\u0300"]) for i, t in enumerate(texts)], "i int, t string, ts array<string>")
    nfc = lambda t: t and unicodedata.normalize("NFC", t)
    got = df.orderBy("i").select(T.nfc(F.col("t")), T.nfc_all(F.col("ts"))).collect()
    assert [(a or None, b) for a, b in got] == [(nfc(t) or None, [nfc(t), "\u00e0"]) for t in texts]
    seen = spark.sparkContext.accumulator(0)
    real = T._nfc

    @F.pandas_udf("string")
    def counted(s):
        seen.add(int(s.notna().sum()))
        return s

    T._nfc = counted
    try:
        df.select(T.nfc(F.col("t"))).collect()
    finally:
        T._nfc = real
    assert seen.value == 4


def test_a_command_is_taken_apart_once(spark):
    df = spark.createDataFrame([("/bad 1 too_long  so",), (None,)], "t string").select(T.parse_command(F.col("t")).alias("c"))
    plan = df.select("c.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 3
    assert [tuple(r.c) for r in df.collect()] == [("bad", 1, "too_long", "so", None, None), (None, None, None, None, None, "reply_id_not_positive")]


def test_a_summary_reads_its_sources_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        read.add(1)
        return k

    rows = spark.createDataFrame([(f"k{i}", f"h{i}", "positive", "human", i) for i in range(5)], "source_key string, content_hash string, polarity string, source_type string, n long")
    none = spark.createDataFrame([], "source_key string, content_hash string")
    current = rows.withColumn("seq", counted("n")).withColumn("source_key", F.concat("source_key", F.col("seq").cast("string")))
    got = build.summary(current, none, none.select("content_hash")).first()
    spark.catalog.clearCache()
    assert (got.total, got.to_analyze, got.example_bank_count) == (5, 5, 5) and read.value == 5


CANDIDATES = "seq long, example_id string, contact_id long, incoming_text string, response_text string, source_type string, polarity string, created_at string"
QUERIES = "query_id long, text string, contact_id long"
NOW = dt.datetime(2024, 3, 1)


def test_only_candidates_within_reach_are_weighed(spark, monkeypatch):
    rows = [(i, f"e{i}", i % 3, f"word w{i}", "r", "fix" if i < 4 else "human", "positive", "") for i in range(200)]
    c, q = spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([(1, "word w150", 0)], QUERIES)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return "general"

    monkeypatch.setattr(T, "intent", lambda text: counted(text))
    got = sorted((r.rank, r.example_id) for r in retrieve.top_k(q, c, as_of=F.lit(NOW), k=3).collect())
    spark.catalog.clearCache()
    assert [e for _, e in got] == ["e3", "e0", "e2"] and seen.value < 50


def _brute(queries, rows, k):
    """top_k in Python, over ASCII texts."""
    first, toks = {}, lambda t: re.findall(r"[\w']+", (t or "").lower())
    for r in sorted(rows, key=lambda r: r[0]):
        if r[6] != "evaluation":
            first.setdefault(tuple(None if t is None else " ".join(t.lower().split()) for t in r[3:5]) + (r[6],), r)
    docs, words = list(first.values()), {}
    for r in docs:
        words.setdefault(r[0], []).extend(toks(r[3]))
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    weights = lambda ws: {w: ws.count(w) * (math.log((len(docs) + 1) / (df.get(w, 0) + 1)) + 1) for w in ws}
    rude = lambda t: None if t is None else any(m in t.lower() for m in T.PROFANITY)
    intent = lambda t: next((n for n, ws in T.INTENTS if set(ws) & set(toks(t))), "aggressive_or_teasing" if rude(t) else "question" if "?" in (t or "") else "business" if set(T.BUSINESS) & set(toks(t)) else "general")
    norm = lambda ws: math.sqrt(sum(x * x for x in ws.values()))
    out = []
    for qid, text, contact in queries:
        a, ranked = weights(toks(text)), []
        for s, e, c, t, _, kind, polarity, at in docs:
            b = weights(words[s])
            score = sum(x * b[w] for w, x in a.items() if w in b) / (norm(a) * norm(b)) if a and b else 0
            score += {"fix": 5, "human": 1}.get(kind, 0) + 0.25 * (polarity == "negative") + (0.25 / (1 + (NOW - dt.datetime.fromisoformat(at)).days / 30) if at else 0)
            score += 1.5 * (contact is not None and c == contact) + 0.5 * (rude(t) is not None and rude(t) == rude(text)) + 0.75 * (intent(t) == intent(text))
            ranked.append((round(score, 9), kind == "fix", at, e, -s))
        out += [(qid, n, r[3], round(r[0], 6)) for n, r in enumerate(sorted(ranked, reverse=True)[:k], 1)]
    return sorted(out)


def test_retrieval_against_brute_force(spark):
    """Few and many fixes, so that reach leaves much or little; texts without words and null, seqs that occur twice, contacts that are null."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "hello", "no", "fuck", "contract", "when?", "it's", "  "]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    queries = [(i, text(6), rng.choice([None, 0, 1, 2])) for i in range(12)]
    for kinds in ("fix rejected approved_ai human", "fix" + " human rejected" * 30, "human rejected"):
        rows = []
        for i in range(150):
            kind = rng.choice(kinds.split())
            rows.append((i - i % 25 // 24, f"e{i}", rng.choice([None, 0, 1, 2]), None if i % 40 == 7 else text(9), rng.choice("xy"), kind, {"rejected": "negative", "approved_ai": "evaluation"}.get(kind, "positive"), "" if i % 5 == 0 else f"2024-01-{i % 19 + 10}"))
        for k in (0, 3, 200):
            got = sorted(tuple(r) for r in retrieve.top_k(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CANDIDATES), as_of=F.lit(NOW), k=k).collect())
            spark.catalog.clearCache()
            want = _brute(queries, rows, k)
            assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_retrieval_by_ids_that_are_single(spark, monkeypatch):
    """Texts are read again by id: with few rows within reach and many, with all that is few broadcast and nothing, with words beyond Latin-1."""
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "hello", "fuck", "when?", "it's", "\u041f\u0440\u0438\u0432\u0435\u0442", "\u0153uvre", "na\u00efve", "\u00c9T\u00c9", "\u03b1\u03a3", "5\u00bd", " \t"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    queries = [(i, text(6), rng.choice([None, 0, 1, 2])) for i in range(8)]
    for kinds, few in (("fix" + " human rejected" * 30, 500_000), ("fix" + " human rejected" * 30, 1), ("human rejected approved_ai", 1)):
        monkeypatch.setattr(retrieve, "FEW", few)
        rows = []
        for i in range(200):
            kind = rng.choice(kinds.split())
            rows.append((i, f"e{i}", rng.choice([None, 0, 1, 2]), None if i % 40 == 7 else text(5), rng.choice("xy"), kind, {"rejected": "negative", "approved_ai": "evaluation"}.get(kind, "positive"), "" if i % 5 == 0 else f"2024-01-{i % 19 + 10}"))
        got = sorted(tuple(r) for r in retrieve.top_k(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, CANDIDATES), as_of=F.lit(NOW), k=3).collect())
        spark.catalog.clearCache()
        want = _brute(queries, rows, 3)
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_texts_stay_and_only_words_that_are_used_are_counted(spark, monkeypatch):
    rows = [(i, f"e{i}", i % 3, f"word w{i}" if i < 180 else "WORD  w1", "r", "fix" if i < 4 else "human", "positive", "") for i in range(200)]
    c, q = spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([(1, "word w150", 0)], QUERIES)
    real, seen = retrieve.frequencies, []
    monkeypatch.setattr(retrieve, "frequencies", lambda texts, only=None: seen.append((texts, only)) or real(texts, only))
    got = sorted((r.rank, r.example_id) for r in retrieve.top_k(q, c, as_of=F.lit(NOW), k=3).collect())
    (texts, only), n = seen[0], seen[0][0].count()
    top = texts._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    counted = {r.token: r.df for r in real(texts, only).collect()}
    spark.catalog.clearCache()
    assert [e for _, e in got] == ["e3", "e0", "e2"] and n == 180 and any("LeftAnti" in x and "rightHint=(strategy=broadcast)" in x for x in top)
    assert counted == {"word": 180, "w0": 1, "w1": 1, "w2": 1, "w3": 1, "w150": 1}


def test_words_by_table_and_by_pattern_are_the_same(spark):
    every = [f"a{chr(i)}B {chr(i)}" for i in range(256)] + [f"a{chr(i)}B {chr(i)}\u20ac" for i in range(0x250)] + ["\u0130x \u03b1\u03a3 5", None, "", " "]
    texts = spark.createDataFrame([(t,) for t in every], "incoming_text string").repartition(4)
    want = {r.token: r.n for r in texts.select(F.explode(F.array_distinct(T.tokens(F.col("incoming_text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    assert {r.token: r.df for r in retrieve.frequencies(texts).collect()} == want and len(want) > 500
    some = sorted(want)[::3]
    assert {r.token: r.df for r in retrieve.frequencies(texts).join(spark.createDataFrame([(t,) for t in some], "token string"), "token").collect()} == {t: want[t] for t in some}
    got = {r.token: r.df for r in retrieve.frequencies(texts, some).collect()}
    assert {t: got[t] for t in some} == {t: want[t] for t in some}
    assert all(chr(c).isspace() == (chr(c) in T.BLANKS) for c in range(sys.maxunicode))


def test_blanks_collapse_and_words_of_an_intent_are_found_once(spark):
    every = "".join(f"{chr(c)}a{chr(c)}{chr(c)}" for c in range(0x3010) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(t,) for t in (every, " a \n\t b  c ", "\u3000", "", None, "no\u00a0 \U0001f600")], "t string")
    assert df.where(~T.collapse(F.col("t")).eqNullSafe(T.strip(F.regexp_replace("t", f"{T.WS}+", " ")))).count() == 0
    plan = df.select(T.intent(F.col("t")).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_evidence_is_ranked_once_and_only_chosen_texts_move(spark, monkeypatch):
    top = spark.createDataFrame([(i, 1, f"doc-{i}", 1.0) for i in range(1, 9)], "query_id long, rank int, example_id string, score double")
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    monkeypatch.setattr(retrieve, "top_k", lambda *a, **k: top.withColumn("score", counted("score")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = catalogue.composed_prompt(spark, "/root/testdata/sf0.001").collect()
        ranked = read.value
        plan = catalogue._evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.catalog.clearCache()
    assert sum(r.selected_count for r in rows) > 0 and ranked == 8 and "SortMergeJoin" not in plan
