"""Settings, the command line, one instance, logs, live batches and review streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from dialoom import __main__ as cli
from dialoom import config
from dialoom.functions import text as T
from dialoom.operators import compose, feedback, review, spec
from dialoom.plans import jobs

BASE = {"OWNER_ID": "42", "CONTACT_ID": "7", "MODEL": "m"}


def test_settings(tmp_path):
    (tmp_path / ".env").write_text('# no\nOWNER_ID="1"\nCONTACT_ID = 7\nMODEL=\'m\'\nnonsense\nEXPORT_REDACT=off\n')
    s = config.Settings.load(tmp_path / ".env", {"OWNER_ID": "42", "MODEL_KEY": "secret"})
    assert (s.owner_id, s.contact_id, s.model, s.export_redact, s.export_limit) == (42, 7, "m", False, 500) and "secret" not in repr(s)
    for env, error in (({"CONTEXT_MESSAGES": "0"}, "greater than zero"), ({"EXPORT_LIMIT": "x"}, "must be a number"), ({"STYLE_ENABLED": "maybe"}, "true or false"), ({"MODEL": " "}, "missing setting: MODEL"), ({"REVIEW_ENABLED": "1"}, "REVIEW_TOKEN"), ({"REVIEW_ENABLED": "1", "REVIEW_TOKEN": "t"}, "REVIEWER_ID"), ({"REVIEW_ENABLED": "1", "REVIEW_TOKEN": "t", "REVIEWER_ID": "3", "REVIEW_CHAT_ID": "4"}, "must equal")):
        with pytest.raises(ValueError, match=error):
            config.Settings.load(tmp_path / "none", BASE | env)
    env = {"A": "kept"}
    (tmp_path / "e").write_text("A=1\nB=2\n")
    config.load_env(tmp_path / "e", env)
    assert env == {"A": "kept", "B": "2"}
    with pytest.raises(ValueError, match="missing files"):
        config.Settings.load(tmp_path / "none", BASE | {"BEHAVIOR_PATH": str(tmp_path / "no.md"), "STYLE_PATH": str(tmp_path)}).check_files()
    (tmp_path / "r.md").write_text("# X\na\n## How to Talk\nshort\nplain\n# Y\nb\n")
    assert config.behavior(tmp_path / "r.md", "how to talk") == "short\nplain" and "short" in compose.fallback_instructions("short") and config.behavior(tmp_path / "r.md", "none") == ""


def test_one_instance(tmp_path):
    with config.Instance(tmp_path):
        with pytest.raises(RuntimeError, match="already running"):
            config.Instance(tmp_path).__enter__()
    (tmp_path / "dialoom.lock").write_text("999999999")
    with config.Instance(tmp_path):
        assert (tmp_path / "dialoom.lock").read_text() == str(os.getpid())
    assert not (tmp_path / "dialoom.lock").exists()


def test_logs_hold_no_texts(tmp_path):
    log = config.logger(tmp_path / "l" / "x.log", "dialoom-test")
    log.info("sent reply_id=%s kind=%s", 5, "NetworkError")
    log.error("failed: %s", "a private message of two words")
    try:
        raise RuntimeError("private words here")
    except RuntimeError:
        log.exception("failed kind=%s", "RuntimeError")
    said = (tmp_path / "l" / "x.log").read_text()
    assert "reply_id=5" in said and "private" not in said and "kind=RuntimeError" in said


def test_error_categories(spark):
    names = ["RetryAfter", "TimedOutTimeout", "NetworkError", "Forbidden", "Unauthorized", "ConnectionError", "BadRequest"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.error_category(F.col("n"))).collect()]
    assert got == ["rate_limited", "timeout", "network", "authorization", "authorization", "api_error", "api_error"]


def test_callbacks(spark):
    made = spark.range(1).select(T.callback(F.lit("cat"), F.lit(5), F.lit("other")).alias("a"), T.callback(F.lit("good"), F.lit(5), F.lit(None).cast("string")).alias("b"), T.callback(F.lit("x" * 64), F.lit(5), F.lit("")).alias("c")).first()
    assert tuple(made) == ("cat:5:other", "good:5", None)
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(x,) for x in ("cat:5:a:b", "good:5", "good", "good:x", "good:²")], "t string").select(T.parse_callback(F.col("t")).alias("p")).collect()]
    assert got == [("cat", 5, "a:b"), ("good", 5, None), None, None, None]


def _events(spark, rows):
    return spark.createDataFrame([(1, i, s, p, t) for i, (s, p, t) in enumerate(rows)], "user_id long, event_id long, s long, payload string, text string").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_review_interactions(spark):
    known = spark.createDataFrame([(1,), (2,)], "id long")
    rows = [(0, "fix:1", None), (10, None, "/status"), (20, None, "  "), (30, None, "x" * 4001), (40, None, " so "), (50, None, "again"), (60, "cat:2:other", None), (60 + 900, None, "late"), (1000, "fix:9", None), (1001, "cat:1:nonsense", None), (1002, "fix:1", None), (1003, "cat:2:other", None), (1004, None, "why"), (1005, "fix:1", None), (1006, None, "/cancel"), (1007, None, "/cancel"), (1008, "no_reply:2", None), (1009, "bad:2", None), (1010, "cat:2:too_long", None), (1011, "fix:1", None), (1012, "cancel:1", None), (1013, None, "text")]
    got = [(r.outcome, r.reply_id, r.feedback_status, r.feedback_category, r.feedback_comment or r.corrected_reply_text) for r in review.interactions(_events(spark, rows), known).orderBy("event_id").collect()]
    none = (None, None, None)
    assert got == [("opened", 1, *none), ("needs_text", 1, *none), ("needs_text", 1, *none), ("too_long", 1, *none), ("saved", 1, "corrected", None, "so"), ("nothing_pending", None, *none), ("opened", 2, *none), ("expired", 2, *none), ("unavailable", 9, *none), ("unavailable", 1, *none), ("opened", 1, *none), ("opened", 2, *none), ("saved", 2, "rejected", "other", "why"), ("opened", 1, *none), ("cancelled", None, *none), ("nothing_pending", None, *none), ("saved", 2, "rejected", "should_not_reply", None), ("asked_reason", 2, *none), ("saved", 2, "rejected", "too_long", None), ("opened", 1, *none), ("cancelled", 1, *none), ("nothing_pending", None, *none)]


def test_cascade_and_lookup(spark):
    replies = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    pending = spark.createDataFrame([(9, 1), (8, 3)], "user_id long, reply_id long")
    assert [tuple(r) for r in feedback.cascade(pending, replies).collect()] == [(1, 9)] and feedback.point(replies, 2).first().t == "b"


def test_a_batch_is_recorded_before_it_counts_as_delivered(spark, tmp_path):
    rows = [(5, 1, 7, False, True, "hi", " hello ", None, True, False, None, 100), (5, 2, 7, False, True, "hi", "x", None, True, True, None, None), (5, 3, 8, False, True, "hi", "x", None, True, False, None, 1), (5, 4, 7, False, False, "hi", "x", None, True, False, None, 1), (5, 5, 7, True, True, "hi", "x", None, True, False, None, 1)]
    e = spark.createDataFrame(rows, "dialog_id long, id long, sender_id long, out boolean, is_private boolean, text string, reply string, reply_error string, stored boolean, replied boolean, send_error string, sent_message_id long")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(lambda df, k: jobs.answer(df, k, str(tmp_path / "log"), allowed_id=7)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    jobs.answer(e, 0, str(tmp_path / "log"), allowed_id=7)  # the batch is tried again
    jobs.answer(e, 1, str(tmp_path / "log"), allowed_id=7)  # and its events come again
    got = sorted((r.incoming_message_id, r.seq, r.kind, r.text, r.delivery_status, r.sent_message_id, r.notification_status) for r in jobs.read_log(spark, str(tmp_path / "log")).collect())
    assert got == [(1, 0, "created", "hello", None, None, None), (1, 1, "delivery", None, "sent", 100, None), (1, 2, "notification", None, None, None, "pending"), (2, 0, "created", "x", None, None, None), (2, 1, "delivery", None, "cancelled_manual", None, None)]


def test_a_stop_file_ends_a_stream(spark, tmp_path):
    q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    (tmp_path / "stop").write_text("")
    jobs.stop_when(q, str(tmp_path / "stop"), every=0.5)
    assert not q.isActive and not (tmp_path / "stop").exists()


def test_unknown_filters_and_sorts(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="no such filter"):
        spec.inbox_filter(df, colour="red")
    with pytest.raises(ValueError, match="no such sort"):
        spec.sorted_by(df, "-name", allowed={"id"})


def test_command_line(spark, tmp_path, capsys):
    r = spark.createDataFrame([("s1", "A", "hello!"), ("s1", "C", "how? why?")], "scenario string, variant string, text string")
    r.write.json(str(tmp_path / "r"))
    assert cli.main(["evaluate", str(tmp_path / "r"), str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["scenarios"] == 1 and spark.read.json(str(tmp_path / "out")).count() == 5
    line = {"example_id": "1", "dialog_id": 7, "context": [{"role": "user", "text": "q"}], "target_reply": "a", "source_message_ids": [1], "created_at": "", "is_human_authored": True}
    (tmp_path / "e.jsonl").write_text(json.dumps(line) + "\n")
    args = ["build", str(tmp_path / "e.jsonl"), str(tmp_path / "style")]
    assert cli.main([*args, "--dry-run"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["to_analyze"] == 1
    assert cli.main(args) == 1 and "needs an analyzer" in capsys.readouterr().err
    assert cli.main([*args, "--analyzer", "tests.test_live:analyze"]) == 0
    capsys.readouterr()
    assert cli.main(["inspect", str(tmp_path / "style")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["by_source"] == {"human": 1}
    assert cli.main([*args, "--status"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["unchanged"] == 1


def analyze(rows):
    import pandas as pd

    return pd.DataFrame({"text": ["Be brief"], "confidence": [0.8], "applicable_context": ["any"], "scope": ["global"], "behavior_category": ["length"], "supporting_source_hashes": [[]]})
