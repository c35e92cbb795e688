"""Incremental builds, exports and the bundle, from small sources."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.operators import build, feedback, style
from dialoom.plans import jobs
from dialoom.sources import files, tables

REPLY = "id long, dialog_id long, incoming_message_id long, sent_message_id long, created_at string, model string, prompt_version string, generated_reply_text string, context_json string, delivery_status string, feedback_status string, feedback_category string, feedback_comment string, corrected_reply_text string, feedback_updated_at string, incoming_message_text string, feedback_source string, feedback_trainer_user_id long"


def replies(spark, rows):
    return spark.createDataFrame([(i, 7, i * 10, i * 10 + 1, "2026-07-24T10:00:00+00:00", "m", "v1", text, context, "sent", status, category, None, fixed, None, incoming, source, None) for i, text, context, status, category, fixed, incoming, source in rows], REPLY)


def training(spark, path, rows):
    """A file of training examples: (example_id, incoming, reply)."""
    lines = [json.dumps({"example_id": e, "dialog_id": 7, "context": [{"role": "user", "text": q}], "target_reply": a, "source_message_ids": [int(e)], "created_at": "", "is_human_authored": True}) for e, q, a in rows]
    path.write_text("\n".join([*lines, "", "not json", '{"is_human_authored": false}']) + "\n", encoding="utf-8")
    return tables.training_jsonl(spark, str(path))


class Analyzer:
    """One rule an example, in batches whose sizes it writes down."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{len(rows)}\n")
        return pd.DataFrame({"text": "Reply briefly", "confidence": 0.7, "applicable_context": "any", "scope": "global", "behavior_category": "length", "supporting_source_hashes": [[h] for h in rows.content_hash]})

    def calls(self):
        try:
            return sorted(map(int, open(f"{self.folder}/calls").read().split()))
        except FileNotFoundError:
            return []


def scan(spark, tmp_path, rows, feedback_rows=()):
    human = style.from_training(training(spark, tmp_path / "examples.jsonl", rows))
    return build.sources(human, style.from_feedback(replies(spark, feedback_rows)))[0].drop("conflicts")


def test_builds_go_on_from_what_is_known(spark, tmp_path):
    root, a = str(tmp_path / "style"), Analyzer(tmp_path)
    run = lambda rows, **k: build.build(spark, scan(spark, tmp_path, rows), root, a, fingerprint=k.pop("fingerprint", "f"), batch_size=2, **k)
    one, two, three = ("1", "one", "reply one"), ("2", "two", "reply two"), ("3", "three", "reply three")
    assert build.status(spark, root, scan(spark, tmp_path, [one]), "f") == {"built": False}
    first = run([one, two, three])
    assert (first["build_mode"], first["new"], first["batches"], a.calls()) == ("full", 3, 2, [1, 2])
    b = build.load_bundle(spark, root)
    (rule,) = b.rules.collect()
    # Three sources of one rule: 0.7 and twice 0.03.
    assert (rule.evidence_count, rule.confidence, rule.source_type) == (3, 0.76, "human") and b.examples.count() == 3 and b.overrides == ""
    assert build.rules_text(b.rules).first().markdown == "# Rules\n\n- Reply briefly\n" and build.contact_rules(b.rules).count() == 0

    # Nothing changed: no call, and the manifest says so.
    again = run([one, two, three])
    assert (again["build_mode"], again["build_id"]) == ("no_op", first["build_id"]) and a.calls() == [1, 2] and jobs.manifest(spark, root)["last_mode"] == "no_op"
    # A source is added, another changed, a third goes: one analysis for each new content.
    delta = run([one, ("2", "two", "other reply"), ("4", "four", "reply four")])
    assert (delta["build_mode"], delta["unchanged"], delta["new"], delta["modified"], delta["deleted"]) == ("incremental", 1, 1, 1, 1) and a.calls() == [1, 2, 2]
    # What was known before costs nothing when it comes back.
    back = run([one, two, three])
    assert (back["to_analyze"], back["reusable"]) == (0, 2) and a.calls() == [1, 2, 2] and build.load(spark, root).hashes.count() == 5
    assert build.vacuum(build.load(spark, root), scan(spark, tmp_path, [one])).count() == 1
    # The same content under another key is analysed once.
    twin = run([one, two, three, ("5", "one", "reply one")])
    assert (twin["new"], twin["to_analyze"]) == (1, 0)

    plan = run([one], dry_run=True)
    assert (plan["build_mode"], plan["deleted"]) == ("dry_run", 3)
    with pytest.raises(ValueError, match="configuration has changed"):
        run([one], fingerprint="other")
    assert build.status(spark, root, scan(spark, tmp_path, [one]), "other")["compatible"] is False
    with pytest.raises(ValueError, match="resynthesis"):
        run([one], resynthesize=True)
    same = run([one, two, three, ("5", "one", "reply one")], resynthesize=True)
    assert same["to_analyze"] == 0 and same["build_id"] != twin["build_id"]
    full = run([one], full=True, fingerprint="other")
    assert (full["build_mode"], full["to_analyze"]) == ("full", 1)
    with pytest.raises(ValueError, match="incremental builds are off"):
        run([one], incremental=False)


def test_a_failed_build_leaves_the_published_one(spark, tmp_path):
    root, a = str(tmp_path / "style"), Analyzer(tmp_path)
    build.build(spark, scan(spark, tmp_path, [("1", "one", "r")]), root, a, fingerprint="f")
    before = files.read_text(spark, f"{root}/CURRENT")
    kept = {p.name for p in (tmp_path / "style").iterdir()}

    def fails(rows):
        return pd.DataFrame()

    with pytest.raises(Exception, match="gave no rules"):
        build.build(spark, scan(spark, tmp_path, [("1", "one", "r"), ("2", "two", "s")]), root, fails, fingerprint="f")
    assert files.read_text(spark, f"{root}/CURRENT") == before and {p.name for p in (tmp_path / "style").iterdir()} == kept
    with pytest.raises(ValueError, match="needs an analyzer"):
        build.build(spark, scan(spark, tmp_path, [("2", "two", "s")]), root, None, fingerprint="f")
    with pytest.raises(ValueError, match="no qualifying examples"):
        build.build(spark, scan(spark, tmp_path, []), root, a, fingerprint="f")
    with pytest.raises(ValueError, match="no bundle"):
        build.load_bundle(spark, str(tmp_path / "nowhere"))


def test_approved_replies_are_never_positive_evidence(spark, tmp_path):
    rows = [(1, "ai said", "[]", "approved", None, None, "q1", None), (2, "bad", "[]", "rejected", None, None, "q2", None), (3, "poor", "[]", "corrected", None, "better", "q3", None), (4, "no", "[]", "rejected", "should_not_reply", None, "", None)]
    a = Analyzer(tmp_path)
    got = build.build(spark, scan(spark, tmp_path, [("1", "one", "r")], rows), str(tmp_path / "s"), a, fingerprint="f")
    assert (got["approved_ai_evaluation_count"], got["fix_example_count"], got["negative_example_count"], got["human_example_count"]) == (1, 1, 1, 1) and sum(a.calls()) == 3
    rules = build.load_bundle(spark, str(tmp_path / "s")).rules.collect()
    keys = {k for r in rules if r.polarity == "positive" for k in r.supporting_source_keys}
    assert keys == {"feedback:3:fix", "dialog:7:1"}


def test_hash_counts_normal_texts_of_the_context(spark):
    rows = [(1, "x", '[{"role":"user","text":"e\\u0301  a \\r\\nb "}]', "approved", None, None, "", None), (2, "x", '[{"role":"user","text":"\\u00e9 a\\nb"}]', "approved", None, None, "", None), (3, "x", '[{"role":"user","text":"e a\\nb"}]', "approved", None, None, "", None)]
    got = {r.feedback_id: r for r in style.canonicalize(style.from_feedback(replies(spark, rows))).collect()}
    assert got[1].content_hash == got[2].content_hash != got[3].content_hash and got[1].incoming_text == "é a\nb"
    assert got[1].created_at == "2026-07-24T10:00:00+00:00"


def test_lines_of_training_examples(spark, tmp_path):
    rows = training(spark, tmp_path / "e.jsonl", [(str(i), f"q{i}", f"a{i}") for i in range(4)])
    kept, bad = tables.first_valid(rows, 2)
    assert sorted(r.example_id for r in kept.collect()) == ["0", "1"] and bad == 0
    kept, bad = tables.first_valid(rows, 50)
    assert kept.count() == 4 and bad == 2
    (tmp_path / "one.jsonl").write_text('{"context":[{"role":"user","text":"q"}],"target_reply":"a b","is_human_authored":true}\n')
    (e,) = style.from_training(tables.training_jsonl(spark, str(tmp_path / "one.jsonl")), contact_id=9).collect()
    assert (e.source_key, e.example_id, e.response_text) == ("dialog:9:line-1", "human-1", "a b")
    (tmp_path / "bank.jsonl").write_text('{"example_id":"1"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        tables.example_bank(spark, str(tmp_path / "bank.jsonl"), "example_id string").collect()


def test_feedback_export(spark, tmp_path):
    turns = '[{"role":"user","text":"mail a@b.org"},{"role":"assistant","text":"ok"}]'
    rows = [(1, "call +380 67 123 45 67", turns, "approved", None, None, "q", None), (2, "see https://x.org/?a=1", "[]", "rejected", "too_long", None, "q", "trainer_bot"), (3, "old", "[]", "corrected", None, "new sk-abcdefghijklmnop", "q", ""), (4, "unseen", "no json", "unreviewed", None, None, "q", None)]
    jobs.export_feedback(replies(spark, rows), str(tmp_path / "x"))
    read = lambda part: {r.reply_id: r for r in spark.read.json(str(tmp_path / "x" / part)).collect()}
    every, positive, negative = read("reviewed"), read("positive"), read("negative")
    assert set(every) == {1, 2, 3} and set(positive) == {1, 3} and set(negative) == {2}
    assert every[1].context[0].text == "mail <EMAIL>" and positive[3].target_reply == "new <SECRET>" and every[3].feedback_source == "saved_messages"
    (s,) = spark.read.json(str(tmp_path / "x" / "summary")).collect()
    assert (s.reviewed_replies, s.positive_examples, s.negative_examples, s.corrected_examples, s.redacted_email, s.redacted_url, s.redacted_phone, s.redacted_secret) == (3, 2, 1, 1, 1, 1, 1, 1)
    first = (tmp_path / "x" / "reviewed").glob("part-*.json")
    line = next(x for p in first for x in p.read_text().splitlines())
    assert list(json.loads(line)) == sorted(json.loads(line)) and '"feedback_comment":null' in line
    bad = replies(spark, [(1, "x", "not json", "approved", None, None, "q", None)])
    with pytest.raises(Exception, match="unreadable context"):
        feedback.export_rows(bad).collect()


def test_training_export(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    history = tables.messages(tables.table(spark, d, "conversations"))
    jobs.export_training(history, str(tmp_path / "t"), limit=3)
    raw, cleaned = (spark.read.json(str(tmp_path / "t" / x)) for x in ("raw", "cleaned"))
    summary = spark.read.json(str(tmp_path / "t" / "summary"))
    assert raw.groupBy("dialog_id").count().agg(F.max("count")).first()[0] <= 3
    total = summary.agg(F.sum("examples_exported"), F.sum("examples_removed")).first()
    assert total[0] == cleaned.count() and total[0] + total[1] == raw.count() and total[0] > 0
    back = style.from_training(tables.training_jsonl(spark, str(tmp_path / "t" / "cleaned")))
    assert back.count() == cleaned.count() and back.where("source_key not like 'dialog:%:%'").count() == 0


def test_codecs(spark):
    df = spark.createDataFrame([('{"example_id":"e","incoming_text":"q","response_text":"a","source_type":"fix","polarity":"positive","contact_id":"12x","feedback_id":" 5 ","context":[{"role":"user"},3]}',), ('{"example_id":"e"}',), ("broken",)], "v string")
    got = [r.e for r in df.select(C.decode_example(F.col("v")).alias("e")).collect()]
    assert (got[0].contact_id, got[0].feedback_id, [tuple(t) for t in got[0].context]) == (0, 5, [("", "user", "")]) and got[1:] == [None, None]
    rules = spark.createDataFrame([('[{"text":"a","confidence":"strong"},{"text":""},4]',), ('{"text":"a"}',)], "v string").select(C.decode_rules(F.col("v")).alias("r")).collect()
    assert [(r.text, r.confidence, r.scope) for r in rules[0].r] == [("a", 0.9, "global")] and rules[1].r is None


def test_files(spark, tmp_path):
    at = str(tmp_path / "f" / "x")
    files.replace_text(spark, at, "öne")
    files.replace_text(spark, at, "twö")
    assert files.read_text(spark, at) == "twö" and files.read_text(spark, at + "y") is None
    found = files.artifacts(spark, str(tmp_path / "f")).where("path = 'x'")
    state = spark.createDataFrame([("x", b"state"), ("z", b"only")], "path string, content binary")
    assert {r.path: bytes(r.content).decode() for r in files.overlay(state, found).collect()} == {"x": "state", "z": "only"}
    with pytest.raises(ValueError, match="missing artifacts.*q"):
        files.require(found, ["x", "q"])
    md = spark.createDataFrame(list(enumerate(["# A", "one", "## B ", "two", "three", "# C", "four"])), "line_no int, value string")
    assert [r.value for r in files.section(md, "b").orderBy("line_no").collect()] == ["two", "three"]
