"""Style compiler: canonical examples with content hashes, change plans, merged rules, statistics."""

from __future__ import annotations

import hashlib
import json

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.functions import text as T

PRIORITIES = {"fix": 100, "human": 80, "should_not_reply": 60, "rejected": 50, "approved_ai": 0}


def priority(source_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])[source_type], F.lit(10))


def from_feedback(replies: DataFrame, *, contact_id: int | None = None) -> DataFrame:
    """Style examples of reviewed replies. Approved replies of the machine are for evaluation only, never positive evidence.

    An empty incoming text falls back to the last of the other one's in the stored context; a row without either goes, as do other contacts' where one is given.
    """
    fix = (F.col("feedback_status") == "corrected") & (F.coalesce("corrected_reply_text", F.lit("")) != "")
    no = F.col("feedback_status") == "rejected"
    kind = F.when(fix, "fix").when(no & F.coalesce(F.col("feedback_category") == "should_not_reply", F.lit(False)), "should_not_reply").when(no, "rejected").when(F.col("feedback_status") == "approved", "approved_ai")
    some = replies if contact_id is None else replies.where(F.col("dialog_id") == contact_id)
    got = some.withColumn("source_type", kind).where("source_type is not null").withColumn("context", C.decode_context(F.col("context_json")))
    got = got.withColumn("incoming_text", F.coalesce(F.nullif("incoming_message_text", F.lit("")), C.last_user_text(F.col("context")))).where("incoming_text <> ''")
    return got.select(
        F.concat(F.lit("feedback-"), "id").alias("example_id"), F.col("dialog_id").alias("contact_id"), "incoming_text",
        F.when(F.col("source_type") == "fix", F.col("corrected_reply_text")).otherwise(F.col("generated_reply_text")).alias("response_text"),
        "source_type", F.when(F.col("source_type") == "fix", "positive").when(F.col("source_type") == "approved_ai", "evaluation").otherwise("negative").alias("polarity"),
        F.coalesce(F.nullif("feedback_updated_at", F.lit("")), "created_at").alias("created_at"), F.col("id").alias("feedback_id"), "context",
        F.when(F.col("source_type") == "fix", "human_fix").otherwise("ai_generated").alias("provenance"), "feedback_status", F.coalesce("feedback_category", F.lit("")).alias("feedback_category"),
        F.concat_ws(":", F.lit("feedback"), "id", F.when(F.col("source_type") == "approved_ai", "good").otherwise(F.col("source_type"))).alias("source_key"), F.col("id").alias("seq"),
    )


def from_training(examples: DataFrame, *, contact_id: int = 0) -> DataFrame:
    """Style examples of a person's own replies; the incoming text is the last turn of the other one.

    examples: as sources.tables.training_jsonl reads them, of which those not valid go, or as operators.extract makes them. A source is known by its message ids, else by
    its example id, else by its line.
    """
    line = F.col("line_no").cast("string") if "line_no" in examples.columns else F.col("seq").cast("string")
    rows = examples.where("valid") if "valid" in examples.columns else examples
    got = rows.withColumn("context", C.normalize_context(_with_provenance(rows))).withColumn("__line", line).withColumn("dialog_id", F.coalesce("dialog_id", F.lit(contact_id)))
    got = got.withColumn("incoming_text", C.last_user_text(F.col("context"))).withColumn("response_text", T.strip(F.coalesce("target_reply", F.lit(""))))
    ids = F.array_join(F.col("source_message_ids").cast("array<string>"), ",")
    identity = F.when(F.size("source_message_ids") > 0, ids).otherwise(F.coalesce("example_id", F.concat(F.lit("line-"), "__line")))
    return got.where("incoming_text <> '' and response_text <> ''").select(
        F.coalesce("example_id", F.concat(F.lit("human-"), "__line")).alias("example_id"), F.col("dialog_id").alias("contact_id"), "incoming_text", "response_text", F.lit("human").alias("source_type"),
        F.lit("positive").alias("polarity"), F.coalesce("created_at", F.lit("")).alias("created_at"), F.lit(None).cast("long").alias("feedback_id"), "context", F.lit("human").alias("provenance"),
        F.lit("").alias("feedback_status"), F.lit("").alias("feedback_category"), F.concat_ws(":", F.lit("dialog"), "dialog_id", identity).alias("source_key"), F.col("__line").cast("long").alias("seq"),
    )


def _with_provenance(rows: DataFrame) -> Column:
    turn = rows.schema["context"].dataType.elementType
    if "provenance" in turn.names:
        return F.col("context")
    return F.transform("context", lambda t: F.when(t.isNotNull(), F.struct(F.lit("").alias("provenance"), t["role"].alias("role"), t["text"].alias("text"))))


def canonicalize(examples: DataFrame) -> DataFrame:
    """Canonical texts, those of the context too, and content_hash: SHA-256 of the fields' JSON, keys sorted; ids and times don't count."""
    text = lambda c: T.canonical(T.nfc(F.coalesce(F.col(c), F.lit(""))))
    c = examples.withColumn("incoming_text", text("incoming_text")).withColumn("response_text", text("response_text"))
    if "context" in examples.columns:
        # Composed in one pass over the turns' texts, then put back in their places.
        composed = T.nfc_all(F.transform("context", lambda t: t["text"]))
        c = c.withColumn("__texts", composed).withColumn("context", F.transform("context", lambda t, i: F.struct(t["provenance"].alias("provenance"), t["role"].alias("role"), T.canonical(F.get("__texts", i)).alias("text")))).drop("__texts")
    else:
        c = c.withColumn("context", F.array().cast(f"array<{C.TURN}>"))
    fields = F.struct("contact_id", "context", "feedback_category", "feedback_status", F.col("incoming_text"), "polarity", "provenance", "source_type", F.col("response_text").alias("target_reply"))
    return c.withColumn("content_hash", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))


def scan(examples: DataFrame) -> DataFrame:
    """The first example of each source_key by (src_ord, seq), with conflicts: how many later ones differ in content."""
    w = Window.partitionBy("source_key").orderBy("src_ord", "seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differs = (F.col("content_hash") != F.first("content_hash").over(whole)).cast("long")
    return examples.withColumn("__at", F.row_number().over(w)).withColumn("__d", differs).withColumn("conflicts", F.sum("__d").over(whole)).where("__at = 1").drop("__at", "__d")


def diff(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(source_key, change_type, content_hash): unchanged, modified, new or deleted, by a full outer join on the key."""
    a, b = current.select("source_key", F.col("content_hash").alias("a")), cached.select("source_key", F.col("content_hash").alias("b"))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return a.join(b, "source_key", "full_outer").select("source_key", kind.alias("change_type"), F.coalesce("a", "b").alias("content_hash"))


def pending_hashes(current: DataFrame, cached: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """(source_key, content_hash, phase, seq, reuse, analyze): new sources (phase 0), then modified ones, in order; current has source_key, content_hash, polarity and seq.

    reuse: an earlier row, or an analysis that is kept, has the same content. analyze: this row stands for its content. Evaluation rows are never
    analysed; an earlier one makes later rows of its content reuse, though nothing was analysed for them.
    """
    changed = diff(current, cached).where("change_type in ('new', 'modified')").select("source_key", F.when(F.col("change_type") == "new", 0).otherwise(1).alias("phase"))
    known = known_hashes.select("content_hash").distinct().withColumn("__known", F.lit(True))
    rows = current.select("source_key", "content_hash", "polarity", "seq").join(changed, "source_key").join(known, "content_hash", "left")
    at = F.row_number().over(Window.partitionBy("content_hash").orderBy("phase", "seq", "source_key"))
    return rows.withColumn("reuse", F.coalesce("__known", F.lit(False)) | (at > 1)).select("source_key", "content_hash", "phase", "seq", "reuse", (~F.col("reuse") & (F.col("polarity") != "evaluation")).alias("analyze"))


def to_analyze(current: DataFrame, cached: DataFrame, known_hashes: DataFrame, *, batch_size: int = 50) -> DataFrame:
    """(content_hash, source_key, batch_number): hashes of changed sources without an analysis; new sources first, then modified ones."""
    return batched(pending_hashes(current, cached, known_hashes).where("analyze"), ["phase", "seq", "source_key"], batch_size).select("content_hash", "source_key", "batch_number")


def batched(rows: DataFrame, order: list[str], batch_size: int) -> DataFrame:
    """Adds batch_number, from 1, over the rows in order. Rows are sorted over all tasks and counted by task, so that no task sees all of them.

    Counting and numbering must see the same tasks, which two sorts needn't have: the sorted rows stay on the executors' disks until the session's cache is cleared.
    """
    sorted_rows = rows.orderBy(*order).withColumn("__task", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    sizes = sorted_rows.groupBy("__task").agg(F.count("*").alias("__n"))
    # One row a task.
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).select("__task", "__start")
    within = F.col("__id") - F.shiftleft(F.col("__task").cast("long"), 33)
    placed = sorted_rows.join(F.broadcast(starts), "__task").withColumn("batch_number", F.floor((F.col("__start") + within) / batch_size) + 1)
    return placed.drop("__task", "__id", "__start")


def plan_summary(current: DataFrame, cached: DataFrame, known_hashes: DataFrame, *, batch_size: int = 50) -> DataFrame:
    """One row: sources by change, rows whose analysis is reused, hashes to analyse, batches that they make, and whether an analyzer is needed."""
    changes = diff(current, cached)
    n = lambda t: F.count_if(F.col("change_type") == t).alias(t)
    kinds = changes.agg(F.count_if(F.col("change_type") != "deleted").alias("total"), *[n(t) for t in ("unchanged", "new", "modified", "deleted")])
    work = pending_hashes(current, cached, known_hashes).agg(F.count_if("reuse").alias("reusable"), F.count_if("analyze").alias("to_analyze"))
    both = kinds.crossJoin(work)  # one row each
    return both.withColumn("batches", F.ceil(F.col("to_analyze") / batch_size)).withColumn("analyzer_needed", F.col("to_analyze") > 0)


def fingerprint(**config) -> str:
    """SHA-256 of an analysis configuration; another value asks for a full rebuild."""
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def match_observations(examples: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of a batch for each of its examples: those without hashes or with the example's; if none match, all."""
    o = observations.withColumnRenamed("batch_number", "__b")
    fits = (F.size("supporting_source_hashes") == 0) | F.array_contains("supporting_source_hashes", F.col("content_hash"))
    both = examples.join(o, F.col("batch_number") == F.col("__b")).withColumn("__fits", F.coalesce(fits, F.lit(True)))
    return both.withColumn("__any", F.max("__fits").over(Window.partitionBy("source_key"))).where("__fits or not __any").drop("__fits", "__any", "__b")


def bind(rules: DataFrame) -> DataFrame:
    """Rules with the evidence of their own example: key, hash, polarity, source type and priority are the example's."""
    identity = F.concat_ws("|", "behavior_category", T.collapse(F.lower("text")), "applicable_context", "scope", "content_hash")
    return rules.select(
        "text", "confidence", "applicable_context", "scope", "behavior_category", "polarity", "source_type", "seq", F.substring(F.sha2(identity, 256), 1, 24).alias("observation_id"),
        F.array("source_key").alias("supporting_source_keys"), F.array("content_hash").alias("supporting_source_hashes"), F.lit(1).cast("long").alias("evidence_count"), priority(F.col("source_type")).alias("source_priority"),
    )


def merge(rules: DataFrame) -> DataFrame:
    """Equivalent rules as one: evidence united, confidence up by 0.03 for each further source to 0.99 at most; other fields of the first by seq."""
    low = lambda c: F.lower(T.strip(F.col(c)))
    keyed = rules.select("*", low("behavior_category").alias("k1"), T.collapse(F.lower("text")).alias("k2"), low("applicable_context").alias("k3"), low("scope").alias("k4"), low("polarity").alias("k5"))
    keys = ["k1", "k2", "k3", "k4", "k5"]
    got = keyed.groupBy(*keys).agg(
        F.min_by(F.struct("text", "applicable_context", "scope", "behavior_category", "polarity"), "seq").alias("first"), F.max("confidence").alias("__c"),
        F.when(F.count_distinct("source_type") == 1, F.min("source_type")).otherwise("mixed").alias("source_type"), F.max("source_priority").alias("source_priority"),
    )
    # Evidence is made distinct by a shuffle of its own, each key on its own, so that copies of it never meet in one row.
    united = lambda c, n: keyed.select(*keys, F.explode(c).alias(c)).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias(c), F.count("*").alias(n))
    got = got.join(united("supporting_source_keys", "__n"), keys, "left").join(united("supporting_source_hashes", "__h"), keys, "left")
    n = F.coalesce("__n", F.lit(0))
    none = F.array().cast("array<string>")
    return got.select(
        F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 24).alias("observation_id"), "first.*", "source_type", "source_priority",
        F.round(F.least(F.lit(0.99), F.col("__c") + 0.03 * F.greatest(n - 1, F.lit(0))), 4).alias("confidence"), n.cast("long").alias("evidence_count"),
        F.coalesce("supporting_source_keys", none).alias("supporting_source_keys"), F.coalesce("supporting_source_hashes", none).alias("supporting_source_hashes"),
    )


def merged_in_order(rules: DataFrame) -> DataFrame:
    """Merged rules in the order in which a bundle lists them."""
    low = lambda c: F.lower(T.strip(F.col(c)))
    return merge(rules).orderBy(low("behavior_category"), T.collapse(F.lower("text")), low("applicable_context"), low("scope"), low("polarity"))


def statistics(examples: DataFrame) -> DataFrame:
    """Figures of each contact's positive examples; contacts without any have zeros. Ratios are rounded half to even in decimal."""
    yes = F.col("polarity") == "positive"
    r = F.col("response_text")
    ratio = lambda c: F.coalesce(F.bround(F.avg(F.when(yes, c.cast("int"))), 3), F.lit(0.0))
    return examples.groupBy("contact_id").agg(
        F.count_if(yes).alias("positive_example_count"), F.count("*").alias("evidence_count"), F.coalesce(F.bround(F.avg(F.when(yes, F.length(r))), 2), F.lit(0.0)).alias("average_response_chars"),
        ratio(r.rlike(r"^\p{Ll}")).alias("lowercase_start_ratio"), ratio(F.endswith(F.regexp_replace(r, f"{T.WS}+$", ""), F.lit("."))).alias("final_period_ratio"),
        ratio(F.contains(r, F.lit("?"))).alias("question_ratio"), ratio(F.contains(r, F.lit("!"))).alias("exclamation_ratio"),
    )


def source_counts(examples: DataFrame) -> DataFrame:
    """(contact_id, source_type, n) of the positive examples."""
    return examples.where("polarity = 'positive'").groupBy("contact_id", "source_type").agg(F.count("*").alias("n"))
