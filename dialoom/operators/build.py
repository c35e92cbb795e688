"""Incremental compilation: what changed, what must be analysed, and what a build makes of it. Analyses are kept by content and never lost."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.operators import clean, style
from dialoom.sources import files

SCHEMA_VERSION = "1"
RULE = "text string, confidence double, applicable_context string, scope string, behavior_category string, supporting_source_hashes array<string>"
#: A template is what an analysis says of a content, before it is bound to a source.
TEMPLATE = f"content_hash string, {RULE}, seq long"
#: An analyzer takes the examples of one batch as a pandas frame and gives rules (RULE).
Analyzer = Callable


@dataclass
class State:
    """The tables of the last build and its manifest."""

    sources: DataFrame  # source_key, content_hash
    templates: DataFrame  # TEMPLATE
    hashes: DataFrame  # content_hash: analysed, or in need of none
    manifest: dict


def sources(human: DataFrame, feedback: DataFrame) -> tuple[DataFrame, Column]:
    """Feedback before a person's own replies, canonical, the first of each source; and how many others of a source differ (to be summed over them)."""
    both = clean.union_ordered(feedback, human)
    return style.scan(style.canonicalize(both)), F.coalesce(F.sum("conflicts"), F.lit(0))


def gate(state: State | None, fingerprint: str, *, full: bool = False) -> State | None:
    """The state that a build goes on from: none for a full one; an error where the analysis has another configuration than the state's."""
    if full or state is None:
        return None
    if state.manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("the state has another schema: rebuild in full")
    if state.manifest.get("fingerprint") != fingerprint:
        raise ValueError("the analysis configuration has changed: rebuild in full")
    return state


def analyze(examples: DataFrame, work: DataFrame, analyzer: Analyzer) -> DataFrame:
    """TEMPLATE rows of the contents in work (content_hash, source_key, batch_number): each batch is one call of the analyzer.

    A rule without hashes, or with a content's, is that content's; a content that no rule of its batch fits gets all of them. A batch without rules is an error.
    """
    columns = ["batch_number", "content_hash", "incoming_text", "response_text", "source_type", "polarity", "contact_id"]
    batch = work.join(examples, ["source_key", "content_hash"]).select(*columns)

    def call(key, rows):
        got = analyzer(rows.sort_values("content_hash"))
        if not len(got):
            raise ValueError(f"the analysis of batch {key[0]} gave no rules")
        got = got.reset_index(drop=True)
        return got.assign(batch_number=key[0], seq=got.index)[["batch_number", *[c.split()[0] for c in RULE.split(", ")], "seq"]]

    observed = batch.groupBy("batch_number").applyInPandas(call, f"batch_number long, {RULE}, seq long")
    matched = style.match_observations(batch.select("batch_number", "content_hash", F.col("content_hash").alias("source_key")), observed)
    return matched.select(*[c.split()[0] for c in TEMPLATE.split(", ")])


def retained(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Templates of the state and of this build, the new ones of a content in place of the old; old ones never go, so that a text that comes back is free."""
    if old is None:
        return new
    return old.join(new.select("content_hash").distinct(), "content_hash", "left_anti").unionByName(new)


def bound(current: DataFrame, templates: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rules of each source: its content's templates, with the source's own key, hash, polarity and type. A content without an analysis is an error."""
    lost = current.where("polarity <> 'evaluation'").join(hashes, "content_hash", "left_anti").select("content_hash").limit(1).collect()
    if lost:
        raise ValueError(f"no analysis is kept of content {lost[0][0][:12]}")
    own = current.where("polarity <> 'evaluation'").select("source_key", "content_hash", "polarity", "source_type", F.col("seq").alias("__seq"))
    rules = templates.drop("supporting_source_hashes").join(own, "content_hash")
    # Rules keep the order of sources, then of the analysis; a window over all rules isn't needed for a key that sorts that way.
    return style.bind(rules.withColumn("seq", F.struct(F.col("source_key").alias("k"), F.col("seq").alias("s"))))


def summary(current: DataFrame, cached: DataFrame, known: DataFrame, **facts) -> DataFrame:
    """One row: sources by change, by type and by polarity, contents, and the facts of the build (names to literals).

    The columns of the sources that count stay on the executors' disks until the session's cache is cleared.
    """
    # Read by every part below, and dear where it is a scan.
    current = current.select("source_key", "content_hash", "polarity", "source_type", "seq").persist(StorageLevel.DISK_ONLY)
    plan = style.plan_summary(current, cached, known)
    by = lambda c, v: F.count_if(F.col(c) == v)
    kinds = current.agg(
        F.count_distinct("content_hash").alias("example_bank_count"), by("source_type", "human").alias("human_example_count"), by("source_type", "fix").alias("fix_example_count"),
        by("polarity", "negative").alias("negative_example_count"), by("source_type", "approved_ai").alias("approved_ai_evaluation_count"),
    )
    prior = cached.agg(F.count("*").alias("prior_source_count"))
    whole = plan.crossJoin(kinds).crossJoin(prior)  # one row each
    return whole.withColumn("analyses_reused", F.col("unchanged") + F.col("reusable")).withColumns({k: F.lit(v) for k, v in facts.items()})


def usage(calls: DataFrame) -> DataFrame:
    """Tokens that an analyzer's calls (input_tokens, output_tokens) used in all; null for good once any call doesn't say."""
    whole = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.coalesce(F.sum(c), F.lit(0))).alias(c)
    return calls.agg(F.count("*").alias("requests"), whole("input_tokens"), whole("output_tokens"))


def load(spark: SparkSession, root: str) -> State | None:
    """The state of the published build below root; none if there is none."""
    text = files.read_text(spark, f"{root}/CURRENT")
    if text is None:
        return None
    m = json.loads(text)
    at = f"{root}/build={m['build']}"
    return State(*[spark.read.parquet(f"{at}/{t}") for t in ("sources", "templates", "hashes")], m)


def _statistics(current: DataFrame) -> DataFrame:
    counts = style.source_counts(current).groupBy("contact_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_counts"))
    return style.statistics(current).join(counts, "contact_id", "left")


def build(spark: SparkSession, current: DataFrame, root: str, analyzer: Analyzer | None, *, fingerprint: str, batch_size: int = 50, full: bool = False, dry_run: bool = False, resynthesize: bool = False, incremental: bool = True, as_of: str = "", conflicts: int = 0) -> dict:
    """One build over the scanned sources; its summary. Modes: dry_run (plans only), no_op (nothing changed), incremental, full.

    Everything is written below a new folder; then one manifest moves into place. A failed build leaves the published one as it was. resynthesize merges
    the kept analyses again although nothing changed, and is an error if something did.
    """
    if batch_size <= 0:
        raise ValueError("the batch size must be positive")
    if not incremental and not full:
        raise ValueError("incremental builds are off: ask for a full one")
    before = load(spark, root)
    state = gate(before, fingerprint, full=full)
    none = lambda schema: spark.createDataFrame([], schema)
    cached = state.sources if state else none("source_key string, content_hash string")
    known = state.hashes if state else none("content_hash string")
    build_id = uuid.uuid4().hex
    at = f"{root}/build={build_id}"
    # The scan is written once: plan, analysis, binding and the bank read it from there.
    current.write.parquet(f"{at}/examples")
    try:
        return _build(spark, spark.read.parquet(f"{at}/examples"), root, at, build_id, analyzer, before, state, cached, known, fingerprint, batch_size, full, dry_run, resynthesize, as_of, conflicts)
    except BaseException:
        files.remove(spark, at)
        raise


def _build(spark, current, root, at, build_id, analyzer, before, state, cached, known, fingerprint, batch_size, full, dry_run, resynthesize, as_of, conflicts) -> dict:
    if not current.take(1):
        raise ValueError("no qualifying examples: export training data first")
    mode = "full" if full or before is None else "incremental"
    facts = {"build_mode": mode, "build_id": build_id, "previous_build": before.manifest["build"] if before else "", "fingerprint": fingerprint, "invalid_sources": conflicts, "built_at": as_of}
    row = summary(current, cached, known, **facts).withColumn("batches", F.ceil(F.col("to_analyze") / batch_size)).first().asDict()
    changed = row["new"] or row["modified"] or row["deleted"] or full
    if dry_run:
        files.remove(spark, at)
        return {**row, "build_mode": "dry_run", "build_id": row["previous_build"]}
    if resynthesize and changed:
        raise ValueError("resynthesis needs sources as they were built")
    if not changed and not resynthesize:
        files.remove(spark, at)
        files.replace_text(spark, f"{root}/CURRENT", json.dumps({**before.manifest, "last_mode": "no_op"}, sort_keys=True))
        return {**row, "build_mode": "no_op", "build_id": before.manifest["build"]}
    if row["to_analyze"] and analyzer is None:
        raise ValueError("new or modified evidence needs an analyzer")
    if row["to_analyze"]:
        work = style.to_analyze(current, cached, known, batch_size=batch_size)
        analyze(current, work, analyzer).write.parquet(f"{at}/analyzed")
        fresh = spark.read.parquet(f"{at}/analyzed")
    else:
        fresh = spark.createDataFrame([], TEMPLATE)
    retained(state.templates if state else None, fresh).write.parquet(f"{at}/templates")
    current.select("content_hash").where("polarity = 'evaluation'").unionByName(fresh.select("content_hash")).unionByName(known).distinct().write.parquet(f"{at}/hashes")
    templates, hashes = (spark.read.parquet(f"{at}/{t}") for t in ("templates", "hashes"))
    bound(current, templates, hashes).write.parquet(f"{at}/observations")
    rules = style.merged_in_order(spark.read.parquet(f"{at}/observations"))
    rules.write.parquet(f"{at}/rules")
    if not spark.read.parquet(f"{at}/rules").take(1):
        raise ValueError("the build made no rules")
    current.select("source_key", "content_hash").write.parquet(f"{at}/sources")
    clean.keep_first(current, [F.col("content_hash")], [F.col("src_ord"), F.col("seq"), F.col("source_key")]).select(C.encode({c: None for c in C.EXAMPLE}).alias("value")).write.text(f"{at}/bank")
    _statistics(current).write.parquet(f"{at}/contacts")
    row["artifacts"] = {r.path: r.hash for r in files.artifacts(spark, f"{at}/rules").unionByName(files.artifacts(spark, f"{at}/bank")).select("path", "hash").collect() if not r.path.rpartition("/")[2].startswith((".", "_"))}
    manifest = {"build": build_id, "fingerprint": fingerprint, "schema_version": SCHEMA_VERSION, "last_mode": mode, "summary": row}
    files.replace_text(spark, f"{root}/CURRENT", json.dumps(manifest, sort_keys=True, default=str))
    return row


@dataclass
class Bundle:
    """What a runtime reads of a published build."""

    rules: DataFrame
    examples: DataFrame
    contacts: DataFrame
    overrides: str
    summary: dict


def load_bundle(spark: SparkSession, root: str) -> Bundle:
    """The published bundle; an error where it is missing or holds no rules. A line of the bank that can't be read raises."""
    state = load(spark, root)
    if state is None:
        raise ValueError(f"no bundle below {root}: build it first")
    at = f"{root}/build={state.manifest['build']}"
    rules = spark.read.parquet(f"{at}/rules")
    if not rules.take(1):
        raise ValueError("the bundle holds no rules")
    bank = spark.read.text(f"{at}/bank").where("value rlike '[^ \\t\\r]'").select(C.decode_example(F.col("value")).alias("e"), "value")
    strict = F.when(F.col("e").isNull(), F.raise_error(F.concat(F.lit("bad line in the example bank: "), F.substring("value", 1, 40)))).otherwise(F.col("e"))
    return Bundle(rules, bank.select(strict.alias("e")).select("e.*"), spark.read.parquet(f"{at}/contacts"), (files.read_text(spark, f"{root}/overrides.md") or "").strip(), state.manifest["summary"])


def contact_rules(rules: DataFrame) -> DataFrame:
    """The rules that speak of one contact."""
    return rules.where("scope = 'contact'")


def rules_text(rules: DataFrame) -> DataFrame:
    """One row: the rules as a Markdown list, in the bundle's order."""
    order = F.struct(*[F.lower(c).alias(c) for c in ("behavior_category", "text", "applicable_context", "scope", "polarity")])
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), "text")))
    return rules.agg(lines.alias("r")).select(F.concat(F.lit("# Rules\n\n"), F.array_join(F.transform("r", lambda r: F.concat(F.lit("- "), r.text)), "\n"), F.lit("\n")).alias("markdown"))


def status(spark: SparkSession, root: str, current: DataFrame, fingerprint: str) -> dict:
    """What a build would find: the published one's counts, whether it can be gone on from, and the changes that wait."""
    state = load(spark, root)
    if state is None:
        return {"built": False}
    fits = state.manifest.get("fingerprint") == fingerprint and state.manifest.get("schema_version") == SCHEMA_VERSION
    got = {"built": True, "compatible": fits, "build": state.manifest["build"], "last_mode": state.manifest["last_mode"], "sources": state.sources.count(), "analyses": state.hashes.count()}
    return got | (style.plan_summary(current, state.sources, state.hashes).first().asDict() if fits else {})


def vacuum(state: State, current: DataFrame) -> DataFrame:
    """The kept templates whose content still has a source; builds never do this by themselves."""
    return state.templates.join(current.select("content_hash").distinct(), "content_hash", "left_semi")
