"""python -m dialoom COMMAND: exports, builds, inspection and evaluation over Parquet tables; a line of JSON on success."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import build, compose, style
from dialoom.plans import jobs
from dialoom.sources import tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dialoom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("export-training", help="history to training examples")
    a.add_argument("history"), a.add_argument("out"), a.add_argument("--known-ai"), a.add_argument("--limit", type=int, default=500), a.add_argument("--context", type=int, default=10), a.add_argument("--no-redact", action="store_true")
    a = sub.add_parser("export-feedback", help="reviewed replies")
    a.add_argument("replies"), a.add_argument("out"), a.add_argument("--no-redact", action="store_true")
    a = sub.add_parser("build", help="compile style evidence")
    a.add_argument("examples"), a.add_argument("root"), a.add_argument("--replies"), a.add_argument("--analyzer", help="module:function"), a.add_argument("--limit", type=int, default=500), a.add_argument("--batch", type=int, default=50), a.add_argument("--model", default="local")
    for flag in ("--full-rebuild", "--dry-run", "--force-resynthesize", "--status"):
        a.add_argument(flag, action="store_true")
    a = sub.add_parser("inspect", help="a published bundle, without texts")
    a.add_argument("root")
    a = sub.add_parser("evaluate", help="measures of stored replies")
    a.add_argument("responses"), a.add_argument("out")
    return p


def inspect(spark: SparkSession, root: str) -> dict:
    """Counts of a published bundle; no text leaves it."""
    b = build.load_bundle(spark, root)
    by = {r.source_type: r["count"] for r in b.examples.groupBy("source_type").count().collect()}
    return {"build": b.summary["build_id"], "built_at": b.summary["built_at"], "rules": b.rules.count(), "examples": sum(by.values()), "by_source": by, "contacts": b.contacts.count(), "has_overrides": bool(b.overrides)}


def _build(spark: SparkSession, o: argparse.Namespace) -> dict:
    if o.full_rebuild and o.force_resynthesize:
        raise ValueError("--full-rebuild and --force-resynthesize exclude each other")
    kept, invalid = tables.first_valid(tables.training_jsonl(spark, o.examples), o.limit)
    human = style.from_training(kept)
    # Without replies the feedback half is the human one without rows.
    feedback: DataFrame = style.from_feedback(spark.read.parquet(o.replies)) if o.replies else human.where("false")
    current, conflicts = build.sources(human, feedback)
    invalid += current.agg(conflicts.alias("n")).first().n
    fingerprint = style.fingerprint(model=o.model, batch_size=o.batch, schema=build.SCHEMA_VERSION)
    if o.status:
        return build.status(spark, o.root, current, fingerprint)
    analyzer = None
    if o.analyzer:
        module, _, name = o.analyzer.partition(":")
        analyzer = getattr(importlib.import_module(module), name)
    return build.build(spark, current.drop("conflicts"), o.root, analyzer, fingerprint=fingerprint, batch_size=o.batch, full=o.full_rebuild, dry_run=o.dry_run, resynthesize=o.force_resynthesize, conflicts=invalid)


def main(argv: list[str] | None = None) -> int:
    o = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"dialoom {o.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if o.command == "export-training":
            jobs.export_training(spark.read.parquet(o.history), o.out, spark.read.parquet(o.known_ai) if o.known_ai else None, limit=o.limit, context_limit=o.context, redact=not o.no_redact)
            done = {"out": o.out}
        elif o.command == "export-feedback":
            jobs.export_feedback(spark.read.parquet(o.replies), o.out, redact=not o.no_redact)
            done = {"out": o.out}
        elif o.command == "build":
            done = _build(spark, o)
        elif o.command == "inspect":
            done = inspect(spark, o.root)
        else:
            measured = compose.evaluation(spark.read.json(o.responses, schema="scenario string, variant string, text string"))
            measured.drop("text").write.json(o.out, ignoreNullFields=False)
            done = {"out": o.out, "variants": len(compose.VARIANTS), "scenarios": measured.agg(F.count_distinct("scenario")).first()[0]}
    except ValueError as e:
        print(f"dialoom {o.command}: {e}", file=sys.stderr)
        return 1
    print(json.dumps(done, default=str, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
