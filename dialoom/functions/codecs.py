"""Codecs between stored JSON or strings and typed columns. Bad input becomes a default, never an error, unless a name says `strict`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import text as T

TURN = "struct<provenance:string,role:string,text:string>"
#: Fields of a style example and of a rule, as stored, with what stands for a missing one.
EXAMPLE = {
    "example_id": "", "contact_id": 0, "incoming_text": "", "response_text": "", "source_type": "", "polarity": "", "created_at": "", "feedback_id": None, "context": (), "provenance": "",
    "feedback_status": "", "feedback_category": "", "source_key": "", "content_hash": "",
}
RULE = {
    "text": "", "confidence": 0.8, "evidence_count": 1, "source_type": "mixed", "applicable_context": "general", "scope": "global", "observation_id": "", "behavior_category": "general",
    "supporting_source_keys": (), "supporting_source_hashes": (), "polarity": "positive", "source_priority": 0,
}
LEVELS = {"high": 0.9, "high_confidence": 0.9, "strong": 0.9, "medium": 0.7, "moderate": 0.7, "low": 0.5, "weak": 0.5}


def safe_long(value: Column, default: int | None = 0) -> Column:
    """A whole number from a string; the default for null, blank and anything else ("12.5" too)."""
    bare = T.strip(value.cast("string"))
    return F.coalesce(F.when(bare.rlike(r"^[+-]?\p{Nd}+$"), bare.try_cast("long")), F.lit(default).cast("long"))


def safe_double(value: Column, default: float = 0.8) -> Column:
    """A number from a string, or from a level of confidence in words; the default for null, blank and anything else."""
    bare = F.lower(T.strip(value.cast("string")))
    words = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), bare.try_cast("double"))
    return F.coalesce(words[bare], number, F.lit(default))


def optional(value: Column, kind: str) -> Column:
    """A nullable stored value as `kind`; what can't be read is null."""
    return value.try_cast(kind)


def first_text(*columns: Column) -> Column:
    """The first of the columns that isn't null or empty, stripped; '' if there is none."""
    return T.strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))


def _objects(payload: Column, path: str = "$") -> Column:
    """The objects of a JSON list as variants; null where the JSON is bad or no list."""
    listed = F.try_variant_get(F.try_parse_json(payload), path, "array<variant>")
    return F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _field(x: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(x, f"$.{name}", kind)


def decode_context(payload: Column) -> Column:
    """Turns of a stored context: only objects of a list count; missing fields are ''; bad JSON and anything but a list give no turns."""
    turn = lambda x: F.struct(*[F.coalesce(_field(x, c), F.lit("")).alias(c) for c in ("provenance", "role", "text")])
    return F.coalesce(F.transform(_objects(payload), turn), F.array().cast(f"array<{TURN}>"))


def strict_context(payload: Column) -> Column:
    """decode_context, but bad JSON and anything but a list raise, as an export must not lose a context silently."""
    bad = F.try_variant_get(F.try_parse_json(payload), "$", "array<variant>").isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("unreadable context: "), F.coalesce(F.substring(payload, 1, 40), F.lit("null"))))).otherwise(decode_context(payload))


def normalize_context(context: Column) -> Column:
    """Turns with role, text and provenance as strings, '' for a missing one; a null context has no turns, a null turn goes."""
    turn = lambda t: F.struct(*[F.coalesce(t[c], F.lit("")).alias(c) for c in ("provenance", "role", "text")])
    return F.coalesce(F.transform(F.filter(context, lambda t: t.isNotNull()), turn), F.array().cast(f"array<{TURN}>"))


def encode_context(context: Column) -> Column:
    """The stored form of (role, text, provenance, message_id): keys in order, nulls written."""
    keys = F.transform(context, lambda t: F.struct(t["message_id"].alias("message_id"), t["provenance"].alias("provenance"), t["role"].alias("role"), t["text"].alias("text")))
    return F.to_json(keys, {"ignoreNullFields": "false"})


def last_user_text(context: Column) -> Column:
    """The text of the last turn of the other one, stripped; '' without such a turn."""
    users = F.filter(context, lambda t: t["role"] == "user")
    return F.when(F.size(users) > 0, T.strip(F.coalesce(F.element_at(users, -1)["text"], F.lit("")))).otherwise("")


def encode(fields: dict) -> Column:
    """The row's columns of a codec as JSON, keys in order, nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})


def decode_example(payload: Column) -> Column:
    """struct of EXAMPLE from its JSON; null where that is bad or lacks an id, a text, a type or a polarity."""
    v = F.try_parse_json(payload)
    got = {c: F.coalesce(_field(v, c), F.lit(d)) for c, d in EXAMPLE.items() if isinstance(d, str)}
    got["contact_id"], got["feedback_id"] = safe_long(_field(v, "contact_id")), safe_long(_field(v, "feedback_id"), None)
    got["context"] = decode_context(F.to_json(_field(v, "context", "variant")))
    whole = _field(v, "example_id").isNotNull()
    for c in ("incoming_text", "response_text", "source_type", "polarity"):
        whole = whole & _field(v, c).isNotNull()
    return F.when(whole, F.struct(*[got[c].alias(c) for c in EXAMPLE]))


def _rule(v: Column) -> Column:
    got = {c: F.coalesce(_field(v, c), F.lit(d)) for c, d in RULE.items() if isinstance(d, str)}
    got["confidence"] = safe_double(_field(v, "confidence"), RULE["confidence"])
    for c in ("evidence_count", "source_priority"):
        got[c] = safe_long(_field(v, c), RULE[c])
    for c in ("supporting_source_keys", "supporting_source_hashes"):
        got[c] = F.coalesce(_field(v, c, "array<string>"), F.array().cast("array<string>"))
    return F.struct(*[got[c].alias(c) for c in RULE])


def decode_rules(payload: Column) -> Column:
    """RULE structs of a JSON list; those without text go; null where the JSON is bad or no list."""
    return F.transform(F.filter(_objects(payload), lambda x: T.strip(F.coalesce(_field(x, "text"), F.lit(""))) != ""), _rule)


def parse_rules(payload: Column) -> Column:
    """RULE structs of an analyzer's answer {"rules": [...]}: items without text go; null where `rules` is missing or no list."""
    return F.transform(F.filter(_objects(payload, "$.rules"), lambda x: T.strip(F.coalesce(_field(x, "text"), F.lit(""))) != ""), _rule)
