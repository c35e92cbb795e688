"""Text functions as Spark columns. Character classes are explicit, since Java's are ASCII only: a word is letters, numbers and "_"."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_SPACES = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NOT_WS, WORD = f"[{_SPACES}]", f"[^{_SPACES}]", r"\p{L}\p{N}_"
#: The signs of WS.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(WS, c))
URL_ONLY = f"(?i)^{WS}*https?://{NOT_WS}+{WS}*$"
COMMAND = f"^{WS}*/[A-Za-z0-9_]+(?:@[{WORD}]+)?(?:{WS}|$)"
# Each begins with what tells most places apart: one character's class. Possessive where the next sign can't be part of the run.
EMAIL = rf"(?<![{WORD}.+-])[{WORD}.+-]++@[{WORD}.-]+\.[A-Za-z]{{2,}}"
QUERY_URL = f"(?i)https?://[^{_SPACES}?]*\\?{NOT_WS}*"
PHONE = rf"(?=[+\p{{Nd}}])(?<![{WORD}])\+?\p{{Nd}}[\p{{Nd}} ()-]{{6,}}\p{{Nd}}(?![{WORD}])"
_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
SECRET = (
    rf"(?i)(?=[ates])(?<![{WORD}])(?:(?:api[_-]?key|token|secret)(?![{WORD}]){WS}*[:=]{WS}*{NOT_WS}+|sk-[A-Za-z0-9_-]{{16,}}{_EDGE}"
    rf"|eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{_EDGE})"
)
#: Redaction in order; each stage sees what the one before left.
STAGES = (("email", EMAIL), ("url", QUERY_URL), ("phone", PHONE), ("secret", SECRET))

PROFANITY = ("fuck", "shit", "нахуй", "хуй", "бля", "пизд", "сука")
INTENTS = (
    ("greeting", ("привет", "дарова", "здарова", "hello", "hi")),
    ("scheduling", ("когда", "сегодня", "завтра", "встреча", "meeting", "schedule")),
    ("acknowledgement", ("ок", "ага", "понял", "да", "нет", "okay", "yes", "no")),
)
BUSINESS = ("договор", "документ", "клиент", "оплата", "invoice", "contract")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    # Sign by sign first: a pattern of the whole class looks it up at every place, and costs ten times as much.
    return F.trim(F.regexp_replace(F.translate(text, BLANKS, " " * len(BLANKS)), "  +", " "))


def redact(text: Column) -> Column:
    for name, pattern in STAGES:
        text = F.regexp_replace(text, pattern, f"<{name.upper()}>")
    return text


def redaction_counts(text: Column) -> dict[str, Column]:
    """Matches of each stage in the text as that stage sees it."""
    out = {}
    for name, pattern in STAGES:
        out[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, f"<{name.upper()}>")
    return out


def meaningful(text: Column) -> Column:
    bare = strip(text)
    return (bare != "") & ~bare.rlike(URL_ONLY) & ~bare.rlike(COMMAND)


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"([{WORD}']+)"), F.lit(1)), F.lower)


def has_profanity(text: Column, markers=PROFANITY) -> Column:
    low, hit = F.lower(text), F.lit(False)
    for m in markers:
        hit = hit | F.contains(low, F.lit(m))
    return hit


def intent(text: Column) -> Column:
    # Taken apart once: as a plain column, the text would be for every list of words.
    return _let(tokens(F.lower(text)), lambda words: _intent(text, words))


def _intent(text: Column, words: Column) -> Column:
    among = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    out = F
    for name, ws in INTENTS:
        out = out.when(among(ws), name)
    return out.when(has_profanity(text), "aggressive_or_teasing").when(F.contains(text, F.lit("?")), "question").when(among(BUSINESS), "business").otherwise("general")


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, with a mark at the end of what was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, max(limit - 14, 0)), f"{WS}+$", ""), F.lit("\n[truncated]")))


def compact(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Characters that are composed, combine with none before them and have no order among marks: a text of these alone is in composed form.
COMPOSED = r"\x00-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u202f-\u205e\u20a0-\u20bf\u3000-\u3029\u3041-\u3096\u309b-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef\x{1f000}-\x{1faff}"


def _composed(text: Column) -> Column:
    return ~text.rlike(f"[^{COMPOSED}]")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form; Spark has no such function, so that this one is in Python, over Arrow batches. Only texts that may change go there."""
    return F.coalesce(_nfc(F.when(~_composed(text), text)), text)


@F.pandas_udf(ArrayType(StringType()))
def _nfc_all(texts: pd.Series) -> pd.Series:
    one = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t)
    return texts.map(lambda ts: ts if ts is None else [one(t) for t in ts])


def nfc_all(texts: Column) -> Column:
    """nfc of each text of an array."""
    return F.coalesce(_nfc_all(F.when(F.exists(texts, lambda t: ~_composed(t)), texts)), texts)


def canonical(text: Column) -> Column:
    """Line feeds as such, blanks and tabs collapsed, lines stripped; apply nfc first."""
    blank = f"[{_SPACES}&&[^\n]]*"
    whole = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(whole, f"{blank}\n{blank}", "\n"))


def iso(ts: Column) -> Column:
    """A timestamp as an ISO string in UTC; '' for null. A zero fraction is left out."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(utc, ".SSSSSS")).otherwise("")
    return F.coalesce(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")), F.lit(""))


CATEGORIES = ("too_formal", "too_informal", "too_long", "too_short", "wrong_tone", "wrong_facts", "invented_information", "missed_context", "bad_emoji", "unnatural_phrase", "should_not_reply", "other")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_command(text: Column) -> Column:
    """struct(name, reply_id, category, comment, correction, error) of a review command; error is null where it is well formed."""
    # Each step is computed once: as plain columns, the patterns would run anew for every field and branch.
    return _let(strip(text), _parts)


def _parts(bare: Column) -> Column:
    part = lambda k: F.regexp_extract(bare, f"^({NOT_WS}+)(?:{WS}+({NOT_WS}+))?(?:{WS}+([\\s\\S]+))?$", k)
    return _let(F.struct(F.lower(part(1)).alias("name"), part(2).alias("number"), part(3).alias("rest")), lambda p: _command(bare, p["name"], p["number"], p["rest"]))


def _command(bare: Column, name: Column, number: Column, rest: Column) -> Column:
    reply = F.when(number.rlike(r"^\+?\p{Nd}+$"), number.try_cast("long"))
    first = F.substring_index(rest, " ", 1)
    known = first.isin(*CATEGORIES)
    after = strip(F.when(F.contains(rest, F.lit(" ")), F.regexp_replace(rest, "^[^ ]* ", "")).otherwise(F.lit("")))
    error = (
        F.when(~name.isin("/good", "/bad", "/fix", "/feedback_help"), "unknown_command")
        .when(name == "/feedback_help", F.when(bare != name, "help_takes_no_arguments"))
        .when(number == "", "reply_id_missing")
        .when(reply.isNull() | (reply <= 0), "reply_id_not_positive")
        .when((name == "/good") & (rest != ""), "good_takes_an_id_only")
        .when((name != "/good") & (rest == ""), "detail_missing")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, F.when(name == "/feedback_help", "help").otherwise(F.substring(name, 2, 10))).alias("name"),
        F.when(ok & (name != "/feedback_help"), reply).alias("reply_id"),
        F.when(ok & (name == "/bad"), F.when(known, first).otherwise("other")).alias("category"),
        F.when(ok & (name == "/bad"), F.when(known, F.nullif(after, F.lit(""))).otherwise(rest)).alias("comment"),
        F.when(ok & (name == "/fix"), rest).alias("correction"),
        error.alias("error"),
    )


def callback(action: Column, reply_id: Column, value: Column) -> Column:
    """action:id[:value]; null beyond 64 bytes."""
    got = F.concat_ws(":", action, reply_id.cast("string"), F.nullif(value, F.lit("")))
    return F.when(F.octet_length(got) <= 64, got)


def parse_callback(payload: Column) -> Column:
    """struct(action, reply_id, value); null where the id is missing or no number."""
    parts = F.split(payload, ":", 3)
    return F.when((F.size(parts) >= 2) & F.get(parts, 1).rlike(r"^\p{Nd}+$"), F.struct(F.get(parts, 0).alias("action"), F.get(parts, 1).try_cast("long").alias("reply_id"), F.get(parts, 2).alias("value")))


def error_category(name: Column) -> Column:
    """The kind of failure by the name of an error, the first that fits."""
    low = F.lower(name)
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
    return F.when(has("retryafter"), "rate_limited").when(has("timeout"), "timeout").when(has("network"), "network").when(has("forbidden", "unauthorized"), "authorization").otherwise("api_error")
