"""Sources: message history, review log and style examples, from the driver's tables or from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import codecs as C
from dialoom.functions import text as T

CONTEXT = "array<struct<role:string,text:string>>"
TRAINING = f"example_id string, dialog_id long, context {CONTEXT}, target_reply string, source_message_ids array<long>, created_at string, is_human_authored boolean"
#: A derivation of the review log from labels, in SQL that both engines read.
REPLY_COLUMNS = (
    "doc_id AS id, doc_id % 50 AS dialog_id, CASE WHEN doc_id % 11 = 3 THEN 'failed' WHEN doc_id % 13 = 5 THEN 'cancelled_manual' ELSE 'sent' END AS delivery_status, "
    "CASE WHEN doc_id % 7 = 0 THEN 'unreviewed' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'corrected' ELSE 'approved' END AS feedback_status, "
    "CASE WHEN toxic = 1 AND doc_id % 7 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'should_not_reply' ELSE 'wrong_tone' END END AS feedback_category, "
    "CASE WHEN quality = 0 AND toxic = 0 AND doc_id % 7 <> 0 THEN CASE WHEN doc_id % 10 = 1 THEN '' ELSE concat('fixed ', doc_id) END END AS corrected_reply_text, "
    "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'trainer_bot' END AS feedback_source, doc_id % 4 AS notification_attempts, "
    "doc_id * 10 AS incoming_message_id, CASE WHEN doc_id % 5 <> 2 THEN doc_id * 10 + 1 END AS sent_message_id, concat('2024-0', doc_id % 9 + 1, '-15T10:00:00+00:00') AS created_at, "
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('question ', doc_id) END AS incoming_message_text, "
    "CASE doc_id % 6 WHEN 0 THEN '[{\"role\":\"user\",\"text\":\"first\"},{\"role\":\"user\",\"text\":\" last one \",\"provenance\":\"contact\"},{\"role\":\"assistant\",\"text\":\"hi\"}]' "
    "WHEN 1 THEN '[]' WHEN 2 THEN 'not json' WHEN 3 THEN CASE WHEN doc_id % 4 = 3 THEN '{\"role\":\"user\",\"text\":\"no list\"}' ELSE '[1,{\"role\":\"user\",\"text\":\"a  b c\"}]' END "
    "WHEN 4 THEN '[{\"role\":\"assistant\",\"text\":\"only mine\"}]' ELSE '[{\"text\":\"no role\"},{\"role\":\"user\"}]' END AS context_json, "
    "CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN concat('2024-1', doc_id % 3, '-01T00:00:00+00:00') END AS feedback_updated_at, "
    "CASE WHEN doc_id % 3 = 1 THEN doc_id + 5 END AS review_message_id, CASE doc_id % 5 WHEN 0 THEN 'not_requested' WHEN 1 THEN 'pending' WHEN 2 THEN 'sending' WHEN 3 THEN 'failed' ELSE 'sent' END AS notification_status, "
    "CASE WHEN doc_id % 8 > 0 THEN CAST(concat('2024-03-01 10:0', doc_id % 8, ':00') AS TIMESTAMP) END AS notification_last_attempt_at, CASE WHEN doc_id % 5 = 3 THEN 'timeout' END AS notification_error, "
    "concat('model-', doc_id % 2) AS model, 'v1' AS prompt_version"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(conversations: DataFrame) -> DataFrame:
    """Message history from conversations: one message a line of a turn, with dates and flags from the numbers."""
    m = conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("frag", "text"))
    step = F.when(F.col("conv_id") % 3 == 0, 180).when(F.col("conv_id") % 3 == 1, 181).otherwise(20)
    seconds = F.lit(1_704_067_200) + F.col("conv_id") * 86_400 + F.col("turn") * 3600 + F.col("frag") * step
    m = m.withColumn("id", (F.col("turn") * 1000 + F.col("frag")).cast("long"))
    return m.select(
        F.col("conv_id").alias("dialog_id"),
        "id",
        F.when(F.col("role") == "assistant", 42).otherwise(1001).cast("long").alias("sender_id"),
        T.strip(F.col("text")).alias("text"),
        F.when(~((F.col("conv_id") % 5 == 3) & (F.col("turn") == 3)), F.timestamp_seconds(seconds)).alias("date"),
        (F.col("role") == "assistant").alias("outgoing"),
        (F.col("role") == "system").alias("is_service"),
        (F.col("id") % 11 == 7).alias("has_media"),
        (F.col("id") % 13 == 5).alias("is_forwarded"),
        ((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 9 == 4)).alias("known_ai"),
    )


def newest(history: DataFrame, limit: int) -> DataFrame:
    """The newest max(3 x limit, 500) messages of each dialog."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("dialog_id").orderBy(F.desc("id")))
    return history.withColumn("__at", at).where(F.col("__at") <= max(3 * limit, 500)).drop("__at")


def replies(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """The state of generated replies, from labels; the document is the reply."""
    text = documents.select(F.col("doc_id").alias("__d"), F.col("text").alias("generated_reply_text"))
    return labels.selectExpr(*_split(REPLY_COLUMNS)).join(text, F.col("id") == F.col("__d")).drop("__d")


def _split(columns: str) -> list[str]:
    """The expressions of a select list."""
    depth, quoted, out, now = 0, False, [], ""
    for c in columns:
        quoted ^= c == "'"
        depth += ((c == "(") - (c == ")")) * (not quoted)
        if c == "," and not depth and not quoted:
            out, now = [*out, now], ""
        else:
            now += c
    return [*out, now]


def training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training examples from JSON lines, with line_no and `valid`: bad JSON, and rows that aren't human or lack text, are marked, not raised.

    line_no rises in the order of files and lines; of one file that one task reads it is the line's number. Lines end with a line feed or a carriage return only, so that a
    text with other separators stays one line.
    """
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id() + 1).where("value rlike '[^ \\t\\r]'")
    read = raw.select("line_no", F.from_json("value", TRAINING).alias("r"), F.col("value").alias("line"))
    got = read.select("line_no", "line", "r.*").withColumn("incoming_text", C.last_user_text(F.coalesce("context", F.array().cast(CONTEXT))))
    said = T.strip(F.coalesce("target_reply", F.lit("")))
    return got.withColumn("valid", F.coalesce(F.col("is_human_authored") & (F.col("incoming_text") != "") & (said != ""), F.lit(False)))


def first_valid(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The first `limit` valid rows of training_jsonl, and how many invalid ones stand before the last of them; all of them if fewer are valid."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    kept = rows.where("valid").orderBy("line_no").limit(limit)
    n, last = kept.agg(F.count("*"), F.max("line_no")).first()
    bad = rows.where("not valid")
    return kept, (bad.where(F.col("line_no") < last) if n == limit else bad).count()


def example_bank(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict reader: a bad line raises."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")
