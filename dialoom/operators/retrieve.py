"""TF-IDF retrieval with boosts, for many queries over one corpus, without a cross join.

All candidates count for the frequencies of words. But a cosine is at most 1 and the boosts of a query are bounded, so that a candidate far enough below the
k that are best by what is their own (source, polarity, age) is among the best of no query: only the others are weighed and scored.

Texts stay where they are read: candidates are told apart by hashes of their texts, and read again for the words, without those that repeat others. If few are within reach,
only words of theirs and of the queries are counted: no other word's frequency is used.

The cosine needs only pairs that share a token: an equi-join on tokens. As nearly all texts share some common word, those are most pairs of a query and
a candidate; they are scored where the candidate lies and only the best k of a task move on. A candidate that shares none scores by its boosts,
which depend on its contact, its profanity flag and its intent alone, and by what is its own. So the best of each such class stand for the rest of it.
"""

from __future__ import annotations

from collections import Counter

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from dialoom.functions import text as T

from .clean import keep_first, union_ordered


#: Words of queries that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Candidates, or words, that may go to all tasks, and different words that a task counts before it hands them on.
FEW = 500_000
#: What a query adds to a candidate of its contact, of its profanity flag, of its intent.
CONTACT, RUDE, INTENT = 1.5, 0.5, 0.75
#: More than any query adds to what is a candidate's own: a cosine of 1 and all boosts, and something for rounding.
REACH = 1 + CONTACT + RUDE + INTENT + 1e-6


def recency(created_at: Column, as_of: Column) -> Column:
    """0.25 / (1 + age in days / 30); 0 for an empty or unreadable date; a date to come has age 0."""
    ts = F.when(created_at.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(created_at))
    days = F.greatest((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0), F.lit(0.0))
    return F.when(ts.isNull(), 0.0).otherwise(F.lit(0.25) / (1 + days / 30))  # greatest() passes over nulls


@F.udf(BinaryType(), useArrow=True)
def _digest(text):
    import hashlib

    # str.split knows the same blanks as T.BLANKS.
    return None if text is None else hashlib.sha256(" ".join(text.split()).encode()).digest()


def _evaluable(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("polarity").isin("positive", "negative"))


#: What tells texts of candidates apart, case and white space aside.
_KEYS = ("__incoming", "__response", "polarity")


def _keyed(some: DataFrame) -> DataFrame:
    return some.withColumns({"__incoming": _digest(F.lower("incoming_text")), "__response": _digest(F.lower("response_text"))})


def dedup(candidates: DataFrame) -> DataFrame:
    """Evaluable candidates, the first of each (incoming, response, polarity) by seq, case and white space aside."""
    return keep_first(_keyed(_evaluable(candidates)), list(_KEYS), [F.col("seq")]).drop("__incoming", "__response")


#: Signs of Latin-1 by number: those of words in lower case, a blank for any other.
_LATIN = bytes(ord(c.lower()) if c.isalnum() or c in "_'" else 32 for c in map(chr, range(256)))


def frequencies(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(token, df): in how many rows of incoming_text each word occurs; of the words in `only`, if it is given.

    Texts in Latin-1 are taken apart in Python, by a table; others come back whole, for the pattern of T.tokens.
    """
    table, most, wanted = _LATIN, FEW, None if only is None else frozenset(only)

    def count(batches):
        import pyarrow as pa

        out = lambda found, other: pa.RecordBatch.from_arrays([pa.array([*found, *[None] * len(other)], pa.string()), pa.array([*found.values(), *[0] * len(other)], pa.int64()), pa.array([*[None] * len(found), *other], pa.string())], ["token", "n", "other"])
        found = Counter()
        for batch in batches:
            other = []
            for t in batch.column(0):
                if (t := t.as_py()) is None:
                    continue
                try:
                    words = t.encode("latin-1").translate(table).decode("latin-1").split()
                except UnicodeEncodeError:
                    other.append(t)
                else:
                    found.update(set(words) if wanted is None else wanted.intersection(words))
                if len(found) > most:
                    yield out(found, [])
                    found = Counter()
            if other:
                yield out({}, other)
        yield out(found, [])

    got = texts.select("incoming_text").mapInArrow(count, "token string, n long, other string")
    words = F.array_distinct(T.tokens(F.col("other")))
    each = F.when(F.col("other").isNull(), F.array(F.struct("token", "n"))).otherwise(F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(1).cast("long").alias("n"))))
    return got.select(F.inline(each)).groupBy("token").agg(F.sum("n").alias("df"))


def runtime_candidates(feedback: DataFrame, bank: DataFrame) -> DataFrame:
    """Candidates of a live query: feedback as it is, before the examples of the bundle; both as style examples."""
    columns = ["example_id", "contact_id", "incoming_text", "response_text", "source_type", "polarity", "created_at"]
    both = union_ordered(feedback.select(*columns), bank.select(*columns))
    # A key that sorts feedback first and tells rows apart; no window over all of them.
    return both.withColumn("seq", F.struct("src_ord", "example_id")).drop("src_ord")


def top_k(queries: DataFrame, candidates: DataFrame, *, as_of: Column, k: int = 8) -> DataFrame:
    """(query_id, rank, example_id, score) of the k best candidates of each query; k <= 0 gives none.

    queries: (query_id, text, contact_id); candidates: (seq, example_id, contact_id, incoming_text, response_text, source_type, polarity, created_at).
    Ties go to fixes, then to the greater created_at, the greater example_id, the lesser seq. Candidates, the frequencies of words and the words of queries stay on the executors' disks
    until the session's cache is cleared; a lost block is computed again.
    """
    own = F.when(F.col("source_type") == "fix", 5.0).when(F.col("source_type") == "human", 1.0).otherwise(0.0) + F.when(F.col("polarity") == "negative", 0.25).otherwise(0.0)
    own = own + recency(F.col("created_at"), as_of)
    some = _evaluable(candidates)
    # Read by every part below, without texts; a lost block is computed again.
    own_columns = ["seq", "example_id", "contact_id", (F.col("source_type") == "fix").alias("fix"), "created_at", own.alias("own")]
    rows = _keyed(some).select(*own_columns, *_KEYS).persist(StorageLevel.DISK_ONLY)
    n_rows, n_seqs = rows.groupBy("seq").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("seq")).first()
    single = n_rows == n_seqs
    # Rows that repeat a seq share their words; their texts can't be found by it, and stay with them.
    docs = (keep_first(rows, list(_KEYS), [F.col("seq")]).drop(*_KEYS) if single else dedup(candidates).select(*own_columns, "incoming_text")).persist(StorageLevel.DISK_ONLY)
    n_docs = docs.count()
    few = lambda d, n: F.broadcast(d) if n <= FEW else d
    if single:
        texts = some.select("seq", "incoming_text").join(few(rows.select("seq").join(docs.select("seq"), "seq", "left_anti"), n_rows - n_docs), "seq", "left_anti")
    else:
        texts = docs.groupBy("seq").agg(F.array_join(F.collect_list("incoming_text"), " ").alias("incoming_text"))
    q = queries.select("query_id", F.col("contact_id").alias("q_contact"), T.has_profanity(F.col("text")).alias("q_rude"), T.intent(F.col("text")).alias("q_intent"), T.tokens(F.col("text")).alias("tokens"))
    best = [r.own for r in docs.select("own").orderBy(F.desc("own")).limit(max(k, 0)).collect()]
    reach = best[-1] - REACH if len(best) == k > 0 else None
    near = docs if reach is None else docs.where(F.col("own") >= reach)
    n_near = near.count()
    if single:
        # Only sources that have candidates within reach are read.
        read = some if reach is None else some.where(own >= reach - 1e-6)
        near = read.select("seq", "incoming_text").join(few(near, n_near), "seq")
    # Rows of a candidate stay in one task from here on.
    near = near.withColumns({"rude": T.has_profanity(F.col("incoming_text")), "intent": T.intent(F.col("incoming_text"))}).repartition("seq").persist(StorageLevel.DISK_ONLY)
    weighty = near.select("seq", "incoming_text") if single else texts.join(near.select("seq").distinct(), "seq", "left_semi")
    only = None
    if n_near * 8 <= n_docs:
        used = weighty.select(F.explode(T.tokens(F.col("incoming_text"))).alias("token")).union(q.select(F.explode("tokens"))).distinct().limit(FEW + 1).collect()
        only = [r.token for r in used] if len(used) <= FEW else None
    df = frequencies(texts, only).persist(StorageLevel.DISK_ONLY)
    idf = F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    tf = weighty.select("seq", F.explode(T.tokens(F.col("incoming_text"))).alias("token")).groupBy("seq", "token").agg(F.count("*").alias("tf"))
    weighed = tf.join(df, "token").select("seq", "token", (F.col("tf") * idf).alias("w"))
    w_norm = weighed.groupBy("seq").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_norm"))
    q_tf = q.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("tf"))
    q_w = q_tf.join(df, "token", "left").select("query_id", "token", (F.col("tf") * idf).alias("qw"), F.when(F.col("df").isNotNull(), idf).alias("idf")).persist(StorageLevel.DISK_ONLY)
    q_norm = q_w.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qw_norm"))
    # Words of queries go to all tasks if they are few: each candidate is then scored where it lies. Else both sides meet by word.
    shared = q_w.where("idf is not null").select("query_id", "token", (F.col("qw") * F.col("idf")).alias("qi"))
    small = F.broadcast if q_w.count() <= BROADCAST_ROWS else (lambda d: d)
    dots = tf.join(small(shared), "token").groupBy("seq", "query_id").agg(F.sum(F.col("tf") * F.col("qi")).alias("dot"))
    met = dots.join(w_norm, "seq").join(small(q_norm), "query_id").select("query_id", "seq", (F.col("dot") / (F.col("w_norm") * F.col("qw_norm"))).alias("cosine"))
    body = near.drop("incoming_text")
    order = [F.desc("own"), F.desc("fix"), F.desc("created_at"), F.desc("example_id"), F.asc("seq")]
    lead = lambda *by: body.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__at") <= k).drop("__at")
    whole, mine = lead("rude", "intent"), lead("contact_id", "rude", "intent")
    head = q.drop("tokens")
    # The leaders of all classes: at most k for each of 2 flags and 7 intents, so that this product is linear in the queries.
    sides = head.crossJoin(F.broadcast(whole)).select("query_id", "seq").unionByName(head.join(mine, F.col("q_contact") == F.col("contact_id")).select("query_id", "seq"))
    pairs = met.unionByName(sides.select("query_id", "seq").withColumn("cosine", F.lit(0.0))).groupBy("seq", "query_id").agg(F.max("cosine").alias("cosine"))
    full = pairs.join(body, "seq").join(small(head), "query_id")
    score = F.col("cosine") + F.col("own") + F.when(F.col("contact_id") == F.col("q_contact"), CONTACT).otherwise(0.0) + F.when(F.col("rude") == F.col("q_rude"), RUDE).otherwise(0.0) + F.when(F.col("intent") == F.col("q_intent"), INTENT).otherwise(0.0)
    # Sums of floats vary in their last bits with the order of rows: ranks go by nine digits.
    ranked = full.withColumn("score", F.round(score, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fix"), F.desc("created_at"), F.desc("example_id"), F.asc("seq"))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "example_id", F.round("score", 6).alias("score"))


def evidence(top: DataFrame, candidates: DataFrame) -> DataFrame:
    """The columns of the candidates that top_k chose, beside (query_id, rank, score). Kept on the executors' disks, as the ranks are, until the session's cache is cleared: whatever
    reads it, the ranking is done once. Ranks go to where the candidates lie if they are few, so that only chosen texts move."""
    top = top.persist(StorageLevel.DISK_ONLY)
    small = F.broadcast if top.count() <= BROADCAST_ROWS else (lambda d: d)
    return small(top).join(candidates.drop("seq"), "example_id").persist(StorageLevel.DISK_ONLY)
