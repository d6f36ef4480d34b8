"""Queries for logs, resume and watched folders. events stand in for an append-only log."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans.corpus import t
from corpusloom.sources import io
from corpusloom.streaming import incremental as I


def log_latest(spark, d):
    log = t(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return I.latest(log, ["user_id", "event_type"], ["event_id"], F.col("value") > 1)


LOG_LATEST = "SELECT user_id, event_type, event_id, value FROM events WHERE value > 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


def antijoin_resume(spark, d):
    work = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    log = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.unseen(work, log, ["o_orderkey"])


ANTIJOIN_RESUME = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


def dedup_before_call(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text")
    return I.once(rows, ["text"], lambda x: x.select("text", F.sha2("text", 256).alias("answer"))).select("doc_id", "answer")


DEDUP_BEFORE_CALL = "SELECT doc_id, sha256(text) AS answer FROM documents"


def unit_states(spark, d):
    return I.unit_states(t(spark, d, "events"), "user_id", (F.col("event_type") == "purchase") & (F.col("value") > 30), 60)


UNIT_STATES = "SELECT user_id, count(*) AS attempts, CASE WHEN bool_or(event_type = 'purchase' AND value > 30) THEN 'accepted' WHEN count(*) >= 60 THEN 'failed' ELSE 'open' END AS state FROM events GROUP BY user_id"


def twin_states(spark, d):
    return I.group_state(unit_states(spark, d).withColumn("twin", F.floor(F.col("user_id") / 2)), "twin")


TWIN_STATES = f"SELECT CAST(floor(user_id / 2) AS BIGINT) AS twin, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_and(state = 'accepted') THEN 'accepted' ELSE 'open' END AS state FROM ({UNIT_STATES}) GROUP BY 1"


def valid_attempts(spark, d):
    log = t(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt"))
    return I.valid_attempts(log, "user_id", "attempt", "event_id", F.col("event_id") % 10 != 0).groupBy("user_id").agg(F.max("attempt").alias("valid"))


VALID_ATTEMPTS = """
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events), b AS (SELECT user_id, coalesce(min(attempt) FILTER (event_id % 10 = 0), max(attempt) + 1) AS stop FROM a GROUP BY 1)
SELECT user_id, CAST(stop - 1 AS INTEGER) AS valid FROM b WHERE stop > 1
"""


def windowed_counts(spark, d):
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = I.windowed_counts(events, "ts", "event_type", "1 hour", "10 minutes")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n")


WINDOWED_COUNTS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def watch_stream(spark, d):
    """Each user's first event once, through a stream over the events table's files."""
    base = io.scratch(spark, "watch")
    source = t(spark, d, "events").select("event_id", "user_id", "event_type")
    source.write.parquet(f"{base}/in")
    query = I.watch(spark, f"{base}/in", source.schema, ["user_id", "event_type"], f"{base}/out", f"{base}/state", lambda b: b.select("user_id", "event_type"))
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


WATCH_STREAM = "SELECT DISTINCT user_id, event_type FROM events"

QUERIES = {f.__name__: f for f in (log_latest, antijoin_resume, dedup_before_call, unit_states, twin_states, valid_attempts, windowed_counts, watch_stream)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
