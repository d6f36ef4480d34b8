"""Incremental jobs: log replay, resume by content hash, work once per distinct request, watched folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.dedup import dedup


def latest(log: DataFrame, keys: list[str], order: list[str], valid: Column | None = None) -> DataFrame:
    """The last valid row of each key."""
    return dedup(log.filter(valid) if valid is not None else log, keys, order, "last")


def unseen(work: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Work that the log lacks."""
    return work.join(log.select(*keys).distinct(), keys, "left_anti")


def once(rows: DataFrame, keys: list[str], call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an expensive call to the distinct requests alone and give each row its answer. call keeps the key columns."""
    answers = call(rows.select(*keys).distinct())
    more = [c for c in answers.columns if c not in keys]
    named = answers.select(*[F.col(k).alias(f"__{k}") for k in keys], *more)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(named, on, "left").select(*rows.columns, *more)


def valid_attempts(log: DataFrame, key: str, attempt: str, order: str, matches: Column) -> DataFrame:
    """Rows whose hashes match and whose attempt follows on: attempt n counts only if n - 1 has counted before it."""
    ok = log.filter(matches)
    first = dedup(ok, [key, attempt], [order], "first")
    ordered = first.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(attempt))).withColumn("__later", F.col(order) > F.coalesce(F.lag(order).over(Window.partitionBy(key).orderBy(attempt)), F.lit(-1)))
    good = (F.col(attempt) == F.col("__n")) & F.col("__later")
    unbroken = F.min(good.cast("int")).over(Window.partitionBy(key).orderBy(attempt).rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("__ok", unbroken == 1).filter("__ok").drop("__n", "__later", "__ok")


def unit_states(events: DataFrame, unit: str, ok: Column, most_attempts: int) -> DataFrame:
    """(unit, attempts, state): accepted after a success, failed after so many failures, else open."""
    tries = events.groupBy(unit).agg(F.count("*").alias("attempts"), F.bool_or(ok).alias("done"))
    return tries.select(unit, "attempts", F.when(F.col("done"), "accepted").when(F.col("attempts") >= most_attempts, "failed").otherwise("open").alias("state"))


def group_state(states: DataFrame, group: str) -> DataFrame:
    """Twins share a state: failed if any is, accepted if all are."""
    return states.groupBy(group).agg(F.when(F.bool_or(F.col("state") == "failed"), "failed").when(F.bool_and(F.col("state") == "accepted"), "accepted").otherwise("open").alias("state"))


def watch(spark: SparkSession, source: str, schema, keys: list[str], out: str, checkpoint: str, job: Callable[[DataFrame], DataFrame], fmt: str = "parquet", trigger: dict | None = None):
    """Process each distinct key of a watched folder once, in micro-batches; out gains rows with batch_id.

    Each batch drops the keys that out has: they outlive restarts as data, not as state. A batch that is run again after a failure
    replaces its own files.
    """
    stream = spark.readStream.format(fmt).schema(schema).load(source)

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(out)
        fresh = batch.dropDuplicates(keys)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            done = session.read.option("basePath", out).parquet(out).filter(F.col("batch_id") != batch_id)
            fresh = unseen(fresh, done, keys)
        job(fresh).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, late: str) -> DataFrame:
    """Counts by time window and key; in a stream, rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
