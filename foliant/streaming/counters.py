"""Vote scores and popularity as continuous jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.discussion import vote_scores
from foliant.operators.graph import resolved_redirects


def _publisher(folder: str):
    def publish(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")

    return publish


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the finished ``prefix=N`` folders, least first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(path)]
    return sorted(int(n.split("=")[1]) for p, n in names if n.startswith(f"{prefix}=") and files.exists(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot and the batches after it."""
    snapshots, batches = _numbers(spark, f"{folder}/snapshots", "upto"), _numbers(spark, f"{folder}/batches", "batch")
    paths = [f"{folder}/snapshots/upto={snapshots[-1]}"] if snapshots else []
    paths += [f"{folder}/batches/batch={b}" for b in batches if not snapshots or b > snapshots[-1]]
    return spark.read.parquet(*paths)


def _snapshot(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    batches = _numbers(spark, f"{folder}/batches", "batch")
    if batches and _numbers(spark, f"{folder}/snapshots", "upto")[-1:] != batches[-1:]:
        rows.write.parquet(f"{folder}/snapshots/upto={batches[-1]}")


def stream_vote_scores(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the last vote per reader and target of a stream of (event_id, ts, user_id, target_id, value).

    The state store holds the last vote per key, ordered by (ts, event_id), so late events cannot win. A batch writes
    only the keys it touched, under its own id; a replayed batch rewrites the same folder.
    """
    last = stream.groupBy("user_id", "target_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("last")).select(
        "user_id", "target_id", "last.ts", "last.event_id", "last.value")
    writer = last.writeStream.outputMode("update").foreachBatch(_publisher(folder)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _newest_votes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "target_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("last")).select("user_id", "target_id", "last.*")


def published_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(votes, scores)`` as of the last published batch, from the newest snapshot and what came after."""
    return vote_scores(_published(spark, folder))


def compact_scores(spark: SparkSession, folder: str) -> None:
    """Write the newest row per key so far as a snapshot named by the last batch in it; older batches may then be deleted."""
    _snapshot(spark, folder, _newest_votes(_published(spark, folder)))


def stream_popularity(stream: DataFrame, redirects: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running counters per surviving work of a stream of (ol_id, kind).

    The redirect table is static; each batch writes the counters it changed.
    """
    mapped = resolved_redirects(redirects)
    work = F.coalesce("resolved", "ol_id")
    counts = stream.filter("ol_id <> ''").join(mapped, F.col("ol_id") == F.col("from_ol"), "left").groupBy(work.alias("work")).agg(
        F.count_if(F.col("kind") == "rating").alias("ratings_count"), F.count_if(F.col("kind") == "reading_log").alias("readinglog_count"))
    writer = counts.writeStream.outputMode("update").foreachBatch(_publisher(folder)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _highest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("work").agg(F.max("ratings_count").alias("ratings_count"), F.max("readinglog_count").alias("readinglog_count"))


def published_popularity(spark: SparkSession, folder: str) -> DataFrame:
    """Counters only grow, so the newest row of a work holds the maximum of both."""
    return _highest(_published(spark, folder)).select(
        F.col("work").alias("ol_id"), F.col("ratings_count").cast("int").alias("ratings_count"), F.col("readinglog_count").cast("int").alias("readinglog_count"))


def compact_popularity(spark: SparkSession, folder: str) -> None:
    _snapshot(spark, folder, _highest(_published(spark, folder)))
