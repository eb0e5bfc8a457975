"""Progress of documents as a stream of review events, and memory as running state."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipigraph.session import scratch


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the files of a table, which may be one file or a folder of them."""
    read = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return read.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return read.parquet(path)


def states(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """(document_id, total, done): segments of each document, and those that are approved, in review or from memory, each counted as often as it is one. segments may be a stream; translations is a table."""
    t = translations.select(F.col("segment_id").alias("id"), (F.col("status") == "memory_applied").alias("memory"))
    done = F.col("status").isin("approved", "needs_review").cast("int") + F.coalesce("memory", F.lit(False)).cast("int")
    return segments.select("id", "document_id", "status").join(t, "id", "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.sum(done).alias("done"))


def staged(documents: DataFrame, states: DataFrame) -> DataFrame:
    """(id, status, step, progress, total): what a client is told of each document; progress and total while it is being translated."""
    d = documents.select("id", F.col("status").alias("_status"), F.col("metadata").alias("_metadata")).join(states.withColumnRenamed("document_id", "id"), "id", "left").fillna(0, ["total", "done"])
    told = F.struct(F.col("_status").alias("status"), F.lit(None).cast("string").alias("step"))
    say = lambda status, step: F.struct(F.lit(status).alias("status"), F.lit(step).cast("string").alias("step"))
    own = F.col("_metadata")["total_segments"].isNotNull()
    total, done = F.when(own, F.col("_metadata")["total_segments"].cast("long")).otherwise(F.col("total")), F.when(own, F.coalesce(F.col("_metadata")["local_segments"].cast("long"), F.lit(0))).otherwise(F.col("done"))
    now = (
        F.when(F.col("_status") == "failed", say("failed", None)).when(F.col("_status") == "processed", say("processed", "ready")).when((F.col("_status") == "uploaded") | ~own & (total == 0), say("processing", "parsing"))
        .when(own | (done < total), say("processing", "translating")).when(F.col("_status") == "processing", say("processing", "scoring")).otherwise(told)
    )
    out = d.select("id", now.alias("s"), done.alias("_done"), total.alias("_total"))
    moving = F.col("s.step") == "translating"
    return out.select("id", "s.status", "s.step", F.when(moving, F.col("_done")).alias("progress"), F.when(moving, F.col("_total")).alias("total"))


def messages(staged: DataFrame) -> DataFrame:
    """(id, message): the event that a client is sent of each document; fields without a value are left out."""
    return staged.select("id", F.concat(F.lit("data: "), F.to_json(F.struct("status", "step", "progress", "total")), F.lit("\n\n")).alias("message"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """work of every batch of a stream of segments, each batch's result committed once; so much of a document shows as its batches have brought."""
    spark = stream.sparkSession
    root = scratch(spark, "batches")

    def keep(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/out").drop("batch")


class Background:
    """A job that runs beside its caller; a failure is its status and not the caller's."""

    def __init__(self, job: Callable[[], object]) -> None:
        self.status, self.error, self.result = "processing", None, None
        self._thread = threading.Thread(target=self._run, args=(job,), daemon=True)
        self._thread.start()

    def _run(self, job: Callable[[], object]) -> None:
        try:
            self.result = job()
            self.status = "processed"
        except Exception as e:  # whatever it was, the job has failed and says so
            self.status, self.error = "failed", str(e)

    def wait(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.status


def windowed(events: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Events by time window and type; rows later than the watermark allows aren't counted, repeated rows are once."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.dropDuplicatesWithinWatermark(["id"]).groupBy(F.window("created_at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that is there now, each batch committed exactly once to a table in the shared folder."""
    spark = stream.sparkSession
    root = scratch(spark, "stream")
    columns = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    out = spark.read.schema(columns.add("batch", "long")).parquet(f"{root}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        return out.join(F.broadcast(last), "batch").drop("batch")
    return out.drop("batch")


def counts(events: DataFrame) -> DataFrame:
    """Running counts of each type of event; a batch table gives the same rows."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def remember(memory_path: str):
    """A batch function that keeps the latest text of each key of approvals (key, target_text, approved_at). A batch writes what it brings and nothing else; one that is repeated after a failure writes the same again."""

    def fold(batch: DataFrame, number: int) -> None:
        _latest(batch).write.mode("overwrite").parquet(f"{memory_path}/batch={number}")

    return fold


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("target_text", F.struct("approved_at", "target_text")).alias("target_text"), F.max("approved_at").alias("approved_at"))


def recall(spark: SparkSession, memory_path: str) -> DataFrame:
    """The memory as its batches left it."""
    return _latest(spark.read.parquet(memory_path).drop("batch"))


def compact(spark: SparkSession, memory_path: str, new_path: str) -> None:
    """The memory as one batch at a new path, for a stream that begins there after many."""
    recall(spark, memory_path).write.mode("overwrite").parquet(f"{new_path}/batch=-1")
