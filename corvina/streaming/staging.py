"""Incremental ingest as a stream (the batch phases' dirty flags, SURVEY 2.11): files in, merged snapshot out.

``foreachBatch`` runs the same merge as the batch path on each micro-batch; the table is kept in key buckets
with a version each, so a batch rewrites what it touches and a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvina.operators.maintenance import merge_staging

COLUMNS = "source string, source_id string, doi string, raw_data string, raw_hash string"
#: Key buckets of the snapshot; a batch rewrites only the buckets that it touches.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64("source", "source_id"), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, path: str, below: int | None = None) -> tuple[int, dict[int, int]]:
    """(batch, version of each bucket): the newest manifest, or the newest of an earlier batch than ``below``; (-1, {}) if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1, {}
    whole = [int(s.getPath().getName()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    last = max((b for b in whole if below is None or b < below), default=-1)
    if last < 0:
        return -1, {}
    return last, {r["bucket"]: r["v"] for r in spark.read.schema("bucket int, v bigint").parquet(f"{path}/manifests/{last}").collect()}  # at most BUCKETS rows


def snapshot(spark: SparkSession, path: str, versions: dict[int, int] | None = None) -> DataFrame:
    """The merged table: the version of each bucket that the newest manifest names, or those given."""
    versions = manifest(spark, path)[1] if versions is None else versions
    paths = [f"{path}/bucket={b}/v={v}" for b, v in sorted(versions.items())]
    return spark.read.schema(COLUMNS).parquet(*paths) if paths else spark.createDataFrame([], COLUMNS)


def ingest(spark: SparkSession, incoming: str, target: str, checkpoint: str) -> StreamingQuery:
    """Merges JSON lines files that arrive in ``incoming`` into the table of ``target``, all that is there, once.

    A batch reads and rewrites only the buckets of its keys, and then writes its manifest. A repeated batch
    starts from the manifest before it, whose versions are kept until the next batch, so it gives the same.
    """
    stream = spark.readStream.schema("source string, source_id string, doi string, raw_data string").json(incoming)
    stream = stream.withColumn("raw_hash", F.md5("raw_data"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = batch.where("source is not null and source_id is not null").groupBy("source", "source_id").agg(F.max_by(F.struct("doi", "raw_data", "raw_hash"), "raw_hash").alias("r")).select("source", "source_id", "r.*")
        touched = {r["b"] for r in new.select(_bucket().alias("b")).distinct().collect()}  # at most BUCKETS
        last, before = manifest(session, target, batch_id)
        old = snapshot(session, target, {b: v for b, v in before.items() if b in touched})
        merged = merge_staging(old, new, ["source", "source_id"], fill=("doi",)).drop("action")
        merged.withColumn("bucket", _bucket()).withColumn("v", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(target)
        now = before | {b: batch_id for b in touched}
        session.createDataFrame(sorted(now.items()), "bucket int, v bigint").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifests/{batch_id}")
        jvm = session.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
        for b, v in manifest(session, target, last)[1].items():  # what only an older manifest names
            if v not in (before.get(b), now.get(b)):
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={b}/v={v}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling counts and sums by type of a stream or a table of (ts, event_type, value); rows later than ``late`` are dropped by a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
