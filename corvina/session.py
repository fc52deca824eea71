"""Session helpers: table access, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``base``; column pruning and pushdown are Catalyst's."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for costly Python steps over few files.

    A table of many files is left as it is, so nothing is shuffled at scale.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without one (tests) gets a folder of its own.

    A cluster without the setting raises, since its executors share no temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvina-"))
            current = sc._jsc.sc().getCheckpointDir()
        root = current.get()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - best effort, e.g. the JVM is gone
        pass


class Cut:
    """Written tables in the shared folder: a lineage cut that survives the loss of executors.

    ``cut(df)`` writes ``df`` once and returns a scan of the result. ``drop(df)`` removes a table that no
    later step reads; ``keep(df)`` ends an operator: it writes the result and removes all its other
    tables. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch_root(spark)
        self.paths: set[str] = set()

    def __call__(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/corvina/{uuid.uuid4().hex}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        self.paths.add(path)
        atexit.register(_delete, self.spark, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_cut_path", None)
            if path in self.paths:
                self.paths.discard(path)
                _delete(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        out = self(df)
        for path in self.paths - {out._cut_path}:
            _delete(self.spark, path)
        self.paths = {out._cut_path}
        return out
