"""Sinks and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.text import strip_markup


def read_csv_dump(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV dump with a header; without a schema all columns are text, so no extra pass infers types."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.csv(path)


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """A small staff spreadsheet (xlsx needs an optional reader; CSV always works)."""
    import pandas as pd

    pdf = pd.read_excel(path) if path.endswith((".xlsx", ".xls")) else pd.read_csv(path)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))


def csv_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The projection of an export: titles as plain text, arrays joined, nested rows as JSON."""
    out = {}
    for name, c in columns.items():
        kind = df.select(c.alias("x")).schema["x"].dataType.typeName()
        if kind == "array":
            inner = df.select(c.alias("x")).schema["x"].dataType.elementType.typeName()
            c = F.to_json(c) if inner in ("struct", "map") else F.array_join(c.cast("array<string>"), "; ")
        elif kind in ("struct", "map"):
            c = F.to_json(c)
        elif kind == "string":
            c = F.trim(F.regexp_replace(strip_markup(c), r"(?U)\s+", " "))
        out[name] = c
    return df.select(*[c.alias(n) for n, c in out.items()])


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One CSV file with a header line, all texts quoted; the first bytes are a byte order mark if wanted, for spreadsheets.

    The rows are written in parts by the executors; the file is the mark, the header and the parts in order,
    put together as a stream of bytes, so nothing is held whole. An empty table gives the header alone.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = target.getFileSystem(conf)
    df.write.mode("overwrite").option("header", False).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(f"{path}.parts")
    quoted = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        out.write(bytearray((("\ufeff" if bom else "") + quoted + "\n").encode("utf-8")))
        names = sorted(s.getPath().getName() for s in fs.listStatus(parts))
        for name in (n for n in names if n.startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    fs.delete(parts, True)


class RawStore:
    """Raw payloads as Parquet by source; a later payload of a key replaces the earlier one on read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame) -> None:
        """``df``: source, source_id, raw_data."""
        df.select("source", "source_id", "raw_data", F.md5("raw_data").alias("raw_hash"), F.current_timestamp().alias("stored_at")).write.mode("append").partitionBy("source").parquet(self.path)

    def latest(self) -> DataFrame:
        """(source, source_id, stored_at, raw_hash) of the payload that counts for each key; payloads themselves aren't read."""
        t = self.spark.read.parquet(self.path).select("source", "source_id", "stored_at", "raw_hash")
        return t.groupBy("source", "source_id").agg(F.max(F.struct("stored_at", "raw_hash")).alias("m")).select("source", "source_id", "m.stored_at", "m.raw_hash")

    def read(self) -> DataFrame:
        """(source, source_id, raw_data): the keys are decided first, so only payloads that count are shuffled."""
        key = ["source", "source_id", "stored_at", "raw_hash"]
        return self.spark.read.parquet(self.path).join(self.latest(), key, "left_semi").dropDuplicates(key).select("source", "source_id", "raw_data")

    def get(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select("source", "source_id").distinct(), ["source", "source_id"], "left_semi")

    def exists(self, keys: DataFrame) -> DataFrame:
        have = self.spark.read.parquet(self.path).select("source", "source_id").distinct().withColumn("stored", F.lit(True))
        return keys.join(have, ["source", "source_id"], "left").fillna(False, ["stored"])

    def orphans(self, staging: DataFrame) -> DataFrame:
        """Stored payloads whose record is gone from staging."""
        return self.latest().select("source", "source_id").join(staging.select("source", "source_id"), ["source", "source_id"], "left_anti")

    def lacking(self, staging: DataFrame) -> DataFrame:
        """Staging records whose payload was emptied and isn't stored: what a restore can't bring back."""
        gone = staging.where("raw_data is null or trim(raw_data) in ('', '{}')").select("source", "source_id").distinct()
        return gone.join(self.latest().select("source", "source_id"), ["source", "source_id"], "left_anti")


def mark_done(staging: DataFrame, done: DataFrame) -> DataFrame:
    """The staging snapshot with the done rows processed and their payload emptied (it lives on in the raw store)."""
    d = done.select("id").distinct().withColumn("__d", F.lit(True))
    s = staging.join(d, "id", "left")
    hit = F.coalesce("__d", F.lit(False))
    return s.withColumn("processed", F.col("processed") | hit).withColumn("raw_data", F.when(hit, "{}").otherwise(F.col("raw_data"))).select(*staging.columns)


class RunLog:
    """One row for each phase of a run, appended to a Parquet table."""

    SCHEMA = "run_id string, phase string, status string, seconds double, metrics string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, run_id: str, phase: str, status: str, seconds: float, metrics: dict) -> None:
        import json

        self.spark.createDataFrame([(run_id, phase, status, seconds, json.dumps(metrics, sort_keys=True))], self.SCHEMA).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
