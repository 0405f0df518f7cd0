"""The session operators over streams; with all input at hand they agree with the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.session import IDLE_SECONDS


def read_log(spark: SparkSession, folder: str, name: str, like: DataFrame, ts: str = "ts") -> DataFrame:
    """A stream of the Parquet table ``name`` in ``folder``, a file or a folder of files.

    The time column becomes a timestamp, as watermarks need.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(like.schema)
    log = reader.parquet(f"{folder}/{name}") if files.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def session_sizes(log: DataFrame, key: str, ts: str, idle: int = IDLE_SECONDS, late: str = "1 day") -> DataFrame:
    """(key, session window, entries) with late entries taken in up to the watermark.

    A gap of exactly ``idle`` does not end a session, as in batch: the window is one microsecond longer.
    """
    gap = f"{idle} seconds 1 microsecond"
    return log.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("entries"), F.max(ts).alias("last"))


def first_queries(log: DataFrame, key: str, signature: str, ts: str, late: str = "1 day") -> DataFrame:
    """Queries without repeats of the same key and signature within the watermark."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, signature])


def run_once(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there now and return the result as a table in ``folder``, which executors share.

    Each batch is written to a place of its own, so that one that is run again replaces itself. In complete mode the last
    batch is the result, in append mode all of them are.
    """
    spark, out = stream.sparkSession, f"{folder}/result"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.queryName(name).outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else None
    empty = spark.createDataFrame([], stream.schema)
    if last is None:
        return empty
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return empty
    batches = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root))
    kept = batches[-1:] if mode == "complete" else batches
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={n}" for n in kept])
