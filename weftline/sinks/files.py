"""Results as files: converted samples by input file, session records, and what was written before."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 1 << 24  # characters of one JSON array


@functools.cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-weftline-")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; where that is unset, a folder of its
    own for a local master, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def done(spark: SparkSession, out: str) -> DataFrame | None:
    """The ``rel_path`` values that ``out`` has already; None where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("rel_path string").json(out).select("rel_path").distinct()


def write_converted(samples: DataFrame, out: str, rewrite: bool = False) -> None:
    """Samples as JSON lines in one folder for each input file (column ``rel_path``); files written before are left
    alone unless ``rewrite``. Which files exist is read from folder names, not from their rows."""
    spark = samples.sparkSession
    before = None if rewrite else done(spark, out)
    if before is not None:
        samples = samples.join(before, "rel_path", "left_anti")
    writer = samples.write.mode("overwrite" if rewrite else "append").partitionBy("rel_path")
    writer.option("partitionOverwriteMode", "dynamic").json(out)


def write_arrays(samples: DataFrame, out: str, most: int = PIECE) -> None:
    """A folder for each input file (column ``rel_path``) with its samples in the order of column ``ord`` as JSON arrays of about
    ``most`` characters, in folders ``piece=0`` on: one array for an input file of up to that, more for a larger one, so that
    no task writes or reads a large file alone. An input file without samples is not written. Only the lengths of an input file's samples are
    summed up in one task; samples are written aside first, as they are read twice."""
    spark, columns = samples.sparkSession, [c for c in samples.columns if c not in ("rel_path", "ord")]
    aside = shared(spark, "samples")
    text = F.to_json(F.struct(*columns), {"pretty": "true"})
    samples.select("rel_path", "ord", text.alias("text"), F.monotonically_increasing_id().alias("row")).write.parquet(aside)
    made = spark.read.parquet(aside)
    w = Window.partitionBy("rel_path").orderBy("ord", "row").rowsBetween(Window.unboundedPreceding, 0)
    lengths = made.select("rel_path", "ord", "row", F.length("text").cast("bigint").alias("n"))
    piece = lengths.withColumn("upto", F.sum("n").over(w)).select("row", F.floor((F.col("upto") - F.col("n")) / most).alias("piece"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "row", "text"))), lambda x: x.text)
    arrays = made.join(piece, "row").groupBy("rel_path", "piece").agg(F.concat(F.lit("[ "), F.array_join(rows, ", "), F.lit(" ]")).alias("value"))
    arrays.write.partitionBy("rel_path", "piece").option("maxRecordsPerFile", 1).text(out)


def session_records(turns: DataFrame, light: bool = False) -> DataFrame:
    """session, total_turns, total_us and the ordered predictions of each session; ``light`` leaves the texts out.
    ``turns``: session, t, us, output. A session's predictions are one row, as its record is one document."""
    row = F.struct("t", "us", F.lit(None).cast("string").alias("output")) if light else F.struct("t", "us", "output")
    return turns.groupBy("session").agg(F.count("*").alias("total_turns"), (F.max("us") - F.min("us")).alias("total_us"), F.array_sort(F.collect_list(row)).alias("predictions"))


def write_stream(df: DataFrame, out: str, checkpoint: str):
    """Everything the stream holds now, appended to Parquet exactly once; returns when it is written."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
