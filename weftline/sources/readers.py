"""Readers of raw inputs: annotation files, logs, WAV files, frame names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<content: string, time: string>"


ANNOTATION = f"video_name string, video_path string, task_type string, source string, question array<{EVENT}>, response string"


def _raw_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Samples with ``file`` and ``broken``, the text of a file that is no JSON. A path of one file is read whatever its
    name; of a folder all ``*.json`` at any depth but those named ``example.json``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.read.schema(f"{ANNOTATION}, broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    if not one:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    named = F.coalesce(F.length("video_name"), F.lit(0)) >= 0  # Spark refuses to read the broken texts alone
    df = reader.json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("ok", F.isnull("broken") & named)
    return df if one else df.where("_metadata.file_name <> 'example.json'")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Samples under ``path``: file, video_name, video_path, task_type, source, question, response. A file holds an array of
    samples or one; responses nested one level are flattened. ``annotation_faults`` names the files that give none."""
    df = _raw_annotations(spark, path).where("ok")
    nested = F.flatten(F.from_json("response", f"array<array<{EVENT}>>"))
    deep = F.rlike("response", F.lit(r"^\s*\[\s*\["))
    return df.withColumn("response", F.when(deep, nested).otherwise(F.from_json("response", f"array<{EVENT}>"))).select("file", "video_name", "video_path", "task_type", "source", "question", "response")


def annotation_faults(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` that are no JSON: file and how many characters they have."""
    return _raw_annotations(spark, path).where("NOT ok").select("file", F.length("broken").alias("n_chars"))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(dir, names): the files of each folder under ``path`` that match, names in order; no file is opened."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    named = df.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    return named.groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("names"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSONL logs: file, line, type, item_type, text, thread_id and valid (the line is an object)."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    read = lambda p: F.get_json_object("line", p)
    return df.select("file", "line", read("$.type").alias("type"), read("$.item.type").alias("item_type"), read("$.item.text").alias("text"), read("$.thread_id").alias("thread_id"), (F.try_parse_json("line").isNotNull() & F.rlike("line", F.lit(r"^\s*\{"))).alias("valid"))


def wav(spark: SparkSession, path: str) -> DataFrame:
    """Mono 16-bit WAV files: path, rate and pcm; ``reason`` says why another file has none."""
    from weftline.functions.audio import read_wav

    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return df.select("path", read_wav(F.col("content")).alias("r")).select("path", "r.*")


def frame_names(directory: Column, n: Column) -> Column:
    """``frame_000000.jpg`` on in a directory, ``n`` of them; none for less than one."""
    names = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint") - 1), lambda i: F.format_string("%s/frame_%06d.jpg", directory, i))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(names)
