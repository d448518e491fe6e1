"""Helpers that several operators share: shared-folder tables, bounded samples, byte words."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-weftline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of its own
    for a local master, as in tests; on a cluster an error, as no folder of one machine is seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text (null id: crc32 of the empty text, 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def in_share(lot: str, n: float, total: int) -> Column:
    """Whether a hash is among about the ``n`` smallest of ``total`` even 64-bit ones; all of them are if n is total."""
    return F.col(lot) <= min(2**63 - 1, int(min(1.0, n / max(total, 1)) * 2**64) - 2**63)


def smallest(df: DataFrame, lot: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest ``lot``, a column of even 64-bit hashes, out of about ``total``. Only rows
    below about twice the share wanted are ranked, so that no task or driver gets more than about 2 n rows."""
    return df.where(in_share(lot, 2 * n + 100, total)).orderBy(lot).limit(n)


def bounded_sample(df: DataFrame, n: int, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows of ``df``, picked by the hash of ``key``: the same rows on each run.

    Only keys are counted and ranked; the rows follow by a broadcast semi join whose size is bounded by ``n`` keys. Rows
    with a null key are never picked; repeated keys come along.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    keys = smallest(keys.withColumn("weftline_lot", F.xxhash64(F.col(key), F.lit(seed))), "weftline_lot", n, keys.count()).select(key)
    return df.join(F.broadcast(keys), key, "left_semi")


def one_row_each(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each ``key``, the smallest by the other columns in their order: a key that repeats without bound
    cannot gather rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased: bytes.lower and bytes.split touch ASCII only."""
    return raw.lower().split()


def small_batches(batches, rows: int = 512):
    """Cut Arrow batches so that what a step builds for one of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
