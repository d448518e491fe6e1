"""Whole files from rows: a Python data source that writes each row's bytes to a path of its own, all of a job or none.

Tasks write aside, into a folder of the job, and name what they wrote; when all tasks are done the driver moves the named
files to their places and removes the folder. A file may come in several rows of one task, one after another, so that a
large one is never a value. A failed job leaves no file behind, a task that ran twice is moved once.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "weftline_documents"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: (place aside, path)."""

    files: list


def opened(uri: str):
    """(file system, path) of a folder: local, or any that Arrow reaches, such as hdfs or s3."""
    from pyarrow import fs

    plain = uri.removeprefix("file:") if uri.startswith("file:") else uri.replace("s3a://", "s3://", 1)
    if plain.startswith("/"):
        return fs.LocalFileSystem(), "/" + plain.strip("/")
    system, path = fs.FileSystem.from_uri(plain)
    return system, path.rstrip("/")


def checked(path: str | None) -> str:
    """A relative path that stays below its folder; anything else is an error."""
    own = PurePosixPath(path or "")
    if not own.name or own.is_absolute() or ".." in own.parts or own.parts[0].startswith("_staging-"):
        raise ValueError(f"no path below the output folder: {path!r}")
    return str(own)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.out, self.rewrite = options["path"], overwrite or options.get("rewrite", "false").lower() == "true"
        self.between = options["between"].encode() if "between" in options else None  # else a row is a file
        self.opening, self.closing = options.get("opening", "").encode(), options.get("closing", "").encode()
        self.aside = f"_staging-{uuid.uuid4().hex}"
        system, out = opened(self.out)
        system.create_dir(f"{out}/{self.aside}", recursive=True)  # here, so that a task of a job that failed cannot bring it back

    def _exists(self, system, place: str) -> bool:
        from pyarrow import fs

        return system.get_file_info(place).type != fs.FileType.NotFound

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, out = opened(self.out)
        made = []
        folder = f"{out}/{self.aside}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=False)
        for given, own in groupby(rows, key=lambda row: row["rel_path"]) if self.between is not None else ((row["rel_path"], [row]) for row in rows):
            path = checked(given)
            if not self.rewrite and self._exists(system, f"{out}/{path}"):
                continue
            place = f"{folder}/{len(made)}"
            with system.open_output_stream(place) as f:
                f.write(self.opening)
                for n, row in enumerate(own):
                    if n:
                        f.write(self.between)
                    f.write(bytes(row["content"] or b""))
                f.write(self.closing)
            made.append((place, path))
        return Staged(made)

    def commit(self, messages: list) -> None:
        system, out = opened(self.out)
        files = [f for m in messages if m is not None for f in m.files]
        twice = [p for p, n in Counter(path for _, path in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows for one file: {sorted(twice)[:5]}")
        for place, path in files:
            final = f"{out}/{path}"
            if self._exists(system, final):
                if not self.rewrite:
                    continue
                system.delete_file(final)
            system.create_dir(final.rsplit("/", 1)[0], recursive=True)
            system.move(place, final)
        self.abort(messages)  # what is left aside

    def abort(self, messages: list) -> None:
        system, out = opened(self.out)
        if self._exists(system, f"{out}/{self.aside}"):
            system.delete_dir(f"{out}/{self.aside}")


class DocumentSource(DataSource):
    """Format ``weftline_documents``: writes (rel_path string, content binary) below the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "rel_path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(dict(self.options), overwrite)


def write_documents(df: DataFrame, out: str, rewrite: bool = False) -> None:
    """Writes ``content`` of each row to ``out``/``rel_path``; files that exist stay as they are unless ``rewrite``. Two rows of one
    path, or a path that leaves ``out``, fail the job, and nothing of it is written. A null content makes an empty file;
    other columns are not read. The driver gets a name for each file."""
    df.sparkSession.dataSource.register(DocumentSource)
    rows = df.select(F.col("rel_path").cast("string").alias("rel_path"), F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).mode("append").option("rewrite", str(rewrite).lower()).save(out)


def write_json_arrays(samples: DataFrame, out: str, rewrite: bool = False) -> None:
    """What ``json_arrays`` gives, written to ``out``/``rel_path`` as ``write_documents`` does, a sample at a time: an input file is
    written by one task, but never held by it. Samples of one ``ord`` come in any order."""
    spark, columns = samples.sparkSession, [c for c in samples.columns if c not in ("rel_path", "ord")]
    spark.dataSource.register(DocumentSource)
    rows = samples.select(F.col("rel_path").cast("string").alias("rel_path"), "ord", F.to_json(F.struct(*columns), {"pretty": "true"}).cast("binary").alias("content"))
    rows = rows.repartition("rel_path").sortWithinPartitions("rel_path", "ord").select("rel_path", "content")
    with small_arrow_batches(spark):
        rows.write.format(FORMAT).mode("append").options(rewrite=str(rewrite).lower(), opening="[ ", between=", ", closing=" ]").save(out)


@contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = 64):
    """At most so many rows reach Python at a time in what runs within; the session's own number comes back after."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def json_arrays(samples: DataFrame) -> DataFrame:
    """(rel_path, content): the samples of each input file (column ``rel_path``) as one JSON array in the order of column ``ord``. An
    input file's samples are one value, as its output is one document; a file without samples gives no row."""
    columns = [c for c in samples.columns if c not in ("rel_path", "ord")]
    rows = F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("r"))), lambda a, b: F.when(a.ord < b.ord, -1).when(a.ord > b.ord, 1).otherwise(0))
    return samples.groupBy("rel_path").agg(F.to_json(F.transform(rows, lambda x: x.r), {"pretty": "true"}).alias("content"))


def images(df: DataFrame, path: Column, url: Column) -> DataFrame:
    """(rel_path, content) of the inline images of ``df``: decoded bytes; rows whose address holds no image are left out."""
    from weftline.functions.values import image_bytes

    return df.select(path.alias("rel_path"), image_bytes(url).alias("content")).where("content IS NOT NULL")


def wavs(df: DataFrame, path: Column, pcm: Column, rate: int) -> DataFrame:
    """(rel_path, content): samples as mono 16-bit WAV files."""
    from weftline.functions.audio import wav

    return df.select(path.alias("rel_path"), wav(pcm, rate).alias("content"))


def stored(spark: SparkSession, out: str, pattern: str = "*") -> DataFrame:
    """(rel_path, content) of the files below ``out``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(out)
    base = spark._jvm.org.apache.hadoop.fs.Path(out).toUri().getPath()
    return df.select(F.expr("substr(path, locate(:base, path) + length(:base) + 1)".replace(":base", "'" + base.replace("'", "''") + "'")).alias("rel_path"), "content")
