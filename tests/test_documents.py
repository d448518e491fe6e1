"""Files from rows: paths, the skip rule, and nothing left of a job that fails."""

import base64
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.sinks import documents
from weftline.sources import readers


def files(place):
    return {str(p.relative_to(place)): p.read_bytes() for p in Path(place).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "rel_path string, content binary, path string").repartition(3)


def test_paths_and_skipping(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    documents.write_documents(frame(spark, [("a/b/1.json", b"one"), ("2 é.bin", b"\0\xff"), ("empty", None)]), out)
    assert files(tmp_path / "out") == {"a/b/1.json": b"one", "2 é.bin": b"\0\xff", "empty": b""}
    documents.write_documents(frame(spark, [("a/b/1.json", b"new"), ("3", b"three")]), out)
    assert files(tmp_path / "out")["a/b/1.json"] == b"one" and files(tmp_path / "out")["3"] == b"three"
    documents.write_documents(frame(spark, [("a/b/1.json", b"new")]), str(tmp_path / "out"), rewrite=True)
    assert files(tmp_path / "out")["a/b/1.json"] == b"new" and len(files(tmp_path / "out")) == 4
    documents.write_documents(frame(spark, []), out)
    assert len(files(tmp_path / "out")) == 4
    assert {(r.rel_path, bytes(r.content)) for r in documents.stored(spark, out, "*.json").collect()} == {("a/b/1.json", b"new")}


@pytest.mark.parametrize("bad", ["../x", "/x", "", None, "a/../../x", "_staging-1/x"])
def test_a_bad_path_writes_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception, match="no path below"):
        documents.write_documents(frame(spark, [(f"{i}", b"x") for i in range(9)] + [(bad, b"x")]), str(tmp_path / "out"))
    assert files(tmp_path) == {}


def test_a_failing_task_or_a_path_named_twice_writes_nothing(spark, tmp_path):
    place = tmp_path / "out"
    documents.write_documents(frame(spark, [("kept", b"old")]), str(place))
    with pytest.raises(Exception, match="several rows"):
        documents.write_documents(frame(spark, [("kept", b"a"), ("x", b"b"), ("x", b"c")]), str(place), rewrite=True)
    late = spark.range(0, 200, numPartitions=4).select(F.col("id").cast("string").alias("rel_path"), F.when(F.col("id") == 199, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="killed"):
        documents.write_documents(late, str(place), rewrite=True)
    assert files(place) == {"kept": b"old"} and [p.name for p in place.iterdir()] == ["kept"]


def test_arrays_images_and_sounds(spark, tmp_path):
    samples = spark.createDataFrame([("d/1.json", 2, "b", None), ("d/1.json", 1, "a", [1]), ("2.json", 5, "c", [])], "rel_path string, ord int, name string, seen array<int>")
    documents.write_documents(documents.json_arrays(samples), str(tmp_path / "json"))
    got = {k: json.loads(v) for k, v in files(tmp_path / "json").items()}
    assert got == {"d/1.json": [{"name": "a", "seen": [1]}, {"name": "b"}], "2.json": [{"name": "c", "seen": []}]}
    url = "data:image/jpeg;base64," + base64.b64encode(b"\xff\xd8picture").decode()
    df = spark.createDataFrame([(1, url), (2, "http://x"), (3, None)], "n int, url string")
    documents.write_documents(documents.images(df, F.format_string("img/%06d.jpg", "n"), F.col("url")), str(tmp_path / "img"))
    assert files(tmp_path / "img") == {"img/000001.jpg": b"\xff\xd8picture"}
    said = spark.createDataFrame([("a.wav", b"\1\2\3\4"), ("b.wav", b"")], "name string, pcm binary")
    documents.write_documents(documents.wavs(said, F.col("name"), F.col("pcm"), 16000), str(tmp_path / "wav"))
    assert {(r.path.rsplit("/")[-1], r.rate, bytes(r.pcm), r.reason) for r in readers.wav(spark, str(tmp_path / "wav")).collect()} == {("a.wav", 16000, b"\1\2\3\4", None), ("b.wav", 16000, b"", None)}


def test_large_arrays_are_never_one_value(spark, tmp_path):
    samples = spark.createDataFrame([(f"d/{i % 3}.json", 900 - i, i, "é" * (i % 40)) for i in range(600)], "rel_path string, ord int, n int, text string")
    documents.write_documents(documents.json_arrays(samples), str(tmp_path / "whole"))
    before = spark.conf.get(documents.BATCH)
    documents.write_json_arrays(samples, str(tmp_path / "parts"))
    assert files(tmp_path / "parts") == files(tmp_path / "whole") and len(files(tmp_path / "parts")) == 3
    documents.write_json_arrays(samples.withColumn("text", F.lit("new")), str(tmp_path / "parts"))
    assert files(tmp_path / "parts") == files(tmp_path / "whole") and spark.conf.get(documents.BATCH) == before
    writer = documents.DocumentWriter({"path": str(tmp_path / "own"), "opening": "[", "between": ",", "closing": "]"}, False)
    writer.commit([writer.write(iter([{"rel_path": "x", "content": str(i).encode()} for i in range(5)]))])
    assert files(tmp_path / "own") == {"x": b"[0,1,2,3,4]"}  # rows of a file were an error
