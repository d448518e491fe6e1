"""PCM packets: a 12-byte big-endian header (number, status, reserved) and 16-bit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import let, speech_parts


def _int32(x: Column) -> Column:
    """Four bytes as a signed number."""
    n = F.conv(F.hex(x), 16, 10).cast("bigint")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def pack(seqid: Column, status: Column, reserved: Column, audio: Column) -> Column:
    word = lambda c: F.unhex(F.right(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit(8)))
    return F.concat(word(seqid), word(status), word(reserved), audio)


def unpack(frame: Column) -> Column:
    """struct(seqid, status, audio); null for frames shorter than the header."""
    return F.when(F.length(frame) >= 12, F.struct(_int32(F.substring(frame, 1, 4)).alias("seqid"), _int32(F.substring(frame, 5, 4)).alias("status"), F.substr(frame, F.lit(13)).alias("audio")))


def until_final(df: DataFrame) -> DataFrame:
    """Rows of each session up to the first ``final`` one, with it."""
    before = Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("over", F.max("final").over(before)).where("NOT coalesce(over, false)").drop("over")


def rechunk(df: DataFrame, size: int) -> DataFrame:
    """(session, slice, n_bytes, n_packets): packets of ``n`` bytes in order of t, cut into slices of ``size``."""
    upto = F.sum("n").over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("b", upto).withColumn("a", F.col("b") - F.col("n")).where("n > 0")
    x = x.withColumn("slice", F.explode(F.sequence(F.floor(F.col("a") / size).cast("bigint"), F.floor((F.col("b") - 1) / size).cast("bigint"))))
    return x.groupBy("session", "slice").agg(F.sum(F.least("b", (F.col("slice") + 1) * size) - F.greatest("a", F.col("slice") * size)).alias("n_bytes"), F.count("*").alias("n_packets"))


def slices(df: DataFrame, size: int) -> DataFrame:
    """(session, slice, audio): the bytes of ``audio`` in order of t, cut into slices of ``size``; the last has the rest. A packet
    meets only the slices it reaches into, so what is gathered is a slice."""
    n = F.coalesce(F.length("audio"), F.lit(0)).cast("bigint")
    upto = F.sum(n).over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    x = df.select("session", "t", "audio", upto.alias("b"), n.alias("n")).withColumn("a", F.col("b") - F.col("n")).where("n > 0")
    x = x.withColumn("slice", F.explode(F.sequence(F.floor(F.col("a") / size).cast("bigint"), F.floor((F.col("b") - 1) / size).cast("bigint"))))
    first = F.greatest(F.col("slice") * size - F.col("a"), F.lit(0))
    part = F.substr("audio", (first + 1).cast("int"), (F.least("b", (F.col("slice") + 1) * size) - F.col("a") - first).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("t", part.alias("part"))))
    return x.groupBy("session", "slice").agg(F.aggregate(parts, F.lit(b""), lambda made, p: F.concat(made, p["part"])).alias("audio"))


def _little(x: Column, at: int, n: int) -> Column:
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring(x, at, n)), F.lit(".."), F.lit(0))), ""), 16, 10).cast("bigint")


def wav(pcm: Column, rate: int) -> Column:
    """A mono 16-bit WAV file of the samples."""
    word = lambda c, n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(c.cast("bigint")), 2 * n, "0"), F.lit(".."), F.lit(0))), ""))
    size = F.length(pcm)
    ascii = lambda text: F.lit(text).cast("binary")
    return F.concat(ascii("RIFF"), word(size + 36, 4), ascii("WAVEfmt "), word(F.lit(16), 4), word(F.lit(1), 2), word(F.lit(1), 2), word(F.lit(rate), 4), word(F.lit(2 * rate), 4), word(F.lit(2), 2), word(F.lit(16), 2), ascii("data"), word(size, 4), pcm)


def read_wav(x: Column) -> Column:
    """struct(rate, pcm, reason) of a WAV file with the usual 44-byte header; reason is null where it is readable."""
    reason = F.when((F.length(x) < 44) | (F.substring(x, 1, 4) != F.lit("RIFF").cast("binary")), "no wav").when(_little(x, 23, 2) != 1, "not mono").when(_little(x, 35, 2) != 16, "not 16 bit")
    ok = reason.isNull()
    return F.struct(F.when(ok, _little(x, 25, 4)).alias("rate"), F.when(ok, F.substr(x, F.lit(45), _little(x, 41, 4).cast("int"))).alias("pcm"), reason.alias("reason"))


def packet_fault(frame: Column) -> Column:
    """Why a packet is refused: short, empty or of odd length; null where it is not."""
    n = F.length(frame) - 12
    return F.when(n < 0, "short header").when(n == 0, "empty audio").when(n % 2 == 1, "odd length")


def asr_result(request: Column, text: Column, kind: Column, code: Column, msg: Column) -> Column:
    """A recognition result as a JSON message."""
    said = F.struct(F.array(F.struct(text.alias("text"), F.lit(None).cast("double").alias("confidence"))).alias("hypothesis"))
    return F.to_json(F.struct(code.alias("code"), msg.alias("msg"), request.alias("mid"), F.struct(kind.alias("event_type"), said.alias("recognition_result")).alias("asr_response")))


def read_asr(message: Column) -> Column:
    """struct(kind, text, msg, code) of such a message; text is that of the first hypothesis."""
    m = F.from_json(message, "code bigint, msg string, mid string, asr_response struct<event_type: string, recognition_result: struct<hypothesis: array<struct<text: string>>>>")
    response = m["asr_response"]
    return F.struct(response["event_type"].alias("kind"), F.get(response["recognition_result"]["hypothesis"], F.lit(0))["text"].alias("text"), m["msg"].alias("msg"), m["code"].alias("code"))


def speech_messages(text: Column, most: int | None = 2000) -> Column:
    """struct(kind, text) in order: the parts of a text, ``most`` characters of it or all, to append, then the commit; an
    error where nothing is said."""

    def made(parts):
        end = F.struct(F.when(F.size(parts) == 0, "error").otherwise("commit").alias("kind"), F.lit(None).cast("string").alias("text"))
        return F.concat(F.transform(parts, lambda p: F.struct(F.lit("append").alias("kind"), p.alias("text"))), F.array(end))

    return let(speech_parts(text, most=most), made)
