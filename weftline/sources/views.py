"""Role views: the driver's tables seen as sessions of turns, frames, outputs and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one session a user: session, event_id, us (epoch microseconds), t (1-based turn),
    event_type, value, prompt (signup events ask) and answered (view and purchase events respond)."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    prompt = F.when(F.col("event_type") == "signup", F.concat(F.lit("ask "), (F.col("event_id") % 3).cast("string")))
    order = Window.partitionBy("session").orderBy("us", "event_id")
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", us.alias("us"), "event_type", "value", prompt.alias("prompt"), F.col("event_type").isin("view", "purchase").alias("answered"))
    return df.withColumn("t", F.row_number().over(order).cast("bigint"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: session, turn, role, text, t (1-based) and prompt (a user's non-blank text)."""
    prompt = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("text"))
    df = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", prompt.alias("prompt"))
    return df.withColumn("t", F.row_number().over(Window.partitionBy("session").orderBy("turn", "role", "text")).cast("bigint"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw model outputs: id and raw, whose marker depends on the id."""
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.lit("</silence>")).when(k == 1, F.concat(F.lit("</response> "), "text")).when(k == 2, F.concat(F.lit("<think>plan</think>\r\n</response> "), F.col("text"))).when(k == 3, F.concat(F.lit("</response> Working on it </delegation> "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", raw.alias("raw"))


FRAMES = """frames AS (SELECT user_id AS session, event_id, epoch_us(ts) AS us, event_type, value,
 CASE WHEN event_type = 'signup' THEN 'ask ' || (event_id % 3)::VARCHAR END AS prompt, event_type IN ('view', 'purchase') AS answered,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"""

TURNS = """turns AS (SELECT conv_id AS session, turn, role, text, CASE WHEN role = 'user' AND trim(text) <> '' THEN text END AS prompt,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS t FROM conversations)"""

OUTPUTS = """outputs AS (SELECT doc_id AS id, text, CASE doc_id % 5 WHEN 0 THEN '</silence>' WHEN 1 THEN '</response> ' || text
 WHEN 2 THEN '<think>plan</think>' || chr(13) || chr(10) || '</response> ' || text WHEN 3 THEN '</response> Working on it </delegation> ' || text ELSE text END AS raw FROM documents)"""
