"""Functions on JSON whose shape is not known: the first object in a text, the text of any value, a stable form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(text: str | None) -> str | None:
    at = (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def first_object(text: Column) -> Column:
    """The first JSON object anywhere in a text, with sorted keys; text may follow it. Null where there is none."""

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(_first)

    return F.pandas_udf(find, "string")(text)


def _text(value) -> str:
    if isinstance(value, list):
        picked = [next((v[k] for k in ("text", "content", "value") if v.get(k)), "") for v in value if isinstance(v, dict)]
        return "\n".join(t for t in map(_text, picked) if t).strip()
    if isinstance(value, dict):
        found = next((t for t in (_text(value.get(k)) for k in ("text", "content", "value")) if t), "")
        return found or json.dumps(value, ensure_ascii=False, indent=2)
    return "" if value is None else str(value).strip()


def _flexible(raw: str | None) -> str:
    try:
        return _text(json.loads(raw or "null"))
    except ValueError:
        return raw.strip()


def flexible_text(raw: Column) -> Column:
    """The text of a JSON value: a string itself, of a list its items' texts by line, of an object its text, content
    or value, or else the object. What is no JSON is text; null is empty."""

    def read(values: pd.Series) -> pd.Series:
        return values.map(_flexible)

    return F.pandas_udf(read, "string")(raw)


def canonical_hash(entries: Column) -> Column:
    """A digest of a map that does not depend on the order in which it was filled: its JSON by key, hashed."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def agent_digest(log: DataFrame) -> DataFrame:
    """A row a session of ``log`` (session, line_no, line): counts by event type and by item type (``type=n``, by comma),
    the last thread_id, usage (JSON) and last_message, n_searches, n_commands, and n_errors, the lines that are no object.

    Lines are counted by session, type and item first, so a session holds no more than its kinds of lines.
    """
    read = lambda path: F.get_json_object("line", path)
    known = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))
    is_object = lambda x: F.coalesce(F.startswith(F.ltrim(x), F.lit("{")), F.lit(False))
    ok = F.try_parse_json("line").isNotNull() & is_object(F.col("line"))
    lines = log.withColumn("ok", F.coalesce(ok, F.lit(False)))
    lines = lines.withColumns({"type": F.when(F.col("ok"), known(read("$.type"))), "item": F.when(F.col("ok") & is_object(read("$.item")), known(read("$.item.type")))})
    said = F.trim(read("$.item.text"))
    thread, usage = (F.col("type") == "thread.started") & (read("$.thread_id") != ""), (F.col("type") == "turn.completed") & is_object(read("$.usage"))
    message = (F.col("type") == "item.completed") & (F.col("item") == "agent_message") & (said != "")
    last = lambda what, test, name: F.max(F.when(test, F.struct("line_no", what.alias("what")))).alias(name)
    kinds = lines.groupBy("session", "type", "item").agg(F.count("*").alias("n"), last(read("$.thread_id"), thread, "thread"), last(read("$.usage"), usage, "used"), last(said, message, "said"))

    def counts(of: str) -> DataFrame:
        rows = kinds.where(F.col(of).isNotNull()).groupBy("session", of).agg(F.sum("n").alias("n"))
        pairs = F.transform(F.array_sort(F.collect_list(F.struct(of, "n"))), lambda r: F.concat(r[of], F.lit("="), r.n.cast("string")))
        return rows.groupBy("session").agg(F.array_join(pairs, ",").alias(f"{of}s"))

    items = lambda item: F.coalesce(F.sum(F.when(F.col("item") == item, F.col("n"))), F.lit(0))
    whole = kinds.groupBy("session").agg(F.max("thread")["what"].alias("thread_id"), F.max("used")["what"].alias("usage"), F.max("said")["what"].alias("last_message"), items("web_search").alias("n_searches"), items("command_execution").alias("n_commands"), F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("n"))), F.lit(0)).alias("n_errors"))
    return whole.join(counts("type"), "session", "left").join(counts("item"), "session", "left").select("session", F.coalesce("types", F.lit("")).alias("events"), F.coalesce("items", F.lit("")).alias("items"), "thread_id", "usage", "last_message", "n_searches", "n_commands", "n_errors")
