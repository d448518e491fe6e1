"""Paths in texts become links where a table of files has them.

Which files exist is data, not a question to a disk: candidate paths are joined with the table, and only the ones
found travel back to their text.
"""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a path and a code span look like, what may follow a path, where links lead.
PATH = r"(?<![\w:/])/(?:[^\s<>'\"`()\[\]{}]+/)*[^\s<>'\"`()\[\]{}]+\.[A-Za-z0-9]{1,12}"
CODE = r"```[\s\S]*?(?:```|$)|`[^`\n]+`"
AFTER, ROUTE = ".,;:!?，。；：！？", "/api/local-file"


def linked(text: str | None, files: frozenset[str], route: str = ROUTE) -> str:
    """One text: outside code, a path of ``files`` becomes a link, or a bare address behind an opening bracket."""

    def link(m: re.Match) -> str:
        if m[0][0] == "`":
            return m[0]
        path = m[0].rstrip(AFTER)
        if path not in files:
            return m[0]
        url = f"{route}?path={quote(path, safe='')}"
        name = re.sub(r"([\\\[\]])", r"\\\1", path.rsplit("/", 1)[1])
        return (url if m.string[: m.start()][-1:] == "(" else f"[{name}]({url})") + m[0][len(path) :]

    return re.sub(f"{CODE}|{PATH}", link, text or "")


def rewrite(df: DataFrame, files: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Replaces column ``text``; ``files`` has column path. Null text is empty; rows with a null key are kept as
    they are but for that. Keys are unique. One text's paths are gathered in one row."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([linked(t, frozenset(f if f is not None else ())) for t, f in zip(texts, found, strict=True)])

    raw = F.transform(F.regexp_extract_all(F.col(text), F.lit(PATH), F.lit(0)), lambda p: F.rtrim(p, F.lit(AFTER)))
    paths = df.select(F.col(key).alias("__key"), F.explode(F.array_distinct(raw)).alias("path")).where("__key IS NOT NULL")
    found = paths.join(files.select("path").distinct(), "path", "left_semi").groupBy("__key").agg(F.collect_set("path").alias("__paths"))
    out = df.join(found, df[key] == found["__key"], "left")
    return out.withColumn(text, put(F.col(text), F.col("__paths"))).select(*df.columns)
