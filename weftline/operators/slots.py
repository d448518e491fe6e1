"""Slots for models: any callable from a list of texts to a list of texts, called with Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import background_result, let

Model = Callable[[list[str]], list[str]]


def asked(prompt: Column, model: Model) -> Column:
    """The model's answers; null prompts are not sent and answer null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        sent = prompts[prompts.notna()]
        answers = pd.Series(model(sent.tolist()) if len(sent) else [], index=sent.index, dtype=object)
        return answers.reindex(prompts.index)

    return run(prompt)


def decided(df: DataFrame, query: str, prompt: str, model: Model, to: str = "output") -> DataFrame:
    """Adds ``to``: silence while no query is known, without asking the model, else its answer."""
    answer = asked(F.when(F.col(query).isNotNull(), F.col(prompt)), model)
    return df.withColumn(to, F.when(F.col(query).isNull(), "</silence>").otherwise(answer))


def compressed(df: DataFrame, keys: list[str], order: str, label: str, text: str, model: Model) -> DataFrame:
    """``keys`` and body: the texts of a batch in order, compressed by the model and headed by the batch's range, from
    its first label to its last. A batch is what one call of the model takes, so its size is bounded by the keys."""
    rows = F.array_sort(F.collect_list(F.struct(order, label, text)))
    g = df.groupBy(*keys).agg(rows.alias("rows"))
    head = F.concat(F.lit("<"), F.get("rows", F.lit(0))[label], F.lit(" - "), F.element_at("rows", -1)[label], F.lit(">\n"))
    parts = F.array_join(F.transform("rows", lambda r: r[text]), "\n")
    return g.select(*keys, F.concat(head, asked(parts, model)).alias("body"))


def summarised(keys: Column, told: Column, label: Column, template: str, model: Model) -> Column:
    """A chunk's summary by the model; a chunk without key frames is not sent and takes ``template``, in which its label
    stands for ``{range}``."""
    return F.when(keys == 0, F.replace(F.lit(template), F.lit("{range}"), label)).otherwise(asked(F.when(keys > 0, told), model))


def token_count(text: Column, tokenizer: Callable[[list[str]], list[list]] | None) -> Column:
    """Tokens of a text; without a tokenizer a quarter of its characters. Null and empty texts have none."""
    if tokenizer is None:
        return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("bigint")

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t) for t in tokenizer(texts.tolist())] if len(texts) else [], index=texts.index, dtype="int64")

    return run(F.coalesce(text, F.lit("")))


def transcribed(pcm: Column, rate: int, model: Callable[[list[bytes], int], list[str]]) -> Column:
    """What a recogniser hears in 16-bit samples at ``rate``; null, empty and odd ones are not sent and are null."""

    @F.pandas_udf("string")
    def run(samples: pd.Series) -> pd.Series:
        sent = samples[samples.map(lambda x: x is not None and len(x) > 0 and len(x) % 2 == 0)]
        heard = pd.Series(model([bytes(x) for x in sent], rate) if len(sent) else [], index=sent.index, dtype=object)
        return heard.reindex(samples.index)

    return run(pcm)


def solved(question: Column, model: Model) -> Column:
    """struct(error, body, summary) of a background solver, a model that answers with JSON (status, text, summary_text,
    error); an answer that is no JSON is its text. Null questions are not sent and are null."""

    def read(answer):
        said = lambda r: F.when(F.try_parse_json(answer).isNull(), answer).otherwise(r["text"])
        result = lambda r: background_result(r["status"], r["error"], said(r), r["summary_text"])
        return F.when(answer.isNotNull(), let(F.from_json(answer, "status string, text string, summary_text string, error string"), result))

    return let(asked(question, model), read)
