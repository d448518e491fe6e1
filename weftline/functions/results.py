"""Column functions on what a background service answers: JSON records of several shapes, or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.jsontext import flexible_text
from weftline.functions.text import clean_summary, let, split_summary, strip, strip_reasoning

# What a record tells of its run besides the answer.
TOLD = ("thread_id", "usage", "duration_ms", "events_digest")


def kind(v: Column) -> Column:
    """The type of a variant: OBJECT, ARRAY, STRING and so on; VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]*", 0)


def result_records(df: DataFrame, column: str, to: str = "result") -> DataFrame:
    """``df`` with ``to``: struct(error, body, summary, rich, metrics) of the background answer in ``column``.

    Of a JSON object: an error unless it is completed and has text, which is its ``text`` or else its ``answer``; a summary
    given with it (``summary_text``, then ``background_summary``) comes before that of a tag in the text; ``rich`` is kept
    as JSON if it is an object; ``metrics`` holds what the record tells of its run, as JSON, under the metrics it brings.
    Anything else is plain text, which may be empty, with no metrics. Null is empty text.
    """
    raw, own_name = F.col(column), "weftline_said"
    whole = F.try_parse_json(raw)
    part = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    json = lambda name: F.to_json(part(name))
    given = lambda name: F.when(~json(name).isin("null", '""', "0", "false", "[]", "{}"), json(name))
    shown = lambda name: F.when(given(name).isNotNull(), F.get_json_object(raw, f"$.{name}"))
    said = flexible_text(F.when(kind(whole) == "OBJECT", F.coalesce(given("text"), json("answer"), F.lit("null"))).otherwise(F.coalesce(raw, F.lit("null"))))
    own = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.coalesce(json(n), F.lit("null"))) for n in TOLD]))
    brought = F.transform_values(F.try_variant_get(whole, "$.metrics", "map<string,variant>"), lambda _, v: F.to_json(v))
    none = F.map_from_entries(F.array().cast("array<struct<k: string, v: string>>"))
    merged = let(F.when(kind(part("metrics")) == "OBJECT", brought).otherwise(none), lambda b: F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(b, k)), b))
    texts = [said, *(flexible_text(F.coalesce(json(n), F.lit("null"))) for n in ("summary_text", "background_summary"))]
    df = df.withColumn(own_name, F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)]))
    summaries = [F.nullif(clean_summary(F.col(f"{own_name}.t{i}")), F.lit("")) for i in (1, 2)]

    def made(parts):
        state = F.coalesce(shown("status"), F.lit("completed"))
        fault = F.when(state != "completed", F.coalesce(shown("error"), F.concat(F.lit("Background service returned status="), state))).when(parts["body"] == "", "Background service returned empty text")
        fault = F.when(kind(whole) == "OBJECT", fault)
        ok = fault.isNull()
        told = F.when(kind(whole) == "OBJECT", F.coalesce(*summaries, parts["summary"])).otherwise(parts["summary"])
        rich = F.when(ok & (kind(whole) == "OBJECT") & (kind(part("rich")) == "OBJECT"), json("rich"))
        return F.struct(fault.alias("error"), F.when(ok, parts["body"]).alias("body"), F.when(ok, told).alias("summary"), rich.alias("rich"), F.when(ok, F.when(kind(whole) == "OBJECT", merged).otherwise(none)).alias("metrics"))

    return df.withColumn(to, let(split_summary(strip_reasoning(strip(F.col(f"{own_name}.t0")))), made)).drop(own_name)
