"""Column functions on chat requests: messages as array<struct<role, text, parts array<struct<type, text, url>>>>, where
``text`` is a message's plain content and ``parts`` its list content, one of them null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import let, strip

# The keys of a light prediction and the prefix of a file's address.
LIGHT = ("turn", "time_range", "query", "prediction", "total_time", "inference_time", "fourb_mid_term_inference_time", "fourb_long_term_inference_time", "ground_truth")
FILE = "file://"


def user_prompt(messages: Column) -> Column:
    """The newest user message's text, its text parts that say something by line; empty where there is none."""
    newest = F.try_element_at(F.filter(messages, lambda m: (m["role"] == "user") & (m["text"].isNotNull() | m["parts"].isNotNull())), F.lit(-1))
    said = F.filter(F.transform(F.filter(newest["parts"], lambda p: p["type"] == "text"), lambda p: strip(p["text"])), lambda t: t != "")
    return F.when(F.size(messages) > 0, F.coalesce(strip(F.coalesce(newest["text"], F.array_join(said, "\n"))), F.lit(""))).otherwise("")


def file_path(url: Column) -> Column:
    """The path of a file's address on this host; null for other addresses."""
    host = F.regexp_extract(url, "^file://([^/]*)", 1)
    path = F.regexp_extract(url, "^file://[^/?#]*([^?#]*)", 1)
    return F.when(F.startswith(url, F.lit(FILE)) & host.isin("", "localhost"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def image_ref(url: Column) -> Column:
    """struct(kind, value): the path of a file, else the address as it is."""
    path = file_path(url)
    return F.struct(F.when(path.isNull(), "data_url").otherwise("path").alias("kind"), F.coalesce(path, url).alias("value"))


def image_refs(messages: Column, local: Column | None = None) -> Column:
    """The images of the newest message that has any, in order, behind ``local``, a path the request names itself. With
    such a path only the newest message of parts is looked at."""
    urls = lambda m: F.transform(F.filter(m["parts"], lambda p: (p["type"] == "image_url") & (p["url"] != "")), lambda p: image_ref(p["url"]))
    listed = F.filter(messages, lambda m: m["parts"].isNotNull())
    own = F.coalesce(urls(F.try_element_at(F.filter(listed, lambda m: F.exists(m["parts"], lambda p: (p["type"] == "image_url") & (p["url"] != ""))), F.lit(-1))), F.array())
    if local is None:
        return own
    newest = F.coalesce(urls(F.try_element_at(listed, F.lit(-1))), F.array())
    return F.when(F.coalesce(strip(local), F.lit("")) != "", F.concat(F.array(F.struct(F.lit("path").alias("kind"), strip(local).alias("value"))), newest)).otherwise(own)


def ref_fault(ref: Column) -> Column:
    """Why an image reference is refused before its path is looked at; null where it is not."""
    bad = ~F.rlike(ref["value"], F.lit(r"^data:image/\w+;base64,.+"))
    return F.when(ref["kind"] == "data_url", F.when(bad, "invalid data URL format")).when(ref["kind"] == "path", F.lit(None)).otherwise("unsupported image reference kind")


def prompt_labels(language: Column) -> Column:
    """struct(query, response): the labels of archived questions; any language but English takes the Chinese ones."""
    return F.when(language == "en", F.struct(F.lit("Query").alias("query"), F.lit("Response").alias("response"))).otherwise(F.struct(F.lit("提问").alias("query"), F.lit("回复").alias("response")))


def model_input(skipped: Column, reason: Column, model: Column, messages: Column, settings: Column) -> Column:
    """The record of what the model was sent: for a turn without inference why, and what would have been sent."""
    none = F.lit(None)
    sent = F.struct(F.lit(False).alias("skipped"), none.cast("string").alias("reason"), model.alias("model"), messages.alias("messages"), settings.alias("settings"))
    return F.when(skipped, F.struct(F.lit(True).alias("skipped"), reason.alias("reason"), none.cast("string").alias("model"), messages.alias("messages"), none.cast("map<string,string>").alias("settings"))).otherwise(sent)


def light_prediction(prediction: Column) -> Column:
    """The entries of a prediction (a map of texts) that a light record keeps."""
    return F.map_filter(prediction, lambda k, _: k.isin(*LIGHT))


# A JSON string that is an inline image and no key.
INLINE = r'"data:image\\?/[^"\\]*+(?:\\.[^"\\]*+)*+"(?!\s*:)'


def marked(parts: Column, least: int = 200) -> Column:
    """array<struct(text, image)> of texts in order: an inline image of more than ``least`` characters leaves its place to a mark,
    numbered from 0. Images are numbered among themselves and sorted back, so no part is compared with those before."""
    big = lambda s: F.coalesce(F.startswith(s["p"], F.lit("data:image/")) & (F.length(s["p"]) > least), F.lit(False))
    indexed = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    images = F.transform(F.filter(indexed, big), lambda s, n: F.struct(s["i"].alias("i"), F.concat(F.lit("__image_"), n.cast("string"), F.lit("__")).alias("text"), s["p"].alias("image")))
    others = F.transform(F.filter(indexed, lambda s: ~big(s)), lambda s: F.struct(s["i"].alias("i"), s["p"].alias("text"), F.lit(None).cast("string").alias("image")))
    return F.transform(F.array_sort(F.concat(images, others)), lambda x: F.struct(x["text"].alias("text"), x["image"].alias("image")))


def without_images(record: Column, least: int = 200) -> Column:
    """struct(record, images) of a JSON text: inline images of more than ``least`` characters at any depth leave their places to
    marks numbered from 0 in the order of the text, which is depth-first; images is array<struct<key, image>>. Images are
    told by their first letters as they stand, of which only the slash may be escaped. Null for text that is no JSON."""
    found = F.regexp_extract_all(record, F.lit(INLINE), F.lit(0))
    read = F.transform(found, lambda f: F.get_json_object(F.concat(F.lit("["), f, F.lit("]")), "$[0]"))

    def made(parts):
        gaps = F.split(record, INLINE)
        place = lambda i: F.when(F.get(parts, i)["image"].isNotNull(), F.concat(F.lit('"'), F.get(parts, i)["text"], F.lit('"'))).otherwise(F.get(found, i))
        joined = F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(place(i - 1), g))), "")
        images = F.transform(F.filter(parts, lambda p: p["image"].isNotNull()), lambda p: F.struct(p["text"].alias("key"), p["image"].alias("image")))
        return F.struct(joined.alias("record"), images.alias("images"))

    return F.when(F.try_parse_json(record).isNotNull(), let(marked(read, least), made))


def attached(answer: Column, result: Column) -> Column:
    """An answer and the result that rides on it."""
    return let(result, lambda r: F.struct(answer.alias("answer"), r.alias("result")))
