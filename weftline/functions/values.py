"""Column functions on settings, addresses and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import strip

# What counts as yes, what as no, and the settings that a request may pass on.
YES = ("1", "true", "yes", "y", "on")
NO = ("0", "false", "no", "off")
SAMPLING = ("skip_special_tokens", "top_k", "repetition_penalty", "min_p", "stop_token_ids", "include_stop_str_in_output")


def bounded(x: Column, default: int, least: int, most: int) -> Column:
    """The whole number that a text states, between ``least`` and ``most``; ``default`` for null and other texts."""
    number = F.when(F.rlike(x, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(x).try_cast("bigint"))
    return F.least(F.greatest(F.coalesce(number, F.lit(default).cast("bigint")), F.lit(least)), F.lit(most))


def is_yes(x: Column, default: bool) -> Column:
    """Whether a setting says yes; ``default`` for null."""
    return F.coalesce(F.lower(strip(x)).isin(*YES), F.lit(default))


def is_not_no(x: Column, default: bool) -> Column:
    """Whether a setting does not say no; ``default`` for null."""
    return F.coalesce(~F.lower(strip(x)).isin(*NO), F.lit(default))


def passed_on(settings: Column) -> Column:
    """The entries of a map that a request may pass on to the model."""
    return F.map_filter(settings, lambda k, _: k.isin(*SAMPLING))


def voice(x: Column, default: str) -> Column:
    """The voice asked for; null, blank and ``default`` mean the default one."""
    asked = strip(x)
    return F.when(asked.isNull() | asked.isin("", "default"), F.lit(default)).otherwise(asked)


def image_bytes(url: Column) -> Column:
    """Bytes of an inline image's address; null where it is none or its base64 is broken."""
    at = F.instr(url, "base64,")
    return F.when(F.startswith(url, F.lit("data:image/")) & (at > 0), F.try_to_binary(F.substring(url, at + F.lit(7), F.length(url)), F.lit("base64")))


# What a setting may be, which statuses and faults of a connection are worth a new try.
RANGES = {"interval": (0.1, 60), "batch": (1, 30), "latency": (0, 10)}
FAULTS, STATUSES = ("timeout", "os", "connection"), (408, 425, 429, 500, 502, 503, 504)


def within(x: Column, setting: str) -> Column:
    return x.between(*RANGES[setting])


def retried(fault: Column, status: Column) -> Column:
    """Whether a connection that failed by ``fault`` or with ``status`` is tried again."""
    return F.coalesce(fault.isin(*FAULTS), F.lit(False)) | F.coalesce(status.isin(*STATUSES), F.lit(False))


def wait(attempt: Column, first: float, most: float) -> Column:
    return F.least(first * F.pow(F.lit(2.0), attempt), F.lit(most))


def reconnect_wait(attempt: Column, delay: float) -> Column:
    """None before the first attempt, then ``delay``, doubling."""
    return F.when(attempt == 0, 0.0).otherwise(delay * F.pow(F.lit(2.0), attempt - 1))


def whole(x: Column) -> Column:
    """The whole number that a text states; null for null and other texts."""
    return F.when(F.rlike(x, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(x).try_cast("bigint"))


def frame_rate(x: Column, default: float) -> Column:
    return F.when(x > 0, F.least(x, F.lit(60.0))).otherwise(default)


def long_edge(x: Column, default: int) -> Column:
    """The longest side an image may have, 256 to 2048; 0 for no limit."""
    n = whole(x)
    return F.when(n.isNull(), default).when(n <= 0, 0).otherwise(F.least(F.greatest(n, F.lit(256)), F.lit(2048))).cast("bigint")


def frame_limit(x: Column, default: int, most: int = 100) -> Column:
    """How many frames are held; null where none is stated."""
    n = whole(x)
    return F.when(n <= 0, default).when(n > 0, F.least(n, F.lit(most))).cast("bigint")


def fit_area(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) of an image scaled down to ``most`` pixels, sides cut to whole numbers."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width * height)))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("bigint")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def fit_edge(width: Column, height: Column, edge: int) -> Column:
    """struct(width, height) of an image whose longer side is scaled down to ``edge``, sides rounded half to even."""
    longer = F.greatest(width, height)
    side = lambda x: F.when(longer > edge, F.greatest(F.lit(1.0), F.rint(x * (F.lit(float(edge)) / longer)))).otherwise(x).cast("bigint")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def speech_config(instructions: Column, emotion: Column, asked: Column, rate: Column, form: Column, default: str) -> Column:
    """struct(instructions, voice, fault): an emotion comes before the instructions; fault says why one is refused."""
    said = F.array_join(F.filter(F.array(strip(emotion), strip(instructions)), lambda x: x != ""), " ")
    fault = F.when(form != "pcm16", "output format").when(rate != 24000, "sample rate")
    return F.struct(said.alias("instructions"), voice(asked, default).alias("voice"), fault.alias("fault"))


def percent_encoded(x: Column) -> Column:
    """A text as part of an address: all but letters, digits and ``-._~`` as percent codes of its UTF-8."""
    form = F.url_encode(x)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def joined_range(labels: Column) -> Column:
    """The label of a turn: the one that all its frames have, else all in order; null labels are left out."""
    known = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(F.array_distinct(known)) == 1, F.get(known, F.lit(0))).otherwise(F.array_join(known, " ~ "))


def wrapped(x: Column, width: int = 60) -> Column:
    """Words filled into lines greedily. The first line counts one blank more than the others; a longer word has a
    line of its own. Null stays null. An Arrow function, as each line depends on the one before."""

    def lines(text: str) -> str:
        made, room = [[]], width
        for word in text.split():
            need = len(word) + 1
            if need > room:
                made.append([])
                need, room = need - 1, width
            made[-1].append(word)
            room -= need
        return "\n".join(" ".join(line) for line in made if line)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lines, na_action="ignore")

    return run(x)


def background_config(enabled: Column, fps: Column, multiplier: Column, frames: Column, cached: Column, most: int = 100, default: int = 100) -> Column:
    """struct of what a background service tells of its sampling: a rate of 0.1 to 60 a second, the interval that it makes, and
    how many frames of those cached it takes, 1 to ``most``; none asked for counts as ``default``."""
    rate = F.least(F.greatest(F.lit(0.1), fps * multiplier.cast("double")), F.lit(60.0))
    wanted = F.least(F.greatest(F.lit(1), F.coalesce(F.nullif(frames, F.lit(0)), F.lit(default))), F.lit(most)).cast("bigint")
    return F.struct(enabled.alias("enabled"), rate.alias("background_fps"), (F.lit(1.0) / rate).alias("sample_interval_seconds"), wanted.alias("target_frame_count"), F.least(cached, wanted).alias("cached_frame_count"))
