"""Column functions on paths and addresses. Which files exist is a table; nothing asks a disk."""

from __future__ import annotations

import re
from mimetypes import MimeTypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.functions.values import percent_encoded

# Images that may be read, files that are never shown inline, and types that are.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp")
ATTACHED = ("7z", "bin", "bz2", "dmg", "exe", "gz", "iso", "lz", "lzma", "rar", "tar", "tgz", "xz", "zip", "zst")
INLINE = ("application/json", "application/pdf", "application/xml", "application/xhtml+xml", "image/svg+xml")


def normal(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` steps; ``..`` at the root stays there."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def suffix(path: Column) -> Column:
    """The part of the name behind its last dot, in lower case; empty for a name without or with a leading one only."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def under(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.when(root == "/", root).otherwise(F.concat(root, F.lit("/"))))


def roots(listed: Column) -> Column:
    """The roots of a list by colons or commas, each once where it first stands; null for ``*``, which allows all."""
    parts = F.filter(F.transform(F.split(listed, "[:,]"), strip), lambda p: p != "")
    return F.when(strip(listed) == "*", F.lit(None)).otherwise(F.array_distinct(F.transform(parts, normal)))


def allowed(path: Column, within: Column) -> Column:
    return F.coalesce(F.exists(within, lambda r: under(path, r)), F.lit(True))


def image_fault(path: Column, exists: Column, within: Column) -> Column:
    """Why an image path is refused; null where it is not. ``within``: roots, an empty list allows none."""
    return F.when(F.size(within) == 0, "disabled").when(~exists, "missing").when(~suffix(path).isin(*IMAGES), "suffix").when(~F.exists(within, lambda r: under(path, r)), "outside")


def _extension(path: Column) -> Column:
    """The last dot of a name and what follows it; empty where only dots stand before it."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)


def content_type(path: Column) -> Column:
    """The type of a file by the standard library's table of suffixes; a suffix of packing such as ``.gz`` is passed over to the
    one before it. Bytes of no kind where the table has none."""
    table = MimeTypes()
    table_of = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    types, short = table_of(table.types_map[True]), table_of(table.suffix_map)
    packing = "|".join(re.escape(e) for e in sorted(table.encodings_map))
    last = _extension(path)
    long = F.coalesce(F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(last)), F.try_element_at(short, F.lower(last))), path)
    plain = F.when(_extension(long).isin(*table.encodings_map), F.regexp_replace(long, rf"(?:{packing})$", "")).otherwise(long)
    end = _extension(plain)
    return F.coalesce(F.try_element_at(types, end), F.try_element_at(types, F.lower(end)), F.lit("application/octet-stream"))


def shown_inline(path: Column) -> Column:
    kind = content_type(path)
    return ~suffix(path).isin(*ATTACHED) & (kind.isin(*INLINE) | F.startswith(kind, F.lit("image/")) | F.startswith(kind, F.lit("text/")))


def save_dir(path: Column, root: str) -> Column:
    """Where a session is saved: an absolute path as it is, another under ``root``; null for none."""
    p = strip(path)
    return F.when(p != "", normal(F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root + "/"), p))))


def light_dir(out: Column) -> Column:
    """The folder of light records beside ``out``."""
    path = normal(out)
    name, parent = F.regexp_extract(path, "[^/]*$", 0), F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    return F.when(F.startswith(name, F.lit("output_")), F.concat(parent, F.lit("output_light_"), F.substr(name, F.lit(8)))).when(name == "output", F.concat(parent, F.lit("output_light"))).otherwise(F.concat(path, F.lit("_light")))


def without_password(url: Column) -> Column:
    return F.regexp_replace(url, "://([^:]+):([^@]+)@", "://$1:****@")


def last_four(secret: Column) -> Column:
    """The end of a secret of more than four characters; others are not shown."""
    return F.when((F.length(secret) > 4) & (secret != "EMPTY"), F.concat(F.lit("***"), F.right(secret, F.lit(4)))).otherwise("EMPTY")


def disposition(kind: str, name: Column) -> Column:
    """A download's header: the ASCII part of the name and all of it in percent codes."""
    ascii_name = F.regexp_replace(name, r"[^\x00-\x7F]", "")
    ascii_name = F.translate(F.when(ascii_name == "", "download").otherwise(ascii_name), '\\"', "__")
    coded = F.replace(percent_encoded(name), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(f'{kind}; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), coded)


def artefact_name(task: Column, other: Column) -> Column:
    """The file of a task's page; ``other`` names one of a task without a name."""
    safe = F.regexp_replace(F.regexp_replace(strip(F.coalesce(task, F.lit(""))), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(safe == "", other).otherwise(safe), F.lit(".html"))
