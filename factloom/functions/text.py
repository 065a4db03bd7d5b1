"""Scalar functions of the fact model, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(c: Column) -> Column:
    """A sort key in the order of UTF-16 code units (Spark itself sorts by UTF-8 bytes)."""
    return F.encode(c, "UTF-16BE")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def contains_ignoring_case(c: Column, pattern: str) -> Column:
    """Whether a text holds another one, whatever their letter case; no character is special."""
    return F.contains(F.lower(c), F.lit(pattern.lower()))


def short_name(c: Column) -> Column:
    """What follows the last slash or colon."""
    return F.regexp_extract(c, r"([^/:]*)$", 1)


def module_short_name(c: Column) -> Column:
    """What follows the last full stop."""
    return F.substring_index(c, ".", -1)


def qualify(container: Column, name: Column) -> Column:
    """container.name, or the name alone where there is no container."""
    return F.when(container.isNull() | (container == ""), name).otherwise(F.concat_ws(".", container, name))


def bounded(c: Column, most: int = 256) -> Column:
    """The text if it has at most so many code units, else null."""
    return F.when(utf16_length(c) <= most, c)


def collapse(c: Column, most: int = 512) -> Column:
    """White space and comment slashes collapsed to single spaces, cut to so many characters."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*///?", " "), r"\s+", " ")), F.lit(most))


def exported_name(c: Column) -> Column:
    """Whether a text may be an exported name: 1 to 256 characters, none of them a control or white space."""
    return c.isNotNull() & F.length(c).between(1, 256) & ~c.rlike(r"\p{Cc}|\s")


def glob_regex(glob: str) -> str:
    """The anchored expression of a glob: ** spans directories, * and ? do not."""
    out, i, g = "", 0, glob.replace("\\", "/")
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    return f"^(?i:{out})$"


def normalise_path(c: Column) -> Column:
    """A relative path with its ``.`` and ``..`` segments applied; null if it leaves its root or has empty segments."""
    parts = F.split(F.translate(c, "\\", "/"), "/")
    bad = F.array(F.lit("\x00"))

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when(acc == bad, acc)
            .when(x == "", bad)
            .when(x == ".", acc)
            .when((x == "..") & (F.size(acc) == 0), bad)
            .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(x)))
        )

    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(done != bad, F.array_join(done, "/"))


def combine_path(directory: Column, path: Column) -> Column:
    """A path relative to a directory, normalised."""
    return normalise_path(F.when(directory == "", path).otherwise(F.concat_ws("/", directory, path)))


def directory_of(c: Column) -> Column:
    """A path without its last segment."""
    return F.regexp_replace(c, r"/?[^/]*$", "")


def content_hash(c: Column) -> Column:
    """``sha256:`` and the digest of a text's UTF-8 bytes or of binary content."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))
