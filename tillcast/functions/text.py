"""Text clean-up: stripping, defaults, safe ids, truncation, booleans and comma lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters removed from both ends of a text.
STRIP_CHARS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0"

# Accepted spellings of a boolean, lower case.
TRUE_WORDS = ["1", "true", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "no", "n", "off"]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


def filled(text: Column) -> Column:
    """The text, or NULL where it is empty."""
    return F.nullif(text, F.lit(""))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor empty."""
    return F.coalesce(*[filled(c) for c in candidates])


def stripped_or(text: Column, default: str) -> Column:
    """The stripped text, or the default where nothing is left."""
    return F.coalesce(filled(strip(text)), F.lit(default))


def safe_id(text: Column) -> Column:
    """Text usable as part of a file name."""
    return F.translate(strip(text), "/\\ ", "___")


def truncate(text: Column, limit: int = 1200) -> Column:
    """Strip, and shorten to ``limit`` characters with a closing ellipsis."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) <= limit, body).otherwise(
        F.concat(F.substring(body, 1, limit - 3), F.lit("..."))
    )


def parse_bool(text: Column, default: bool | None = None) -> Column:
    word = F.lower(strip(text))
    return (
        F.when(word.isin(TRUE_WORDS), F.lit(True))
        .when(word.isin(FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(default).cast("boolean"))
    )


def comma_list(text: Column) -> Column:
    """Non-empty stripped parts of a comma list, or NULL where there is none."""
    parts = F.array_remove(F.transform(F.split(text, ","), strip), "")
    return F.when(F.size(parts) > 0, parts)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
