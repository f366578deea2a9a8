"""Normal forms of keys, and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.temporal import micros


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def reference(text: Column) -> Column:
    """A key as compared: stripped, upper case; null where nothing is left."""
    return F.nullif(F.upper(stripped(text)), F.lit(""))


def hex_identity(event_id: Column) -> Column:
    """The 32 hexadecimal digits of an identifier, in lower case.

    Case, separators, brackets and a prefix before the digits do not matter: a prefix may hold
    letters that are digits too, so the last 32 count. An identifier of fewer digits stands for
    itself, stripped and in lower case; null and blank give null.
    """
    digits = F.right(F.regexp_replace(F.lower(event_id), "[^0-9a-f]", ""), F.lit(32))
    own = F.nullif(F.lower(stripped(event_id)), F.lit(""))
    return F.when(F.length(digits) == 32, digits).otherwise(own)


def dashed(digits: Column) -> Column:
    """32 hexadecimal digits as 8-4-4-4-12; anything else as it is."""
    return F.regexp_replace(
        digits, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5"
    )


def surrogate_key(*columns: tuple[Column, str]) -> Column:
    """md5 over the columns, each given with its type; timestamps count as microseconds."""
    parts = [micros(c) if kind.startswith("timestamp") else c for c, kind in columns]
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("∅")) for p in parts]))
