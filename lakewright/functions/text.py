"""Text, path, hash and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def format_timespan(minutes: Column) -> Column:
    """Whole minutes as `d.hh:mm:00`; days are not padded."""
    m = minutes.cast("bigint")
    return F.format_string(
        "%d.%02d:%02d:00",
        F.floor(m / 1440), F.floor((m % 1440) / 60), m % 60,
    )


def _framed(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hash_concat(*cols: Column, safe: bool = False) -> Column:
    """md5 of the arguments joined without a separator.

    `safe` frames every argument with its length, so that ("ab", "c") and
    ("a", "bc") differ, and marks NULL apart from ''; ledger keys use that form.
    """
    parts = [_framed(c) for c in cols] if safe else [c.cast("string") for c in cols]
    return F.md5(F.concat_ws("", *parts))


def row_hash(*cols: Column) -> Column:
    """60-bit number identifying a ledger entry."""
    return F.conv(F.substring(hash_concat(*cols, safe=True), 1, 15), 16, 10).cast("bigint")


def strip_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def path_segment(path: Column, position: int) -> Column:
    """Segment by 1-based position; -1 is the last one; NULL when there is none."""
    return F.try_element_at(F.split(strip_slashes(path), "/"), F.lit(position))


def resource_segment(path: Column, position: int) -> Column:
    """n-th non-empty segment of a resource id."""
    return F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(position - 1))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def email_local_part(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def alnum_only(text: Column) -> Column:
    """Letters and digits of any script."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def title(text: Column) -> Column:
    return F.initcap(text)


def replace_in(text: Column, old: str, new: str) -> Column:
    """Literal replacement in a string column."""
    return F.replace(text, F.lit(old), F.lit(new))


def replace_in_array(items: Column, old: str, new: str) -> Column:
    return F.transform(items, lambda x: F.replace(x, F.lit(old), F.lit(new)))


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))
