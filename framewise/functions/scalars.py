"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_suffix(stem: Column) -> Column:
    """Trailing digits as a number; 0 (no suffix) where there are none or they overflow."""
    return F.coalesce(F.regexp_extract(stem, "([0-9]+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def split_suffix(stem: Column) -> tuple[Column, Column]:
    """(prefix, digits) of a stem."""
    return F.regexp_extract(stem, "^(.*?)([0-9]*)$", 1), F.regexp_extract(stem, "^(.*?)([0-9]*)$", 2)


def gap_seconds(a: Column, b: Column) -> Column:
    """Absolute difference of two timestamps in seconds, to the microsecond."""
    return F.abs(F.timestamp_diff("MICROSECOND", a, b)) / F.lit(1e6)


def slug(text: Column) -> Column:
    """Runs of other than letters and digits become one dash; dashes at the ends go."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def loose_int(text: Column) -> Column:
    """Number by way of double, truncated; null where it is none."""
    return text.try_cast("double").try_cast("bigint")


def strict_int(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))


def loose_bool(text: Column, wide: bool = True) -> Column:
    """true/false (wide: also 1/yes and 0/no), else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", *(("1", "yes") if wide else ())), True).when(t.isin("false", *(("0", "no") if wide else ())), False)


def percent(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1f%%", value * 100)).otherwise(F.lit("n/a"))


def metric(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value)).otherwise(F.lit("n/a"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, by 32-bit halves (a 64-bit value would overflow a long)."""
    def half(h: Column, at: int) -> Column:
        return F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")

    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).cast("int")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def draw(*parts: Column | str) -> Column:
    """A reproducible 32-bit number from md5 of the parts joined by '|': the same in any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def ordinal(label: Column) -> Column:
    return F.when(label == "reject", 0).when(label == "review", 1).when(label == "pick", 2)


def safe_stem(text: Column) -> Column:
    """Runs of other than ASCII letters, digits, dot, underscore and dash become one dash."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")


def short_number(value: Column, digits: int = 6) -> Column:
    """Fixed digits without the zeros behind, nor a bare point."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"\.?0+$", "")


def grouped(value: Column) -> Column:
    """A whole number with thousands commas, n/a where absent."""
    return F.when(value.isNotNull(), F.format_number(value, 0)).otherwise(F.lit("n/a"))


def first_non_empty(*values: Column) -> Column:
    """The first of several that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))
