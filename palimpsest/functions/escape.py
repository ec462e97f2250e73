"""Escapes and small text functions of the output formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def markdown(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\*_#`\[\]])", r"\\$1")


def html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_attribute(s: Column) -> Column:
    return F.replace(F.replace(html(s), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def rtf(s: Column) -> Column:
    """Backslash and braces escaped; what isn't ASCII as a signed 16-bit code point with a question mark."""
    escaped = F.regexp_replace(s, r"([\\{}])", r"\\$1")
    one = lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.when(F.ascii(c) > 32767, F.ascii(c) - 65536).otherwise(F.ascii(c)).cast("string"), F.lit("?")))
    chars = F.regexp_extract_all(escaped, F.lit("(?s)(.)"), F.lit(1))
    return F.when(escaped.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(chars, one), "")).otherwise(escaped)


def pdf(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\()])", r"\\$1")


def strip_tags(s: Column) -> Column:
    """Text of an HTML string: scripts, styles, comments and tags go, white space runs are one space."""
    for pattern in (r"(?is)<(script|style)[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        s = F.regexp_replace(s, pattern, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))
