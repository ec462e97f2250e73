"""Typefaces: the base family of a face, widths from metric files, text width."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: words in a face's name that tell its base family; a fixed-pitch face counts before its name does.
FAMILIES = [("Courier", "courier|gothic 12|prestige|elite|pica|letter"), ("Helvetica", "helv|univers|arial|swiss|sans|gothic"), ("Symbol", "symbol|math|greek"), ("ZapfDingbats", "dingbat")]


def base_family(name: Column, proportional: Column) -> Column:
    """One of the base families of a viewer; Times where nothing else is told."""
    out = F.when(proportional.eqNullSafe(F.lit(False)), F.lit("Courier"))
    for family, words in FAMILIES:
        out = out.when(F.lower(name).rlike(words), F.lit(family))
    return out.otherwise(F.lit("Times"))


def base_face(family: Column, bold: Column, italic: Column) -> Column:
    slant = F.when(family == "Times", F.lit("Italic")).otherwise(F.lit("Oblique"))
    style = F.when(bold & italic, F.concat(F.lit("Bold"), slant)).when(bold, F.lit("Bold")).when(italic, slant)
    plain = F.when(family == "Times", F.lit("Times-Roman")).otherwise(family)
    return F.when(family.isin("Symbol", "ZapfDingbats") | style.isNull(), plain).otherwise(F.concat(family, F.lit("-"), style))


def read_metrics(lines: Iterable[str]) -> dict[int, int]:
    """Width in thousandths of an em by character code, of a font metrics file."""
    found = (re.match(r"C\s+(-?\d+)\s*;\s*WX\s+(\d+)", line) for line in lines)
    return {int(m[1]): int(m[2]) for m in found if m and int(m[1]) >= 0}


def metrics_table(spark: SparkSession, faces: dict[str, dict[int, int]]) -> DataFrame:
    """``face, widths``: one row for each face, small enough to broadcast (a face has at most 256 codes)."""
    rows = [(face, widths) for face, widths in faces.items()]
    return spark.createDataFrame(rows, "face string, widths map<int,int>")


def text_width(text: Column, widths: Column, other: int = 500) -> Column:
    """Thousandths of an em; characters that the face doesn't have count ``other``. A fixed pitch is 600 each."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    return F.when(widths.isNull(), F.length(text) * 600).otherwise(F.aggregate(chars, F.lit(0), lambda n, c: n + F.coalesce(F.try_element_at(widths, F.ascii(c)), F.lit(other))))
