"""Dot commands: arguments with units, values in force, page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: the format's grammar of a command and of its number.
NAME = r"(?s)^\.([LFEPlfep]#|[A-Za-z]{1,3})\s*(.*)$"
NUMBER = r"^\s*([0-9]*\.?[0-9]+)\s*(\"|[A-Za-z]{1,2})?"
#: Fixed: defaults of the page, in each command's own unit.
DEFAULTS = {"pl": 66.0, "mt": 3.0, "mb": 8.0, "po": 8.0, "hm": 2.0, "fm": 2.0, "lh": 8.0, "ls": 1.0, "cw": 12.0, "pn": 1.0, "pc": 28.0}
#: Fixed: named sizes with height and width in inches; how near a height must come to take the name.
SIZES = [("Letter", 11.0, 8.5), ("Legal", 14.0, 8.5), ("Foolscap Folio", 13.5, 8.5), ("A4", 11.693, 8.268)]
SNAP = 0.25
#: Units of an inch by command; the others count lines, six to the inch.
PER_INCH = {"po": 10.0, "lh": 48.0, "cw": 120.0}


def command(line: Column) -> Column:
    """Lower-case name of a dot command, null for other lines."""
    return F.nullif(F.lower(F.regexp_extract(line, NAME, 1)), F.lit(""))


def argument(line: Column) -> Column:
    return F.when(line.rlike(NAME), F.regexp_extract(line, NAME, 2))


def inches(value: Column, unit: Column) -> Column:
    """Null where there is no unit or an unknown one."""
    u = F.upper(unit)
    return F.when(u.isin('"', "I", "IN"), value).when(u.isin("C", "CM"), value / 2.54).when(u.isin("P", "PM", "PT"), value / 72.0)


def resolved(name: Column, arg: Column) -> Column:
    """The argument in the command's own unit, null where it means nothing."""
    number = F.nullif(F.regexp_extract(arg, NUMBER, 1), F.lit("")).cast("double")
    unit = F.regexp_extract(arg, NUMBER, 2)
    per = F.lit(6.0)
    for n, x in PER_INCH.items():
        per = F.when(name == n, F.lit(x)).otherwise(per)
    value = F.coalesce(inches(number, unit) * per, number)
    spacing = F.when((unit == "") & number.between(1, 9), number)
    return F.when(name == "ls", spacing).when(name.isin("lh", "cw"), F.when(value > 0, value)).otherwise(value)


def first_wins(lines: DataFrame) -> DataFrame:
    """``doc_id`` and one column for each page command: the first value that means something."""
    held = lines.select("doc_id", "pos", command(F.col("line")).alias("cmd"), argument(F.col("line")).alias("arg")).where(F.col("cmd").isin(*DEFAULTS))
    valued = held.withColumn("value", resolved(F.col("cmd"), F.col("arg"))).where("value is not null")
    # one value of each command first, so that the argument is read in one place; then one column for each command
    first = valued.groupBy("doc_id", "cmd").agg(F.min_by("value", "pos").alias("value"))
    return first.groupBy("doc_id").agg(*[F.max(F.when(F.col("cmd") == c, F.col("value"))).alias(c) for c in DEFAULTS])


def text_lines(pl: Column, mt: Column, mb: Column, lh: Column) -> Column:
    """Text lines on a page; a length of zero turns page breaks off."""
    return F.when(pl == 0, F.lit(1_000_000_000)).otherwise(F.greatest(F.lit(1), ((pl - mt - mb) * 8.0 / lh).cast("long"))).cast("long")


def page_size(pl: Column) -> tuple[Column, Column, Column]:
    """Height, name and width: the nearest named size if it is near enough."""
    height = pl / 6.0
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(h) - height).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(h).alias("h"), F.lit(w).alias("w")) for k, (n, h, w) in enumerate(SIZES)]))
    near = best["d"] <= SNAP
    return F.when(near, best["h"]).otherwise(height), F.when(near, best["name"]).otherwise(F.lit("Custom")), F.when(near, best["w"]).otherwise(F.lit(8.5))


def page_geometry(lines: DataFrame) -> DataFrame:
    """Page of each document that has lines, with defaults where it says nothing."""
    said = lines.select("doc_id").distinct().join(first_wins(lines), "doc_id", "left")
    v = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in DEFAULTS.items()}
    height, name, width = page_size(v["pl"])
    return said.select("doc_id", *[v[c].alias(f"{c}_value") for c in ("pl", "mt", "mb", "lh")], F.col("pl").isNotNull().alias("pl_from_file"), text_lines(v["pl"], v["mt"], v["mb"], v["lh"]).alias("text_lines"), height.alias("height_in"), name.alias("size_name"), width.alias("width_in"))


def switch(name: str) -> Column:
    """What a line sets an on/off command to, null if nothing."""
    word = F.upper(F.regexp_extract("line", rf"(?i)^\.{name}\s+(ON|OFF|[CRD])\b", 1))
    return F.nullif(word, F.lit(""))


def in_force(lines: DataFrame, names: tuple[str, ...] = ("oc", "oj", "aw")) -> DataFrame:
    """``doc_id, pos, line`` of text lines with the last setting of each command up to there. A line that begins with a
    full stop is a command, whatever follows."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.select("doc_id", "pos", "line", *[F.last(switch(n), ignorenulls=True).over(order).alias(n) for n in names])
    return held.where(~F.col("line").startswith("."))


def alignment(oc: Column, oj: Column) -> Column:
    """Centring beats justification; left is the default."""
    return F.when(oc == "ON", F.lit("center")).when(oj == "ON", F.lit("justify")).when(oj == "C", F.lit("center")).when(oj == "R", F.lit("right")).otherwise(F.lit("left"))


def format_blocks(stated: DataFrame, names: tuple[str, ...] = ("oc", "oj", "aw")) -> DataFrame:
    """``doc_id, block_ix, first_pos, n_lines, align``: a new block wherever a state differs from the line before."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    now = F.concat_ws("|", *[F.coalesce(n, F.lit("-")) for n in names])
    held = stated.withColumn("state", now)
    turn = F.coalesce(F.col("state") != F.lag("state").over(order), F.lit(False))
    numbered = held.withColumn("turn", turn).withColumn("block_ix", F.sum(F.col("turn").cast("int")).over(order))
    return numbered.groupBy("doc_id", "block_ix").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_lines"), F.first(alignment(F.col("oc"), F.col("oj"))).alias("align"))
