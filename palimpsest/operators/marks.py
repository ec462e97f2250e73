"""Tables that dot commands and notes spread over a document: contents, index, running heads, breaks, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dots import NUMBER, argument, command


def commands(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, cmd, arg``."""
    return lines.select("doc_id", "pos", command(F.col("line")).alias("cmd"), argument(F.col("line")).alias("arg")).where("cmd is not null")


def contents(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, level, entry`` of .tc to .tc9; the plain one is level 1."""
    form = r"(?i)^\.tc([1-9]?)\s+(.*)$"
    return lines.where(F.col("line").rlike(form)).select("doc_id", "pos", F.coalesce(F.nullif(F.regexp_extract("line", form, 1), F.lit("")).cast("int"), F.lit(1)).alias("level"), F.regexp_extract("line", form, 2).alias("entry"))


def index_entries(lines: DataFrame) -> DataFrame:
    return commands(lines).where("cmd = 'ix'").select("doc_id", "pos", F.col("arg").alias("entry"))


def includes(lines: DataFrame) -> DataFrame:
    return commands(lines).where("cmd = 'fi'").select("doc_id", "pos", F.col("arg").alias("name"), F.concat(F.lit("[insert: "), "arg", F.lit("]")).alias("shown"))


def breaks(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, kind, lines``: page breaks, and conditional ones with the lines they ask for (1 if unsaid)."""
    n = F.coalesce(F.nullif(F.regexp_extract("arg", NUMBER, 1), F.lit("")).cast("double"), F.lit(1.0)).cast("int")
    return commands(lines).where(F.col("cmd").isin("pa", "cp")).select("doc_id", "pos", F.when(F.col("cmd") == "pa", "pagebreak").otherwise("condpage").alias("kind"), F.when(F.col("cmd") == "cp", n).alias("lines"))


HEAD = r"(?i)^\.(h[e1-5]|f[o1-5])\s?(.*)$"


def head_events(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, place, n, text``: running heads and feet as they change; an empty text clears."""
    name = F.lower(F.regexp_extract("line", HEAD, 1))
    n = F.when(name.isin("he", "fo"), 1).otherwise(F.substring(name, 2, 1).cast("int"))
    return lines.where(F.col("line").rlike(HEAD)).select("doc_id", "pos", F.when(F.substring(name, 1, 1) == "h", "head").otherwise("foot").alias("place"), n.alias("n"), F.regexp_extract("line", HEAD, 2).alias("text"))


def running_heads(events: DataFrame) -> DataFrame:
    """``doc_id, heads, feet``: maps of what stands at the end."""
    last = events.groupBy("doc_id", "place", "n").agg(F.max_by("text", "pos").alias("text")).where("text <> ''")
    entry = lambda place: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("place") == place, F.struct("n", "text")))))
    return last.groupBy("doc_id").agg(entry("head").alias("heads"), entry("foot").alias("feet"))


def heads_on_pages(events: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, place, n, text``: the head in force where each page begins, its number sign replaced."""
    slots = events.select("doc_id", "place", "n").distinct()
    at = pages.groupBy("doc_id", "page").agg(F.min("pos").alias("pos")).join(slots, "doc_id").select("doc_id", "place", "n", "pos", "page", F.lit(None).cast("string").alias("text"))
    both = events.select("doc_id", "place", "n", "pos", F.lit(None).cast("int").alias("page"), "text").unionByName(at.withColumn("page", F.col("page").cast("int")))
    w = Window.partitionBy("doc_id", "place", "n").orderBy("pos", F.col("page").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("shown", F.last("text", ignorenulls=True).over(w)).where("page is not null and shown <> ''")
    return held.select("doc_id", "page", "place", "n", F.replace("shown", F.lit("#"), F.col("page").cast("string")).alias("text"))


def comment_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, text`` of .. and .ig lines, which become comments."""
    form = r"(?i)^\.(\.|ig)\s?(.*)$"
    return lines.where(F.col("line").rlike(form)).select("doc_id", "pos", F.regexp_extract("line", form, 2).alias("text"))


def foreign(lines: DataFrame) -> DataFrame:
    """``doc_id, is_foreign``: whether commands of another producer appear."""
    return lines.groupBy("doc_id").agg(F.bool_or(F.coalesce(command(F.col("line")).isin("pt", "psa", "psb"), F.lit(False))).alias("is_foreign"))


def ruler(line: Column) -> Column:
    return line.rlike(r"(?i)^\.rr?[^a-z]*[-!]+[-!# ]*$")


def note_sections(notes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``doc_id, kind, section``: the notes of each chosen kind in order. Labels came before, over all notes."""
    held = notes.where(F.col("kind").isin(*kinds))
    row = F.struct("note_ix", F.concat(F.lit("["), "shown", F.lit("] "), "text").alias("said"))
    return held.groupBy("doc_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["said"]), "\n").alias("section"))


def marker_pad(labels: DataFrame) -> DataFrame:
    """Adds ``padded``: markers of a kind in a document, padded on the left to the widest."""
    widest = F.max(F.length("label")).over(Window.partitionBy("doc_id", "kind"))
    return labels.withColumn("padded", F.lpad(F.concat("label", F.lit(".")), (widest + 1).cast("int"), F.lit(" ")))
