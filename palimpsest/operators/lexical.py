"""Physical lines, visible lengths, margins and break kinds, as array and window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: the least margin, the share of lines below it, and the marks of a finished sentence.
LEAST_MARGIN, MARGIN_SHARE = 65, 0.9
TERMINAL = r"[.!?][\"'”’]*\s*$"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def physical_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, line`` in order of appearance."""
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(lines_of(docs[text_col])).alias("pos", "line"))


def visible_length(line: Column) -> Column:
    return F.length(F.rtrim(line))


def margin(lengths: Column) -> Column:
    """The length at nine tenths of the sorted non-blank lengths, at least 65."""
    held = F.array_sort(F.filter(lengths, lambda n: n > 0))
    at = F.floor(F.lit(MARGIN_SHARE) * F.size(held)).cast("int")
    return F.greatest(F.lit(LEAST_MARGIN), F.coalesce(F.get(held, at), F.lit(0)))


def terminal_share(lines: Column) -> tuple[Column, Column]:
    """Lines with letters, and how many of them end as finished sentences."""
    scored = F.filter(lines, lambda x: x.rlike(r"\p{L}"))
    return F.size(scored), F.size(F.filter(scored, lambda x: x.rlike(TERMINAL)))


def line_profile(docs: DataFrame) -> DataFrame:
    """Lines, margin and finished sentences of each document: one projection, no shuffle."""
    lines = lines_of(F.col("text"))
    lengths = F.transform(lines, visible_length)
    scored, ended = terminal_share(lines)
    return docs.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lengths, lambda n: n == 0)).cast("long").alias("n_blank"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest"),
        margin(lengths).cast("long").alias("margin"),
        scored.cast("long").alias("n_scored"),
        ended.cast("long").alias("n_terminal"),
    )


def separators(lines: DataFrame, soft_is_wrap: bool = False) -> DataFrame:
    """Break kind of each non-blank line of ``doc_id, pos, line, hard, margin`` (``hard``: its return is a hard one),
    and of each blank one.

    Islands: a non-blank line and the blank lines after it are one run; the run's hard and total breaks decide.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    blank = F.trim("line") == ""
    run = F.sum(F.when(~blank, 1).otherwise(0)).over(order)
    held = lines.withColumn("blank", blank).withColumn("run", run)
    in_run = Window.partitionBy("doc_id", "run")
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    ends = F.col("pos") == last  # the last line has no return of its own
    counted = held.withColumn("n_total", F.sum(F.when(ends, 0).otherwise(1)).over(in_run)).withColumn("n_hard", F.sum(F.when(F.col("hard") & ~ends, 1).otherwise(0)).over(in_run))
    text = counted.where(~F.col("blank"))
    following = F.lead("line").over(order)
    measured = text.withColumn("next", following)
    first_word = F.length(F.regexp_extract("next", r"^[^ ]*", 0))
    fits = visible_length(F.col("line")) + 1 + first_word < F.col("margin")
    soft = F.when(F.col("next").startswith(" "), F.lit("line"))
    soft = soft.otherwise(F.lit("wrap")) if soft_is_wrap else soft.when(fits, F.lit("line")).otherwise(F.lit("wrap"))
    kind = F.when(F.col("next").isNull(), F.lit("eof")).when((F.col("n_hard") >= 1) & (F.col("n_total") >= 2), F.lit("para")).when(F.col("n_hard") == 1, F.lit("line")).otherwise(soft)
    classified = measured.select("doc_id", "pos", "line", kind.alias("sep"))
    blanks = counted.where("blank").select("doc_id", "pos", "line", F.when(F.col("hard"), F.lit("blank-hard")).otherwise(F.lit("blank-soft")).alias("sep"))
    return classified.unionByName(blanks)


def logical_lines(classified: DataFrame) -> DataFrame:
    """Wrapped lines joined: ``doc_id, first_pos, text``. A space joins, unless the text so far ends with a space or a
    hyphen; a continuation loses its leading white space."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    held = classified.where(~F.col("sep").startswith("blank"))
    starts = F.coalesce(F.lag("sep").over(order) != "wrap", F.lit(True))
    grouped = held.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(order)).groupBy("doc_id", "island")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    joined = F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda out, x: F.concat(out, F.when(out.rlike("[ -]$"), F.lit("")).otherwise(F.lit(" ")), F.ltrim(x)))
    return grouped.agg(F.min("pos").alias("first_pos"), joined.alias("text")).select("doc_id", "first_pos", "text")
