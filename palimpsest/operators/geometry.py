"""Printed geometry: points from the page's own units, margins in force, margins and tabs, pages with breaks and notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dots import NUMBER, inches, text_lines
from .reflow import folded

#: Fixed: points of a column and a line, least body lines on a page with notes, the rule before them.
POINTS_A_COLUMN, POINTS_A_LINE, LEAST_BODY, RULE = 7.2, 12, 3, 20


def printed_points(page: DataFrame) -> DataFrame:
    """Top, lead, size and left edge in points of ``doc_id, mt, mt_said, hm, lh, cw, po, height_pt``. The header's lines
    add to the top only where the file doesn't set it. Halves round to even."""
    top = F.col("mt") + F.when(F.col("mt_said"), F.lit(0.0)).otherwise(F.col("hm"))
    size = F.greatest(F.lit(1), F.bround("cw").cast("int"))
    return page.select(
        "doc_id",
        F.greatest(F.lit(0), F.least(F.bround(top * POINTS_A_LINE).cast("int"), (F.col("height_pt") - POINTS_A_LINE).cast("int"))).alias("top_pt"),
        (F.col("lh") * 1.5).alias("lead_pt"),
        size.alias("size_pt"),
        F.greatest(F.lit(0.0), F.least(F.col("po") * POINTS_A_COLUMN, F.lit(612.0) - size * 0.6)).alias("left_pt"),
    )


def roll(arg: Column) -> Column:
    """The sub- and superscript roll in 48ths of an inch; fractions are of an inch, zero means none."""
    form = r"^\s*([0-9.]+)\s*/\s*([0-9.]+)"
    a, b = F.regexp_extract(arg, form, 1).try_cast("double"), F.regexp_extract(arg, form, 2).try_cast("double")
    n = F.nullif(F.regexp_extract(arg, NUMBER, 1), F.lit("")).try_cast("double")
    return F.when(arg.rlike(form), F.when(b != 0, a / b * 48)).otherwise(F.coalesce(inches(n, F.regexp_extract(arg, NUMBER, 2)) * 48, n))


def margin_columns(cmd: Column, value: Column, unit: Column) -> Column:
    """Left, right and paragraph margins in columns; without a unit the left ones count from one."""
    plain = F.when(cmd == "rm", value).otherwise(F.greatest(F.lit(0.0), value - 1))
    return F.coalesce(inches(value, unit) * 10, plain)


def tab_stops(arg: Column) -> Column:
    """Distinct tab stops of a .tb line, in order; a leading # marks decimal ones and is dropped."""
    n = F.transform(F.split(F.trim(arg), r"[\s,]+"), lambda x: F.regexp_replace(x, "^#", "").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(n, lambda x: x.isNotNull() & (x > 0))))


def capacity_in_force(margins: DataFrame, pages: DataFrame, pl: float = 66.0, lh: float = 8.0) -> DataFrame:
    """``doc_id, page, capacity``: text lines of each page, by the margins set last at or before its first line."""
    first = pages.groupBy("doc_id", "page").agg(F.min("pos").alias("pos"))
    both = margins.select("doc_id", "pos", "mt", "mb", F.lit(None).cast("long").alias("page")).unionByName(first.select("doc_id", "pos", F.lit(None).cast("double").alias("mt"), F.lit(None).cast("double").alias("mb"), F.col("page").cast("long").alias("page")))
    w = Window.partitionBy("doc_id").orderBy("pos", F.col("page").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, d: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(d))
    held = both.withColumn("now_mt", last("mt", 3.0)).withColumn("now_mb", last("mb", 8.0)).where("page is not null")
    return held.select("doc_id", "page", F.greatest(F.lit(LEAST_BODY + 1), text_lines(F.lit(pl), F.col("now_mt"), F.col("now_mb"), F.lit(lh))).alias("capacity"))


def paginate_breaks(lines: DataFrame, capacity: int = 55) -> DataFrame:
    """``doc_id, pos, page`` of text lines in ``doc_id, pos, kind, n``. Kinds: ``text``; ``over``, which takes no room;
    ``pagebreak``; ``condpage``, which breaks a page that holds something and has fewer than n lines left."""

    def pages(kinds: list[str], needs: list[int]) -> Iterator[int | None]:
        page, used = 1, 0
        for kind, need in zip(kinds, needs, strict=True):
            if kind == "pagebreak" or (kind == "condpage" and used and capacity - used < need):
                page, used = page + 1, 0
            if kind == "text":
                page, used = (page + 1, 1) if used and used + 1 > capacity else (page, used + 1)
            yield page if kind in ("text", "over") else None

    return folded(lines, {"kind": F.col("kind"), "n": F.col("n")}, pages, "page")


def note_pages(body: list[tuple[str, list[list[str]]]], capacity: int) -> list[tuple[list[str], list[str]]]:
    """Pages of body lines and note lines. A line brings its notes to the foot of its page, behind a rule; what doesn't
    fit goes on to the next page behind a line that says so; three body lines stay wherever there are that many."""
    pages: list[tuple[list[str], list[str]]] = []
    page: list[str] = []
    foot: list[str] = []
    waiting: list[str] = []

    def close() -> None:
        nonlocal page, foot, waiting
        if waiting:
            foot.append("...Continued...")
        pages.append((page, foot))
        room = capacity - 1 - (LEAST_BODY if waiting else 0)
        page, foot = [], []
        if waiting:
            foot, waiting = ["-" * RULE, *waiting[: room - 1]], waiting[room - 1 :]

    for text, notes in body:
        reserve = bool(waiting)
        if page and len(page) + 1 + len(foot) + reserve > capacity:
            close()
        page.append(text)
        for note in notes:
            rows = list(note)
            if not foot and rows:
                foot.append("-" * RULE)
            room = max(0, capacity - 1 - max(len(page), LEAST_BODY) - len(foot)) if not waiting else 0
            foot += rows[:room]
            waiting += rows[room:]
    while page or foot or waiting:
        close()
    return pages


def paginate_notes(documents: DataFrame, capacity: int = 55) -> DataFrame:
    """``doc_id, page, lines, notes`` for ``doc_id, body`` with body as array of (text, notes as arrays of lines)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k + 1, a, b) for i, body in zip(batch["doc_id"], batch["body"], strict=True) for k, (a, b) in enumerate(note_pages([(x["text"], [list(n) for n in x["notes"]]) for x in body], capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "lines", "notes"])

    return documents.select("doc_id", "body").mapInPandas(run, "doc_id long, page int, lines array<string>, notes array<string>")
