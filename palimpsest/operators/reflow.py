"""Verse and prose, lists and centring, note labels, pagination."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lexical import TERMINAL

#: Fixed: shares that decide between verse and prose.
VERSE_TERMINAL, QUOTE_VETO, PROSE_CEILING = 0.8, 1 / 3, 0.9
SELF_CONTAINED = r"^\s*[\"‘“'].*[\"’”'].*$"
BOXES = r"[\x{2500}-\x{259F}]"


def folded(rows: DataFrame, fields: dict[str, Column], step: Callable[..., Iterator[int | None]], name: str) -> DataFrame:
    """``doc_id, pos`` and a number for each row of a document, by one pass over its rows in order: ``step`` takes the
    fields' values and gives a number, or null for a row that has none. Linear in a document's rows."""
    names = ("pos", *fields)
    held = rows.select("doc_id", F.col("pos").cast("long").alias("pos"), *[c.alias(n) for n, c in fields.items()])
    ordered = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            ends = lists.offsets.to_numpy()
            columns = [lists.values.field(n).to_pylist() for n in names]
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends, ends[1:], strict=False):
                pos, *values = (c[a:b] for c in columns)
                made = list(step(*values))
                keep = [k for k, x in enumerate(made) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(keep), pa.int64()), pa.array(np.array(pos, dtype=np.int64)[keep]), pa.array([made[k] for k in keep], pa.int64())], names=["doc_id", "pos", name])

    return ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "rows").mapInArrow(run, f"doc_id long, pos long, {name} long")


def verse_verdict(n_text: Column, n_graphic: Column, n_scored: Column, n_quotes: Column, n_terminal: Column) -> Column:
    """Whether a run of short lines is a stanza; ties are prose."""
    share = n_terminal / F.nullif(n_scored, F.lit(0))
    return (
        F.when((n_text >= 2) & (n_graphic / F.nullif(n_text, F.lit(0)) >= 0.5), True)
        .when(n_scored < 2, False)
        .when(n_quotes / F.nullif(n_scored, F.lit(0)) >= QUOTE_VETO, False)
        .when(share >= PROSE_CEILING, False)
        .otherwise(share < VERSE_TERMINAL)
    )


def verse_runs(lines: DataFrame, run: Column) -> DataFrame:
    """``doc_id, run_ix`` with counts and the verdict; ``run`` numbers the runs of ``doc_id, pos, line``."""
    line = F.col("line")
    letters = line.rlike(r"\p{L}")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    text = F.trim("line") != ""
    counted = lines.groupBy("doc_id", run.alias("run_ix")).agg(
        n(text).alias("n_text"),
        n(text & ~letters & line.rlike(BOXES)).alias("n_graphic"),
        n(letters).alias("n_scored"),
        n(letters & line.rlike(SELF_CONTAINED)).alias("n_quotes"),
        n(letters & line.rlike(TERMINAL)).alias("n_terminal"),
    )
    return counted.withColumn("is_verse", verse_verdict(*[F.col(c) for c in ("n_text", "n_graphic", "n_scored", "n_quotes", "n_terminal")]))


def modal_indent(lines: DataFrame) -> DataFrame:
    """``doc_id, indent``: the commonest indent of opening lines; of equally common ones the first seen."""
    held = lines.where(F.trim("line") != "").select("doc_id", "pos", F.length(F.regexp_extract("line", "^ *", 0)).alias("indent"))
    counted = held.groupBy("doc_id", "indent").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("doc_id").agg(F.max_by("indent", F.struct("n", -F.col("first"))).alias("indent"), F.max("n").alias("n_lines"))


def paragraph_units(lines: DataFrame, least: int = 5) -> DataFrame:
    """``doc_id, unit_ix, line_from, line_to, n_lines``: a line indented by five spaces or more begins a unit."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    opens = F.col("line").rlike(rf"^ {{{least},}}\S")
    held = lines.where(F.trim("line") != "").withColumn("unit_ix", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    return held.groupBy("doc_id", "unit_ix").agg(F.min("pos").alias("line_from"), F.max("pos").alias("line_to"), F.count("*").alias("n_lines"))


#: Fixed: a scene's heading line, and the blocks that a scene reaches over.
SLUGLINE = r"^[ \t]*\d{0,4}[ \t]*(?:&[^&\r\n]{1,24}&[ \t]*)?(?:INT\.|EXT\.|INT\.?/EXT\.|I/E\.)[ \t]"
SCENE = 40


def screenplay_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_ix, in_scene`` of ``doc_id, block_ix, text, heading, kind``, text being a block's lines. A scene
    begins at a block with a slugline and ends before the next one, at a heading or a break, or ``SCENE`` blocks on."""
    order = Window.partitionBy("doc_id").orderBy("block_ix").rowsBetween(Window.unboundedPreceding, 0)
    para = F.col("kind") == "para"
    slug = para & F.col("text").rlike("(?m)" + SLUGLINE)
    start = F.max(F.when(slug, F.col("block_ix"))).over(order)
    stop = F.max(F.when(~slug & (~para | F.col("heading").isNotNull()), F.col("block_ix"))).over(order)
    held = blocks.select("doc_id", "block_ix", start.alias("start"), stop.alias("stop"))
    inside = F.col("start").isNotNull() & (F.col("block_ix") - F.col("start") <= SCENE) & (F.col("stop").isNull() | (F.col("stop") < F.col("start")))
    return held.select("doc_id", "block_ix", F.coalesce(inside, F.lit(False)).alias("in_scene"))


def bullets(lines: DataFrame) -> DataFrame:
    """Rows of lists: ``doc_id, pos, col, marker, body``. A glyph is a bullet where it opens lines at one column at least twice."""
    form = r"^( *)([^\p{L}\p{N}\s])( +)(\S.*)$"
    held = lines.where(F.col("line").rlike(form)).select("doc_id", "pos", F.length(F.regexp_extract("line", form, 1)).alias("col"), F.regexp_extract("line", form, 2).alias("marker"), F.regexp_extract("line", form, 4).alias("body"))
    alone = held.where(~F.expr("contains(body, marker)"))
    return alone.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "col", "marker"))).where("n >= 2").drop("n")


def definitions(lines: DataFrame) -> DataFrame:
    form = r"^(\S+:)( {2,})(\S.*)$"
    return lines.where(F.col("line").rlike(form)).select("doc_id", "pos", F.regexp_extract("line", form, 1).alias("label"), F.regexp_extract("line", form, 3).alias("body"))


def levels(columns: list[int]) -> Iterator[int]:
    stack: list[int] = []
    for column in columns:
        while stack and stack[-1] >= column:
            stack.pop()
        stack.append(column)
        yield len(stack)


def nesting(rows: DataFrame) -> DataFrame:
    """``doc_id, pos, level``: a stack of columns. A deeper column pushes, a shallower one pops to where it fits."""
    return folded(rows, {"col": F.col("col")}, levels, "level")


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a positive number; other numbers as they are."""
    pairs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))])
    start = F.struct(n.cast("int").alias("rest"), F.lit("").alias("out"))
    done = F.aggregate(pairs, start, lambda a, p: F.struct((a["rest"] % p["v"]).cast("int").alias("rest"), F.concat(a["out"], F.repeat(p["s"], F.floor(a["rest"] / p["v"]).cast("int"))).alias("out")), lambda a: a["out"])
    return F.when(n > 0, done).otherwise(n.cast("string"))


def note_labels(notes: DataFrame, start: int = 1, scheme: str = "word") -> DataFrame:
    """``doc_id, note_ix, kind`` with ``rank`` among its kind, ``label`` and ``shown`` under the scheme. Ranks are
    over all notes; filters come after. ``number`` (from 0) and ``tag`` count where they are set."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("note_ix"))
    held = notes.withColumn("rank", rank)
    number = F.coalesce(F.col("number"), F.col("rank") - 1) + start
    label = F.when(F.col("kind") == "annotation", F.coalesce("tag", F.col("rank").cast("string"))).when(F.col("kind").isin("footnote", "endnote"), number.cast("string")).otherwise(F.col("rank").cast("string"))
    held = held.withColumn("label", label)
    prefixed = F.concat(F.when(F.col("kind") == "endnote", "e").when(F.col("kind") == "annotation", "a").when(F.col("kind") == "comment", "c").otherwise(""), "rank")
    word = F.when(F.col("kind") == "endnote", roman(F.col("label").cast("int"))).when(F.col("kind") == "comment", F.concat(F.lit("c"), "rank")).otherwise(F.col("label"))
    return held.withColumn("shown", prefixed if scheme == "prefixed" else word)


def slug(label: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit("0")).otherwise(made)


def aligned(line: Column, align: Column, right: int = 65, left: int = 0) -> Column:
    """The line padded for centre or right alignment in a measure of right + left + 1 columns."""
    stripped = F.trim(line)
    pad = F.greatest(F.lit(0), F.lit(right + left + 1) - F.length(stripped))
    return F.when(align == "center", F.concat(F.repeat(F.lit(" "), F.floor(pad / 2).cast("int")), stripped)).when(align == "right", F.concat(F.repeat(F.lit(" "), pad), stripped)).otherwise(line)


def paginate(lines: DataFrame, capacity: int = 55, width: int = 65) -> DataFrame:
    """``doc_id, pos, page``: lines wrapped at ``width`` fill pages greedily; a line never breaks an empty page."""

    def pages(rows: list[int]) -> Iterator[int]:
        page, used = 1, 0
        for n in rows:
            if used and used + n > capacity:
                page, used = page + 1, 0
            used += n
            yield page

    return folded(lines, {"rows": F.greatest(F.lit(1), F.ceil(F.length("line") / width)).cast("int")}, pages, "page")
