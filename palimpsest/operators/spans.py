"""Operators over arrays of spans, as expressions: coalescing, graphics, indents, visible text, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = "struct<text:string,styles:array<string>,font:int,colour:int,ref:int>"
GRAPHICS = r"[\x{2500}-\x{259F}]+"


def visible_text(spans: Column) -> Column:
    """The text of a line without note marks."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["ref"].isNull()), lambda s: s["text"]), "")


def coalesce(spans: Column) -> Column:
    """Neighbours of equal look as one span; note marks stay apart, empty spans go."""
    look = lambda s: F.struct(F.array_sort(s["styles"]), s["font"], s["colour"], s["ref"])
    start = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joins = (F.size(out) > 0) & s["ref"].isNull() & look(last).eqNullSafe(look(s))
        grown = F.struct(F.concat(last["text"], s["text"]).alias("text"), last["styles"].alias("styles"), last["font"].alias("font"), last["colour"].alias("colour"), last["ref"].alias("ref"))
        return F.when(s["text"] == "", out).when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, start, step)


def split_graphics(spans: Column) -> Column:
    """Runs of box and shade characters as spans of their own."""
    pieces = lambda s: F.regexp_extract_all(s["text"], F.lit(rf"({GRAPHICS}|[^\x{{2500}}-\x{{259F}}]+)"), F.lit(1))
    return F.flatten(F.transform(spans, lambda s: F.transform(pieces(s), lambda p: F.struct(p.alias("text"), s["styles"].alias("styles"), s["font"].alias("font"), s["colour"].alias("colour"), s["ref"].alias("ref")))))


def leading_indent(spans: Column) -> Column:
    """Spaces before the first visible character, across changes of style and past note marks."""
    return F.length(F.regexp_extract(visible_text(spans), "^ *", 0))


def effective_styles(span_styles: Column, style_attrs: Column, heading: Column) -> Column:
    """A span's styles with its paragraph style's; headings are bold."""
    return F.array_sort(F.array_union(F.array_union(span_styles, F.coalesce(style_attrs, F.array().cast("array<string>"))), F.when(heading.isNotNull(), F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))))


def dominant_style(spans: DataFrame) -> DataFrame:
    """``doc_id, block_ix, styles``: the style set of most spans of a block; of equally common ones the first seen."""
    key = F.array_join(F.array_sort("styles"), ",")
    n = spans.groupBy("doc_id", "block_ix", key.alias("styles")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return n.groupBy("doc_id", "block_ix").agg(F.max_by("styles", F.struct("n", -F.col("first"))).alias("styles"))


def style_in_force(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """As-of: the last style selected at or before each block. One window over both instead of a range join."""
    both = events.select("doc_id", "pos", F.col("style_id").alias("style"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("block_ix")).unionByName(
        blocks.select("doc_id", "pos", F.lit(None).cast("int").alias("style"), F.lit(1).alias("turn"), F.col("block_ix").cast("long").alias("block_ix"))
    )
    w = Window.partitionBy("doc_id").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("style_id", F.last("style", ignorenulls=True).over(w)).where("turn = 1").select("doc_id", "block_ix", "style_id")


def align_spaces(text: Column, align: Column) -> Column:
    """The typed padding of centred and right-aligned lines goes; other lines keep it."""
    return F.when(align.isin("center", "right"), F.trim(text)).otherwise(text)


#: Fixed: what the symbol face shows for the characters of its codes; suits that the dingbats face has beside its block.
SYMBOL_CODES = "ABGDEZHQIKLMNXOPRSTUFCYWabgdezhqiklmnxoprstufcywVjvJ\"$'*-@~¹£³´¸¥ÎÏåÕÖ×¶Ñò«¬®¯"
SYMBOL_SHOWN = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρστυφχψωςϕϖϑ∀∃∋∗−≅∼≠≤≥×÷∞∈∉∑∏√⋅∂∇∫↔←→↓"
SUIT_CODES, SUITS = "¨©ª«", "♣♦♥♠"


def symbol(text: Column) -> Column:
    return F.translate(text, SYMBOL_CODES, SYMBOL_SHOWN)


def unsymbol(text: Column) -> Column:
    return F.translate(text, SYMBOL_SHOWN, SYMBOL_CODES)


#: The dingbats face shows its codes 21 to 7E as the characters 2701 to 275E.
_DINGBAT_CODES = "".join(map(chr, range(0x21, 0x7F)))
_DINGBATS = "".join(chr(0x2700 + ord(c) - 0x20) for c in _DINGBAT_CODES)


def dingbats(text: Column) -> Column:
    return F.translate(text, _DINGBAT_CODES + SUIT_CODES, _DINGBATS + SUITS)


def undingbats(text: Column) -> Column:
    return F.translate(text, _DINGBATS + SUITS, _DINGBAT_CODES + SUIT_CODES)
