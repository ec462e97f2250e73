"""Queries of dot commands: what they set from their place on, what they collect, and where they break.

Commands are put before lines chosen by their position, as lines of their own; every line of the documents stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import blocks, emit, geometry, marks, reflow
from palimpsest.plans.catalogue import query
from palimpsest.plans.documents import LINES_SQL, lines, table
from palimpsest.plans.formats import files, latin_lines, partitions

SEEN = f"{LINES_SQL}, seen AS (SELECT doc_id, pos, translate(line, 'ÈÓÊÍ', '????') AS line FROM lines)"


def inserted(rules: list[tuple[str, str]], gap: str = "\r\n"):
    """Each line behind the commands that its position calls for. Conditions and commands are SQL over ``pos, doc_id``."""
    import re

    def framed(line: Column, k: Column) -> Column:
        parts = []
        for cond, said in rules:
            m, n, r = re.fullmatch(r"pos % (\d+) = (\d+)(.*)", cond).groups()
            parts.append(F.when(k % int(m) == int(n), F.concat(*[F.col("doc_id").cast("string") if x == "{doc}" else k.cast("string") if x == "{pos}" else F.lit(x) for x in re.split(r"(\{\w+\})", said) if x], F.lit("\r\n"))).otherwise(F.lit("")))
        return F.concat(*parts, line, F.lit(gap))

    return lambda spark, sf_dir: files(latin_lines(spark, sf_dir), F.transform("l", framed))


def folded(spark: SparkSession, sf_dir: str, rules: list[tuple[str, str]], gap: str = "\r\n") -> DataFrame:
    return blocks.read_blocks(inserted(rules, gap)(spark, sf_dir), variant="ws5+", partitions=partitions(spark))


STATES = [
    ("pos % 10 = 1", ".lm 8"), ("pos % 10 = 6", ".lm 0.5\""), ("pos % 11 = 3", ".rm 60"), ("pos % 13 = 2", ".pm5"), ("pos % 10 = 4", ".oc on"), ("pos % 10 = 7", ".oc off"),
    ("pos % 8 = 2", ".oj on"), ("pos % 8 = 5", ".OJ r"), ("pos % 12 = 7", ".co2, 0.3\""), ("pos % 12 = 11", ".co 1"), ("pos % 9 = 2", ".aw off"), ("pos % 9 = 5", ".aw on"), ("pos % 7 = 3", ".lh 12"), ("pos % 7 = 6", ".lh8"),
]
_STATES = f"""{SEEN}, said AS (SELECT *, CASE pos % 10 WHEN 1 THEN 7.0 WHEN 6 THEN 5.0 END AS lm, CASE WHEN pos % 11 = 3 THEN 60.0 END AS rm, CASE WHEN pos % 13 = 2 THEN 4.0 END AS pm, CASE pos % 10 WHEN 4 THEN 'on' WHEN 7 THEN 'off' END AS oc,
      CASE pos % 8 WHEN 2 THEN 'justify' WHEN 5 THEN 'right' END AS oj, CASE pos % 12 WHEN 7 THEN 2 WHEN 11 THEN 1 END AS co, CASE WHEN pos % 12 = 7 THEN 3.0 END AS gutter, CASE pos % 9 WHEN 2 THEN 'off' WHEN 5 THEN 'on' END AS aw, CASE pos % 7 WHEN 3 THEN 12.0 WHEN 6 THEN 8.0 END AS lh FROM seen),
    held AS (SELECT doc_id, pos, line, last_value(lm IGNORE NULLS) OVER w AS lm, last_value(rm IGNORE NULLS) OVER w AS rm, last_value(pm IGNORE NULLS) OVER w AS pm, last_value(oc IGNORE NULLS) OVER w AS oc, last_value(oj IGNORE NULLS) OVER w AS oj,
      last_value(co IGNORE NULLS) OVER w AS co, last_value(gutter IGNORE NULLS) OVER w AS gutter, last_value(aw IGNORE NULLS) OVER w AS aw, last_value(lh IGNORE NULLS) OVER w AS lh, first_value(lh IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_lh
      FROM said WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    formed AS (SELECT doc_id, pos, line, lm::DOUBLE AS lm, rm::DOUBLE AS rm, pm::DOUBLE AS pm, co::BIGINT AS co, gutter::DOUBLE AS gutter, coalesce(aw, 'on') = 'on' AS wrap, CASE WHEN oc = 'on' THEN 'center' ELSE coalesce(oj, 'left') END AS align,
      nullif(coalesce(lh, 8.0), coalesce(first_lh, 8.0))::DOUBLE AS lead FROM held)"""


@query("line_formats", f"WITH {_STATES} SELECT doc_id, pos::BIGINT AS pos, line AS text, lm AS left_margin, rm AS right_margin, pm AS para_margin, co AS columns, gutter, wrap, align, lead FROM formed")
def line_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins, alignment, wrap, columns and line height in force at each line."""
    each = F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda x: F.struct(x["text"], x["lead"], b["left"].alias("left"), b["right"].alias("right"), b["para"].alias("para"), b["columns"].alias("columns"), b["gutter"].alias("gutter"), b["wrap"].alias("wrap"), b["align"].alias("align")))))
    rows = folded(spark, sf_dir, STATES).select("doc_id", F.posexplode(each).alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "x.text", F.col("x.left").alias("left_margin"), F.col("x.right").alias("right_margin"), F.col("x.para").alias("para_margin"), F.col("x.columns").cast("long").alias("columns"), "x.gutter", "x.wrap", "x.align", "x.lead")


@query(
    "block_runs",
    f"""WITH {_STATES}, t AS (SELECT *, concat_ws('|', coalesce(lm, -1), coalesce(rm, -1), coalesce(pm, -1), coalesce(co, -1), coalesce(gutter, -1), wrap, align) AS look FROM formed), u AS (SELECT *, CASE WHEN look <> lag(look) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM t),
    v AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS block_ix FROM u) SELECT doc_id, block_ix::BIGINT AS block_ix, count(*)::BIGINT AS n_lines, min(align) AS align, string_agg(line, chr(10) ORDER BY pos) AS text FROM v GROUP BY doc_id, block_ix""",
)
def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block ends wherever one of its properties changes."""
    rows = folded(spark, sf_dir, STATES).select("doc_id", F.posexplode("blocks").alias("k", "b"))
    return rows.select("doc_id", F.col("k").cast("long").alias("block_ix"), F.size("b.lines").cast("long").alias("n_lines"), "b.align", F.array_join(F.transform("b.lines", lambda x: x["text"]), "\n").alias("text"))


PAGE = [("pos % 1000 = 0", ".mt {doc}"), ("pos % 1000 = 0", ".mt 2"), ("pos % 1000 = 0", ".pl 14\""), ("pos % 1000 = 0", ".po .8\""), ("pos % 1000 = 0", ".LH6"), ("pos % 1000 = 0", ".cw 10"), ("pos % 1000 = 0", ".ls 3"), ("pos % 1000 = 0", ".ls 2"), ("pos % 1000 = 0", ".pn5"), ("pos % 1000 = 0", ".hm junk"), ("pos % 1000 = 0", ".fm 72pt"), ("pos % 1000 = 0", ".mb 2.54cm")]


@query(
    "page_values",
    """WITH v AS (SELECT doc_id, unnest(['mt', 'pl', 'po', 'lh', 'cw', 'ls', 'pn', 'fm', 'mb']) AS name, unnest([doc_id::DOUBLE, 84, 8, 6, 10, 3, 5, 6, 6]) AS value FROM documents) SELECT doc_id, name, round(value, 6)::DOUBLE AS value FROM v""",
)
def page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, junk, and the first value of each command, which wins."""
    return folded(spark, sf_dir, PAGE).select("doc_id", F.explode("page").alias("name", "value")).select("doc_id", "name", F.round("value", 6).alias("value"))


COLLECTED = [("pos % 8 = 2", ".tc2 Entry {pos} #"), ("pos % 8 = 6", ".TC Plain {pos}"), ("pos % 5 = 4", ".ix term {pos}"), ("pos % 9 = 3", ".h1 Head {pos}"), ("pos % 9 = 7", ".fo"), ("pos % 14 = 5", ".f3 Foot #")]


@query(
    "collected_entries",
    f"""WITH {SEEN} SELECT doc_id, 'toc' AS what, CASE pos % 8 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS n, CASE pos % 8 WHEN 2 THEN 'Entry ' || pos || ' #' ELSE 'Plain ' || pos END AS text, pos::BIGINT AS block_ix FROM seen WHERE pos % 8 IN (2, 6)
    UNION ALL SELECT doc_id, 'index', 0, 'term ' || pos, pos FROM seen WHERE pos % 5 = 4 UNION ALL SELECT doc_id, 'head', 1, 'Head ' || pos, pos FROM seen WHERE pos % 9 = 3
    UNION ALL SELECT doc_id, 'foot', 1, '', pos FROM seen WHERE pos % 9 = 7 UNION ALL SELECT doc_id, 'foot', 3, 'Foot #', pos FROM seen WHERE pos % 14 = 5""",
)
def collected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents, index and running heads, each with the block that follows it."""
    held = folded(spark, sf_dir, COLLECTED, "\r\n\r\n")
    row = lambda what, n, text, at: F.struct(what.alias("what"), n.cast("long").alias("n"), text.alias("text"), at.cast("long").alias("block_ix"))
    every = F.concat(F.transform("toc", lambda x: row(F.lit("toc"), x["level"], x["entry"], x["block_ix"])), F.transform("index", lambda x: row(F.lit("index"), F.lit(0), x["entry"], x["block_ix"])), F.transform("heads", lambda x: row(x["place"], x["n"], x["text"], x["block_ix"])))
    return held.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


@query(
    "contents_section",
    f"""WITH {SEEN}, c AS (SELECT doc_id, string_agg(CASE pos % 8 WHEN 2 THEN '  Entry ' || pos ELSE 'Plain ' || pos END, chr(10) ORDER BY pos) AS toc FROM seen WHERE pos % 8 IN (2, 6) GROUP BY doc_id),
    i AS (SELECT doc_id, string_agg('term ' || pos, chr(10) ORDER BY pos) AS idx FROM seen WHERE pos % 5 = 4 GROUP BY doc_id)
    SELECT doc_id, coalesce(toc, '') AS toc, coalesce(idx, '') AS idx FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def contents_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled contents and index at the end of a text."""
    made = emit.convert(inserted(COLLECTED, "\r\n\r\n")(spark, sf_dir), to="text", variant="ws5+", partitions=partitions(spark), toc=True)
    toc = F.regexp_extract("output", r"(?s)\nTABLE OF CONTENTS\n\n(.*?)(\n\nINDEX\n|\n\n?$)", 1)
    return made.select("doc_id", F.rtrim(toc, F.lit("\n")).alias("toc"), F.regexp_extract("output", r"(?s)\nINDEX\n\n(.*)\n$", 1).alias("idx"))


@query(
    "styled_heads",
    r"SELECT doc_id, '{\\header \\pard\\plain \\f0\\fs22 {Part ' || doc_id || ' }{\\b bold}{ and }{\\i it}{ p. {\\chpgn }}\\par}' AS header, 2::BIGINT AS n_runs FROM documents".replace("\\\\", "\\"),
)
def styled_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running head keeps its toggles, and its number sign becomes the page number's field."""
    held = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.lit(".he Part "), F.col("doc_id").cast("string"), F.lit(" \x02bold\x02 and \x19it\x19 p. #\r\nbody\r\n")), "ISO-8859-1").alias("content"))
    made = emit.convert(held, to="rtf", variant="ws5+", partitions=partitions(spark))
    header = F.regexp_extract("output", r"(\{\\header .*?\\par\})", 1)
    return made.select("doc_id", header.alias("header"), F.regexp_count(header, F.lit(r"\\[bi] ")).cast("long").alias("n_runs"))


@query(
    "comment_notes",
    f"WITH {SEEN} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS note_ix, CASE pos % 6 WHEN 1 THEN 'remark ' || pos ELSE 'other ' || pos END AS text, CASE pos % 6 WHEN 1 THEN '..' ELSE '.ig' END AS origin, pos::BIGINT AS block_ix FROM seen WHERE pos % 6 IN (1, 4)",
)
def comment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lines become notes, whose marks stand on the lines that follow."""
    held = folded(spark, sf_dir, [("pos % 6 = 1", "..remark {pos}"), ("pos % 6 = 4", ".ig other {pos}")], "\r\n\r\n")
    refs = held.select("doc_id", F.posexplode("blocks").alias("block_ix", "b")).select("doc_id", "block_ix", F.explode(F.flatten(F.transform("b.lines", lambda x: x["refs"]))).alias("note_ix"))
    notes = held.select("doc_id", F.explode("notes").alias("n")).select("doc_id", "n.note_ix", "n.text", "n.origin")
    return notes.join(refs, ["doc_id", "note_ix"]).select("doc_id", F.col("note_ix").cast("long").alias("note_ix"), "text", "origin", F.col("block_ix").cast("long").alias("block_ix"))


SETTINGS = [("pos % 1000 = 0", x) for x in (".op", ".pr or=l", ".sr 3/48", ".f# {doc}", ".f# 1", ".e# page", ".l# 5", ".p# 1.Z", ".cc 4", ".cv f e", ".pe", ".ul off", ".psa", ".kr on", ".sb maybe")]


@query(
    "document_settings",
    "SELECT doc_id, false AS auto_numbers, 'landscape' AS orientation, 3.0::DOUBLE AS roll, doc_id AS footnote_start, 'page' AS endnote_mode, 5::BIGINT AS line_numbers, '1.Z' AS paragraph_numbers, '4' AS conditional_column, 'f e' AS converted_note, true AS endnotes_here, false AS ul, true AS foreign_producer, true AS kr FROM documents",
)
def document_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "auto_numbers boolean, orientation string, roll double, footnote_start long, endnote_mode string, line_numbers long, paragraph_numbers string, conditional_columns array<string>, converted_notes array<string>, endnotes_here boolean, ul boolean, foreign boolean, kr boolean"
    held = folded(spark, sf_dir, SETTINGS).select("doc_id", F.from_json("settings", form).alias("s"))
    names = ("auto_numbers", "orientation", "roll", "footnote_start", "endnote_mode", "line_numbers", "paragraph_numbers")
    return held.select("doc_id", *[f"s.{n}" for n in names], F.col("s.conditional_columns")[0].alias("conditional_column"), F.col("s.converted_notes")[0].alias("converted_note"), "s.endnotes_here", "s.ul", F.col("s.foreign").alias("foreign_producer"), "s.kr")


@query(
    "break_blocks",
    f"""WITH {SEEN} SELECT doc_id, pos::BIGINT AS before_line, 'pagebreak' AS kind, 0::BIGINT AS need FROM seen WHERE pos % 7 = 3 UNION ALL SELECT doc_id, pos, 'condpage', 1 + pos % 10 FROM seen WHERE pos % 10 = 5""",
)
def break_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page breaks and conditional ones as blocks, each with the number of the line after it."""
    held = folded(spark, sf_dir, [("pos % 7 = 3", ".pa"), ("pos % 10 = 5", ".cp 6")], "\r\n\r\n")
    rows = held.select("doc_id", "blocks", F.posexplode("blocks").alias("k", "b")).where("b.kind <> 'para'")
    before = F.size(F.filter(F.slice("blocks", F.lit(1), F.col("k") + 1), lambda x: x["kind"] == "para"))
    return rows.select("doc_id", before.cast("long").alias("before_line"), "b.kind", F.col("b.need").cast("long").alias("need"))


@query("insert_blocks", f"WITH {SEEN} SELECT doc_id, pos::BIGINT AS before_line, '[insert: PART' || pos || '.DOC]' AS text FROM seen WHERE pos % 6 = 2")
def insert_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = folded(spark, sf_dir, [("pos % 6 = 2", ".fi PART{pos}.DOC 2")], "\r\n\r\n")
    rows = held.select("doc_id", "blocks", F.posexplode("blocks").alias("k", "b")).where("b.origin = 'fi'")
    before = F.size(F.filter(F.slice("blocks", F.lit(1), F.col("k") + 1), lambda x: x["origin"] == ""))
    return rows.select("doc_id", before.cast("long").alias("before_line"), F.col("b.lines")[0]["text"].alias("text"))


# the same commands as rows of lines

MARKED = "marked AS (SELECT doc_id, pos, CASE pos % 12 WHEN 1 THEN '.tc' || (pos % 3 + 1) || ' ' || line WHEN 3 THEN '.ix ' || line WHEN 4 THEN '.fi FILE' || pos WHEN 5 THEN '.pa' WHEN 6 THEN '.cp ' || (pos % 9 + 2) WHEN 7 THEN '.he ' || line WHEN 8 THEN '.f2 ' || line WHEN 9 THEN '..' || line WHEN 10 THEN '.psa' ELSE line END AS line FROM lines)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pos = F.col("pos") % 12, F.col("pos")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = F.col("line")
    cases = {1: text(".tc", pos % 3 + 1, " ", line), 3: text(".ix ", line), 4: text(".fi FILE", pos), 5: F.lit(".pa"), 6: text(".cp ", pos % 9 + 2), 7: text(".he ", line), 8: text(".f2 ", line), 9: text("..", line), 10: F.lit(".psa")}
    out = F
    for n, value in cases.items():
        out = out.when(k == n, value)
    return lines(spark, sf_dir).withColumn("line", out.otherwise(line))


@query("marks_contents", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, (pos % 3 + 1)::BIGINT AS level, line AS entry FROM lines WHERE pos % 12 = 1")
def marks_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.contents(marked(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "entry")


@query("marks_index", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, line AS entry FROM lines WHERE pos % 12 = 3")
def marks_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.index_entries(marked(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "entry")


@query("marks_includes", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, '[insert: FILE' || pos || ']' AS shown FROM lines WHERE pos % 12 = 4")
def marks_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.includes(marked(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "shown")


@query("marks_breaks", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, CASE pos % 12 WHEN 5 THEN 'pagebreak' ELSE 'condpage' END AS kind, CASE WHEN pos % 12 = 6 THEN (pos % 9 + 2)::BIGINT END AS lines FROM lines WHERE pos % 12 IN (5, 6)")
def marks_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.breaks(marked(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.col("lines").cast("long").alias("lines"))


@query("marks_comments", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, line AS text FROM lines WHERE pos % 12 = 9")
def marks_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.comment_lines(marked(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


@query("marks_foreign", f"WITH {LINES_SQL} SELECT doc_id, max(pos) >= 10 AS is_foreign FROM lines GROUP BY doc_id")
def marks_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.foreign(marked(spark, sf_dir))


@query("marks_heads", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, CASE pos % 12 WHEN 7 THEN 'head' ELSE 'foot' END AS place, CASE pos % 12 WHEN 7 THEN 1 ELSE 2 END::BIGINT AS n, line AS text FROM lines WHERE pos % 12 IN (7, 8)")
def marks_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.head_events(marked(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "place", F.col("n").cast("long").alias("n"), "text")


@query(
    "marks_last_heads",
    f"WITH {LINES_SQL}, e AS (SELECT doc_id, pos, CASE pos % 12 WHEN 7 THEN 'head' ELSE 'foot' END AS place, line AS text FROM lines WHERE pos % 12 IN (7, 8)) SELECT doc_id, max_by(text, pos) FILTER (place = 'head') AS head, max_by(text, pos) FILTER (place = 'foot') AS foot FROM e GROUP BY doc_id",
)
def marks_last_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = marks.running_heads(marks.head_events(marked(spark, sf_dir)))
    return held.select("doc_id", F.try_element_at("heads", F.lit(1)).alias("head"), F.try_element_at("feet", F.lit(2)).alias("foot"))


@query(
    "heads_by_page",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, pos, pos // 20 + 1 AS page FROM lines), s AS (SELECT doc_id, page, min(pos) AS pos FROM p GROUP BY doc_id, page),
    e AS (SELECT doc_id, pos, 'Page # of ' || pos AS text FROM lines WHERE pos % 12 = 7),
    h AS (SELECT s.doc_id, s.page, max_by(e.text, e.pos) AS text FROM s JOIN e ON e.doc_id = s.doc_id AND e.pos <= s.pos GROUP BY s.doc_id, s.page)
    SELECT doc_id, page::BIGINT AS page, replace(text, '#', page::VARCHAR) AS text FROM h""",
)
def heads_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head in force where each page begins."""
    source = lines(spark, sf_dir)
    headed = source.withColumn("line", F.when(F.col("pos") % 12 == 7, F.concat(F.lit(".he Page # of "), F.col("pos").cast("string"))).otherwise(F.col("line")))
    pages = source.select("doc_id", "pos", (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"))
    return marks.heads_on_pages(marks.head_events(headed), pages).select("doc_id", F.col("page").cast("long").alias("page"), "text")


@query("ruler_lines", f"WITH {LINES_SQL} SELECT doc_id, (count(*) FILTER (pos % 6 = 2))::BIGINT AS n_rulers FROM lines GROUP BY doc_id")
def ruler_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lines(spark, sf_dir).withColumn("line", F.when(F.col("pos") % 6 == 2, F.lit(".RR--!----!-----")).otherwise(F.col("line")))
    return held.groupBy("doc_id").agg(F.count_if(marks.ruler(F.col("line"))).alias("n_rulers"))


_NOTES = "n AS (SELECT conv_id AS doc_id, turn AS note_ix, CASE turn % 3 WHEN 0 THEN 'footnote' WHEN 1 THEN 'endnote' ELSE 'comment' END AS kind, text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY note_ix) AS k FROM n)"


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") % 3
    kind = F.when(t == 0, "footnote").when(t == 1, "endnote").otherwise("comment")
    held = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("note_ix"), kind.alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("tag"), "text")
    return reflow.note_labels(held, scheme="prefixed")


@query("note_sections", f"WITH {_NOTES} SELECT doc_id, kind, string_agg('[' || CASE kind WHEN 'endnote' THEN 'e' ELSE '' END || k || '] ' || text, chr(10) ORDER BY note_ix) AS section FROM r WHERE kind <> 'comment' GROUP BY doc_id, kind")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.note_sections(conversation_notes(spark, sf_dir), ("footnote", "endnote"))


@query("note_markers", f"WITH {_NOTES}, w AS (SELECT *, max(length(k::VARCHAR)) OVER (PARTITION BY doc_id, kind) AS widest FROM r) SELECT doc_id, note_ix, kind, lpad(k || '.', (widest + 1)::INT, ' ') AS padded FROM w")
def note_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.marker_pad(conversation_notes(spark, sf_dir)).select("doc_id", "note_ix", "kind", "padded")


@query("note_slugs", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), '0') AS slug FROM pages")
def note_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", reflow.slug(F.col("url")).alias("slug"))


@query(
    "paginate_with_breaks",
    f"""WITH RECURSIVE {LINES_SQL}, k AS (SELECT doc_id, pos, CASE WHEN pos % 30 = 17 THEN 'pagebreak' WHEN pos % 8 = 5 THEN 'condpage' WHEN pos % 11 = 3 THEN 'over' ELSE 'text' END AS kind, pos % 20 AS n FROM lines),
    p AS (SELECT doc_id, 0 AS pos, kind, 1 AS page, 1 AS used FROM k WHERE pos = 0 UNION ALL
      SELECT k.doc_id, k.pos, k.kind, p.page + CASE WHEN k.kind = 'pagebreak' OR (k.kind = 'condpage' AND p.used > 0 AND 20 - p.used < k.n) OR (k.kind = 'text' AND p.used > 0 AND p.used + 1 > 20) THEN 1 ELSE 0 END,
        CASE WHEN k.kind = 'pagebreak' OR (k.kind = 'condpage' AND p.used > 0 AND 20 - p.used < k.n) THEN 0 WHEN k.kind = 'text' AND p.used > 0 AND p.used + 1 > 20 THEN 1 WHEN k.kind = 'text' THEN p.used + 1 ELSE p.used END FROM p JOIN k ON k.doc_id = p.doc_id AND k.pos = p.pos + 1)
    SELECT doc_id, pos::BIGINT AS pos, page::BIGINT AS page FROM p WHERE kind IN ('text', 'over')""",
)
def paginate_with_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced and conditional breaks, and lines printed over others, which take no room."""
    pos = F.col("pos")
    kind = F.when(pos % 30 == 17, "pagebreak").when(pos % 8 == 5, "condpage").when(pos % 11 == 3, "over").otherwise("text")
    held = lines(spark, sf_dir).select("doc_id", "pos", kind.alias("kind"), (pos % 20).alias("n"))
    return geometry.paginate_breaks(held, 20).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("page").cast("long").alias("page"))


@query(
    "capacity_by_page",
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, pos // 20 + 1 AS page, min(pos) AS pos FROM lines GROUP BY doc_id, pos // 20),
    m AS (SELECT doc_id, pos, CASE WHEN pos % 25 = 7 THEN (pos % 9 + 1)::DOUBLE END AS mt, CASE WHEN pos % 25 = 12 THEN (pos % 7 + 2)::DOUBLE END AS mb FROM lines WHERE pos % 25 IN (7, 12)),
    h AS (SELECT s.doc_id, s.page, coalesce((SELECT max_by(mt, m.pos) FROM m WHERE m.doc_id = s.doc_id AND m.pos <= s.pos AND mt IS NOT NULL), 3) AS mt, coalesce((SELECT max_by(mb, m.pos) FROM m WHERE m.doc_id = s.doc_id AND m.pos <= s.pos AND mb IS NOT NULL), 8) AS mb FROM s)
    SELECT doc_id, page::BIGINT AS page, greatest(4, trunc((66 - mt - mb) * 8 / 8))::BIGINT AS capacity FROM h""",
)
def capacity_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins that change in mid-document count from the next page on."""
    pos, source = F.col("pos"), lines(spark, sf_dir)
    margins = source.where((pos % 25).isin(7, 12)).select("doc_id", "pos", F.when(pos % 25 == 7, (pos % 9 + 1).cast("double")).alias("mt"), F.when(pos % 25 == 12, (pos % 7 + 2).cast("double")).alias("mb"))
    pages = source.select("doc_id", "pos", (F.floor(pos / 20) + 1).alias("page"))
    return geometry.capacity_in_force(margins, pages).select("doc_id", "page", F.col("capacity").cast("long").alias("capacity"))
