"""Queries of span arrays, printed geometry, settings, file lookup and quality measures.

Spans are cut from the documents' lines: runs of words whose styles come from their places.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fonts
from palimpsest.operators import detect, diagnostics, dots, geometry, pictures, reflow, settings, spans
from palimpsest.plans.catalogue import query
from palimpsest.plans.documents import LINES_SQL, lines, table
from palimpsest.sources import files as sources

#: Words of a line; the k-th has the styles of its place, and every ninth is a note mark.
WORDS_SQL = f"{LINES_SQL}, words AS (SELECT doc_id, pos, unnest(range(len(w)))::INT AS k, unnest(w) AS word FROM (SELECT doc_id, pos, string_split(line, ' ') AS w FROM lines)), spans AS (SELECT *, CASE WHEN k % 9 = 8 THEN k END AS ref, CASE k // 2 % 3 WHEN 1 THEN 'b' WHEN 2 THEN 'i' ELSE '' END AS style FROM words)"


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(word: Column, k: Column) -> Column:
        style = F.when(F.floor(k / 2) % 3 == 1, F.array(F.lit("b"))).when(F.floor(k / 2) % 3 == 2, F.array(F.lit("i"))).otherwise(F.array().cast("array<string>"))
        none = F.lit(None).cast("int")
        return F.struct(word.alias("text"), style.alias("styles"), none.alias("font"), none.alias("colour"), F.when(k % 9 == 8, k).alias("ref"))

    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.transform(F.split("line", " ", -1), span).alias("spans"))


@query("span_visible", f"WITH {WORDS_SQL} SELECT doc_id, pos::BIGINT AS pos, coalesce(string_agg(CASE WHEN ref IS NULL THEN word END, '' ORDER BY k), '') AS text FROM spans GROUP BY doc_id, pos")
def span_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(spark, sf_dir).select("doc_id", "pos", spans.visible_text(F.col("spans")).alias("text"))


@query(
    "span_coalesce",
    f"""WITH {WORDS_SQL}, h AS (SELECT * FROM spans WHERE word <> ''), g AS (SELECT *, CASE WHEN ref IS NOT NULL OR lag(ref) OVER w IS NOT NULL OR lag(style) OVER w IS DISTINCT FROM style THEN 1 ELSE 0 END AS s FROM h WINDOW w AS (PARTITION BY doc_id, pos ORDER BY k)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, pos ORDER BY k) AS island FROM g), o AS (SELECT doc_id, pos, island, string_agg(word, '' ORDER BY k) AS text, min(style) AS style FROM i GROUP BY doc_id, pos, island)
    SELECT doc_id, pos::BIGINT AS pos, string_agg(style || ':' || text, '|' ORDER BY island) AS made FROM o GROUP BY doc_id, pos""",
)
def span_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array_join(F.transform(spans.coalesce(F.col("spans")), lambda s: F.concat(F.array_join(s["styles"], ","), F.lit(":"), s["text"])), "|")
    return span_rows(spark, sf_dir).select("doc_id", "pos", made.alias("made")).where("made <> ''")


@query("span_graphics", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, regexp_replace('┌──' || replace(line, ' ', '█') || '░▒', '([─-▟]+|[^─-▟]+)', '<\\1>', 'g') AS made FROM lines")
def span_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("int")
    text = F.concat(F.lit("┌──"), F.replace("line", F.lit(" "), F.lit("█")), F.lit("░▒"))
    held = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array(F.struct(text.alias("text"), F.array().cast("array<string>").alias("styles"), none.alias("font"), none.alias("colour"), none.alias("ref"))).alias("spans"))
    return held.select("doc_id", "pos", F.array_join(F.transform(spans.split_graphics(F.col("spans")), lambda s: F.concat(F.lit("<"), s["text"], F.lit(">"))), "").alias("made"))


@query("span_indent", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, (pos % 9)::BIGINT AS indent FROM lines")
def span_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indent that crosses a change of style and a note mark."""
    none, plain = F.lit(None).cast("int"), F.array().cast("array<string>")
    span = lambda text, styles, ref: F.struct(text.alias("text"), styles.alias("styles"), none.alias("font"), none.alias("colour"), ref.alias("ref"))
    n = F.col("pos") % 9
    half = F.floor(n / 2).cast("int")
    made = F.array(span(F.repeat(F.lit(" "), half), plain, none), span(F.lit("7"), plain, F.lit(6)), span(F.concat(F.repeat(F.lit(" "), n - half), "line"), F.array(F.lit("b")), none))
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), spans.leading_indent(made).cast("long").alias("indent"))


@query(
    "span_styles",
    f"""WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, array_to_string(list_sort(list_distinct(list_concat(list_concat(CASE WHEN pos % 2 = 0 THEN ['i'] ELSE ['u', 'b'] END, CASE WHEN pos % 3 = 0 THEN ['sub'] ELSE [] END), CASE WHEN pos % 5 = 0 THEN ['b'] ELSE [] END))), ',') AS styles FROM lines""",
)
def span_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    own = F.when(pos % 2 == 0, F.array(F.lit("i"))).otherwise(F.array(F.lit("u"), F.lit("b")))
    made = spans.effective_styles(own, F.when(pos % 3 == 0, F.array(F.lit("sub"))), F.when(pos % 5 == 0, 1))
    return lines(spark, sf_dir).select("doc_id", pos.cast("long").alias("pos"), F.array_join(made, ",").alias("styles"))


@query(
    "dominant_styles",
    f"WITH {WORDS_SQL}, n AS (SELECT doc_id, pos // 10 AS block_ix, style, count(*) AS n, min(pos * 100000 + k) AS first FROM spans GROUP BY ALL) SELECT doc_id, block_ix::BIGINT AS block_ix, first(style ORDER BY n DESC, first) AS styles FROM n GROUP BY doc_id, block_ix",
)
def dominant_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = span_rows(spark, sf_dir).select("doc_id", "pos", F.posexplode("spans").alias("k", "s"))
    rows = held.select("doc_id", F.floor(F.col("pos") / 10).alias("block_ix"), (F.col("pos") * 100000 + F.col("k")).alias("pos"), "s.styles")
    return spans.dominant_style(rows)


@query(
    "style_as_of",
    f"WITH {LINES_SQL}, e AS (SELECT doc_id, pos, pos % 4 AS style FROM lines WHERE pos % 7 = 3), b AS (SELECT doc_id, pos, pos // 5 AS block_ix FROM lines WHERE pos % 5 = 0) SELECT b.doc_id, b.block_ix::BIGINT AS block_ix, e.style::BIGINT AS style_id FROM b ASOF LEFT JOIN e ON b.doc_id = e.doc_id AND b.pos >= e.pos",
)
def style_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style selected last at or before each block."""
    source = lines(spark, sf_dir)
    events = source.where("pos % 7 = 3").select("doc_id", "pos", (F.col("pos") % 4).alias("style_id"))
    blocks = source.where("pos % 5 = 0").select("doc_id", "pos", F.floor(F.col("pos") / 5).alias("block_ix"))
    return spans.style_in_force(events, blocks).select("doc_id", "block_ix", F.col("style_id").cast("long").alias("style_id"))


@query("align_spaces", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, CASE WHEN pos % 3 = 2 THEN '   ' || line || '  ' ELSE line END AS text FROM lines")
def align_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    align = F.when(F.col("pos") % 3 == 0, "center").when(F.col("pos") % 3 == 1, "right").otherwise("left")
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), spans.align_spaces(F.concat(F.lit("   "), "line", F.lit("  ")), align).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("symbol_face", f"SELECT doc_id, translate(text, {_quoted(spans.SYMBOL_CODES)}, {_quoted(spans.SYMBOL_SHOWN)}) AS shown, true AS back FROM documents")
def symbol_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spans.symbol(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("shown"), (spans.unsymbol(made) == F.col("text")).alias("back"))


@query(
    "dingbats_face",
    "SELECT doc_id, list_aggregate(list_transform(string_split(t, ''), lambda c: CASE WHEN ord(c) BETWEEN 33 AND 126 THEN chr(ord(c) + 9952) WHEN c = '¨' THEN '♣' ELSE c END), 'string_agg', '') AS shown, true AS back FROM (SELECT doc_id, '¨' || text AS t FROM documents)",
)
def dingbats_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("¨"), "text")
    made = spans.dingbats(text)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("shown"), (spans.undingbats(made) == text).alias("back"))


@query(
    "base_faces",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN 'Courier' WHEN p_partkey % 4 = 0 THEN 'Helvetica' WHEN p_partkey % 4 = 1 THEN 'Symbol' WHEN p_partkey % 4 = 2 THEN 'Times' ELSE 'ZapfDingbats' END AS family,
      CASE WHEN p_partkey % 5 = 0 THEN 'Courier' || CASE WHEN p_size % 2 = 0 THEN '-Bold' ELSE '' END WHEN p_partkey % 4 = 0 THEN 'Helvetica' || CASE WHEN p_size % 2 = 0 THEN '-Bold' ELSE '' END WHEN p_partkey % 4 = 1 THEN 'Symbol' WHEN p_partkey % 4 = 2 THEN CASE WHEN p_size % 2 = 0 THEN 'Times-Bold' ELSE 'Times-Roman' END ELSE 'ZapfDingbats' END AS face FROM part""",
)
def base_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's base family and face of a typeface; a fixed pitch counts before the name does."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "Univers").when(k % 4 == 1, "Symbol (Greek)").when(k % 4 == 2, "Garamond").otherwise("ITC Zapf Dingbats")
    family = fonts.base_family(name, k % 5 != 0)
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), family.alias("family"), fonts.base_face(family, F.col("p_size") % 2 == 0, F.lit(False)).alias("face"))


@query("text_widths", f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, CASE WHEN pos % 2 = 0 THEN length(line) * 600 ELSE list_sum(list_transform(string_split(line, ''), lambda c: CASE WHEN c = ' ' THEN 250 WHEN c BETWEEN 'a' AND 'z' AND ord(c) < 128 THEN 400 + ord(c) ELSE 500 END)) END::BIGINT AS width FROM lines")
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths by a metric table of a few faces, which is broadcast; without one the pitch is fixed."""
    metrics = fonts.read_metrics(["C 32 ; WX 250 ; N space ;", *(f"C {c} ; WX {400 + c} ; N x ;" for c in range(97, 123)), "C -1 ; WX 9 ; N none ;"])
    faces = F.broadcast(fonts.metrics_table(spark, {"Proportional": metrics}))
    held = lines(spark, sf_dir).withColumn("face", F.when(F.col("pos") % 2 == 1, "Proportional")).join(faces, "face", "left")
    return held.select("doc_id", F.col("pos").cast("long").alias("pos"), fonts.text_width(F.col("line"), F.col("widths")).cast("long").alias("width"))


def _picture(flags: int, colour_planes: int) -> bytes:
    """A raster of eight by four pixels in one tile, as the format keeps it."""
    info = bytes([0, flags]) + bytes(16) + struct.pack("<HH", 8, 4) + bytes([colour_planes]) + bytes(6)
    tile = b"".join(bytes([0xAA, 0x80, 0x55, 0x00, 0x80, 0xFF]) for _ in range(colour_planes))
    items = [(0x00, info), (0x01, bytes(64)), (0x02, struct.pack("<HHHH", 4, 8, 1, 1)), (0x8000, tile)]
    at, index = 4 + 8 * len(items), b""
    for key, data in items:
        index += struct.pack("<HHI", key, len(data), at)
        at += len(data)
    return struct.pack("<HH", 0, len(items)) + index + b"".join(data for _, data in items)


@query(
    "pictures_decoded",
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 < 2 THEN 8::BIGINT END AS width, CASE WHEN c_custkey % 5 < 2 THEN 4::BIGINT END AS height, CASE c_custkey % 5 WHEN 2 THEN 'text-mode' WHEN 3 THEN 'format' WHEN 4 THEN 'missing' END AS error, CASE WHEN c_custkey % 5 < 2 THEN '89504E470D0A1A0A' END AS head FROM customer",
)
def pictures_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters to PNG; a picture that can't be decoded is a row that says why."""
    k = F.col("c_custkey") % 5
    content = F.when(k == 0, F.lit(_picture(1, 1))).when(k == 1, F.lit(_picture(1, 4))).when(k == 2, F.lit(_picture(0, 1))).when(k == 3, F.lit(_picture(1, 1)[:40]))
    made = pictures.decode_pictures(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("x").alias("path"), content.alias("content")))
    return made.select("doc_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "error", F.hex(F.substring("png", 1, 8)).alias("head"))


@query(
    "printed_points",
    """WITH p AS (SELECT c_custkey AS doc_id, c_custkey % 13 AS mt, c_custkey % 2 = 0 AS mt_said, c_custkey % 4 AS hm, (c_custkey % 5 + 6)::DOUBLE AS lh, (c_custkey % 9 + 8)::DOUBLE AS cw, (c_custkey % 20)::DOUBLE AS po FROM customer)
    SELECT doc_id, greatest(0, least((mt + CASE WHEN mt_said THEN 0 ELSE hm END) * 12, 780))::BIGINT AS top_pt, lh * 1.5 AS lead_pt, greatest(1, cw)::BIGINT AS size_pt, round(greatest(0, least(po * 7.2::DOUBLE, 612 - cw * 0.6::DOUBLE)), 6) AS left_pt FROM p""",
)
def printed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    page = table(spark, sf_dir, "customer").select(k.alias("doc_id"), (k % 13).cast("double").alias("mt"), (k % 2 == 0).alias("mt_said"), (k % 4).cast("double").alias("hm"), (k % 5 + 6).cast("double").alias("lh"), (k % 9 + 8).cast("double").alias("cw"), (k % 20).cast("double").alias("po"), F.lit(792.0).alias("height_pt"))
    return geometry.printed_points(page).select("doc_id", F.col("top_pt").cast("long").alias("top_pt"), "lead_pt", F.col("size_pt").cast("long").alias("size_pt"), F.round("left_pt", 6).alias("left_pt"))


@query(
    "roll_values",
    """WITH r AS (SELECT c_custkey AS k, c_custkey % 5 AS form, c_custkey % 11 AS n FROM customer) SELECT k AS doc_id, round(CASE form WHEN 0 THEN n::DOUBLE WHEN 1 THEN n::DOUBLE / 48 * 48 WHEN 2 THEN n::DOUBLE / 72 * 48 WHEN 3 THEN NULL WHEN 4 THEN n::DOUBLE / 2.54 * 48 END, 6) AS roll FROM r""",
)
def roll_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n = (k % 11).cast("string")
    arg = F.when(k % 5 == 0, n).when(k % 5 == 1, F.concat(n, F.lit("/48\""))).when(k % 5 == 2, F.concat(n, F.lit("pt"))).when(k % 5 == 3, F.concat(n, F.lit("/0"))).otherwise(F.concat(n, F.lit(" cm")))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.round(geometry.roll(arg), 6).alias("roll"))


@query(
    "margin_values",
    "SELECT c_custkey AS doc_id, round(CASE c_custkey % 3 WHEN 0 THEN greatest(0, c_custkey % 30 - 1)::DOUBLE WHEN 1 THEN (c_custkey % 30)::DOUBLE ELSE (c_custkey % 30)::DOUBLE * 10 END, 6) AS columns FROM customer",
)
def margin_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left margin without a unit counts from one; a right one doesn't; units convert."""
    k = F.col("c_custkey")
    cmd = F.when(k % 3 == 1, "rm").otherwise("lm")
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.round(geometry.margin_columns(cmd, (k % 30).cast("double"), F.when(k % 3 == 2, F.lit("in")).otherwise(F.lit(""))), 6).alias("columns"))


@query("tab_stop_lists", "SELECT c_custkey AS doc_id, array_to_string(list_sort(list_distinct(list_filter([c_custkey % 40, 8, c_custkey % 7, 15], lambda x: x > 0))), ',') AS stops FROM customer")
def tab_stop_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    arg = F.concat((k % 40).cast("string"), F.lit(" #8, "), (k % 7).cast("string"), F.lit(" x 15 "))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.array_join(F.transform(geometry.tab_stops(arg), lambda x: x.cast("long").cast("string")), ",").alias("stops"))


@query(
    "effective_settings",
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::DOUBLE ELSE round(1195.0::DOUBLE / 240, 6) END AS mt, CASE WHEN c_custkey % 3 = 0 THEN 'file' ELSE 'machine-default' END AS mt_source, CASE WHEN c_custkey % 2 = 0 THEN 5.0 ELSE 2.0 END::DOUBLE AS hm, CASE WHEN c_custkey % 2 = 0 THEN 'file' ELSE 'default' END AS hm_source FROM customer",
)
def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's word, then the machine's, then the default."""
    k = F.col("c_custkey")
    said = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 3 == 0, k.cast("double")).alias("mt"), F.when(k % 2 == 0, F.lit(5.0)).alias("hm"))
    machine = settings.page_settings("sawyer")
    (mt, mt_source), (hm, hm_source) = settings.effective("mt", machine), settings.effective("hm", machine)
    return said.select("doc_id", F.round(mt, 6).alias("mt"), mt_source.alias("mt_source"), hm.alias("hm"), hm_source.alias("hm_source"))


@query(
    "era_joined",
    "SELECT c_custkey AS doc_id, v AS variant, v IN ('ws3', 'ws4') AS high_bit_wordwrap, CASE WHEN v = 'ws3' THEN 33 ELSE 28 END::BIGINT AS pc_default FROM (SELECT c_custkey, ['ws3', 'ws4', 'ws5+', 'text', 'unknown'][c_custkey % 5 + 1] AS v FROM customer)",
)
def era_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each variant; an unknown one is taken as the newest."""
    names = F.array(*[F.lit(v) for v in ("ws3", "ws4", "ws5+", "text", "unknown")])
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("variant"))
    return detect.with_era(held).select("doc_id", "variant", "high_bit_wordwrap", F.col("pc_default").cast("long").alias("pc_default"))


@query("page_sizes", "WITH h AS (SELECT p_partkey AS k, (p_partkey % 90 + 40)::DOUBLE AS pl FROM part), d AS (SELECT *, [['Letter', '11.0', '8.5'], ['Legal', '14.0', '8.5'], ['Foolscap Folio', '13.5', '8.5'], ['A4', '11.693', '8.268']] AS s FROM h), b AS (SELECT k, pl, list_filter(s, lambda x: abs(x[2]::DOUBLE - pl / 6) <= 0.25) AS near FROM d), c AS (SELECT k, pl, list_sort(list_transform(near, lambda x: struct_pack(d := abs(x[2]::DOUBLE - pl / 6), n := x))) AS o FROM b) SELECT k AS doc_id, coalesce(o[1].n[1], 'Custom') AS name, round(coalesce(o[1].n[2]::DOUBLE, pl / 6), 6) AS height, coalesce(o[1].n[3]::DOUBLE, 8.5) AS width FROM c")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    height, name, width = dots.page_size(F.col("pl"))
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 90 + 40).cast("double").alias("pl"))
    return held.select("doc_id", name.alias("name"), F.round(height, 6).alias("height"), width.alias("width"))


_PICTURES = "g AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS graphic_ix, 'C:\\ART\\' || p_type || '\\' || p_brand || '.PIX' AS graphic FROM part), f AS (SELECT DISTINCT '/archive/art/' || lower(p_type) || '/' || p_brand || '.pix' AS path FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT '/archive/other/' || p_brand || '.PIX' FROM part)"


@query(
    "pictures_found",
    f"WITH {_PICTURES}, m AS (SELECT doc_id, graphic_ix, path, CASE WHEN lower(path) = '/archive/' || replace(lower(substr(graphic, 4)), chr(92), '/') THEN 0 ELSE 1 END AS rank FROM g JOIN f ON lower(split_part(path, '/', -1)) = lower(split_part(graphic, chr(92), -1))) SELECT doc_id, graphic_ix, first(path ORDER BY rank, path) AS path FROM m GROUP BY doc_id, graphic_ix",
)
def pictures_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graphic's file is the one whose path ends with the longest suffix of the graphic's path, whatever the case."""
    part = table(spark, sf_dir, "part")
    graphics = part.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 3).alias("graphic_ix"), F.concat(F.lit("C:\\ART\\"), "p_type", F.lit("\\"), "p_brand", F.lit(".PIX")).alias("graphic"))
    near = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("/archive/art/"), F.lower("p_type"), F.lit("/"), "p_brand", F.lit(".pix")).alias("path"))
    there = near.unionByName(part.select(F.concat(F.lit("/archive/other/"), "p_brand", F.lit(".PIX")).alias("path"))).distinct()
    return sources.resolve_pictures(graphics, there).select("doc_id", "graphic_ix", "path")


@query("export_names", "WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS graphic_ix, o_orderstatus AS stem, row_number() OVER (PARTITION BY o_custkey, lower(o_orderstatus) ORDER BY o_orderkey) AS k FROM orders) SELECT doc_id, graphic_ix, stem || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END AS name FROM r")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("graphic_ix"), F.col("o_orderstatus").alias("stem"))
    return sources.export_names(images).select("doc_id", "graphic_ix", "name")


@query("settings_dumps", "SELECT doc_id, unnest(['ALPHA', 'BETA']) AS label, unnest([chr(65 + (doc_id % 20)::INT) || 'text', 'xy']) AS value FROM documents")
def settings_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with hexadecimal and quoted items, continued lines, a label said twice, and an end mark."""
    code = F.lpad(F.hex(65 + F.col("doc_id") % 20), 2, "0")
    dump = F.concat(F.lit("BETA=01\r\nALPHA="), code, F.lit(',"te"\r\n=78,74\r\nBETA="xy"\r\n\x1aALPHA=00\r\n'))
    held = sources.read_settings(table(spark, sf_dir, "documents").select("doc_id", F.encode(dump, "ISO-8859-1").alias("content")))
    return held.select("doc_id", "label", F.decode("value", "ISO-8859-1").alias("value"))


@query(
    "line_parity",
    f"""WITH {LINES_SQL}, a AS (SELECT * FROM lines WHERE pos % 5 <> 2), b AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 1 THEN upper(line) ELSE line END AS line FROM lines WHERE pos % 6 <> 4)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.pos, b.pos)::BIGINT AS pos, a.line IS NULL AS only_right, b.line IS NULL AS only_left, a.line IS NOT DISTINCT FROM b.line AS same FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos""",
)
def line_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of lines side by side, with what only one of them has."""
    source = lines(spark, sf_dir)
    right = source.where("pos % 6 <> 4").withColumn("line", F.when(F.col("pos") % 7 == 1, F.upper("line")).otherwise(F.col("line")))
    found = diagnostics.parity(source.where("pos % 5 <> 2"), right)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("left").isNull().alias("only_right"), F.col("right").isNull().alias("only_left"), "same")


@query(
    "output_lint",
    """SELECT page_id AS doc_id, CASE page_id % 5 WHEN 0 THEN 'adjacent_equal_tags' WHEN 1 THEN 'empty_paragraph' WHEN 2 THEN 'unbalanced_paragraphs' WHEN 3 THEN 'control_character' ELSE 'note_without_target' END AS rule FROM pages""",
)
def output_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fault planted in each output."""
    k = F.col("page_id") % 5
    text = F.regexp_replace("url", r"[<>\x00-\x1f]", "")
    said = F.when(k == 0, F.concat(F.lit("<p><b>"), text, F.lit("</b><b>x</b></p>"))).when(k == 1, F.concat(F.lit("<p> </p><p>"), text, F.lit("</p>"))).when(k == 2, F.concat(F.lit("<p>"), text)).when(k == 3, F.concat(F.lit("<p>\x02"), text, F.lit("</p>"))).otherwise(F.concat(F.lit('<p><a href="#fn-9">'), text, F.lit("</a></p>")))
    return diagnostics.lint(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), said.alias("output")))


@query("byte_divergence", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 7) % length(regexp_replace(text, '[^ -~]', 'x', 'g')) END AS at FROM documents")
def byte_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two strings of bytes part, to the byte."""
    plain = F.regexp_replace("text", "[^ -~]", "x")
    at = F.col("doc_id") * 7 % F.length(plain)
    other = F.when(F.col("doc_id") % 3 == 0, plain).otherwise(F.concat(F.substring(plain, F.lit(1), at), F.lit("\x01"), F.substring(plain, at + 2, F.length(plain))))
    return table(spark, sf_dir, "documents").select("doc_id", diagnostics.divergence(F.encode(plain, "US-ASCII"), F.encode(other, "US-ASCII")).cast("long").alias("at"))


@query("roundtrip_classes", "SELECT class, count(*)::BIGINT AS n FROM (SELECT ['equal', 'longer', 'shorter', 'changed', 'refused'][doc_id % 5 + 1] AS class FROM documents) GROUP BY class")
def roundtrip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id") % 5, F.concat(F.lit("ab"), "text")
    out = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit("!"))).when(k == 2, F.concat(F.lit("a"), "text")).when(k == 3, F.concat(F.lit("ba"), "text"))
    return diagnostics.roundtrip_census(table(spark, sf_dir, "documents").select("doc_id", F.encode(text, "UTF-8").alias("content"), F.encode(out, "UTF-8").alias("output")))


@query("word_alignment", f"WITH {LINES_SQL}, w AS (SELECT doc_id, pos, len(string_split(line, ' ')) AS n FROM lines) SELECT doc_id * 1000 + pos AS doc_id, n::BIGINT AS n_matched, 0::BIGINT AS n_left, 1::BIGINT AS n_right, 2.5::DOUBLE AS dx, -1.0::DOUBLE AS dy, 0.0::DOUBLE AS residual FROM w")
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line against the same words in a frame that is set off, with one more at the end."""
    word = lambda w, x, y: F.struct(w.alias("word"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    left = F.transform(F.split("line", " ", -1), lambda w, k: word(w, k * 10, F.lit(5)))
    right = F.concat(F.transform(F.split("line", " ", -1), lambda w, k: word(w, k * 10 + 2.5, F.lit(4))), F.array(word(F.lit("\u0001"), F.lit(0), F.lit(0))))
    held = lines(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("pos")).alias("doc_id"), left.alias("left"), right.alias("right"))
    return diagnostics.align_words(held).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_matched", "n_left", "n_right")], "dx", "dy", "residual")


@query(
    "scene_blocks",
    f"""WITH {LINES_SQL}, b AS (SELECT doc_id, pos, pos % 50 = 12 AS slug, pos % 70 = 33 AS heading, pos % 45 = 40 AS brk FROM lines), a AS (SELECT *, max(CASE WHEN slug THEN pos END) OVER w AS start, max(CASE WHEN (heading OR brk) AND NOT slug THEN pos END) OVER w AS stop FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos::BIGINT AS block_ix, (start IS NOT NULL AND pos - start <= 40 AND (stop IS NULL OR stop < start)) AS in_scene FROM a""",
)
def scene_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes reach from a slugline to the next one, a heading, a break, or forty blocks on."""
    pos = F.col("pos")
    held = lines(spark, sf_dir).select("doc_id", pos.alias("block_ix"), F.when(pos % 50 == 12, F.concat(F.lit(" 12 INT. "), "line")).otherwise(F.concat(F.lit("x"), "line")).alias("text"), F.when((pos % 70 == 33) & (pos % 50 != 12), 1).alias("heading"), F.when((pos % 45 == 40) & (pos % 50 != 12), "pagebreak").otherwise("para").alias("kind"))
    return reflow.screenplay_blocks(held).select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), "in_scene")
