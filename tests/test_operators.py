"""Span, mark, picture and diagnostic operators on small fixtures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diagnostics, emit, marks, pictures, reflow, spans
from palimpsest.sources import files


def lines(spark, *rows):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "doc_id long, pos int, line string")


def test_spans(spark):
    rows = [(1, [("  a", ["b"], None, None, None), ("b", ["b"], None, None, None), ("1", [], None, None, 0), ("", [], None, None, None), ("c──d", [], None, None, None)])]
    df = spark.createDataFrame(rows, f"doc_id long, s array<{spans.SPAN}>")
    r = df.select(spans.visible_text(F.col("s")).alias("v"), spans.coalesce(F.col("s")).alias("c"), spans.split_graphics(F.col("s")).alias("g"), spans.leading_indent(F.col("s")).alias("i")).collect()[0]
    assert r["v"] == "  abc──d"
    assert [x["text"] for x in r["c"]] == ["  ab", "1", "c──d"]
    assert [x["text"] for x in r["g"]] == ["  a", "b", "1", "c", "──", "d"]
    assert r["i"] == 2


def test_style_in_force_and_dominant(spark):
    events = spark.createDataFrame([(1, 2, 7), (1, 5, 9)], "doc_id long, pos int, style_id int")
    blocks = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 4, 2), (1, 6, 3)], "doc_id long, pos int, block_ix int")
    assert {r["block_ix"]: r["style_id"] for r in spans.style_in_force(events, blocks).collect()} == {0: None, 1: 7, 2: 7, 3: 9}
    held = spark.createDataFrame([(1, 0, 0, ["i"]), (1, 0, 1, ["b"]), (1, 0, 2, ["b"]), (1, 0, 3, ["i"])], "doc_id long, block_ix int, pos int, styles array<string>")
    assert [r["styles"] for r in spans.dominant_style(held).collect()] == ["i"]


def test_symbol_face(spark):
    df = spark.range(1).select(spans.symbol(F.lit("abg")).alias("a"), spans.unsymbol(spans.symbol(F.lit("Watt"))).alias("b"))
    assert tuple(df.collect()[0]) == ("αβγ", "Watt")


def test_marks(spark):
    df = lines(spark, ".tc2 Two", ".tc One", ".ix word", ".fi OTHER.WS", ".pa", ".cp 5", ".cp", ".he Page #", ".h2 second", ".he", ".. hidden", ".psa x", "text")
    assert [(r["level"], r["entry"]) for r in marks.contents(df).orderBy("pos").collect()] == [(2, "Two"), (1, "One")]
    assert marks.index_entries(df).collect()[0]["entry"] == "word"
    assert marks.includes(df).collect()[0]["shown"] == "[insert: OTHER.WS]"
    assert [(r["kind"], r["lines"]) for r in marks.breaks(df).orderBy("pos").collect()] == [("pagebreak", None), ("condpage", 5), ("condpage", 1)]
    assert marks.running_heads(marks.head_events(df)).collect()[0]["heads"] == {2: "second"}
    assert marks.comment_lines(df).collect()[0]["text"] == "hidden"
    assert marks.foreign(df).collect()[0]["is_foreign"]
    pages = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 12, 3)], "doc_id long, pos int, page int")
    got = {(r["page"], r["n"]): r["text"] for r in marks.heads_on_pages(marks.head_events(df), pages).collect()}
    assert got == {(1, 1): "Page 1", (2, 1): "Page 2", (2, 2): "second", (3, 2): "second"}


def test_roman_and_nesting(spark):
    r = spark.range(1).select(*[reflow.roman(F.lit(n)).alias(str(n)) for n in (1, 4, 9, 14, 1987, 0)]).collect()[0]
    assert list(r) == ["i", "iv", "ix", "xiv", "mcmlxxxvii", "0"]
    assert [emit.roman(n) for n in (1, 4, 9, 14, 1987, 0)] == list(r)
    rows = spark.createDataFrame([(1, k, c) for k, c in enumerate([0, 3, 6, 3, 0, 6])], "doc_id long, pos int, col int")
    assert [x["level"] for x in reflow.nesting(rows).orderBy("pos").collect()] == [1, 2, 3, 2, 1, 2]


def encode_picture(image, planes, palette=bytes(64)):
    """The inverse of the decoder: one tile of whole rows."""
    h, w = image.shape
    tile = b""
    for p in range(planes):
        bits = np.packbits(image >> p & 1, axis=1)
        tile += bits[0].tobytes()
        for a, b in zip(bits, bits[1:], strict=False):
            tile += np.packbits(a != b).tobytes() + b[a != b].tobytes()
    info = bytearray(29)
    info[1] = 1
    info[18:22] = struct.pack("<HH", w, h)
    info[22] = planes
    options = struct.pack("<15h", *[0] * 12, 720, 1440, 0) + bytes(16)
    items = [(0, bytes(info)), (1, palette), (2, struct.pack("<HHHH", h, w, 1, 1)), (0x11, options), (0x8000, tile)]
    at, head, blob = 4 + 8 * len(items), b"", b""
    for k, item in items:
        head += struct.pack("<HHI", k, len(item), at + len(blob))
        blob += item
    return struct.pack("<HH", 1, len(items)) + head + blob


@pytest.mark.parametrize("planes", [1, 2, 4])
def test_pictures(planes):
    image = np.random.default_rng(planes).integers(0, 1 << planes, (9, 16)).astype(np.uint8)
    data = encode_picture(image, planes)
    got, colours = pictures.decode(data)
    assert (got == image).all()
    assert pictures.physical_size(data) == (2.0, 1.0)
    out = pictures.png(got, colours)
    assert out.startswith(b"\x89PNG") and zlib.decompress(out[out.index(b"IDAT") + 4 :])
    with pytest.raises(pictures.PictureError):
        pictures.decode(data[:40])


def test_picture_table(spark):
    good = encode_picture(np.zeros((2, 8), np.uint8), 1)
    df = spark.createDataFrame([(1, "a.pix", bytearray(good)), (2, "b.pix", bytearray(b"no")), (3, "c.pix", None)], "doc_id long, path string, content binary")
    assert {r["doc_id"]: (r["width"], r["error"]) for r in pictures.decode_pictures(df).collect()} == {1: (8, None), 2: (None, "format"), 3: (None, "missing")}


def test_picture_lookup(spark):
    graphics = spark.createDataFrame([(1, 0, "C:\\ART\\CAT.PIX"), (1, 1, "NONE.PIX")], "doc_id long, graphic_ix int, graphic string")
    there = spark.createDataFrame([("file:/x/cat.pix",), ("file:/x/art/Cat.pix",)], "path string")
    got = {r["graphic_ix"]: r["path"] for r in files.resolve_pictures(graphics, there).collect()}
    assert got == {0: "file:/x/art/Cat.pix", 1: None}
    names = files.export_names(spark.createDataFrame([(1, 0, "a"), (1, 1, "A"), (1, 2, "b")], "doc_id long, graphic_ix int, stem string"))
    assert [r["name"] for r in names.orderBy("graphic_ix").collect()] == ["a", "A-1", "b"]


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 200), bytearray(b"abc" * 200)), (2, bytearray(b"x" * 300 + b"y"), bytearray(b"x" * 300 + b"z")), (3, bytearray(b"ab"), bytearray(b"abc"))], "doc_id long, content binary, output binary")
    assert {r["doc_id"]: r["at"] for r in df.select("doc_id", diagnostics.divergence(F.col("content"), F.col("output")).alias("at")).collect()} == {1: None, 2: 300, 3: 2}
    assert {r["class"]: r["n"] for r in diagnostics.roundtrip_census(df).collect()} == {"equal": 1, "changed": 1, "longer": 1}
    bad = spark.createDataFrame([(1, "<p></p><b>a</b><b>b</b>"), (2, "<p>fine</p>")], "doc_id long, output string")
    assert sorted((r["doc_id"], r["rule"]) for r in diagnostics.lint(bad).collect()) == [(1, "adjacent_equal_tags"), (1, "empty_paragraph")]
    assert diagnostics.parity(lines(spark, "a", "b"), lines(spark, "a", "c", "d")).where("not same").count() == 2
    words = "array<struct<word:string,x:double,y:double>>"
    pair = spark.createDataFrame([(1, [("a", 0.0, 0.0), ("b", 1.0, 0.0)], [("a", 2.0, 1.0), ("q", 0.0, 0.0), ("b", 3.0, 1.0)])], f"doc_id long, left {words}, right {words}")
    r = diagnostics.align_words(pair).collect()[0]
    assert (r["n_matched"], r["n_right"], r["dx"], r["dy"], r["residual"]) == (2, 1, 2.0, 1.0, 0.0)


def test_stream_of_files(spark, tmp_path):
    from palimpsest.streaming.events import detected, ingest

    (tmp_path / "a.ws").write_bytes(b"plain text here\r\nand more of it\r\n")
    (tmp_path / "b.bin").write_bytes(bytes(range(1, 26)) * 9)
    q = detected(ingest(spark, str(tmp_path))).writeStream.format("memory").queryName("arrived").start()
    try:
        q.processAllAvailable()
        assert sorted(r["variant"] for r in spark.table("arrived").collect()) == ["binary", "printstream"]
    finally:
        q.stop()


def test_stream_of_events(spark, tmp_path):
    from palimpsest.streaming.events import hourly

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = hourly(stream, late="1 hour").writeStream.format("memory").outputMode("update").queryName("hours").start()
    try:
        q.processAllAvailable()
        assert spark.table("hours").agg(F.sum("n")).collect()[0][0] == source.count()
    finally:
        q.stop()
