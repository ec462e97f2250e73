"""Settings and typefaces."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fonts
from palimpsest.operators import settings


def test_page_settings():
    assert settings.page_settings("modern") == {"mt": 6.0, "mb": 6.0, "po": 10.0}
    assert settings.page_settings("mt=1in, po=.5in,size=legal,hm=2") == {"mt": 6.0, "po": 5.0, "pl": 84.0, "hm": 2.0}
    for bad in ("xx=1", "mt=", "size=b5", "mt=q"):
        with pytest.raises(ValueError, match="page settings"):
            settings.page_settings(bad)


def test_blocks():
    block = bytearray(0x42)
    for at, n in ((0x14, 720), (0x24, 1440), (0x40, 240)):
        block[at : at + 2] = n.to_bytes(2, "little")
    got = settings.block_settings(bytes(block))
    assert (got["mt"], got["po"], got["lh"]) == (3.0, 8.0, 8.0)
    assert set(settings.block_settings(bytes(block[:0x20]))) == {"mt", "mb", "pl"}
    assert settings.block_settings(None) == {}
    ruler = bytearray(74)
    ruler[8] = 3
    ruler[10:16] = (900).to_bytes(2, "little") + bytes(2) + (1800).to_bytes(2, "little")
    assert settings.ruler_stops(bytes(ruler)) == [5.0, 10.0]


def test_whose_word_counts(spark):
    df = spark.createDataFrame([(1, 4.0, None, None)], "doc_id long, mt double, mb double, po double")
    r = df.select(*[c for n in ("mt", "mb", "po") for c in settings.effective(n, {"mt": 9.0, "mb": 6.0})]).collect()[0]
    assert list(r) == [4.0, "file", 6.0, "machine-default", 8.0, "default"]


def test_options():
    assert settings.checked_options({"mode": "printed"}) == {"mode": "printed", "to": "pdf"}
    assert settings.checked_options({})["to"] == "rtf"
    with pytest.raises(ValueError, match="mode"):
        settings.checked_options({"mode": "both"})


def test_fonts(spark):
    widths = fonts.read_metrics(["C 65 ; WX 722 ; N A ;", "C 66 ; WX 667 ; N B ;", "C -1 ; WX 1 ; N x ;", "noise"])
    table = fonts.metrics_table(spark, {"Times-Roman": widths})
    r = table.select(fonts.text_width(F.lit("ABq"), F.col("widths")).alias("w")).collect()[0]
    assert r["w"] == 722 + 667 + 500
    named = spark.createDataFrame([("Helv Narrow", True), ("Anything", False), ("Bodoni", None)], "n string, p boolean")
    fam = [x["f"] for x in named.select(fonts.base_family(F.col("n"), F.col("p")).alias("f")).collect()]
    assert fam == ["Helvetica", "Courier", "Times"]
    face = spark.range(1).select(fonts.base_face(F.lit("Times"), F.lit(True), F.lit(True)), fonts.base_face(F.lit("Courier"), F.lit(False), F.lit(True)), fonts.base_face(F.lit("Times"), F.lit(False), F.lit(False)))
    assert list(face.collect()[0]) == ["Times-BoldItalic", "Courier-Oblique", "Times-Roman"]
