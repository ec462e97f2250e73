"""Printed geometry and pagination on small fixtures."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import geometry


def test_points(spark):
    df = spark.createDataFrame([(1, 3.0, False, 2.0, 8.0, 12.0, 8.0, 792), (2, 1.0, True, 2.0, 12.0, 10.5, 999.0, 792)], "doc_id long, mt double, mt_said boolean, hm double, lh double, cw double, po double, height_pt int")
    got = [tuple(r)[1:] for r in geometry.printed_points(df).orderBy("doc_id").collect()]
    assert got == [(60, 12.0, 12, 57.6), (12, 18.0, 10, 606.0)]


def test_arguments(spark):
    r = spark.range(1).select(*[geometry.roll(F.lit(x)).alias(x) for x in ("3", "3/48", "5pt", "0", "x")], geometry.tab_stops(F.lit("5, #10 5 x")).alias("t"), geometry.margin_columns(F.lit("lm"), F.lit(1.0), F.lit("")).alias("m"), geometry.margin_columns(F.lit("rm"), F.lit(6.5), F.lit("i")).alias("n")).collect()[0]
    assert [r["3"], r["3/48"], round(r["5pt"], 6), r["0"], r["x"]] == [3.0, 3.0, 3.333333, 0.0, None]
    assert (r["t"], r["m"], r["n"]) == ([5.0, 10.0], 0.0, 65.0)


def test_capacity_in_force(spark):
    margins = spark.createDataFrame([(1, 10, 6.0, 8.0)], "doc_id long, pos int, mt double, mb double")
    pages = spark.createDataFrame([(1, 0, 1), (1, 9, 1), (1, 10, 2), (1, 20, 3)], "doc_id long, pos int, page int")
    assert {r["page"]: r["capacity"] for r in geometry.capacity_in_force(margins, pages).collect()} == {1: 55, 2: 52, 3: 52}


def test_breaks(spark):
    rows = [("condpage", 99), ("text", 0), ("over", 0), ("text", 0), ("condpage", 2), ("text", 0), ("pagebreak", 0), ("text", 0), ("condpage", 9), ("text", 0)]
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(rows)], "doc_id long, pos int, kind string, n int")
    assert [r["page"] for r in geometry.paginate_breaks(df, capacity=4).orderBy("pos").collect()] == [1, 1, 1, 1, 2, 3]


def test_notes_lose_nothing_and_end():
    r = random.Random(1)
    for _ in range(200):
        body = [(f"b{k}", [[f"n{k}.{j}.{m}" for m in range(r.randrange(1, 12))] for j in range(r.choice([0, 0, 0, 1, 2]))]) for k in range(r.randrange(1, 60))]
        capacity = r.randrange(8, 20)
        pages = geometry.note_pages(body, capacity)
        assert [x for page, _ in pages for x in page] == [t for t, _ in body]
        assert [x for _, foot in pages for x in foot if x.startswith("n")] == [x for _, notes in body for n in notes for x in n]
        assert all(page or foot for page, foot in pages)


def test_notes_table(spark):
    df = spark.createDataFrame([(1, [("a", [["one"]]), ("b", [])])], "doc_id long, body array<struct<text:string,notes:array<array<string>>>>")
    assert [tuple(r) for r in geometry.paginate_notes(df).collect()] == [(1, 1, ["a", "b"], ["-" * 20, "one"])]
