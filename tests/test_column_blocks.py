"""Columns of any text: what a line begins with, blank lines, characters that a file of bytes lacks, no text."""

import duckdb

from palimpsest.operators import codec
from palimpsest.plans import catalogue

TEXTS = [
    None,
    "",
    "\n",
    "a\n\nb\n\n\nc\n",
    "x\n- a\ny\n- b\nz\n* c\nw\n* d",
    "È a\n? b\nÈ c\n? d\nÓ:  e\nterm:  f",
    ".pa\n.he head\n.. remark\n...and so\n.5 is half",
    " a\n  b \n     c\n          d\n   \ne ",
    "line a\nline \n<p>line b</p>\n<b>&amp;",
    "~\n~~\n~41~\na~b~c",
    "Á a\nÚ b\nÁ c\nÚ d\n• e\n😀 漢字﻿ ",
    "a ─── b\n│ c │\n└──┘\n░▒▓■",
    "a\x01b\x02c\x1ad\x1be\x1d\n\tf\tg\x0c\r\nh\x7f\x85\r\x00",
    "INT. ROOM\nEXT. STREET",
]


def test_lines_are_kept_whatever_they_hold(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, output FROM ({catalogue.oracles()['column_blocks']})").fetchall())
    got = sorted((r["doc_id"], r["output"]) for r in catalogue.queries()["column_blocks"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == len(TEXTS) - 1


def test_spelling_is_undone_but_for_four_letters(spark):
    texts = ["".join(map(chr, range(0x2600))), "~7e~ 😀\U0010ffff", "", None]
    made = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", codec.decode_cp437(codec.spell_cp437("t")).alias("t"))
    got = [r["t"] for r in made.select("k", codec.unspelled(made["t"]).alias("t")).orderBy("k").collect()]
    assert got == [t and t.translate(dict.fromkeys(map(ord, codec.LOSSY), codec.LOST)) for t in texts]
