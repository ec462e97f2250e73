"""Letters that the code page lacks become question marks, which open no lists."""

import duckdb
import pytest

from palimpsest.operators import codec, emit, wordfile
from palimpsest.plans import catalogue

TEXTS = [
    "\n".join(f"{'ÈÓÊÍ'[k % 4]} lechch la ou {k}" for k in range(24)),
    "Plain line.\nÊ opens one\nÉ is in the page\nÈ opens another\nPlain again\nÍ and a third\nA last",
    "È alone",
]


def test_a_repeated_question_mark_is_a_marker_unless_it_stands_for_lost_letters():
    d = wordfile.parse(b"- a\r\n- b\r\n\r\n.pa\r\n? one thing\r\n\r\n? other thing\r\n", "ws5+")
    assert "<ul><li>one thing</li><li>other thing</li></ul>" in emit.html(d)
    assert '<ul><li>a</li><li>b</li></ul><hr class="pb">\n<p>? one thing</p>\n<p>? other thing</p>\n' in emit.html(d, replaced=codec.LOST)
    assert '"marker": "?"' in emit.layout(d) and '"marker": "?"' not in emit.layout(d, replaced=codec.LOST)


@pytest.mark.parametrize("name", ["emit_html", "aligned_blocks", "column_blocks"])
def test_query_keeps_them_as_its_sql_does(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, output FROM ({catalogue.oracles()[name]})").fetchall())
    got = {r["doc_id"]: r["output"] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == len(TEXTS)
