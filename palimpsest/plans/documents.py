"""Queries of the document operators over the driver's tables.

The tables hold prose without dot commands, indents or lists, so the queries frame it first: some lines, chosen by
their position, become commands, indented or bulleted. The oracles frame it in the same way and share no other code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import escape
from palimpsest.operators import codec, detect, dots, lexical, marks, reflow
from palimpsest.plans.catalogue import query

LINES_SQL = "lines AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.physical_lines(table(spark, sf_dir, "documents"))


def _when(rules: list[tuple[str, str]]) -> Column:
    out = F
    for cond, value in rules:
        out = out.when(F.expr(cond), F.expr(value))
    return out.otherwise(F.col("line"))


def _case(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + " ELSE line END"


#: Framing rules; the expressions mean the same in both dialects.
DOT_RULES = [
    ("pos % 9 = 2", "'.oc on'"),
    ("pos % 9 = 5", "'.oc off'"),
    ("pos % 11 = 4", "'.oj on'"),
    ("pos % 11 = 8", "'.oj off'"),
    ("pos % 13 = 6 and doc_id % 4 <> 0", "concat('.mt ', cast(doc_id % 7 + 1 as varchar(9)))"),
    ("pos % 13 = 9 and doc_id % 3 = 0", "'.pl 14\"'"),
    ("pos % 13 = 9 and doc_id % 3 = 1", "'.pl 70.5'"),
    ("pos % 13 = 10", "'.lh 12'"),
    ("pos % 13 = 12", "'.mb 1i'"),
]
LIST_RULES = [
    ("pos % 6 = 1", "concat('* ', line)"),
    ("pos % 6 = 2", "concat('   - ', line)"),
    ("pos % 6 = 3", "concat('      + ', line)"),
    ("pos % 6 = 4", "concat('   - ', line)"),
    ("pos % 6 = 5", "concat('label:   ', line)"),
]
INDENT_RULES = [("pos % 5 = 0", "concat('     ', line)"), ("pos % 5 = 3", "concat('       ', line)"), ("pos % 17 = 4", "''")]
SHORT_RULES = [("pos % 4 = 0", "concat(line, '.')"), ("pos % 4 = 1", "concat(line, ',')"), ("pos % 4 = 2", "concat('\"', line, '\"')")]


def framed(spark: SparkSession, sf_dir: str, rules: list[tuple[str, str]]) -> DataFrame:
    return lines(spark, sf_dir).withColumn("line", _when(rules))


def _framed_sql(rules: list[tuple[str, str]], name: str = "f") -> str:
    return f"WITH {LINES_SQL}, {name} AS (SELECT doc_id, pos, {_case(rules)} AS line FROM lines)"


@query(
    "line_profile",
    r"""
    WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    q AS (SELECT doc_id, l, list_transform(l, lambda x: length(rtrim(x, ' '))) AS n FROM p),
    r AS (SELECT doc_id, l, n, list_sort(list_filter(n, lambda x: x > 0)) AS s, list_filter(l, lambda x: regexp_matches(x, '\p{L}')) AS t FROM q)
    SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(n, lambda x: x = 0))::BIGINT AS n_blank, coalesce(list_max(n), 0)::BIGINT AS longest,
      greatest(65, coalesce(s[floor(0.9::DOUBLE * len(s))::INT + 1], 0))::BIGINT AS margin, len(t)::BIGINT AS n_scored,
      len(list_filter(t, lambda x: regexp_matches(x, '[.!?]["''”’]*\s*$')))::BIGINT AS n_terminal
    FROM r""",
)
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.line_profile(table(spark, sf_dir, "documents"))


@query(
    "detect_verdict",
    r"""
    WITH t AS (SELECT doc_id, doc_id % 5 AS k, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS a FROM documents),
    m AS (SELECT doc_id, k, length(a) - length(replace(a, chr(10), '')) AS nl, length(a) AS n, regexp_extract_all(a, '[A-Za-z] ') AS ends,
      length(a) - length(regexp_replace(a, '[\x00-\x09\x0B-\x1F\x7F]', '', 'g')) AS ctl FROM t),
    c AS (SELECT doc_id, k,
      CASE WHEN k = 0 THEN n + nl WHEN k = 1 THEN n + nl WHEN k = 2 THEN n + nl WHEN k = 3 THEN n ELSE n + 9 END AS size,
      CASE WHEN k IN (1, 2) THEN nl ELSE 0 END AS soft, CASE WHEN k = 0 THEN nl ELSE 0 END AS hard,
      CASE WHEN k = 1 THEN nl + len(ends) WHEN k = 2 THEN nl ELSE 0 END AS hi, CASE WHEN k = 4 THEN 0 ELSE 0 END AS blocks, CASE WHEN k = 4 THEN 3 ELSE 0 END AS trips, ctl FROM m),
    d AS (SELECT *, least(100, ((size - ctl - (CASE WHEN k = 4 THEN 6 ELSE 0 END) + 2 * trips) * 100 // size)) AS pct FROM c)
    SELECT doc_id, size::BIGINT AS size, soft::BIGINT AS soft, hard::BIGINT AS hard, hi::BIGINT AS hi, trips::BIGINT AS trips,
      CASE WHEN size = 0 OR pct < 40 THEN 'binary' WHEN trips >= 3 THEN 'ws5+'
        WHEN (soft >= 3 OR (hi >= greatest(1, size // 20) AND pct >= 70)) THEN CASE WHEN soft >= 3 AND hi < soft // 4 THEN 'ws5+' ELSE 'ws4' END
        WHEN pct >= 90 AND hard >= 2 THEN 'printstream' WHEN pct >= 90 THEN 'text' ELSE 'binary' END AS variant
    FROM d""",
)
def detect_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text framed as bytes in five ways: hard returns, soft ones with flagged word ends, soft ones, bare, wrapped characters."""
    k = F.col("doc_id") % 5
    a = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    flagged = F.regexp_replace(a, "([A-Za-z]) ", "\u0000$1 ")
    flagged = F.array_join(F.transform(F.split(flagged, "\u0000", -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.char(F.ascii(x) + 128), x.substr(2, 1 << 30)))), "")
    latin = (
        F.when(k == 0, F.replace(a, F.lit("\n"), F.lit("\r\n")))
        .when(k == 1, F.replace(flagged, F.lit("\n"), F.lit("\x8d\n")))
        .when(k == 2, F.replace(a, F.lit("\n"), F.lit("\x8d\n")))
        .when(k == 3, a)
        .otherwise(F.concat(a, F.lit("\x1ba\x1c\x1bb\x1c\x1bc\x1c")))
    )
    found = detect.detect(table(spark, sf_dir, "documents").select("doc_id", F.encode(latin, "ISO-8859-1").alias("content")))
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("size", "soft", "hard", "hi", "trips")], "variant")


@query(
    "era_dimension",
    """SELECT * FROM (VALUES ('ws3', true, false, false, false, 'font', 33), ('ws4', true, false, false, false, 'font', 28), ('ws5+', false, true, true, true, 'tenth-inch', 28),
    ('printstream', false, false, false, false, 'tenth-inch', 28), ('text', false, false, false, false, 'tenth-inch', 28), ('binary', false, false, false, false, 'tenth-inch', 28))
    AS t(variant, high_bit_wordwrap, symmetric_blocks, has_notes, has_sb, column_unit, pc_default)""",
)
def era_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.eras(spark)


@query("cp437_roundtrip", "SELECT doc_id, translate(text, 'ÈÓÊÍ', '????') AS decoded, length(text)::BIGINT AS n_bytes FROM documents")
def cp437_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = table(spark, sf_dir, "documents").select("doc_id", codec.encode_cp437("text").alias("content"))
    return encoded.select("doc_id", codec.decode_cp437("content").alias("decoded"), F.length("content").cast("long").alias("n_bytes"))


@query(
    "bare_lf_scan",
    "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_bare, (strpos(text, chr(10)) - 1)::BIGINT AS first_at, 0::BIGINT AS n_stray FROM documents",
)
def bare_lf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at, stray = detect.print_damage(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bare"), at.cast("long").alias("first_at"), stray.cast("long").alias("n_stray"))


@query(
    "dot_first_wins",
    _framed_sql(DOT_RULES)
    + """,
    g AS (SELECT doc_id, bool_or(line = '.lh 12') AS lh, bool_or(line = '.mb 1i') AS mb, bool_or(line = '.pl 14"') AS pl14, bool_or(line = '.pl 70.5') AS pl70, max(CASE WHEN line LIKE '.mt %' THEN CAST(substr(line, 5) AS DOUBLE) END) AS mt FROM f GROUP BY doc_id),
    v AS (SELECT doc_id, CASE WHEN pl14 THEN 84.0::DOUBLE WHEN pl70 THEN 70.5::DOUBLE ELSE 66.0::DOUBLE END AS pl_value, coalesce(mt, 3.0)::DOUBLE AS mt_value, CASE WHEN mb THEN 6.0::DOUBLE ELSE 8.0::DOUBLE END AS mb_value,
      CASE WHEN lh THEN 12.0::DOUBLE ELSE 8.0::DOUBLE END AS lh_value, (pl14 OR pl70) AS pl_from_file FROM g)
    SELECT *, greatest(1, trunc((pl_value - mt_value - mb_value) * 8 / lh_value))::BIGINT AS text_lines,
      CASE pl_value WHEN 84 THEN 14.0::DOUBLE WHEN 66 THEN 11.0::DOUBLE ELSE 11.693::DOUBLE END AS height_in, CASE pl_value WHEN 84 THEN 'Legal' WHEN 66 THEN 'Letter' ELSE 'A4' END AS size_name,
      CASE pl_value WHEN 70.5 THEN 8.268::DOUBLE ELSE 8.5::DOUBLE END AS width_in FROM v""",
)
def dot_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dots.page_geometry(framed(spark, sf_dir, DOT_RULES))


_STATE_SQL = """,
    s AS (SELECT doc_id, pos, line, last_value(CASE line WHEN '.oc on' THEN 'ON' WHEN '.oc off' THEN 'OFF' END IGNORE NULLS) OVER w AS oc,
      last_value(CASE line WHEN '.oj on' THEN 'ON' WHEN '.oj off' THEN 'OFF' END IGNORE NULLS) OVER w AS oj FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    a AS (SELECT *, CASE WHEN oc = 'ON' THEN 'center' WHEN oj = 'ON' THEN 'justify' ELSE 'left' END AS align FROM s WHERE NOT regexp_matches(line, '^\\.[A-Za-z]{1,3}'))"""


@query("dot_state_window", _framed_sql(DOT_RULES) + _STATE_SQL + " SELECT doc_id, align, count(*)::BIGINT AS n_lines, sum(pos)::BIGINT AS sum_pos FROM a GROUP BY doc_id, align")
def dot_state_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = dots.in_force(framed(spark, sf_dir, DOT_RULES))
    return stated.groupBy("doc_id", dots.alignment(F.col("oc"), F.col("oj")).alias("align")).agg(F.count("*").alias("n_lines"), F.sum("pos").alias("sum_pos"))


@query(
    "format_blocks",
    _framed_sql(DOT_RULES)
    + _STATE_SQL
    + """, b AS (SELECT *, coalesce(oc, '-') || '|' || coalesce(oj, '-') AS st FROM a), c AS (SELECT *, CASE WHEN st <> lag(st) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS t FROM b),
    d AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY pos) AS block_ix FROM c)
    SELECT doc_id, block_ix::BIGINT AS block_ix, min(pos)::BIGINT AS first_pos, count(*)::BIGINT AS n_lines, min(align) AS align FROM d GROUP BY doc_id, block_ix""",
)
def format_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dots.format_blocks(dots.in_force(framed(spark, sf_dir, DOT_RULES)))
    return found.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), F.col("first_pos").cast("long").alias("first_pos"), F.col("n_lines").cast("long").alias("n_lines"), "align")


_WRAP_SQL = (
    _framed_sql(INDENT_RULES)
    + """,
    g AS (SELECT *, pos % 3 = 0 AS hard, trim(line, ' ') = '' AS blank, 70 AS margin FROM f),
    h AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run, max(pos) OVER (PARTITION BY doc_id) AS last FROM g),
    i AS (SELECT *, sum(CASE WHEN pos = last THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, run) AS n_total, sum(CASE WHEN hard AND pos <> last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) AS n_hard FROM h),
    j AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM i WHERE NOT blank),
    k AS (SELECT doc_id, pos, line, CASE WHEN nxt IS NULL THEN 'eof' WHEN n_hard >= 1 AND n_total >= 2 THEN 'para' WHEN n_hard = 1 THEN 'line' WHEN nxt LIKE ' %' THEN 'line'
      WHEN length(rtrim(line, ' ')) + 1 + length(regexp_extract(nxt, '^[^ ]*')) < margin THEN 'line' ELSE 'wrap' END AS sep FROM j),
    c AS (SELECT * FROM k UNION ALL SELECT doc_id, pos, line, CASE WHEN hard THEN 'blank-hard' ELSE 'blank-soft' END FROM i WHERE blank)"""
)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = framed(spark, sf_dir, INDENT_RULES).withColumn("hard", F.col("pos") % 3 == 0).withColumn("margin", F.lit(70))
    return lexical.separators(held)


@query("wrap_classify", _WRAP_SQL + " SELECT doc_id, sep, count(*)::BIGINT AS n, sum(pos)::BIGINT AS sum_pos FROM c GROUP BY doc_id, sep")
def wrap_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("doc_id", "sep").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query(
    "logical_lines",
    _WRAP_SQL
    + """, l AS (SELECT *, CASE WHEN coalesce(lag(sep) OVER (PARTITION BY doc_id ORDER BY pos), '') <> 'wrap' THEN 1 ELSE 0 END AS s FROM c WHERE sep NOT LIKE 'blank%'),
    m AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l),
    n AS (SELECT doc_id, min(pos) AS first_pos, list(line ORDER BY pos) AS parts FROM m GROUP BY doc_id, island)
    SELECT doc_id, first_pos::BIGINT AS first_pos, list_reduce(parts, lambda a, b: a || CASE WHEN regexp_matches(a, '[ -]$') THEN '' ELSE ' ' END || ltrim(b, ' ')) AS text FROM n""",
)
def logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.logical_lines(_classified(spark, sf_dir)).select("doc_id", F.col("first_pos").cast("long").alias("first_pos"), "text")


@query(
    "verse_verdict",
    _framed_sql(SHORT_RULES)
    + r""", g AS (SELECT doc_id, pos // 6 AS run_ix, line, regexp_matches(line, '\p{L}') AS letters FROM f),
    c AS (SELECT doc_id, run_ix, count(*) FILTER (trim(line, ' ') <> '') AS n_text, count(*) FILTER (letters) AS n_scored, count(*) FILTER (letters AND regexp_matches(line, '^\s*["‘“''].*["”’''].*$')) AS n_quotes,
      count(*) FILTER (letters AND regexp_matches(line, '[.!?]["''”’]*\s*$')) AS n_terminal FROM g GROUP BY doc_id, run_ix)
    SELECT doc_id, run_ix::BIGINT AS run_ix, n_text::BIGINT AS n_text, n_scored::BIGINT AS n_scored, n_quotes::BIGINT AS n_quotes, n_terminal::BIGINT AS n_terminal,
      CASE WHEN n_scored < 2 THEN false WHEN n_quotes / n_scored >= 1.0::DOUBLE / 3 THEN false WHEN n_terminal / n_scored >= 0.9 THEN false ELSE n_terminal / n_scored < 0.8 END AS is_verse FROM c""",
)
def verse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.verse_runs(framed(spark, sf_dir, SHORT_RULES), F.floor(F.col("pos") / 6))
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("run_ix", "n_text", "n_scored", "n_quotes", "n_terminal")], "is_verse")


@query(
    "layout_context",
    _framed_sql(INDENT_RULES)
    + """, g AS (SELECT doc_id, length(line) - length(ltrim(line, ' ')) AS indent, count(*) AS n, min(pos) AS first FROM f WHERE trim(line, ' ') <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM g) SELECT doc_id, indent::BIGINT AS indent, n::BIGINT AS n_lines FROM r WHERE k = 1""",
)
def layout_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.modal_indent(framed(spark, sf_dir, INDENT_RULES))
    return found.select("doc_id", F.col("indent").cast("long").alias("indent"), F.col("n_lines").cast("long").alias("n_lines"))


@query(
    "paragraph_units",
    _framed_sql(INDENT_RULES)
    + """, g AS (SELECT doc_id, pos, sum(CASE WHEN regexp_matches(line, '^ {5,}[^ ]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS unit_ix FROM f WHERE trim(line, ' ') <> '')
    SELECT doc_id, unit_ix::BIGINT AS unit_ix, min(pos)::BIGINT AS line_from, max(pos)::BIGINT AS line_to, count(*)::BIGINT AS n_lines FROM g GROUP BY doc_id, unit_ix""",
)
def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.paragraph_units(framed(spark, sf_dir, INDENT_RULES))
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("unit_ix", "line_from", "line_to", "n_lines")])


_BULLET_SQL = (
    _framed_sql(LIST_RULES)
    + r""", g AS (SELECT doc_id, pos, length(regexp_extract(line, '^( *)([*+-])( +)(\S.*)$', 1)) AS col, regexp_extract(line, '^( *)([*+-])( +)(\S.*)$', 2) AS marker, regexp_extract(line, '^( *)([*+-])( +)(\S.*)$', 4) AS body
      FROM f WHERE regexp_matches(line, '^( *)([*+-])( +)(\S.*)$')),
    b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, col, marker) AS n FROM g WHERE strpos(body, marker) = 0) WHERE n >= 2)"""
)


@query("bullet_rows", _BULLET_SQL + " SELECT doc_id, pos::BIGINT AS pos, col::BIGINT AS col, marker, length(body)::BIGINT AS n_body FROM b")
def bullet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.bullets(framed(spark, sf_dir, LIST_RULES))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").cast("long").alias("col"), "marker", F.length("body").cast("long").alias("n_body"))


@query(
    "definition_rows",
    _framed_sql(LIST_RULES) + r" SELECT doc_id, pos::BIGINT AS pos, regexp_extract(line, '^(\S+:)( {2,})(\S.*)$', 1) AS label, length(regexp_extract(line, '^(\S+:)( {2,})(\S.*)$', 3))::BIGINT AS n_body FROM f WHERE regexp_matches(line, '^(\S+:)( {2,})(\S.*)$')",
)
def definition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.definitions(framed(spark, sf_dir, LIST_RULES))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "label", F.length("body").cast("long").alias("n_body"))


@query(
    "row_nesting",
    _BULLET_SQL
    + """, RECURSIVE_ROWS AS (SELECT doc_id, list(struct_pack(p := pos, c := col) ORDER BY pos) AS r FROM b GROUP BY doc_id),
    e AS (SELECT doc_id, unnest(r) AS x, r FROM RECURSIVE_ROWS),
    lv AS (SELECT doc_id, x.p AS pos, 1 + len(list_distinct(list_transform(list_filter(r, lambda y: y.p < x.p AND y.c < x.c AND len(list_filter(r, lambda z: z.p > y.p AND z.p < x.p AND z.c <= y.c)) = 0), lambda y: y.c))) AS level FROM e)
    SELECT doc_id, level::BIGINT AS level, count(*)::BIGINT AS n, sum(pos)::BIGINT AS sum_pos FROM lv GROUP BY doc_id, level""",
)
def row_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.nesting(reflow.bullets(framed(spark, sf_dir, LIST_RULES)))
    return found.groupBy("doc_id", F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query(
    "paginate_uniform",
    f"""WITH RECURSIVE {LINES_SQL}, w AS (SELECT doc_id, pos, greatest(1, ceil(length(line) / 65.0))::INT AS n FROM lines),
    p AS (SELECT doc_id, pos, 1 AS page, n AS used FROM w WHERE pos = 0 UNION ALL
      SELECT w.doc_id, w.pos, p.page + CASE WHEN p.used + w.n > 55 THEN 1 ELSE 0 END, CASE WHEN p.used + w.n > 55 THEN w.n ELSE p.used + w.n END FROM p JOIN w ON w.doc_id = p.doc_id AND w.pos = p.pos + 1)
    SELECT doc_id, page::BIGINT AS page, min(pos)::BIGINT AS first_pos, count(*)::BIGINT AS n_lines FROM p GROUP BY doc_id, page""",
)
def paginate_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflow.paginate(lines(spark, sf_dir))
    return found.groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n_lines"))


@query(
    "toc_compile",
    f"""WITH RECURSIVE {LINES_SQL}, w AS (SELECT doc_id, pos, line, greatest(1, ceil(length(line) / 65.0))::INT AS n FROM lines),
    p AS (SELECT doc_id, pos, line, 1 AS page, n AS used FROM w WHERE pos = 0 UNION ALL
      SELECT w.doc_id, w.pos, w.line, p.page + CASE WHEN p.used + w.n > 55 THEN 1 ELSE 0 END, CASE WHEN p.used + w.n > 55 THEN w.n ELSE p.used + w.n END FROM p JOIN w ON w.doc_id = p.doc_id AND w.pos = p.pos + 1)
    SELECT doc_id, pos::BIGINT AS pos, replace(line || ' #', '#', page::VARCHAR) AS entry FROM p""",
)
def toc_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the page they fall on, which replaces the number sign."""
    source = lines(spark, sf_dir)
    pages = reflow.paginate(source)
    commands = source.withColumn("line", F.concat(F.lit(".tc3 "), "line", F.lit(" #")))
    entries = marks.contents(commands)
    return entries.join(pages, ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"), F.replace("entry", F.lit("#"), F.col("page").cast("string")).alias("entry"))


@query("text_align", f"WITH {LINES_SQL}, t AS (SELECT doc_id, pos, trim(line, ' ') AS s FROM lines) SELECT doc_id, pos::BIGINT AS pos, CASE pos % 3 WHEN 0 THEN repeat(' ', (greatest(0, 66 - length(s)) // 2)::INT) || s WHEN 1 THEN repeat(' ', greatest(0, 66 - length(s))::INT) || s ELSE s END AS line FROM t")
def text_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    align = F.when(F.col("pos") % 3 == 0, "center").when(F.col("pos") % 3 == 1, "right").otherwise("left")
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), reflow.aligned(F.col("line"), align).alias("line"))


@query("markdown_escape", r"SELECT doc_id, regexp_replace(text, '([\\*_#`\[\]])', '\\\1', 'g') AS escaped FROM documents")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", escape.markdown(F.col("text")).alias("escaped"))


@query("html_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", escape.html(F.col("html")).alias("escaped"))


@query(
    "rtf_escape",
    r"SELECT doc_id, list_aggregate(list_transform(string_split(regexp_replace(text, '([\\{}])', '\\\1', 'g'), ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE '\u' || ord(c) || '?' END), 'string_agg', '') AS escaped FROM documents",
)
def rtf_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", escape.rtf(F.col("text")).alias("escaped"))


_NOTES_SQL = "n AS (SELECT conv_id AS doc_id, turn AS note_ix, CASE turn % 4 WHEN 0 THEN 'footnote' WHEN 1 THEN 'endnote' WHEN 2 THEN 'annotation' ELSE 'comment' END AS kind FROM conversations)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") % 4
    kind = F.when(t == 0, "footnote").when(t == 1, "endnote").when(t == 2, "annotation").otherwise("comment")
    tag = F.when(F.col("turn") % 8 == 2, F.concat(F.lit("A"), F.col("turn").cast("string")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("note_ix"), kind.alias("kind"), F.lit(None).cast("int").alias("number"), tag.alias("tag"))


@query(
    "note_labels",
    f"""WITH {_NOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY note_ix) AS rank FROM n),
    l AS (SELECT *, CASE WHEN kind = 'annotation' AND note_ix % 8 = 2 THEN 'A' || note_ix ELSE rank::VARCHAR END AS label FROM r)
    SELECT doc_id, note_ix, kind, label, CASE kind WHEN 'endnote' THEN ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii'][rank] WHEN 'comment' THEN 'c' || rank ELSE label END AS shown FROM l""",
)
def note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.note_labels(_notes(spark, sf_dir)).select("doc_id", "note_ix", "kind", "label", "shown")


@query(
    "note_refs_resolved",
    f"""WITH {_NOTES_SQL}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY note_ix) AS ref_ix, kind FROM n), refs AS (SELECT DISTINCT doc_id, unnest(range(1, 8)) AS ref_ix FROM n)
    SELECT refs.doc_id, refs.ref_ix::BIGINT AS ref_ix, coalesce('[^' || kind || ']', refs.ref_ix::VARCHAR) AS shown, kind IS NULL AS is_stray FROM refs LEFT JOIN r USING (doc_id, ref_ix)""",
)
def note_refs_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by position among a document's notes; one with no note stays text."""
    from pyspark.sql.window import Window

    notes = _notes(spark, sf_dir).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("note_ix")).alias("ref_ix"), "kind")
    refs = notes.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ref_ix"))
    shown = F.coalesce(F.concat(F.lit("[^"), "kind", F.lit("]")), F.col("ref_ix").cast("string"))
    return refs.join(notes, ["doc_id", "ref_ix"], "left").select("doc_id", F.col("ref_ix").cast("long").alias("ref_ix"), shown.alias("shown"), F.col("kind").isNull().alias("is_stray"))


@query(
    "document_info",
    f"""WITH {_NOTES_SQL}, c AS (SELECT doc_id, count(*) AS n_notes, count(*) FILTER (kind = 'footnote') AS n_footnotes, count(*) FILTER (kind = 'comment') AS n_comments FROM n GROUP BY doc_id)
    SELECT d.doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, length(text)::BIGINT AS n_chars, coalesce(n_notes, 0)::BIGINT AS n_notes, coalesce(n_footnotes, 0)::BIGINT AS n_footnotes, coalesce(n_comments, 0)::BIGINT AS n_comments
    FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
)
def document_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_notes"), F.count_if(F.col("kind") == "footnote").alias("n_footnotes"), F.count_if(F.col("kind") == "comment").alias("n_comments"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(lexical.lines_of(F.col("text"))).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
    zero = F.lit(0).cast("long")
    return docs.join(n, "doc_id", "left").select("doc_id", "n_lines", "n_chars", *[F.coalesce(c, zero).alias(c) for c in ("n_notes", "n_footnotes", "n_comments")])


@query("quality_by_variant", "SELECT lang, quality::BIGINT AS quality, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def quality_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return both.groupBy("lang", F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n"), F.sum("n").alias("n_chars"))


def as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: hard returns, in every third one a blank line after each line."""
    brk = F.when(F.col("doc_id") % 3 == 0, F.lit("\n\n")).otherwise(F.lit("\n"))
    held = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), brk).alias("t"))
    return held.select("doc_id", codec.encode_cp437(F.replace("t", F.lit("\n"), F.lit("\r\n"))).alias("content"))


@query(
    "parsed_lines",
    "SELECT doc_id, ((len(string_split(text, chr(10))) - 1) * (CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END) + 1)::BIGINT AS n_lines, length(replace(text, chr(10), ''))::BIGINT AS n_chars FROM documents",
)
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte reader over framed documents: its lines and the characters it kept."""
    from palimpsest.operators.wordfile import read_documents

    latin = F.regexp_replace(detect.byte_string(F.col("content")), r"([\x80-\xff])", "\x1b$1\x1c")  # as newer files write them
    files = as_files(spark, sf_dir).withColumn("content", F.encode(latin, "ISO-8859-1"))
    read = read_documents(files, variant="ws5+", partitions=2 * spark.sparkContext.defaultParallelism)
    n = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    return read.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n.alias("n_chars"))
