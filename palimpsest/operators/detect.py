"""What a byte string is, by its content: header, byte statistics, the ordered verdict, damage.

Bytes are read as ISO-8859-1, one character each, so that regular expressions and ``translate`` see bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: what each release does differently.
ERAS = [
    ("ws3", True, False, False, False, "font", 33),
    ("ws4", True, False, False, False, "font", 28),
    ("ws5+", False, True, True, True, "tenth-inch", 28),
    ("printstream", False, False, False, False, "tenth-inch", 28),
    ("text", False, False, False, False, "tenth-inch", 28),
    ("binary", False, False, False, False, "tenth-inch", 28),
]
ERA_SCHEMA = "variant string, high_bit_wordwrap boolean, symmetric_blocks boolean, has_notes boolean, has_sb boolean, column_unit string, pc_default int"


def byte_string(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _u16(s: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.ascii(F.substring(s, at + 1, F.lit(1))) + 256 * F.ascii(F.substring(s, at + 2, F.lit(1)))


def has_header(s: Column) -> Column:
    """Whether the bytes open with a framed header block of a known release. It is looked for before anything is cut."""
    jump = _u16(s, 1)
    end = jump + 2
    byte = lambda at: F.substring(s, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(1))
    framed = (byte(0) == "\x1d") & (byte(3) == "\x00") & jump.between(8, 0x3FF) & (end < F.length(s)) & (byte(end) == "\x1d") & (_u16(s, end - 2) == jump)
    return (F.length(s) >= 8) & F.coalesce(framed & F.ascii(byte(4)).isin(0x50, 0x55, 0x60, 0x70), F.lit(False))


def statistics(s: Column) -> dict[str, Column]:
    """Counts over the bytes before the first 0x1A."""
    core = F.substring_index(s, "\x1a", 1)
    n = F.length(core)
    # lengths of what is left are cheaper than counts of matches
    without = lambda pattern: F.length(F.regexp_replace(core, pattern, ""))
    times = lambda said: F.floor((n - F.length(F.replace(core, F.lit(said), F.lit("")))) / len(said)).cast("int")
    trips = F.regexp_count(core, F.lit("(?s)\x1b.\x1c"))
    textual = n - without("[\\x20-\\x7e\\xa0-\\xfe\\r\\n\\t]+")
    return {
        "size": n,
        "soft": times("\x8d\n"),
        "hard": times("\r\n"),
        "hi": n - without("[\\x80-\\xff]+"),
        "blocks": times("\x1d"),
        "trips": trips,
        "text_pct": F.when(n > 0, F.least(F.lit(100), F.floor((textual + 2 * trips) * 100 / n).cast("int"))).otherwise(0),
    }


def verdict(header: Column, size: Column, soft: Column, hard: Column, hi: Column, blocks: Column, trips: Column, text_pct: Column) -> Column:
    """The ladder; its order matters."""
    wordlike = (soft >= 3) | ((hi >= F.greatest(F.lit(1), F.floor(size / 20))) & (text_pct >= 70))
    newer = (soft >= 3) & (hi < F.floor(soft / 4))
    return (
        F.when(header, F.lit("ws5+"))
        .when(size == 0, F.lit("binary"))
        .when(text_pct < 40, F.lit("binary"))
        .when((blocks >= 2) | (trips >= 3), F.lit("ws5+"))
        .when(wordlike & newer, F.lit("ws5+"))
        .when(wordlike, F.lit("ws4"))
        .when((text_pct >= 90) & (hard >= 2), F.lit("printstream"))
        .when(text_pct >= 90, F.lit("text"))
        .otherwise(F.lit("binary"))
    )


def detect(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``variant`` and the counts it rests on; ``error`` is set where nothing can be parsed."""
    s = byte_string(F.col(content_col))
    counted = files.withColumns({**statistics(s), "header": has_header(s)})
    names = ("header", "size", "soft", "hard", "hi", "blocks", "trips", "text_pct")
    found = counted.withColumn("variant", verdict(*[F.col(c) for c in names]))
    return found.withColumn("error", F.when(F.col("size") == 0, F.lit("empty")).when(F.col("variant") == "binary", F.lit("binary")))


def eras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERAS, ERA_SCHEMA)


def with_era(detected: DataFrame) -> DataFrame:
    """Joins the six-row dimension; a name from elsewhere gets the row that destroys no text."""
    dimension = F.broadcast(eras(detected.sparkSession).withColumnRenamed("variant", "era"))
    known = [e[0] for e in ERAS]
    return detected.withColumn("era", F.when(F.col("variant").isin(known), F.col("variant")).otherwise(F.lit("ws5+"))).join(dimension, "era", "left")


def print_damage(s: Column) -> tuple[Column, Column, Column]:
    """Line feeds without a carriage return: how many and where the first is (from 0, or -1); stray 0x14 bytes."""
    bare = F.lit("(?<!\r)\n")
    return F.regexp_count(s, bare), F.regexp_instr(s, bare) - 1, F.regexp_count(s, F.lit("\x14"))
