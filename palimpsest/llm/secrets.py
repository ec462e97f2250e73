"""Secret scan with corpus-wide ownership frequency.

Every whole text is scanned for candidates. The hash of each candidate's value is counted over the whole
corpus by distinct repositories (``source``) and owners (the part of the source before a slash, or all of
it). A value that many owners hold is a copied example; one that few hold, and that looks random, is live.

Kinds: the base ones ``assign``, ``access`` and ``hex``, always reported; and ``token``, ``jwt`` and ``pem``,
reported only where the counts say that the value is owner-specific, or for ``pem`` always.

Defined results: a null text counts as empty and has no spans; a null source is an owner of its own kind
(the empty name); a null id stays null; repeated rows give one row each; an empty table
gives an empty one; a text of any length is scanned whole, in linear time; further columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rows, spool

#: Fixed patterns of the base kinds, with the least length of what must be long enough.
KINDS = ("assign", "access", "hex", "token", "jwt", "pem")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: A value held by more owners than this is a copied example.
OWNERS = 2
#: Bits a character from which a value counts as random.
ENTROPY = 3.0

Span = tuple[int, int, int, str]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan(text: str) -> list[Span]:
    """(start, kind, end, value) of each candidate, sorted; kind is an index into KINDS."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    if "eyJ" in text:
        found += [(m.start(), 4, m.end(), m[0]) for m in JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 5, m.end(), m[0]) for m in PEM.finditer(text)]
    starts = [x[0] for x in base]
    reach = list(accumulate((x[2] for x in base), max))  # the farthest end of the spans up to each
    for m in TOKEN.finditer(text):
        value = m[0]
        k = bisect_left(starts, m.end())
        if not (k and reach[k - 1] > m.start()) and re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value) and entropy(value) >= 4.0:
            found.append((m.start(), 3, m.end(), value))
    return sorted(found)


class Scan:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.string()), ("random", pa.bool_())])
    schema = pa.schema([("row_id", pa.string()), ("doc_id", pa.int64()), ("source", pa.string()), ("spans", pa.list_(span))])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(self.schema)
        for batch in batches:
            for row_id, doc_id, source, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "source")), batch.column("text"), strict=True):
                spans = [{"kind": k, "start": a, "end": b, "value_hash": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= ENTROPY} for a, k, b, v in scan(text.as_py())]
                yield from rows.add((row_id, doc_id, source, spans), 64 + 160 * len(spans))
        yield from rows.flush()


SPANS = "row_id string, doc_id long, source string, spans array<struct<kind:int,start:long,end:long,value_hash:string,random:boolean>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document with its candidate spans, written once to the shared folder."""
    rows = docs.select(
        F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("row_id"),
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[source_col], F.lit("")).alias("source"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    return spool(rows.mapInArrow(Scan(), SPANS), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, n_repositories, n_owners, n_places``, over the whole corpus. A value is first reduced to
    one row per source, map side included, so a value that a third of all rows hold costs no task more."""
    by_source = found.select("source", F.explode("spans").alias("s")).groupBy(F.col("s.value_hash").alias("value_hash"), "source").agg(F.count("*").alias("n"))
    owner = F.substring_index("source", "/", 1)
    by_owner = by_source.groupBy("value_hash", owner.alias("owner")).agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_places"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_owners: int = OWNERS) -> DataFrame:
    """``doc_id, spans`` with spans as array of (start, kind, end, value_hash, n_repositories, n_owners, live),
    by start and then kind as in :data:`KINDS`."""
    found = candidates(docs, id_col, text_col, source_col)
    each = found.select("row_id", F.explode("spans").alias("s")).select("row_id", "s.*")
    counted = each.join(ownership(found), "value_hash")
    live = F.col("random") & (F.col("n_owners") <= max_owners)
    kept = counted.where((F.col("kind") < 3) | (F.col("kind") == 5) | live)
    per_row = kept.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value_hash", "n_repositories", "n_owners", live.alias("live")))).alias("kept"))
    spans = F.coalesce(F.col("kept"), F.array().cast("array<struct<start:long,kind:int,end:long,value_hash:string,n_repositories:long,n_owners:long,live:boolean>>"))
    return found.select("row_id", "doc_id").join(per_row, "row_id", "left").select("doc_id", spans.alias("spans"))
