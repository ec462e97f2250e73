"""Token-ID output: ids ranked by frequency, in a byte-aligned variable-length code with separate control bytes.

An id's rank by corpus frequency (ties to the smaller id) is stored in one to four bytes. The lengths, two
bits each, stand apart in control bytes, four ids to a byte, so a reader looks four lengths up at once in a
256-row table and gathers the data bytes without a loop over ids.

Files: Parquet containers in one folder, so the format lives wherever Spark writes and a lost executor's
half-written part is discarded. A row of ``segments`` is a segment of whole documents in ascending doc_id order: its part
and place, its documents' ids and lengths, and ``payload`` = magic, id count (8 bytes), control bytes, data bytes.
``ranks`` is the table of ids by rank. The folder is all that a reader needs.

Order: by doc_id, null first; equal doc_ids by a hash of their ids and then by the ids, so repeated rows are
stored next to each other and a doc_id that very many rows share is still dealt over many parts. A null text counts as empty
and is stored as just the end id. A text of any length is encoded whole; a segment holds whole documents, so a very long
one is a segment of its own. An empty table gives no segment. Further columns are dropped. Ids come from the rank encoder
of ``vocab``, which gives the library's ids (the tests compare every text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Rows, id_and_text, shared_root, spool
from .vocab import read, text_encoder

MAGIC = b"FRQ1"
#: Ids after which a segment is closed.
SEGMENT = 1 << 18
#: Lengths of the four ids of each control byte.
LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    v = values.astype("<u4")
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    return control.tobytes() + data.tobytes()


def unpack(data: bytes | memoryview, n: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    width = -(-n // 4)
    size = LENGTHS[raw[:width]].ravel()[:n]
    body = np.concatenate([raw[width:], np.zeros(3, np.uint8)])
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    value = body[at].astype(np.uint32)
    for k in (1, 2, 3):
        (longer,) = (size > k).nonzero()
        if not len(longer):
            break
        value[longer] |= body[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def stored(ids: np.ndarray) -> bytes:
    """A document's ids between the passes: their width, then two bytes each, or four where one needs more."""
    width = 2 if ids.max(initial=0) <= 0xFFFF else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def restored(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of counts by id."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    total = a.copy()
    total[: len(b)] += b
    return total


class Encode:
    """Ids with the end id; after a partition's documents, one row with its counts by id."""

    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def __init__(self, data: bytes, end_id: int):
        self.data, self.end = data, np.array([end_id], dtype="<u4").tobytes()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = text_encoder(self.data), Rows(self.schema)
        counts = np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []  # counted together: a count is as long as the largest id, whatever the document's length
        n = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = np.frombuffer(encode(text.as_py()) + self.end, dtype="<u4")
                held.append(raw)
                n += len(raw)
                if n >= SEGMENT:
                    counts = added(counts, np.bincount(np.concatenate(held)))
                    held, n = [], 0
                ids = stored(raw)
                yield from rows.add((0, doc_id, ids), len(ids))
        if held:
            counts = added(counts, np.bincount(np.concatenate(held)))
        yield from rows.add((1, None, counts.tobytes()), 8 * len(counts))
        yield from rows.flush()


class Counts:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for held in batch.column("ids"):
                total = added(total, np.frombuffer(held.as_py(), dtype=np.int64))
        (at,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=self.schema)


class Segments:
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def __init__(self, rank: np.ndarray, limit: int):
        self.rank, self.limit = rank, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            payload = MAGIC + n.to_bytes(8, "little") + pack(self.rank[np.concatenate(held)])
            row = ([part], [start], [n], [docs], [[len(x) for x in held]], [payload])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, self.schema, strict=True)], schema=self.schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = restored(ids.as_py())
                docs.append(doc_id)
                held.append(x)
                n += len(x)
                if n >= self.limit:
                    yield close()
                    docs, held, start, n = [], [], start + n, 0
        if held:
            yield close()


class Documents:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def __init__(self, by_rank: np.ndarray, base: dict[int, int]):
        self.by_rank, self.base = by_rank, base

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(self.schema)
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, n, doc_ids, lengths, payload = (batch.column(k)[r].as_py() for k in range(6))
                if payload[:4] != MAGIC or int.from_bytes(payload[4:12], "little") != n:
                    raise ValueError("not a segment of this format")
                ids = self.by_rank[unpack(memoryview(payload)[12:], n)].astype("<u4")
                at = 0
                for doc_id, length in zip(doc_ids, lengths, strict=True):
                    yield from rows.add((doc_id, self.base[part] + start + at, length, ids[at : at + length].tobytes()), 4 * length)
                    at += length
        yield from rows.flush()


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> str:
    """Encodes every whole text, appends ``end_id``, and writes the files in ascending doc_id order; the folder they are
    in, which also holds the table of ids by rank and needs nothing else to be read."""
    spark = docs.sparkSession
    encoded = spool(id_and_text(docs, id_col, text_col).mapInArrow(Encode(read(tokenizer_path), end_id), "kind int, doc_id long, ids binary"), "ids")
    counted = encoded.where("kind = 1").mapInArrow(Counts(), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    order = sorted(((-r["n"], r["id"]) for r in counted))
    by_rank = np.array([i for _, i in order], dtype=np.uint32)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    path = path or f"{shared_root(spark)}/spool/{spark.sparkContext.applicationId}/tokens-{np.random.default_rng().integers(1 << 62):x}"
    by_id = encoded.where("kind = 0").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    ordered = by_id.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    ordered.mapInArrow(Segments(rank, segment), SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")
    spark.createDataFrame([(k, i) for k, i in enumerate(by_rank.tolist())], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    return path


SEGMENTS = "part int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; start counts the ids of all documents before it."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    ranks = spark.read.schema("rank int, id long").parquet(f"{path}/ranks").orderBy("rank").collect()  # a row for each id of the vocabulary at most
    by_rank = np.array([r["id"] for r in ranks], dtype=np.uint32)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each part
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]
    return segments.mapInArrow(Documents(by_rank, base), "doc_id long, start long, n_tokens long, ids binary")
