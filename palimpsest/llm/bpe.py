"""Byte-level BPE encoding and decoding.

A long text is cut into overlapping chunks that are pre-tokenised independently. The pattern has no
look-behind, so two scans that both begin a match at one position agree from there on: neighbouring
chunks are stitched at the first boundary they share in their overlap. Each piece between boundaries
is then encoded by rank, and decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty and has no ids; a null id stays null; repeated rows give
repeated results; an empty table gives an empty one; a text of any length is encoded whole,
in chunks, in time linear in its length; further columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .shared import Rows, id_and_text

CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Pieces that a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000


@lru_cache(maxsize=4)
def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of base64 token and rank."""
    ranks = {}
    for line in data.splitlines():
        token, _, rank = line.partition(b" ")
        if token:
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


@lru_cache(maxsize=4)
def encoder(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(data), special_tokens={})


class Pieces(dict):
    """Ids of a pre-token as little-endian unsigned 32-bit integers, computed when first asked for."""

    def __init__(self, data: bytes, pattern: str):
        self.encoding = encoder(data, pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoding._core_bpe.encode_single_piece(piece.encode())
        found = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


@lru_cache(maxsize=4)
def pieces(data: bytes, pattern: str) -> Pieces:
    return Pieces(data, pattern)


def windows(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each chunk; each but the last reaches ``overlap`` characters into the next."""
    return [(a, min(length, a + chunk + overlap)) for a in range(0, max(1, length - overlap), chunk)]


def _starts_from(begin: int, tokens: list[str], limit: int) -> dict[int, int]:
    """Start of each leading token before ``limit``, with its index."""
    found = {}
    for k, token in enumerate(tokens):
        if begin >= limit:
            break
        found[begin] = k
        begin += len(token)
    return found


def stitched(text: str, scan: Callable[[str], list[str]], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of a text, in runs, by overlapping chunks."""
    spans = windows(len(text), chunk, overlap)
    begin, end = spans[0]
    held = scan(text[begin:end])  # begins at a true boundary
    goal = 0
    for start, stop in spans[1:]:
        if stop < goal and stop < len(text):
            continue  # within one long match: the next scan is twice as long, so all scans are linear in its length
        cut = None
        if start < end:
            ahead = scan(text[start:stop])
            candidates = _starts_from(start, ahead, end)
            at, k = end, len(held)
            while k and at > start:  # from the back: tokens of the earlier scan inside the overlap
                k -= 1
                at -= len(held[k])
                if at in candidates:
                    cut = (k, candidates[at], at)
        if cut is None:  # one match covers the overlap: scan on from the last true boundary
            held, end, goal = scan(text[begin:stop]), stop, begin + 2 * (stop - begin)
            continue
        yield held[: cut[0]]
        held, begin, end = ahead[cut[1] :], cut[2], stop
    yield held


class Encode:
    def __init__(self, data: bytes, pattern: str, chunk: int, overlap: int):
        self.data, self.pattern, self.chunk, self.overlap = data, pattern, chunk, overlap

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, ids_of = regex.compile(self.pattern).findall, pieces(self.data, self.pattern).__getitem__
        rows = Rows(self.schema)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = b"".join(b"".join(map(ids_of, run)) for run in stitched(text.as_py(), scan, self.chunk, self.overlap))
                yield from rows.add((doc_id, len(ids) // 4, ids), len(ids))
        yield from rows.flush()


class Decode:
    def __init__(self, data: bytes):
        self.data = data

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(self.data)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        bytes_of, rows = table.__getitem__, Rows(self.schema)
        for batch in batches:
            for doc_id, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_py()
                decoded = b"".join(map(bytes_of, np.frombuffer(ids, dtype="<u4").tolist()))
                yield from rows.add((doc_id, n, ids, decoded), len(ids) + len(decoded))
        yield from rows.flush()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of each whole text as little-endian unsigned 32-bit integers."""
    with open(ranks_path, "rb") as f:  # the vocabulary is read once, on the driver, and goes with the task
        data = f.read()
    return id_and_text(docs, id_col, text_col).mapInArrow(Encode(data, pattern, chunk, overlap), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of the ids of a table that :func:`encode` made."""
    with open(ranks_path, "rb") as f:
        data = f.read()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(Decode(data), "doc_id long, n_tokens long, ids binary, decoded binary")
