"""Best-fit packing by linear grouping.

Only the histogram of piece lengths decides how sequences are filled, and it has at most ``capacity`` rows
however large the corpus is. Large lengths are sorted and grouped into groups of equal cardinality, each
rounded up to its longest member. Over these few sizes the configuration program is solved by column
generation, and its whole part taken. Actual pieces are substituted for the rounded ones, so each sequence
gets back what the rounding cost; then what is left over of the large pieces, and the small ones, are best-fit.

The plan is a list of runs "the pieces of length L with ranks r .. r + n - 1 go to sequences s .. s + n - 1 at
offset o". A piece's rank among those of its length is its place within its input partition plus the count
in the partitions before it, so no task ever holds a length's pieces together.

Defined results: a null text counts as empty and is a piece of just the end id; a null id stays null; repeated
rows are packed each; an empty table gives no rows; a text of any length is cut into pieces; further columns are
dropped. Ids come from the rank encoder of ``vocab``, which gives the library's ids (the tests compare every text).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Rows, id_and_text, spool
from .token_output import pack as packed_ids
from .token_output import unpack as unpacked_ids
from .vocab import read, text_encoder

CAPACITY = 1024
#: Rows of partition and length that are broadcast, 150 bytes each as the tool measures them.
BASES = 250_000
#: Groups of large lengths; the shares of the capacity, tried in turn, up to which a length is small; steps of column generation.
GROUPS, SMALL, STEPS = 64, (1 / 16, 1 / 4, 1 / 2), 400


def best_column(size: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one sequence that is worth most (an unbounded knapsack, copies taken in powers of two)."""
    value = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for j in np.flatnonzero(worth > 1e-12):
        copies = 1
        while copies * size[j] <= capacity:
            with_it = np.full(capacity + 1, -np.inf)
            with_it[copies * size[j] :] = value[: capacity + 1 - copies * size[j]] + copies * worth[j]
            better = with_it > value + 1e-12
            if better.any():
                value = np.where(better, with_it, value)
                taken.append((int(j), copies, better))
            copies *= 2
    column, room = np.zeros(len(size)), int(value.argmax())
    best = float(value[room])
    for j, copies, better in reversed(taken):
        if better[room]:
            column[j] += copies
            room -= copies * int(size[j])
    return best, column


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, int]]:
    """Fillings over few sizes and how often each is used: the whole part of the configuration program's optimum."""
    k = len(size)
    basis = np.diag((capacity // size).astype(float))
    inverse, x = np.linalg.inv(basis), demand / np.diag(basis)
    for step in range(steps):
        best, column = best_column(size, inverse.sum(axis=0), capacity)
        if best <= 1 + 1e-7:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        if step % 25 == 24:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / d[leave]
            inverse = inverse - np.outer(d, row)
            inverse[leave] = row
        x = np.maximum(inverse @ demand, 0)
    return [(basis[:, p].astype(int), int(x[p] + 1e-9)) for p in range(k) if x[p] + 1e-9 >= 1]


@dataclass
class Plan:
    """Runs, sorted by length and rank: pieces of a length from a rank on go to sequences from one on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.rank
        at = np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


class Builder:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int]] = []
        self.used = np.zeros(capacity + 1, dtype=np.int64)  # ranks given out, by length
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # sequences (first, how many) by what is left in them
        self.rooms: list[int] = []

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), first, offset))
        self.used[length] += count

    def leave(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.room:
                self.room[room] = []
                insort(self.rooms, room)
            self.room[room].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        while count > 0:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                fit = self.capacity // length
                whole = count // fit
                for n, each in ((whole, fit), (1 if count % fit else 0, count % fit)):
                    for slot in range(each if n else 0):
                        self.put(length, n, self.sequences, slot * length)
                    if n:
                        self.leave(self.capacity - each * length, self.sequences, n)
                        self.sequences += n
                return
            room = self.rooms[k]
            first, n = self.room[room].pop()
            if not self.room[room]:
                del self.room[room]
                self.rooms.pop(k)
            taken = min(n, count)
            self.put(length, taken, first, self.capacity - room)
            self.leave(room - length, first, taken)
            self.leave(room, first + taken, n - taken)
            count -= taken

    def configuration(self, column: np.ndarray, times: int, queues: list[list[list[int]]]) -> None:
        """Substitutes actual pieces: each slot of a rounded size takes the next ``times`` pieces of its group, the
        longest first. Where the length changes, the run of equal sequences is split."""
        slots: list[list[list[int]]] = []
        for group, copies in enumerate(column):
            for _ in range(copies):
                slot, need = [], times
                while need and queues[group]:
                    length, n = queues[group][0]
                    take = min(n, need)
                    slot.append([length, take])
                    need -= take
                    queues[group][0][1] -= take
                    if n == take:
                        queues[group].pop(0)
                if slot:
                    slots.append(slot)
        at = 0
        while at < times and (live := [s for s in slots if s]):
            n = min(min(s[0][1] for s in live), times - at)
            offset = 0
            for s in live:
                self.put(s[0][0], n, self.sequences, offset)
                offset += s[0][0]
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            self.leave(self.capacity - offset, self.sequences, n)
            self.sequences += n
            at += n


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> Plan:
    """Fills sequences from the number of pieces of each length, with the bound of small lengths that needs fewest."""
    return min((grouped(histogram, capacity, groups, share) for share in small), key=lambda p: p.n_sequences)


def grouped(histogram: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    b = Builder(capacity)
    if full := histogram.get(capacity, 0):
        b.put(capacity, full, 0, 0)
        b.sequences = full
    rest = {k: n for k, n in histogram.items() if 0 < k < capacity and n}
    large = sorted((k for k in rest if k > capacity * small), reverse=True)
    total, queues, size, demand, seen = sum(rest[k] for k in large), [], [], [], 0
    for k in large:  # equal cardinality; a length is split between groups where it must be
        left = rest[k]
        while left:
            group = len(size) - 1
            room = -(-total * (group + 1) // groups) - seen if size else 0
            if room <= 0:
                size.append(k)
                demand.append(0)
                queues.append([])
                continue
            take = min(left, room)
            queues[-1].append([k, take])
            demand[-1] += take
            seen += take
            left -= take
    if size:
        merged: dict[int, int] = {}
        for s, d in zip(size, demand, strict=True):
            merged[s] = merged.get(s, 0) + d
        joined: dict[int, list[list[int]]] = {s: [] for s in merged}
        for s, q in zip(size, queues, strict=True):
            joined[s] += q
        sizes = np.array(list(merged))
        queues = [joined[s] for s in merged]
        for column, times in sorted(configurations(sizes, np.array(list(merged.values()), dtype=float), capacity), key=lambda x: -x[1]):
            b.configuration(column, times, queues)
        for k in {length for q in queues for length, _ in q} | set(large):
            rest[k] = sum(n for q in queues for length, n in q if length == k)
    for k in sorted(rest, reverse=True):
        b.best_fit(k, rest[k])
    runs = np.array(sorted(b.runs), dtype=np.int64).reshape(-1, 4)
    return Plan(runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3], b.sequences)


class Cut:
    """Pieces of each document, with their place among those of their length in this partition."""

    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def __init__(self, data: bytes, end_id: int, capacity: int):
        self.data, self.end, self.capacity = data, np.array([end_id], dtype="<u4").tobytes(), capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, part = text_encoder(self.data), Rows(self.schema), TaskContext.get().partitionId()
        counts = [0] * (self.capacity + 1)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + self.end
                n, whole = len(ids) // 4, np.frombuffer(ids, dtype="<u4")
                start, stop = 0, n if n <= self.capacity else n % self.capacity or self.capacity
                piece = 0
                while start < n:
                    length = stop - start
                    yield from rows.add((part, doc_id, piece, start, length, counts[length], packed_ids(whole[start:stop])), 4 * length)
                    counts[length] += 1
                    piece, start, stop = piece + 1, stop, stop + self.capacity
        yield from rows.flush()


class Place:
    """The pieces with their ids unpacked, their sequences and their places there, in small batches."""

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def __init__(self, plan: Plan):
        self.plan = plan

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                length = part.column("length").to_numpy()
                sequence, offset = self.plan.place(length, part.column("rank").to_numpy())
                ids = [unpacked_ids(x.as_buffer(), n).astype("<u4").tobytes() for x, n in zip(part.column("ids"), length, strict=True)]
                columns = [*(part.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(ids, pa.binary()), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``. A document longer than the capacity is cut into
    pieces of it, of which the first may be shorter. ``ids`` are little-endian unsigned 32-bit integers."""
    pieces = spool(id_and_text(docs, id_col, text_col).mapInArrow(Cut(read(tokenizer_path), end_id, capacity), "part int, doc_id long, piece int, start long, length long, place long, ids binary"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # pieces of a length in the partitions before: broadcast while they are few, else met by a shuffle on both columns
    bases = spool(counts.select("part", "length", before.alias("before")), "bases")
    bases = F.broadcast(bases) if bases.count() <= BASES else bases.hint("merge")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    filled = plan(histogram, capacity, groups, small)

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", (F.col("place") + F.col("before")).alias("rank"), "ids")
    return ranked.mapInArrow(Place(filled), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
