"""Near-duplicate documents by ProbMinHash.

A text becomes weighted five-word shingles (weight 1 + ln of the count). Each shingle's arrivals form a Poisson
process whose rate is its weight and whose randomness is a hash of the shingle; an arrival falls on a register, and
the register keeps the earliest. A shingle stops when its next arrival is later than every register of the text. Two
texts agree in a register with the probability Jaccard similarity of their weighted shingles.

Bands of registers are bucket keys. Buckets are never expanded into pairs: every text is compared with its
bucket's least member, exactly, and texts that are similar enough are linked. Where a bucket still holds several
components after that, the texts outside its largest component are dealt into blocks; each block meets the bucket's
blocks and compares registers across components, and pairs that may be similar are compared exactly. Copies of one text
are one node from the start. Classes are the connected components of the links.

Defined results: a null text counts as empty; texts without words are alike only if they are equal; a text of fewer
than five words is one shingle; ``class_id`` is the least doc_id of the class, null only if all its ids are null;
repeated rows and ids are kept; an empty table gives an empty one; a text of any length is taken whole, and a very long
one is held alone; further columns are dropped. Similarity is exact, so what a copy may differ in is fixed by it: one
edited word changes five shingles, and two texts of n words that differ in k words far apart are alike up to about
k = n / 45.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import group_starts, spool, whole_groups

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Texts, and their bytes, whose registers are filled together; texts in a block of a divided bucket.
TOGETHER, TOGETHER_BYTES, BLOCK = 1_000, 1 << 20, 256
#: Rows of one key that a join by shuffle takes whatever their share is; rows to be dropped that are broadcast.
HOT, DROPPED = 1_000, 1_000_000
REMEMBERED = 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_word = re.compile(r"\w+")
_words: dict[str, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct five-word shingles of a text, ascending, and their weights."""
    words = _word.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            h = h * _A + w[k : len(w) - width + 1 + k]
    found, n = np.unique(mixed(h), return_counts=True)
    return found, 1 + np.log(n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: over common elements, the sum of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    (ha, x), (hb, y) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_x, only_y = x.sum() - x[ia].sum(), y.sum() - y[ib].sum()
    u, v = x[ia], y[ib]
    order = np.argsort(v / u, kind="stable")
    u, v = u[order], v[order]
    lower, upper = only_x + np.cumsum(u), only_y + v.sum() - np.cumsum(v)
    ratio = v / u
    last = np.searchsorted(ratio, ratio, side="right") - 1  # equal ratios belong to the lower sum
    return float((1 / (lower[last] / u + upper[last] / v)).sum())


def registers(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which shingle came first at each register of each text; texts without shingles have zeros."""
    n = len(texts)
    first = np.full((n, REGISTERS), np.inf)
    holder = np.zeros((n, REGISTERS), dtype=np.uint64)
    size = np.array([len(h) for h, _ in texts])
    for k in np.flatnonzero(size == 1):
        holder[k] = texts[k][0][0]
    many = np.flatnonzero(size > 1)
    if not len(many):
        return holder
    element = np.concatenate([texts[k][0] for k in many])
    rate = np.concatenate([texts[k][1] for k in many])
    text = np.repeat(many, size[many])
    arrival = np.zeros(len(element))
    turn = 0
    flat_first, flat_holder = first.ravel(), holder.ravel()
    while len(element):
        turn += 1
        with np.errstate(over="ignore"):
            r = mixed(element + np.uint64(turn) * _A)
        arrival = arrival - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        at = text * REGISTERS + (mixed(r ^ _C) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(flat_first, at, arrival)
        won = arrival == flat_first[at]
        flat_holder[at[won]] = element[won]
        active = np.unique(text) if turn > 1 else many
        latest = np.zeros(n)
        latest[active] = first[active].max(axis=1)
        on = arrival < latest[text]
        element, rate, text, arrival = element[on], rate[on], text[on], arrival[on]
    return holder


class Sign:
    """Each row with its row_id and the digest, band keys and registers of its text. Texts are worked on in groups
    that are bounded by rows and by characters, so a long text is held alone."""

    def __init__(self, text_col: str):
        self.text_col = text_col

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("row").field(self.text_col)
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())))
            a = 0
            while a < batch.num_rows:
                base = size[a - 1] if a else 0
                b = min(a + TOGETHER, max(a + 1, int(np.searchsorted(size, base + TOGETHER_BYTES, "right"))))
                yield self.sign(batch.slice(a, b - a))
                a = b

    def sign(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("row").field(self.text_col).to_pylist()]
        elements = [shingles(t) for t in texts]
        held = registers(elements)
        with np.errstate(over="ignore"):
            bands = held.reshape(len(texts), BANDS, ROWS)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS))
            for k in range(ROWS):
                keys = mixed(keys * _A + bands[:, :, k])
        short = mixed(held).astype(np.uint32)
        columns = {
            "row_id": batch.column("row_id"),
            "node": pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()),
            "keys": pa.array([k.view(np.int64).tolist() if len(e[0]) else [] for k, e in zip(keys, elements, strict=True)], pa.list_(pa.int64())),
            "registers": pa.array([r.tobytes() for r in short], pa.binary()),
            "row": batch.column("row"),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Verify:
    """Exact similarity of pairs of texts."""

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple] = OrderedDict()

        def of(node: int, text: pa.Scalar) -> tuple:
            if node not in held:
                if len(held) >= 64:
                    held.popitem(last=False)
                held[node] = shingles(text.as_py())
            held.move_to_end(node)
            return held[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = [similarity(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], schema=self.schema)


def links(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of nodes that are similar enough. Hot nodes are keys of plain joins, which Spark can split."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(Verify(), "a long, b long, similarity double").where(F.col("similarity") >= least)


def met(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with a table that has one row for a key, by shuffle and merge at every size. A key that holds more than a thousandth of the
    rows would fill one task: of those there are a thousand at most, so they are met by broadcast, all others by shuffle.
    ``rows`` must be a spooled table, since it is read three times."""
    each = rows.groupBy(key).count()
    hot = each.where(F.col("count") > max(HOT, rows.count() // 1000)).select(key)
    names = [x["k"] for x in hot.select(F.col(key).alias("k")).collect()]  # at most a thousand
    if not names:
        return rows.join(found.hint("merge"), key)
    few = F.broadcast(found.where(F.col(key).isin(names)))
    return rows.where(F.col(key).isin(names)).join(few, key).unionByName(rows.where(~F.col(key).isin(names)).join(found.hint("merge"), key))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component, for nodes that have an edge. Labels move along
    edges and then jump to their own labels, so the rounds grow with the logarithm of a component's width."""
    both = spool(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = spool(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = met(both, labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = spool(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")), "hooked")
        # every label is a node that has an edge, and so has a label of its own
        jumped = spool(met(hooked, labels.select(F.col("node").alias("next"), F.col("label").alias("over")), "next").select("node", "label", F.least("next", "over").alias("next")), "labels")
        labels = jumped.select("node", F.col("next").alias("label"))
        if jumped.where("label <> next").isEmpty():
            return labels


#: A pair of blocks of a bucket.
PAIR = ("key", "i", "j")


def alike(band: int, side: np.ndarray, label: np.ndarray, held: np.ndarray, maybe: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the left block the rows of the right one, of other components, whose registers agree in the share
    ``maybe`` at least and whose first band in common is the bucket's: each pair comes up in one bucket."""
    left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)
    y, labels = held[right], label[right]
    for k in left:
        same = held[k] == y
        near = np.flatnonzero((same.mean(axis=1) >= maybe) & (labels != label[k]))
        if len(near):
            shared = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            yield k, right[near[shared == band]]


class Blocks:
    """Pairs of blocks, whole, from rows sorted by ``PAIR``. A pair of blocks has 2 * ``BLOCK`` rows or so."""

    def __init__(self, maybe: float):
        self.maybe = maybe

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Iterator[tuple[int, np.ndarray]]]]:
        for batch in whole_groups(batches, PAIR, 2 * BLOCK):
            starts = group_starts(batch, PAIR)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                held = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint32).reshape(b - a, REGISTERS)
                yield part, alike(part.column("band")[0].as_py(), part.column("side").to_numpy(), part.column("label").to_numpy(), held, self.maybe)


class Candidates(Blocks):
    """The rows of a pair of blocks that have a partner to be compared with, by registers alone."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in self.pairs(batches):
            keep = np.zeros(part.num_rows, bool)
            for k, others in found:
                keep[k] |= len(others) > 0
                keep[others] = True
            if keep.any():
                yield part.filter(pa.array(keep))


class Compare(Blocks):
    """Links between components in a pair of blocks, by exact similarity. Components that a link joins are one from
    there on, so no more links come out than texts went in."""

    def __init__(self, maybe: float, least: float):
        super().__init__(maybe)
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in self.pairs(batches):
            node, label = part.column("node").to_numpy(), part.column("label").to_numpy()
            elements: dict[int, tuple] = {}
            over: dict[int, int] = {}
            a, b = [], []

            def root(x: int) -> int:
                while x in over:  # noqa: B023
                    x = over[x]  # noqa: B023
                return x

            for k, others in found:
                for m in others:
                    p, q = root(label[k]), root(label[m])
                    if p == q:
                        continue
                    for n in (k, m):
                        if n not in elements:
                            elements[n] = shingles(part.column("text")[int(n)].as_py())
                    if similarity(elements[k], elements[m]) >= self.least:
                        over[max(p, q)] = min(p, q)
                        a.append(max(node[k], node[m]))
                        b.append(min(node[k], node[m]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def across(buckets: DataFrame, labels: DataFrame, signed: DataFrame, text: Column, least: float, maybe: float) -> DataFrame:
    """Links that join components within the buckets which still hold several. Rows of a bucket's largest component need
    no comparison with one another: the others are dealt into blocks, and each block meets the bucket's blocks once.
    Only registers travel for that; texts are fetched for rows that have a partner."""
    member = spool(buckets.join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label")), "members")
    size = member.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed_keys = spool(size.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1").select("key", F.col("top.label").alias("main"), F.col("top.n").alias("n_main"), (F.col("n") - F.col("top.n")).alias("n_rest")), "mixed")
    if mixed_keys.isEmpty():
        return labels.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    dealt = member.join(mixed_keys, "key")
    rest_blocks, main_blocks = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("n_rest", "n_main"))
    in_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(in_main, main_blocks).otherwise(rest_blocks))
    # blocks of the rest are 0 .. r-1, those of the largest component -1, -2, ..: a pair (i, j) has i >= 0 and j <= i
    rest = F.sequence(F.lit(0).cast("long"), rest_blocks - 1)
    to_main = F.transform(rest, lambda o: F.struct(o.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(2).alias("side")))
    to_rest = F.transform(rest, lambda o: F.struct(F.greatest("own", o).alias("i"), F.least("own", o).alias("j"), F.when(F.col("own") > o, 0).when(F.col("own") < o, 2).otherwise(1).alias("side")))
    to_mains = F.transform(F.sequence(F.lit(0).cast("long"), main_blocks - 1), lambda o: F.struct(F.col("own").alias("i"), (-1 - o).alias("j"), F.lit(0).alias("side")))
    placed = dealt.withColumn("own", own).select("band", "key", "node", "label", F.when(in_main, to_main).otherwise(F.concat(to_rest, to_mains)).alias("to"))
    placed = placed.join(signed.select(F.col("row_id").alias("node"), "registers").hint("merge"), "node")
    spread = placed.select("band", "key", "node", "label", "registers", F.explode("to").alias("p")).select("band", "key", "node", "label", "registers", "p.i", "p.j", F.col("p.side").cast("int").alias("side"))
    tasks = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), spool_rows(mixed_keys, "n_main", "n_rest") // (16 * BLOCK))
    paired = lambda rows: rows.repartition(tasks, *PAIR).sortWithinPartitions(*PAIR)
    near = spool(paired(spread).mapInArrow(Candidates(maybe), spread.schema), "near")
    wanted = near.select("node").distinct()
    texts = signed.select(F.col("row_id").alias("node"), text.alias("text")).join(wanted.hint("merge"), "node")
    return paired(near.join(texts.hint("merge"), "node")).mapInArrow(Compare(maybe, least), "a long, b long")


def spool_rows(mixed_keys: DataFrame, *columns: str) -> int:
    return int(mixed_keys.agg(F.sum(sum(F.col(c) for c in columns)).alias("n")).collect()[0]["n"] or 0)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, maybe: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and ``row_id, doc_id, class_id, is_kept, node`` for each of them."""
    if least < SIMILARITY:
        raise ValueError(f"the bands propose pairs from a similarity of {SIMILARITY} on")
    maybe = least - 4 * (least * (1 - least) / REGISTERS) ** 0.5 if maybe is None else maybe
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*names).alias("row"))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType()), T.StructField("row", keyed.schema["row"].dataType)])
    signed = spool(keyed.mapInArrow(Sign(text_col), schema), "signed")
    text, doc_id = F.coalesce(F.col("row")[text_col], F.lit("")), F.col("row")[id_col].cast("long")
    # copies of a text are one node, for which its first row stands
    first = signed.groupBy("node").agg(F.min("row_id").alias("first"))
    stands = spool(met(spool(signed.select("row_id", "node", doc_id.alias("doc_id")), "rows"), first, "node"), "rows")
    ones = signed.select("row_id", "keys").join(stands.where("row_id = first").select("row_id").hint("merge"), "row_id")
    every = ones.select(F.col("row_id").alias("node"), F.posexplode("keys").alias("band", "key"))
    shared = every.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    # only buckets of two or more are kept
    buckets = spool(every.join(shared.hint("merge"), "key").select("band", "key", "node", "b"), "buckets")
    pairs = spool(buckets.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    chosen = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = spool(signed.select(F.col("row_id").alias("node"), text.alias("text")).join(chosen.hint("merge"), "node"), "texts")
    linked = spool(links(pairs, texts, least), "links")
    labels = components(linked)
    more = spool(across(buckets.select("band", "key", "node"), labels, signed, text, least, maybe), "links")
    if not more.isEmpty():
        labels = components(linked.select("a", "b").union(more))
    joined = stands.join(labels.select(F.col("node").alias("first"), "label"), "first", "left")
    named = spool(joined.select("row_id", "doc_id", "node", F.coalesce("label", "first").alias("label")), "classes")
    # the least id, null last; of rows with that id the first
    kept = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("kept"))
    return signed, met(named, kept, "label").select("row_id", "doc_id", F.col("kept.doc_id").alias("class_id"), (F.col("row_id") == F.col("kept.row_id")).alias("is_kept"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, maybe: float | None = None) -> DataFrame:
    """``doc_id, class_id, is_kept, node``: one row per document; ``is_kept`` marks one row of each class (the first
    with the least id);
    ``node`` is the digest of the text. ``maybe`` is the share of equal registers from which a pair of a divided bucket is
    compared exactly, four standard deviations below ``least`` if not given; 0 compares every such pair."""
    found = classes(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text", least, maybe)[1]
    return found.select("doc_id", "class_id", "is_kept", "node")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows with all their columns, one of each class of near-duplicates. Rows that go are few next to the texts:
    up to ``DROPPED`` of them are broadcast (8 bytes each), more are met by a shuffle of the rows."""
    signed, found = classes(docs, id_col, text_col, least)
    dropped = spool(found.where("not is_kept").select("row_id"), "dropped")
    gone = F.broadcast(dropped) if dropped.count() <= DROPPED else dropped
    return signed.select("row_id", "row").join(gone, "row_id", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
