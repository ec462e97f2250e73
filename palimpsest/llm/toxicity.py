"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Fitting: labelled documents are hashed into presence of character n-grams; for each hashed n-gram the
distributed counts by class give a log-count ratio r. The n-grams with the strongest evidence become the
vocabulary; a logistic regression over presence times r gives the weights. Scoring is one pass without a
shuffle. Presence, not frequency, keeps very long texts comparable to short ones.

Bounds, documented parameters: at most ``sample`` labelled documents are fitted on (the first ones by a hash
of their id), and the vocabulary has at most ``vocabulary`` n-grams. Everything else covers all rows.

Defined results: a null text counts as empty and gets the score of the intercept; a null id stays null and is
not held out; labels that are null or whose id matches no document are ignored; an id labelled twice takes the
larger label; without labels of both classes every score is the prior; repeated rows are scored each, and count each in the fit if they
are labelled; an empty table gives an empty one; a text of any length is taken whole; further columns are dropped.

The vocabulary of n-grams is a parameter of the fit: all 2^20 hashed n-grams are the exact way, at a dense weight vector of
8 MB and a Newton step that grows with the square of the n-grams that occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Rows, id_and_text, spool

#: Lengths of the n-grams, bits of their hash.
LENGTHS, BITS = (4, 5, 6), 20
SAMPLE, VOCABULARY = 20_000, 4_096
FOLDS = 5
_MULTIPLIER = np.uint32(0x9E3779B1)


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by FOLDS."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def hashed(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each length, the hash of the n-gram that begins at each character (fewer at the end)."""
    x = codes.astype(np.uint32)
    with np.errstate(over="ignore"):
        h = x * _MULTIPLIER
        for n in range(2, max(LENGTHS) + 1):
            if len(x) < n:
                return
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[n - 1 :] * _MULTIPLIER
            if n in LENGTHS:
                yield ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)


def characters(text: str) -> np.ndarray:
    """Code points of the text in lower case, with a space before and after."""
    return np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def features(text: str, chosen: np.ndarray) -> np.ndarray:
    """Distinct entries of the vocabulary in the text; chosen: entry by hash, or -1."""
    codes = characters(text)
    found = [f[f >= 0] for f in (chosen[h] for h in hashed(codes))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, chosen.dtype)


@dataclass
class Model:
    chosen: np.ndarray  #: entry of the vocabulary by hash, -1 for none
    weights: np.ndarray  #: by entry, the log-count ratio already multiplied in
    intercept: float

    def score(self, text: str) -> float:
        f = features(text, self.chosen)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[f].sum(), -30, 30))))


class Presence:
    """Documents of each class that hold each hashed n-gram, summed over the partition."""

    schema = pa.schema([("h", pa.int32()), ("label", pa.int32()), ("n", pa.int64())])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                for h in hashed(characters(text.as_py())):
                    counts[label, np.unique(h)] += 1
        for label in (0, 1):
            (at,) = counts[label].nonzero()
            for a in range(0, len(at), 65_536):
                k = at[a : a + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(np.full(len(k), label, np.int32)), pa.array(counts[label, k])], schema=self.schema)


class Entries:
    """Vocabulary entries of each labelled document."""

    schema = pa.schema([("label", pa.int32()), ("entries", pa.list_(pa.int32()))])

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(self.schema)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                f = features(text.as_py(), self.chosen).tolist()
                yield from rows.add((label, f), 16 + 4 * len(f))
        yield from rows.flush()


class Score:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [self.model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], schema=self.schema)


def logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights over presence times ratio, and the intercept: Newton's method, each step solved by conjugate
    gradients. The classes weigh alike, so that 0.5 is the threshold between them and not between their sizes."""
    n, k = len(rows), len(ratio)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    entry = np.concatenate(rows)
    value = ratio[entry]
    mass = np.where(y > 0, (n / 2) / max(y.sum(), 1), (n / 2) / max(n - y.sum(), 1))
    penalty = np.append(np.full(k, l2), 1e-6)

    def forward(w: np.ndarray) -> np.ndarray:
        return w[k] + np.bincount(owner, w[entry] * value, n)

    def back(x: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(entry, x[owner] * value, k), x.sum())

    def loss(w: np.ndarray) -> float:
        z = forward(w)
        return float((mass * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w**2).sum() / 2)

    w = np.zeros(k + 1)
    held = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        grad = back(mass * (p - y)) + penalty * w
        curve = mass * p * (1 - p)
        step, rest = np.zeros(k + 1), -grad
        along, size = rest, float(rest @ rest)
        first = size
        for _ in range(40):
            ahead = back(curve * forward(along)) + penalty * along
            far = size / float(along @ ahead)
            step, rest = step + far * along, rest - far * ahead
            size, before = float(rest @ rest), size
            if size <= 1e-4 * first:
                break
            along = rest + size / before * along
        scale = 1.0
        while (now := loss(w + scale * step)) > held and scale > 1e-3:
            scale /= 2
        if now > held - 1e-6 * abs(held):
            break
        w, held = w + scale * step, now
    return w[:k] * ratio, float(w[k])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, vocabulary: int = VOCABULARY, seed: int = 7) -> Model:
    """Fits on labelled documents that :func:`held_out` leaves to it. At most ``sample`` rows of ``labels`` are
    taken, so the broadcast below is bounded by that parameter; so is what reaches the driver."""
    by_id = labels.where(labels[label_col].isin(0, 1) & ~held_out(labels[id_col]) & labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("doc_id")).agg(F.max(labels[label_col].cast("int")).alias("label"))
    taken = by_id.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    train = spool(id_and_text(docs, id_col, text_col).join(F.broadcast(taken), "doc_id").select("text", "label"), "toxicity")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = np.full(1 << BITS, -1, dtype=np.int32)
    if len(sizes) < 2:
        prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(chosen, np.zeros(1), float(np.log(prior / (1 - prior))))
    n = train.mapInArrow(Presence(), "h int, label int, n long").groupBy("h").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    p, q = (F.col("p") + 1) / (sizes[1] + 2), (F.col("q") + 1) / (sizes[0] + 2)
    ratio = F.log(p / q)
    evidence = F.abs(ratio) * F.sqrt(F.col("p") + F.col("q"))  # a strong ratio that enough documents bear out
    top = n.select("h", ratio.alias("r"), evidence.alias("e")).orderBy(F.desc("e"), "h").limit(vocabulary).collect()
    ratios = np.array([r["r"] for r in top])
    chosen[[r["h"] for r in top]] = np.arange(len(top), dtype=np.int32)
    rows = train.mapInArrow(Entries(chosen), "label int, entries array<int>").toArrow()
    held = [np.asarray(x, dtype=np.int64) for x in rows.column("entries").to_pylist()]
    weights, intercept = logistic(held, np.asarray(rows.column("label"), dtype=np.float64), ratios)
    return Model(chosen, weights, intercept)


def scorer(model: Model) -> Callable[[Column | str], Column]:
    """The score of a text column, as a column; a null text is the empty one."""

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in text], dtype="float64")

    return of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one pass over whole texts, no shuffle."""
    return id_and_text(docs, id_col, text_col).mapInArrow(Score(model), "doc_id long, score double")
