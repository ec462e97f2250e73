"""Quality measures: round-trip census, page parity, output lint, word alignment."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divergence(a: Column, b: Column) -> Column:
    """Place of the first byte in which two strings differ, from 0; null if they are equal. The common prefix grows by
    halved steps, so every byte is compared once or twice."""

    def place(s: Column) -> Column:
        n = F.least(F.length(s["a"]), F.length(s["b"]))
        steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
        grown = lambda at, step: (at + step <= n) & (s["a"].substr(at + 1, step) == s["b"].substr(at + 1, step))
        prefix = F.aggregate(steps, F.lit(0), lambda at, step: F.when(grown(at, step), at + step).otherwise(at))
        return F.when(s["a"] != s["b"], prefix)

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), place)[0]


def roundtrip_census(pairs: DataFrame) -> DataFrame:
    """``class, n`` for ``doc_id, content, output``: equal, longer, shorter or changed."""
    kind = F.when(F.col("output").isNull(), "refused").when(F.col("content") == F.col("output"), "equal").when(F.length("content") < F.length("output"), "longer").when(F.length("content") > F.length("output"), "shorter").otherwise("changed")
    return pairs.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """``doc_id, pos, left, right, same`` of two line streams ``doc_id, pos, line``, unmatched positions included."""
    a = left.select("doc_id", "pos", F.col("line").alias("left"))
    b = right.select("doc_id", "pos", F.col("line").alias("right"))
    return a.join(b, ["doc_id", "pos"], "full_outer").withColumn("same", F.col("left").eqNullSafe(F.col("right")))


def lint(output: DataFrame) -> DataFrame:
    """``doc_id, rule`` for each rule that an HTML output breaks."""
    s = F.col("output")
    rules = {
        "adjacent_equal_tags": s.rlike(r"</(b|i|u)><\1>"),
        "empty_paragraph": s.rlike(r"<p>\s*</p>"),
        "unbalanced_paragraphs": F.regexp_count(s, F.lit("<p>")) != F.regexp_count(s, F.lit("</p>")),
        "control_character": s.rlike(r"[\x00-\x08\x0b\x0e-\x1f]"),
        "note_without_target": F.size(F.array_except(F.regexp_extract_all(s, F.lit('href="#([a-z]{2}-[^"]*)"'), F.lit(1)), F.regexp_extract_all(s, F.lit('<li id="([^"]*)"'), F.lit(1)))) > 0,
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    return output.where("output is not null").select("doc_id", F.explode(broken).alias("rule"))


def align_words(pairs: DataFrame) -> DataFrame:
    """``doc_id, n_matched, n_left, n_right, dx, dy, residual`` for two arrays of (word, x, y): words aligned in order,
    the frame's offset as the median of their distances, and the median of what is left."""
    names = ["doc_id", "n_matched", "n_left", "n_right", "dx", "dy", "residual"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, a, b in zip(batch["doc_id"], batch["left"], batch["right"], strict=True):
                m = difflib.SequenceMatcher(None, [w["word"] for w in a], [w["word"] for w in b], autojunk=False)
                d = np.array([(b[j + k]["x"] - a[g + k]["x"], b[j + k]["y"] - a[g + k]["y"]) for g, j, n in m.get_matching_blocks() for k in range(n)]).reshape(-1, 2)
                middle = np.median(d, axis=0) if len(d) else np.array([np.nan, np.nan])
                out.append((i, len(d), len(a) - len(d), len(b) - len(d), *middle, np.median(np.abs(d - middle).max(axis=1)) if len(d) else np.nan))
            yield pd.DataFrame(out, columns=names)

    return pairs.select("doc_id", "left", "right").mapInPandas(run, "doc_id long, n_matched int, n_left int, n_right int, dx double, dy double, residual double")
