"""The registered queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media, nndescent, packing, pii, probminhash, secrets, token_counts, token_output, toxicity


#: For the queries over synthetic tables; a corpus has a key of its own.
KEY = "palimpsest"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media(table(spark, sf_dir, "documents"))
    payload = F.col("payload")
    n = F.length(payload).cast("long")
    return m.select(
        "doc_id",
        "n_bytes",
        n.alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("wav").cast("long").alias("media_bytes"),
        F.sha2("wav", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fp_code"), F.hex(F.xxhash64("fp_time", "fp_code"))).alias("feature"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = pii.pseudonymize(docs, KEY, found_col="pseudonyms", seen_col="seen")
    changed = F.size(F.filter(F.zip_with("seen", "pseudonyms", lambda a, b: a != b), lambda x: x))
    return p.select("doc_id", "text", changed.cast("long").alias("n_pseudonyms"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


def op5_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = nndescent.Index(table(spark, sf_dir, "embeddings"))
    return index.search(F.col("vec_id") % 20 == 0, k=20).select("query_id", "rank", "vec_id", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_output.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    return s.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(as_text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_media": op2_media,
    "op3_pii": op3_pii,
    "op4_probminhash": op4_probminhash,
    "op5_nndescent": op5_nndescent,
    "op6_token_counts": op6_token_counts,
    "op7_token_output": op7_token_output,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
}

#: None of these is expressible in SQL; tests/llm holds each against a brute-force version.
ORACLES: dict[str, str] = {}
