"""Byte-level BPE, token counts, token output and packing against the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm import bpe, packing, token_counts, token_output, vocab

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
WORDS = P.path("word_bpe_49k.json")
ALPHABET = "abcdetshlrv'  \n12é€ßÉΣİ!.,-日🙂́<|>\x00\x85"


def noise(n, length, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(length))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (16, 8), (64, 16)])
def test_stitching_equals_one_scan(chunk, overlap):
    scan = regex.compile(P.PATTERN).findall
    for text in [*noise(200, 300), "x" * 100, " " * 90 + "a", "", "a" * 30 + " " + "b" * 50]:
        assert [t for run in bpe.stitched(text, scan, chunk, overlap) for t in run] == scan(text)


def test_encode_and_decode(spark, edge, edge_texts, nothing):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(vocab.read(RANKS)), special_tokens={})
    rows = bpe.decode(bpe.encode(edge, RANKS, P.PATTERN, chunk=64, overlap=8), RANKS).collect()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows)
    want = Counter((i, len(x), np.array(x, "<u4").tobytes(), t.encode()) for i, t in edge_texts for x in [encoding.encode_ordinary(t)])
    assert got == want
    assert bpe.decode(bpe.encode(nothing, RANKS, P.PATTERN), RANKS).count() == 0


def test_vocabulary_encoder_equals_the_library(library):
    encode = vocab.text_encoder(vocab.read(JSON))
    for text in [*noise(300, 200), "a<|endoftext|>b", "<|endoftext|>" * 3, ""]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(spark, edge, edge_texts, nothing):
    whole = Tokenizer.from_file(WORDS)
    texts = [*noise(600, 300, 2), "x" * 3000, "ΣΑΣ ΟΔΟΣ", "don't DON'T 'll'", "<|endoftext|>hi<|startoftext|>", "   ", ""]
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(vocab.read(WORDS)).count(texts).tolist() == want
    got = Counter(map(tuple, token_counts.count_tokens(edge, WORDS).collect()))
    assert got == Counter((i, len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids)) for i, t in edge_texts)
    assert token_counts.count_tokens(nothing, WORDS).count() == 0


def test_chunk_maps_compose():
    """Lanes of any width count alike: what a lane does depends on its entry state only up to a piece's end."""
    texts = noise(50, 500, 3) + ["y" * 900]
    c = token_counts.Counter(vocab.read(WORDS))
    want = c.count(texts).tolist()
    old = token_counts.LANE
    try:
        for token_counts.LANE in (3, 17):
            assert c.count(texts).tolist() == want
    finally:
        token_counts.LANE = old


def test_variable_length_code():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert token_output.unpack(token_output.pack(v), n).tolist() == v.tolist()


def test_token_files(spark, edge, edge_texts, nothing, library):
    files = token_output.write_tokens(edge, JSON, end_id=0, segment=50)
    got = token_output.read_tokens(spark, files).orderBy("start").collect()
    ids = {t: [*library.encode(t, add_special_tokens=False).ids, 0] for _, t in edge_texts}
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, np.array(ids[t], "<u4").tobytes()) for i, t in edge_texts)
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        assert (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    assert token_output.read_tokens(spark, token_output.write_tokens(nothing, JSON)).count() == 0


def test_documents_are_counted_together(monkeypatch):
    """op7: ids are counted once for many documents, and take two bytes each between the passes."""
    calls, count = 0, np.bincount

    def counted(*args, **more):
        nonlocal calls
        calls += 1
        return count(*args, **more)

    texts = [f"text {k} of many" for k in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": texts})
    monkeypatch.setattr(np, "bincount", counted)
    rows = [r for b in token_output.Encode(vocab.read(JSON), 0)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.undo()
    assert calls == 1
    encode = vocab.text_encoder(vocab.read(JSON))
    want = [[*np.frombuffer(encode(t), "<u4").tolist(), 0] for t in texts]
    assert [token_output.restored(r["ids"]).tolist() for r in rows[:-1]] == want
    assert sum(len(r["ids"]) for r in rows[:-1]) == sum(1 + 2 * len(x) for x in want)
    assert np.frombuffer(rows[-1]["ids"], np.int64).tolist() == count(np.concatenate(want)).tolist()


@pytest.mark.parametrize("limit", [1, 7, 1 << 18])
def test_counts_and_wide_ids(monkeypatch, limit):
    """Ids that need more than two bytes, and counts that are summed after any number of ids, give the same files."""
    wide = {"": [], "a": [65_535], "b": [65_536, 1], "c": [70_000, 0, 70_000], "d": [5] * 20}
    monkeypatch.setattr(token_output, "text_encoder", lambda data: lambda text: np.array(wide[text], "<u4").tobytes())
    monkeypatch.setattr(token_output, "SEGMENT", limit)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": list(wide)})
    rows = [r for b in token_output.Encode(b"", 0)(iter([batch])) for r in b.to_pylist()]
    want = [[*x, 0] for x in wide.values()]
    assert [token_output.restored(r["ids"]).tolist() for r in rows[:-1]] == want
    assert np.frombuffer(rows[-1]["ids"], np.int64).tolist() == np.bincount(np.concatenate(want)).tolist()


def check_plan(histogram, capacity=1024):
    p = packing.plan(histogram, capacity)
    held = {}
    for length, n in histogram.items():
        sequence, offset = p.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            held.setdefault(s, []).append((o, length))
    assert set(held) == set(range(p.n_sequences))
    for places in held.values():
        at = 0
        for o, length in sorted(places):
            assert o == at
            at += length
        assert at <= capacity
    return p.n_sequences, -(-sum(k * n for k, n in histogram.items()) // capacity)


@pytest.mark.parametrize("histogram", [{}, {1024: 3}, {1: 5}, {600: 10}, {1023: 2, 1: 1}, {512: 7, 513: 4, 511: 4}, {341: 9, 342: 3}])
def test_plans_fit(histogram):
    check_plan(histogram)


def test_plan_is_near_the_bound():
    r = np.random.default_rng(2)
    lengths, n = np.unique(np.clip(np.exp(r.normal(5.8, 0.9, 5000)), 1, 1023).astype(int), return_counts=True)
    used, bound = check_plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    assert used <= 1.01 * bound
    used, _ = check_plan({k: 3 for k in range(300, 500)})
    assert used <= 300  # two or three to a sequence


def test_packing(spark, edge, edge_texts, nothing, library):
    rows = packing.pack(edge, JSON, end_id=2, capacity=64).collect()
    want = Counter()
    for i, t in edge_texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        cut = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        starts = [0, *range(cut, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(nothing, JSON).count() == 0


def test_registered_queries_match_the_libraries(spark, library):
    from palimpsest.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in QUERIES["op7_token_output"](spark, sf).orderBy("doc_id").collect():
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in QUERIES["op1_byte_bpe"](spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_one_run_of_a_match_is_scanned_in_linear_time():
    scanned = 0
    whole = regex.compile(P.PATTERN).findall

    def scan(text):
        nonlocal scanned
        scanned += len(text)
        return whole(text)

    for text in ("x" * 400_000, "a b" * 1000 + "y" * 300_000 + " end", "\n  " * 50_000):
        scanned = 0
        assert [t for run in bpe.stitched(text, scan, 1_000, 100) for t in run] == whole(text)
        assert scanned < 6 * len(text)


def test_op1_and_op6_by_the_libraries(spark, small):
    from palimpsest.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(vocab.read(RANKS)), special_tokens={})
    for r in QUERIES["op1_byte_bpe"](spark, sf).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    whole = Tokenizer.from_file(WORDS)
    for r in QUERIES["op6_token_counts"](spark, sf).collect():
        n = len(whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_op8_by_the_library(spark, small, library):
    from palimpsest.llm.queries import QUERIES

    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in small.collect()}
    rows = QUERIES["op8_packing"](spark, "/root/testdata/sf0.001").orderBy("doc_id", "piece").collect()
    ends, places = Counter(), {}
    for r in rows:
        assert r["start"] == ends[r["doc_id"]] and 0 < r["length"] <= 1024
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        ends[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert ends == {i: len(x) for i, x in want.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(ends.values()) // 1024)
    assert len(places) <= least + 2


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_vocabulary_encoder_on_every_text(spark, library, sf):
    """The rank encoder that op7 and op8 use gives the library's ids on all texts of the tables."""
    encode = vocab.text_encoder(vocab.read(JSON))
    for (text,) in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect():
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_several_megabytes_of_text(spark):
    """A very long text goes whole through the token operators."""
    text = "some words of a long text, 12 of them. " * 80_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    n = dict(token_counts.count_tokens(df, WORDS).select("doc_id", "n_tokens").collect())
    assert n[1] == len(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids)
    rows = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in rows} == {1: text.encode(), 2: b"short"}
    path = token_output.write_tokens(df, JSON, end_id=0)
    assert {r["doc_id"]: r["n_tokens"] for r in token_output.read_tokens(spark, path).collect()}[2] < 10
