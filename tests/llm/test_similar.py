"""Near-duplicates, nearest neighbours and the pipeline against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import nndescent, probminhash

WORDS = [f"w{k}" for k in range(5000)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, text, n):
    words = text.split()
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


def brute_classes(rows, least=0.8):
    """Least id of each row's class, by comparing all pairs."""
    elements = [probminhash.shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or probminhash.similarity(elements[a], elements[b]) >= least:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, low.get(find(k))) for k, (i, _) in enumerate(rows))


def test_similarity_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (dict(zip(rng.choice(30, 12, replace=False).tolist(), rng.integers(1, 5, 12).tolist(), strict=True)) for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float))
        assert probminhash.similarity(pack(a), pack(b)) == pytest.approx(want)
        assert probminhash.similarity(pack(a), pack(a)) == pytest.approx(1)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    base = text_of(rng, 400)
    for n in (2, 8, 20):
        pairs = [(probminhash.shingles(t), probminhash.shingles(edited(rng, t, n))) for t in (text_of(rng, 400) for _ in range(12))]
        estimate = np.mean([(r[0] == r[1]).mean() for r in (probminhash.registers([a, b]) for a, b in pairs)])
        assert estimate == pytest.approx(np.mean([probminhash.similarity(a, b) for a, b in pairs]), abs=0.04)
    alone, among = probminhash.registers([probminhash.shingles(base)])[0], probminhash.registers([probminhash.shingles(x) for x in ("a b", base, "")])[1]
    assert (alone == among).all()


def planted():
    rng = np.random.default_rng(4)
    texts = [text_of(rng, 200) for _ in range(12)]
    rows = list(enumerate(texts))
    rows += [(100 + k, texts[0]) for k in range(40)]  # copies
    rows += [(200 + k, edited(rng, texts[1], 2)) for k in range(40)]  # near copies of one text, near one another
    chain = texts[2]
    for k in range(6):  # each near the one before only
        chain = edited(rng, chain, 3)
        rows.append((300 + k, chain))
    shared = text_of(rng, 120)
    rows += [(400 + k, shared + " " + text_of(rng, 100)) for k in range(30)]  # a passage in common, no copies
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one two"), (None, texts[3]), (None, "lonely text of no id at all"), (3, texts[3])]
    return rows


def test_classes_by_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    got = probminhash.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(rows)
    assert Counter(r["class_id"] for r in got if r["is_kept"] and r["class_id"] is not None).most_common(1)[0][1] == 1
    kept = probminhash.deduplicate(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["is_kept"] for r in got)


def test_blocks_find_links_that_the_centre_misses(spark):
    """A bucket whose texts link among each other but not to its least member."""
    rng = np.random.default_rng(5)
    base = text_of(rng, 200)
    texts = [edited(rng, base, int(rng.integers(1, 5))) for _ in range(30)]
    signed = [probminhash.registers([probminhash.shingles(t)])[0] for t in texts]
    short = [probminhash.mixed(s).astype(np.uint32) for s in signed]
    first = short[0].copy()
    for s in short:
        s[:6] = first[:6]  # one bucket in band 0
    rows = pa.RecordBatch.from_pydict({"band": [0] * 30, "key": [0] * 30, "i": [1] * 30, "j": [0] * 30, "side": [0 if k % 2 else 2 for k in range(30)], "node": list(range(30)), "label": list(range(30)), "registers": [s.tobytes() for s in short], "text": texts})
    e = [probminhash.shingles(t) for t in texts]
    for maybe in (0, 0.6):
        near = list(probminhash.Candidates(maybe)(iter([rows.slice(0, 11), rows.slice(11)])))
        found = [(r["a"], r["b"]) for x in probminhash.Compare(maybe, 0.8)(iter(near)) for r in x.to_pylist()]
        assert 0 < len(found) < 30
        for a, b in found:
            assert probminhash.similarity(e[a], e[b]) >= 0.8
        # what the links join is what all similar pairs of the two blocks join
        classes = [{k} for k in range(30)]
        wanted = [{k} for k in range(30)]
        for groups, pairs in ((classes, found), (wanted, [(x, y) for x in range(1, 30, 2) for y in range(0, 30, 2) if probminhash.similarity(e[x], e[y]) >= 0.8])):
            for x, y in pairs:
                gx, gy = next(g for g in groups if x in g), next(g for g in groups if y in g)
                if gx is not gy:
                    groups.remove(gy)
                    gx |= gy
        assert sorted(map(sorted, classes)) == sorted(map(sorted, wanted))


def test_divided_buckets_by_brute_force(spark):
    """Chains around many texts: buckets hold several components after the comparison with their least member."""
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):
        base = text_of(rng, 150)
        for k in range(25):
            rows.append((100 * g + k, edited(rng, base, int(rng.integers(2, 8)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = probminhash.near_duplicates(df, maybe=0).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(rows)
    with pytest.raises(ValueError):
        probminhash.near_duplicates(df, least=0.5)


def test_near_copies_are_found(spark):
    """Copies with one edited word in a hundred are classes; the recall is by definition of the similarity."""
    rng = np.random.default_rng(10)
    rows = []
    for k in range(150):
        text = text_of(rng, 200)
        rows += [(2 * k, text), (2 * k + 1, edited(rng, text, 2))]
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[2 * k] == got[2 * k + 1] for k in range(150)]) >= 0.98


def test_near_duplicate_edges(spark, edge, edge_texts, nothing):
    got = probminhash.near_duplicates(edge).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(edge_texts)
    assert probminhash.deduplicate(edge).columns == edge.columns
    assert probminhash.near_duplicates(nothing).count() == 0
    assert probminhash.deduplicate(nothing).count() == 0


def brute_nearest(rows, k, is_query):
    held = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in held:
        if is_query(i):
            scored = sorted((-float((v * w).sum()), j) for j, w in held if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_nearest_with_copies_norms_and_unusable_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.2, 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (None, rows[0][1]), (2100, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {}
    for r in nndescent.Index(df).search(nndescent.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    assert all(len(x) == 20 for x in got.values())
    for q, x in got.items():
        assert x == sorted(x, key=lambda p: (-p[1], p[0]))
        assert q not in {j for j, _ in x}


def test_recall_far_above_the_beam(spark):
    """Vectors without structure, so many that the search sees but a part of them: recall holds with the same effort."""
    x = np.random.default_rng(8).standard_normal((24_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nndescent.Index(df).search(nndescent.F.col("vec_id") % 200 == 0, width=32).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::200] @ x.T
    s[np.arange(len(s)), np.arange(len(s)) * 200] = -np.inf
    want = np.argpartition(-s, 20, axis=1)[:, :20]
    assert len(got) == len(want)
    assert np.mean([len(got[200 * k] & set(w.tolist())) / 20 for k, w in enumerate(want)]) >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in (0, 20, 3)], "vec_id long, embedding array<float>")
    got = nndescent.Index(df).search(nndescent.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    assert nndescent.Index(df.where("false")).search(nndescent.F.col("vec_id") % 20 == 0).count() == 0


def test_exact_search(spark):
    x = np.random.default_rng(11).standard_normal((700, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nndescent.Index(df, shard=300).search(nndescent.F.col("vec_id") % 20 == 0, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        assert found == np.lexsort((np.arange(700), -s))[:20].tolist()


def test_op4_and_op5_by_brute_force(spark):
    from palimpsest.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_probminhash"](spark, sf).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(texts)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20, lambda i: i % 20 == 0)
    found = {}
    for r in QUERIES["op5_nndescent"](spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    assert np.mean([len({j for j, _ in found[q]} & {j for j, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    for q, x in found.items():
        assert x == sorted(x, key=lambda p: (-p[1], p[0])) and len(x) == len(want[q])


def test_pipeline_edges(spark, edge, nothing, tmp_path):
    """Nulls, long texts, repeated rows, clashing columns and an empty table, through all stages."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 0, i % 2) for i in (1, 2, 6, 7, 99)], "doc_id long, quality int, toxic int")
    for name, docs in (("edge", edge), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        held = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, held, f"{tmp_path}/{name}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert made.columns == held.columns
                made.write.parquet(f"{tmp_path}/{name}/stage{k}")
                held = spark.read.parquet(f"{tmp_path}/{name}/stage{k}")
        assert made.select("doc_id", "piece", "start", "length", "sequence_id", "offset").count() == (0 if name == "nothing" else made.count())


def test_pipeline_by_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from palimpsest.llm import pii, toxicity
    from palimpsest.llm.queries import KEY

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(r["text"] or "") < 0.5]
    kept = {c for _, c in brute_classes(clean)}
    texts = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame([x for x in clean if x[0] in kept], "doc_id long, text string"), KEY).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in texts.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).orderBy("doc_id", "piece").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert got == want
