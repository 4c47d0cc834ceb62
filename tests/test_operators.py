import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.operators import code as CO
from parchmint.operators import dataset as D
from parchmint.operators import metrics as E
from parchmint.operators import segmentation as S
from parchmint.operators import splitters as P
from parchmint.operators.keywords import keyword_summary, keywords


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_paragraphs(spark):
    text = "Head\n\n  First one.\n \nсекция:\n\n1. item is here."
    rows = P.split_paragraphs(docs(spark, text, "")).orderBy("chunk_no").collect()
    assert [r.text for r in rows] == ["Head", "First one.", "секция:", "1. item is here."]
    assert all(text[r.start_pos : r.end_pos] == r.text for r in rows)
    assert [r.is_header for r in rows] == [True, False, True, True]
    assert rows[0].chunk_id.startswith("chunk_000000_") and len(rows[0].chunk_id) == 21


def test_semantic_split_matches_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(12)]
    texts = ["\n".join(" ".join(rng.choice(words, 6)) for _ in range(rng.integers(1, 12))) for _ in range(20)]
    config = P.SplitterConfig(paragraph_separator="\n", semantic_threshold=0.6, max_chunk_size=150)

    def plain(text):
        out, cur = [], ""
        for p in [x.strip() for x in text.split("\n") if x.strip()]:
            a, b = set(cur.split()), set(p.split())
            if cur and (not (a and b and len(a & b) / min(len(a), len(b)) >= 0.6) or len(cur) + 2 + len(p) > 150):
                out.append(cur)
                cur = p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
        return out + [cur] * bool(cur)

    got: dict = {}
    for r in P.split_semantic(docs(spark, *texts), config).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert [got[i] for i in range(20)] == list(map(plain, texts))
    mixed: dict = {}
    for r in P.split_mixed(docs(spark, *texts), P.SplitterConfig(paragraph_separator="\n", semantic_threshold=0.6, max_chunk_size=150)).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert set(mixed) == set(range(20))


def test_fixed_size(spark):
    text = "a" * 120 + ". " + "b" * 60 + "! " + "c" * 30
    config = P.SplitterConfig(min_chunk_size=50, max_chunk_size=100)
    rows = P.split_fixed(docs(spark, text), config).orderBy("chunk_no").collect()
    assert [(r.start_pos, r.end_pos) for r in rows] == [(0, 121), (121, 214)]
    assert rows[0].text == "a" * 120 + "." and all(len(r.text) >= 50 for r in rows)
    kept = P.split_fixed(docs(spark, "x" * 130), P.SplitterConfig(min_chunk_size=50, max_chunk_size=100, keep_tail=True)).count()
    assert kept == 2 and P.split_fixed(docs(spark, "x" * 130), config).count() == 1 and P.split_fixed(docs(spark, ""), config).count() == 0


def test_unknown_splitter(spark):
    with pytest.raises(ValueError):
        P.split_text(docs(spark, "a"), "none")


def test_embedding_split_of_short_texts(spark):
    encoder = lambda s: F.array(F.length(s).cast("float"), F.lit(1.0).cast("float"))
    rows = P.split_embedding(docs(spark, "", "One only", "First. Second one is longer."), encoder=encoder).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, ""), (1, "One only"), (2, "First."), (2, "Second one is longer.")]
    with pytest.raises(ValueError):
        P.split_embedding(docs(spark, "a"))


def vectors(spark, *groups):
    rows = [(d, i, [float(x) for x in v]) for d, g in enumerate(groups) for i, v in enumerate(g)]
    return spark.createDataFrame(rows, "doc_id long, pos int, embedding array<float>")


def test_gap_cut_matches_merging_the_nearest_neighbours(spark):
    """The k clusters of repeated merging of the nearest neighbours are the pieces between the k - 1 widest gaps."""
    rng = np.random.default_rng(3)
    groups = [rng.normal(size=(n, 4)) for n in (1, 2, 9, 30)]
    got: dict = {}
    for r in S.gap_cut(vectors(spark, *groups), k=4).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.segment)
    for d, g in enumerate(groups):
        g = g.astype(np.float32).astype(float)
        gaps = [1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(g, g[1:])]
        cuts = sorted(sorted(range(len(gaps)), key=lambda i: (-gaps[i], i))[: min(4, len(g)) - 1])
        assert got[d] == [sum(c < i for c in cuts) for i in range(len(g))]


def test_zero_vectors_and_greedy(spark):
    rows = S.greedy(vectors(spark, [[1, 0], [1, 0.1], [0, 0], [0, 1], [0, 1]]), 0.5).orderBy("pos").collect()
    assert [r.segment for r in rows] == [0, 0, 1, 2, 2]


def plain_scores(t, p, n):
    k = max(1, n // 20)
    win = [(sum(t[i : i + k]), sum(p[i : i + k])) for i in range(n - k)]
    pk = sum((a > 0) != (b > 0) for a, b in win) / len(win) if win else 0
    wd = sum(abs(a - b) for a, b in win) / len(win) if win else 0
    tp, free = [i for i, x in enumerate(t) if x], [i for i, x in enumerate(p) if x]
    if not tp and not free:
        return pk, wd, 1.0
    total, hits = len(tp) + len(free), 0
    for a in tp:
        near = next((b for b in free if abs(a - b) <= 1), None)
        if near is not None:
            hits += 1
            free.remove(near)
    return pk, wd, 2 * hits / total


def test_metrics_match_plain_loops(spark):
    rng = np.random.default_rng(4)
    cases, rows = [], []
    for d, n in enumerate([1, 2, 5, 19, 40, 63, 63]):
        t, p = (rng.random(n - 1) < 0.3).astype(int).tolist(), (rng.random(n - 1) < 0.3).astype(int).tolist()
        if d == 6:
            t = p = [0] * (n - 1)
        cases.append(plain_scores(t, p, n))
        rows += [(d, i, sum(t[:i]), sum(p[:i])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, true_segment int, pred_segment int")
    for r in E.scores(E.boundaries(df)).orderBy("doc_id").collect():
        assert (r.pk, r.windowdiff, r.boundary_f1) == pytest.approx(cases[r.doc_id])


def test_intra_similarity_matches_pairs(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(9, 3))
    df = vectors(spark, g, [[1, 0, 0]]).withColumn("pred_segment", F.floor(F.col("pos") / 4).cast("int"))
    u = g.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = [np.mean([u[i] @ u[j] for i in range(a, b) for j in range(i + 1, b)]) for a, b in ((0, 4), (4, 8))]
    got = {r.doc_id: r.intra for r in E.intra_similarity(df).collect()}
    assert got == pytest.approx({0: np.mean(sims), 1: 0.0})


def test_keywords(spark):
    text = "beta alpha beta the the the gamma alpha it"
    rows = keywords(docs(spark, text, "the and", ""), 2).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.term, r.frequency) for r in rows] == [(0, "beta", 2), (0, "alpha", 2), (1, "the", 1), (1, "and", 1)]
    empty = {r.doc_id: r for r in keyword_summary(docs(spark, text, "the and", "")).collect()}[2]
    assert empty.key_terms == [] and empty.term_frequencies == {}


CODE = "Some prose here.\n```python\nx = 1\n```\nMore prose here.\n~~~\ny = 2;\n~~~\nEnd of it.\ndef f(x):\n\n    return x\nThe end."


def test_code_blocks(spark):
    rows = CO.extract_code(docs(spark, CODE, "", "Only prose.")).orderBy("start_pos").collect()
    assert [(r.kind, r.language, r.code) for r in rows if r.kind == "fenced"] == [("fenced", "python", "x = 1"), ("fenced", "unknown", "y = 2;")]
    assert [r.code for r in rows if r.kind == "heuristic"][-1] == "def f(x):\n\n    return x"
    assert all(r.kind == "fenced" or CODE[r.start_pos : r.end_pos] == r.code for r in rows)


def test_a_code_block_inside_an_earlier_one_goes(spark):
    short = "    return y"
    text = f"def f(y):\n{short}\n    x = compute(1);\nThis is only prose about the thing.\n{short}\nMore prose about the thing."
    assert CO.heuristic_blocks(docs(spark, text)).count() == 2
    rows = CO.extract_code(docs(spark, text)).collect()
    assert len(rows) == 1 and text[rows[0].start_pos : rows[0].end_pos] == rows[0].code and rows[0].code.startswith("def f")


def test_boundary_model(spark):
    rng = np.random.default_rng(6)
    groups = [np.repeat(rng.normal(size=(4, 3)), 3, axis=0) + rng.normal(size=(12, 3)) * 0.01 for _ in range(30)]
    rows = vectors(spark, *groups).withColumn("label", (F.col("pos") % 3 == 0).cast("int"))
    pairs = S.pair_features(rows)
    assert pairs.first().features.__len__() == 10
    told = S.predict_boundaries(S.fit_boundaries(pairs, grid=(1.0,), max_iter=20), pairs)
    assert told.count() == 330


def test_boundary_model_tells_every_pair(spark, tmp_path):
    from parchmint.plans.queries import boundary_model

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(25 * 20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    told = boundary_model(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.pair_index) for r in told} == {(d, p) for d in range(20) for p in range(24)} and len(told) == 480
    assert len({r.doc_id for r in told if r.is_test}) == 6 and len({(r.doc_id, r.is_test) for r in told}) == 20


def test_preparation_repeats_itself(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert D.sample_documents(ids, 50).count() == 50
    split = D.train_test_split(ids)
    assert split.where("is_test").count() == 300
    again = D.train_test_split(ids.repartition(7)).where("is_test")
    assert {r.doc_id for r in split.where("is_test").collect()} == {r.doc_id for r in again.collect()}
    numbers = D.renumber(ids.where("doc_id % 3 = 0")).collect()
    assert {r.doc_id: r.number for r in numbers} == {i: i // 3 for i in range(0, 1000, 3)}
    assert {r.fold for r in D.folds(ids).collect()} == set(range(5))


def test_bootstrap_and_summaries(spark):
    df = spark.createDataFrame([(i, float(i % 10), "m") for i in range(200)], "doc_id long, v double, method string")
    r = E.bootstrap_ci(df, "v", 300).first()
    assert r.low < r.mean < r.high and math.isclose(r.mean, 4.5) and r.high - r.low < 1.2
    s = E.summary(df, ["v"]).first()
    assert s.v_text.startswith("4.500 ± 2.8")
    cv = D.cross_validated(D.folds(df), ["v"], ["method"]).first()
    assert cv.v_std >= 0
    assert json.loads(df.limit(1).toJSON().first())["method"] == "m"


def brute_scores(labels, chunks, vectors):
    """pk, windowdiff, similarity within chunks and F1 of one document, chunk by chunk."""
    n = len(labels)
    true = {i - 1 for i in range(1, n) if labels[i] == 1}
    pred = {max(c) for c in chunks if c and max(c) < n - 1}
    k = max(1, n // 20)
    starts = range(n - k)
    count = lambda s, i: sum(x in s for x in range(i, i + k))
    pk = sum((count(true, i) > 0) != (count(pred, i) > 0) for i in starts) / (n - k) if n > k else 0.0
    wd = sum(abs(count(true, i) - count(pred, i)) for i in starts) / (n - k) if n > k else 0.0
    free, hits = sorted(pred), 0
    for t in sorted(true):
        near = next((p for p in free if abs(p - t) <= 1), None)
        if near is not None:
            free.remove(near)
            hits += 1
    f1 = 1.0 if not true and not pred else 2 * hits / (len(true) + len(pred)) if hits else 0.0
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    sims = [np.mean([cos(vectors[i], vectors[j]) for x, i in enumerate(c) for j in c[x + 1 :]]) for c in chunks if len(c) > 1]
    return pk, wd, float(np.mean(sims)) if sims else 0.0, f1


def test_benchmark_run_against_brute_force(spark):
    from parchmint.plans.benchmark import METHODS, METRICS, benchmark, splitter_chunks
    from parchmint.operators.splitters import SplitterConfig

    rng = np.random.default_rng(6)
    rows = []
    for d, n in enumerate((1, 2, 9, 45)):
        for i in range(n):
            words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 6))
            rows.append((d, i, f"Sentence {words}.", int(i == 0 or rng.random() < 0.3), rng.random(4).tolist(), rng.random(3).tolist()))
    schema = "doc_id long, pos int, sentence string, label int, minilm array<float>, rubert array<float>"
    df = spark.createDataFrame(rows, schema)
    config = SplitterConfig(min_chunk_size=60, max_chunk_size=120, target_chunks_alpha=4)
    got = {r.doc_id: r for r in benchmark(df, df, config, max_iter=20).collect()}
    assert set(got) == {0, 1, 2, 3} and len(got[0]) == 2 + len(METHODS) * len(METRICS)
    assert [got[0][f"sup_{m}"] for m in METRICS] == [0.0] * 4
    splits = {name: c.collect() for name, c in splitter_chunks(df, config).items()}
    for d, n in enumerate((1, 2, 9, 45)):
        mine = [r for r in rows if r[0] == d]
        labels, vectors, other = [r[3] for r in mine], np.array([r[4] for r in mine], np.float32).astype(float), np.array([r[5] for r in mine], np.float32).astype(float)
        gaps = lambda v: [1 - v[i] @ v[i + 1] / np.linalg.norm(v[i]) / np.linalg.norm(v[i + 1]) for i in range(n - 1)]

        def cut(after):
            edges = [0, *(i + 1 for i in sorted(after)), n]
            return [list(range(a, b)) for a, b in zip(edges, edges[1:])]

        k = 1 + sum(labels[1:])
        widest = lambda v: sorted(range(n - 1), key=lambda i: (-gaps(v)[i], i))[: k - 1]
        want = {"gr": (cut([i for i, g in enumerate(gaps(vectors)) if 1 - g < 0.5]), vectors), "hier_oracle_minilm": (cut(widest(vectors)), vectors), "hier_oracle_rubert": (cut(widest(other)), other)}
        assert any(not any(r.doc_id == 0 for r in found) for found in splits.values())  # a document without chunks
        for name, found in splits.items():
            by: dict = {}
            for r in found:
                if r.doc_id == d:
                    by.setdefault(r.chunk_no, []).append(r.pos)
            want[name] = ([sorted(c) for c in by.values()], vectors)
        for name, (chunks, v) in want.items():
            assert [got[d][f"{name}_{m}"] for m in METRICS] == pytest.approx(brute_scores(labels, chunks, v), abs=1e-6), (d, name)
