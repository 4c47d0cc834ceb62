import hashlib
from collections import Counter

import numpy as np
import pytest

from parchmint.llm import common, jaccard, suffix
from parchmint.llm.components import connected_components


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        hit = np.cumsum(hit)[: len(r)] > 0
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((len(r), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("runs_per_shard", [2000, 3])
def test_suffix_dedup_matches_brute_force(monkeypatch, docs, rows, runs_per_shard):
    monkeypatch.setattr(suffix, "SHARD_RUNS", runs_per_shard)  # 3: hashes are spread over shards and merged
    got = sorted(map(tuple, suffix.deduplicate(docs).collect()), key=repr)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200))), key=repr)
    assert got == want


def test_suffix_dedup_by_shuffles(monkeypatch, docs, rows):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix.deduplicate(docs).collect())
    assert got == sorted((r[0] or -1, b[1]) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200)))


def test_runs_of_equal_names_and_different_bytes_get_other_names(spark, docs):
    def weak(x, seed):
        return hashlib.blake2b(x if seed > 1 else x[:1], digest_size=16).digest()

    rows = suffix._keyed(docs, "doc_id", "text")
    held = spark.sparkContext.broadcast(suffix.flags(suffix._hashes(rows, 200)))
    pieces, name = suffix._pieces(rows, held, 200, weak)
    assert name.keywords == {"seed": 2}
    good, first = suffix._pieces(rows, held, 200)
    assert first.keywords == {"seed": 0} and sorted(r.n for r in pieces.collect()) == sorted(r.n for r in good.collect())


def test_suffix_dedup_of_nothing(empty):
    assert suffix.deduplicate(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    pieces = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (1, 7, 30, 64, 64, 200)] + [b"aaaaaaaaaaaaaaaaaaaa", b"ab\0\0\0c", b"ab"]
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    lengths = np.array(list(map(len, pieces)))
    starts = np.cumsum(lengths + 1) - lengths - 1
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    rem = starts[piece] + lengths[piece] - np.arange(len(text))
    sa, rank = suffix.suffix_array(text, rem, piece)
    keys = [([b + 1 for b in text[i : i + rem[i]]] + [0, int(piece[i])]) for i in range(len(text))]
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: keys[i])
    assert (rank[sa] == np.arange(len(text))).all()
    lcp = suffix.common_prefixes(text, sa, rank, starts, lengths, rem)
    for r in range(1, len(sa)):
        if rem[sa[r]]:
            a, b = keys[sa[r - 1]][:-2], keys[sa[r]][:-2]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[r] == same


def brute_groups(rows, words, num, den):
    sets = []
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    linked = [sum(bool(a and b) and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    return [(r[0], len(s), least.get(find(i)), n) for i, (r, s, n) in enumerate(zip(rows, sets, linked))]


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 4, 5)])
def test_jaccard_groups_match_brute_force(docs, rows, words, num, den):
    got = sorted(map(tuple, jaccard.groups(docs, jaccard.Similarity(words, num, den), with_links=True).collect()), key=repr)
    assert got == sorted(brute_groups(rows, words, num, den), key=repr)


def test_jaccard_in_blocks_and_by_shuffles(monkeypatch, docs, rows):
    for name, value in (("BLOCK", 2), ("OUTSIDERS", 2), ("BROADCAST_BYTES", 0), ("NEAREST_FIRST", -1), ("LINK_CLASSES", 3), ("DENSE", 2)):
        monkeypatch.setattr(jaccard, name, value)
    got = sorted(map(tuple, jaccard.groups(docs, jaccard.Similarity(3, 90, 100), with_links=True).collect()), key=repr)
    assert got == sorted(brute_groups(rows, 3, 90, 100), key=repr)


def test_jaccard_of_nothing(empty):
    assert jaccard.groups(empty, jaccard.Similarity()).count() == 0


def test_keep_first_keeps_one_of_each_group(docs, rows):
    kept = jaccard.keep_first(docs, jaccard.Similarity())
    assert kept.columns == docs.columns
    want = sorted({c for i, _, c, _ in brute_groups(rows, 5, 4, 5) if i is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_components_of_a_long_chain(spark):
    from pyspark.sql import functions as F

    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(chain)
    assert got.count() == 100_001 and got.where("component <> 0").isEmpty()


def test_rows_of_an_id_are_judged_text_by_text(spark, rows):
    base, other = rows[0][1], "something else entirely that nothing resembles here at all"
    table = [(0, base), (5, base), (5, other), (5, other), (7, None), (7, ""), (None, base), (8, base + " end"), (8, "short one")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in table], "doc_id long, text string, gone_id string, gone_key string, whole_row string")
    kept = jaccard.keep_first(df, jaccard.Similarity())
    assert kept.columns == df.columns
    assert sorted((repr(r.doc_id), repr(r.text)) for r in kept.collect()) == sorted((repr(i), repr(t)) for i, t in [(0, base), (5, other), (7, None), (7, ""), (None, base), (8, "short one")])


def test_common_shingles_are_counted_alike_by_products_and_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[:25]] for a in sets]
    for dense in (0, 100, 1 << 30):
        monkeypatch.setattr(jaccard, "DENSE", dense)
        assert jaccard.intersections(sets, sets[:25]).tolist() == want
    assert jaccard.intersections(sets[:1], [np.array([99], np.uint64)]).tolist() == [[0]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 200)] + [(300, 300), (401, 400), (400, 401)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 200)} | {400: 400, 401: 400}
