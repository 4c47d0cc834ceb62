"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams of words (a word's ends count as characters) are hashed to
buckets; each bucket has a learned vector, a document is the average of the vectors of all its features, and a softmax
layer gives the label. Vectors and layer are trained by plain stochastic gradient descent in numpy, on a bounded sample
of labelled rows.

A document's logits are linear in the average, so for scoring each bucket's vector is folded with the softmax layer
into one number; a document's score then needs the mean of these numbers over its features, whatever its length. That
table (one float for each bucket) is all that is sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batches, cut, free, held_out, texts, tidied

BITS = 18
GRAMS = (3, 4, 5)
#: Labelled rows to learn from, and bytes of their texts, at most.
SAMPLE = 4000
SAMPLE_BYTES = 16 << 20
#: Bytes of text whose features are taken at a time.
PART_BYTES = 1 << 20
DIM = 8
THRESHOLD = 0.7

_SPACES = np.array([0, 9, 10, 11, 12, 13, 32], dtype=np.uint32)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_DOWN = np.uint64(64 - BITS)


def features(values: list[str | None]):
    """For each kind of feature: the bucket of each, and the document each belongs to (in order)."""
    lengths = np.array([len(v or "") for v in values], dtype=np.int64)
    text = "\0" + "".join((v or "") + "\0" for v in values)  # zeros part documents and stand at both ends
    char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.isin(char, _SPACES)
    doc = np.concatenate(([0], np.repeat(np.arange(len(values)), lengths + 1)))
    code = np.where(space, 1, char).astype(np.uint64)  # all white space is the same end of a word
    gaps = np.concatenate(([0], np.cumsum(space)))  # spaces before a place
    for n in GRAMS:  # from a word's first end to its last: only the outer two characters may be ends
        if len(code) < n:
            continue
        inner = gaps[n - 1 : len(code)] - gaps[1 : len(code) - n + 2]
        at = np.flatnonzero(inner == 0)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h * _K[1]) ^ code[at + k]
            h ^= h >> np.uint64(29)
        yield (h * _K[0]) >> _DOWN, doc[at + 1]
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(begin):
        return
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    # a word's hash: the sum of its characters, each mixed with its place in the word (before the first: any)
    place = np.arange(len(code)) - np.repeat(np.concatenate(([0], begin)), np.diff(np.concatenate(([0], begin, [len(code)]))))
    mixed = (code + np.uint64(7)) * _K[2] * ((place.astype(np.uint64) << np.uint64(1)) + np.uint64(1))
    mixed ^= mixed >> np.uint64(31)
    mixed *= _K[1]
    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
    word = (total[end] - total[begin]) * _K[0]
    owner = doc[begin]
    yield word >> _DOWN, owner
    pair = owner[1:] == owner[:-1]
    # the difference of two hashes: all repetitions of a word share a bucket
    yield (((word[1:] - word[:-1]) * _K[2]) >> _DOWN)[pair], owner[1:][pair]


def counted(values: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and the share of its features that each has."""
    parts = list(features(values))
    bucket = np.concatenate([b for b, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    doc = np.concatenate([d for _, d in parts]) if parts else np.zeros(0, np.int64)
    keys, n = np.unique((doc << BITS) | bucket, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(values) + 1) << BITS)
    return [((keys[a:b] & ((1 << BITS) - 1)).astype(np.int32), (n[a:b] / max(1, n[a:b].sum())).astype(np.float32)) for a, b in zip(cuts[:-1], cuts[1:])]


def backward(mean: np.ndarray, layer: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the cross entropy of one document by the layer and by the document's mean vector."""
    logits = layer @ mean
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1
    return np.outer(p, mean), p @ layer


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 2.0, seed: int = 1) -> np.ndarray:
    """The folded table: what each bucket adds to the log odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), dtype=np.float32)
    samples = [s for s in samples if len(s[0])]
    total, done = max(1, epochs * len(samples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            buckets, share, label = samples[k]
            step = np.float32(rate * (1 - done / total))
            done += 1
            by_layer, back = backward(share @ vectors[buckets], layer, label)
            layer -= step * by_layer
            vectors[buckets] -= (step * share * len(share) ** 0.5)[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32)


def score(table: np.ndarray, values: list[str | None]) -> np.ndarray:
    """The probability of label 1 for each text; 0.5 where there is no feature."""
    total, n = np.zeros(len(values)), np.zeros(len(values))
    for bucket, doc in features(values):
        total += np.bincount(doc, table[bucket.view(np.int64)], len(values))
        n += np.bincount(doc, minlength=len(values))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1), -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The table learned from at most `sample` labelled rows, of `sample_bytes` of text, that are not held out.

    The sample is that with the smallest hashes of their ids; where an id has several labels the largest counts, and
    where it has several texts that with the smallest hash. Only sampled ids (a bounded number) are broadcast; the
    sampled texts are gathered by a shuffle, their features are taken on the executors, and the driver gets shares per
    bucket in one job, whatever the number of partitions.
    """
    wanted = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = {r.doc_id: r.label for r in wanted.collect()}
    if not known:
        return np.zeros(1 << BITS, dtype=np.float32)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(int(k),) for k in known], "doc_id long")
    rows = texts(docs, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    held = cut(rows.groupBy("doc_id").agg(one).select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("t.text").alias("size"), F.col("t.text").alias("text")))
    within, total = [], 0
    for r in sorted(held.select("h", "doc_id", "size").collect()):
        total += r.size
        if total > sample_bytes and within:
            break
        within.append((r.doc_id,))
    if not within:
        return np.zeros(1 << BITS, dtype=np.float32)
    bounded = held.join(F.broadcast(spark.createDataFrame(within, "doc_id long")), "doc_id").select("doc_id", "text")

    def run(parts):
        for part in parts:
            for a, b in batches(part.column(1), PART_BYTES):
                got = counted(part.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).slice(a, b - a), "buckets": pa.array([x.tobytes() for x, _ in got], pa.binary()), "shares": pa.array([x.tobytes() for _, x in got], pa.binary())})

    found = bounded.mapInArrow(tidied(run), "doc_id long, buckets binary, shares binary").collect()
    free(held)
    return train([(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.shares, "<f4"), known[r.doc_id]) for r in sorted(found, key=lambda r: r.doc_id)])


def score_documents(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row, from its text alone.

    A null or empty text has no features and scores 0.5. Rows that repeat are repeated; a null id is not held out;
    other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)  # 1 MB, whatever the corpus

    def run(parts):
        for part in parts:
            for a, b in batches(part.column(2), PART_BYTES):
                got = score(held.value, part.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).slice(a, b - a), "held_out": part.column(1).slice(a, b - a), "score": pa.array(got, pa.float64()), "predicted": pa.array((got >= threshold).astype(np.int32), pa.int32())})

    rows = texts(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels))
