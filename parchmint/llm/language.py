"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

One network reads a text's bytes forwards, one backwards; at every position both states give probabilities of the
languages, and a document's probabilities are the mean over its positions. Training is backpropagation through time
with Adam on a bounded sample. For scoring, a text is read in segments of fixed length, and many segments in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import batches, held_out, texts, tidied

HIDDEN = 8
SEGMENT = 128
#: Segments that are read in step, times languages (up to 16 languages: 2,048 segments).
LANES = 2048 * 16
#: Documents to learn from: in all, and for each language, at most. Of each a number of stretches of some bytes.
SAMPLE, PER_LANGUAGE = 8000, 400
STRETCHES, STRETCH = 16, 64
UNKNOWN = "und"
GATES = "zrn"


def initial(classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        for g in GATES:
            p[f"x{g}{way}"] = rng.normal(0, 0.3, (256, HIDDEN))
            p[f"u{g}{way}"] = np.linalg.qr(rng.normal(0, 1, (HIDDEN, HIDDEN)))[0]
        p[f"o{way}"] = rng.normal(0, 0.3, (HIDDEN, classes))
    p["bias"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def run(p: dict, x: np.ndarray, way: str, keep: bool = False):
    """States (length, lanes, HIDDEN) of one direction over x (length, lanes), in the order of the text.

    A zero byte is padding: it sets the state to zero. With keep, what backpropagation needs comes too.
    The sigmoid is written with tanh: s(a) = (1 + tanh(a / 2)) / 2.
    """
    length, lanes = x.shape
    half = np.float32(0.5)
    xz, xr, xn = p[f"xz{way}"] * half, p[f"xr{way}"] * half, p[f"xn{way}"]
    uz, ur, un = p[f"uz{way}"] * half, p[f"ur{way}"] * half, p[f"un{way}"]
    states = np.empty((length, lanes, HIDDEN), np.float32)
    h = np.zeros((lanes, HIDDEN), np.float32)
    z, r, n, a = (np.empty_like(h) for _ in range(4))
    padded = (x == 0).any(axis=1)
    kept = []
    for t in range(length) if way == "f" else range(length - 1, -1, -1):
        row = x[t]
        np.take(xz, row, axis=0, out=z, mode="clip")
        np.matmul(h, uz, out=a)
        z += a
        np.tanh(z, out=z)
        z += 1
        z *= half
        np.take(xr, row, axis=0, out=r, mode="clip")
        np.matmul(h, ur, out=a)
        r += a
        np.tanh(r, out=r)
        r += 1
        r *= half
        np.matmul(h, un, out=a)
        if keep:
            hu = a.copy()
        a *= r
        np.take(xn, row, axis=0, out=n, mode="clip")
        n += a
        np.tanh(n, out=n)
        if keep:
            kept.append((t, h.copy(), z.copy(), r.copy(), n.copy(), hu))
        out = states[t]
        np.subtract(h, n, out=out)
        out *= z
        out += n
        if padded[t]:
            out[row == 0] = 0
        h = out
    return (states, kept) if keep else states


def probabilities(p: dict, x: np.ndarray) -> np.ndarray:
    """Of each language at every position: (length, lanes, classes)."""
    length, lanes = x.shape
    logits = run(p, x, "f").reshape(-1, HIDDEN) @ p["of"]
    logits += run(p, x, "b").reshape(-1, HIDDEN) @ p["ob"]
    logits += p["bias"]
    np.exp(logits, out=logits)  # states are within 1, so logits stay small
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(length, lanes, -1)


def gradients(p: dict, x: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions that aren't padding, and its gradients by backpropagation through time."""
    length, lanes = x.shape
    out = {k: np.zeros_like(v) for k, v in p.items()}
    passes = {way: run(p, x, way, keep=True) for way in "fb"}
    logits = sum(passes[w][0] @ p[f"o{w}"] for w in "fb") + p["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    real = x != 0
    count = max(1, int(real.sum()))
    lane = np.arange(lanes)
    loss = -float(np.log(prob[:, lane, labels] + 1e-9)[real].sum()) / count
    prob[:, lane, labels] -= 1
    prob *= real[:, :, None] / np.float32(count)
    out["bias"] = prob.sum(axis=(0, 1))
    for way in "fb":
        states, kept = passes[way]
        out[f"o{way}"] = np.einsum("tlh,tlc->hc", states, prob)
        above = prob @ p[f"o{way}"].T
        carry = np.zeros((lanes, HIDDEN), np.float32)
        for t, h, z, r, n, hu in reversed(kept):
            d = (carry + above[t]) * real[t][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * hu * r * (1 - r)
            dhu = dn * r
            carry = d * z
            for g, dg in (("z", dz), ("r", dr), ("n", dhu)):
                out[f"u{g}{way}"] += h.T @ dg
                carry = carry + dg @ p[f"u{g}{way}"].T
            for g, dg in (("z", dz), ("r", dr), ("n", dn)):
                np.add.at(out[f"x{g}{way}"], x[t], dg)
    return loss, out


def train(samples: list[tuple[bytes, int]], classes: int, steps: int | None = None, lanes: int = 128, length: int = 48, rate: float = 0.02, seed: int = 5) -> dict:
    """Parameters learned from random stretches of the samples, each language as often as any other.

    Steps are 300, and more from 16 languages on, so that each is read as often.
    """
    steps = steps or 300 * -(-max(classes, 1) // 16)
    rng = np.random.default_rng(seed)
    p = initial(classes)
    by = [[s for s, y in samples if y == c and s] for c in range(classes)]
    live = [c for c in range(classes) if by[c]]
    if len(live) < 2:
        return p
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        labels = rng.choice(live, lanes)
        x = np.zeros((length, lanes), np.uint8)
        for k, c in enumerate(labels):
            s = by[c][rng.integers(len(by[c]))]
            start = rng.integers(max(1, len(s) - length + 1))
            piece = np.frombuffer(s[start : start + length], np.uint8)
            x[: len(piece), k] = piece
        _, g = gradients(p, x, labels)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lower = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            v = g[k] / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - lower * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def pooled(p: dict, raw: list[bytes]) -> np.ndarray:
    """The mean probabilities over the positions of each text; zeros for an empty one. Zero bytes count as spaces."""
    classes = len(p["bias"])
    total = np.zeros((len(raw), classes))
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    segments = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(raw)), segments)
    grid = np.zeros((int(segments.sum()), SEGMENT), np.uint8)
    row = 0
    for r, k in zip(raw, segments.tolist()):
        body = np.frombuffer(r.replace(b"\0", b" "), np.uint8)
        grid[row : row + k].reshape(-1)[: len(body)] = body
        row += k
    lanes = max(1, LANES // max(16, classes))
    for a in range(0, len(grid), lanes):
        x = np.ascontiguousarray(grid[a : a + lanes].T)
        prob = probabilities(p, x)
        if not x.all():
            prob[x == 0] = 0
        sums = prob.sum(axis=0)
        for c in range(classes):
            total[:, c] += np.bincount(owner[a : a + lanes], sums[:, c], len(raw))
    return total / np.maximum(lengths, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def learn(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict]:
    """The languages (every value of lang_col) and the network, from rows that are not held out and whose language is known.

    Of each language the rows with the smallest hashes are used, per_language at most and no more than an equal part
    of `sample` (one at least); of each STRETCHES stretches of STRETCH bytes, from places all over the text by hash. They are
    ranked on the executors and come in one job, whatever the number of partitions. Equal rows count once.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8").alias("raw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("raw").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], initial(1)
    wanted = max(1, min(per_language, sample // len(languages)))
    # rows under a threshold of their hash: somewhat more than what is wanted of each language, so that few are ranked
    spark = docs.sparkSession
    near = wanted + 6 * wanted**0.5 + 12
    shares = spark.createDataFrame([(lang, min(1.0, near / n)) for lang, n in counts.items()], "lang string, share double")
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32("raw"), F.lit(11)), 1)
    few = rows.withColumn("h", hashed).join(F.broadcast(shares), "lang").where(F.col("h") / F.lit(2.0**63) < F.col("share"))
    room = F.greatest(F.octet_length("raw") - STRETCH + 1, F.lit(1))
    pieces = [F.substring(F.col("raw"), F.pmod(F.xxhash64("h", F.lit(k)), room).cast("int") + 1, F.lit(STRETCH)) for k in range(STRETCHES)]
    few = few.groupBy("lang", "h").agg(F.min(F.array(*pieces)).alias("pieces"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= wanted)
    at = {lang: k for k, lang in enumerate(languages)}
    found = sorted((at[r["lang"]], r["r"], r["pieces"]) for r in ranked.select("lang", "r", "pieces").collect())
    return languages, train([(bytes(s).replace(b"\0", b" "), k) for k, _, pieces in found for s in pieces], len(languages))


def identify(docs: DataFrame, languages: list[str], p: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its text alone.

    A null text, or one without a letter, is `und` with score 0. Rows that repeat are repeated; other columns are
    left out. If nothing could be learned every row is `und`.
    """
    held = docs.sparkSession.sparkContext.broadcast((languages, p))  # 256 rows for each gate, whatever the corpus

    def rows(parts):
        names, net = held.value
        for part in parts:
            for a, b in batches(part.column(2)):
                values = part.column(2).slice(a, b - a).to_pylist()
                known = [bool(names) and bool(v) and has_letter(v) for v in values]
                prob = pooled(net, [v.encode("utf-8", "surrogatepass") if k else b"" for v, k in zip(values, known)])
                best = prob.argmax(axis=1)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).slice(a, b - a), "held_out": part.column(1).slice(a, b - a), "lang_pred": pa.array([names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known)], pa.string()), "score": pa.array([min(1.0, float(q[i])) if k else 0.0 for q, i, k in zip(prob, best.tolist(), known)], pa.float64())})

    return texts(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidied(rows), "doc_id long, held_out boolean, lang_pred string, score double")


def op6(docs: DataFrame) -> DataFrame:
    return identify(docs, *learn(docs))
