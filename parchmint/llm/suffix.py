"""Suffix-array deduplication: every byte covered by a string of `length` bytes that starts anywhere else too goes.

Matching strings are brought together before suffixes are sorted, without loss. Over each string of `length` bytes the
least hash of its K-grams is taken; equal strings have equal least hashes, and neighbouring strings mostly share one,
so a document falls into runs of start positions, each with one hash. A run whose hash occurs nowhere else holds no
repeated string. Runs of equal hash and equal bytes (all copies are compared byte by byte) are one run that is repeated
as a whole, and need no sorting against each other. Runs of equal hash and different bytes go into shards by hash.

Each shard is sorted by Larsson-Sadakane refinement (prefix doubling over groups that are still unsorted), and Kasai's
algorithm gives the common prefixes of neighbours: starts whose neighbour shares `length` bytes are repeated. A hash
with very many different runs is spread over several shards; what each finds only once is merged across these shards by
binary search over sorted fingerprints.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import cut, free, small_side, tidied
from parchmint.llm.sketch import flags, passes

LENGTH = 200
GRAM = 32
#: Start positions in a run, at most: longer ones (of periodic text) are cut.
RUN = 512
#: Bytes of a shard, and runs of one hash in a shard.
SHARD_BYTES, SHARD_RUNS = 1 << 20, 2000
#: Fingerprints in a task that merges shards, about.
MERGE = 500_000

_B = 0x9E3779B97F4A7C15


def gram_hashes(raw: bytes) -> np.ndarray:
    """A mixed hash of each GRAM bytes, by doubling."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    size, factor = 1, _B
    while size < GRAM:
        x = x[:-size] * np.uint64(factor) + x[size:]
        x ^= x >> np.uint64(29)
        size, factor = 2 * size, factor * factor & 0xFFFFFFFFFFFFFFFF
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(raw: bytes, length: int = LENGTH):
    """Of each run its hash, first start, number of starts, and whether it may hold a string twice by itself."""
    if len(raw) < length:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty, empty, empty.astype(bool)
    h = gram_hashes(raw)
    wide, least, step = length - GRAM + 1, h, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.concatenate((new, [len(least)])))
    # the least hash stands at a start, and still is the least one after it: it stands there twice
    twice = np.flatnonzero((h[: len(least) - 1] == least[:-1]) & (least[1:] == least[:-1]))
    again = np.zeros(len(new), dtype=bool)
    again[np.searchsorted(new, twice, side="right") - 1] = True
    parts = -(-count // RUN)
    if (parts > 1).any():
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(new, parts) + k * RUN
        count = np.minimum(np.repeat(count, parts) - k * RUN, RUN)
        return least[start], start, count, np.repeat(again, parts)
    return least[new], new, count, again


def suffix_array(text: np.ndarray, rem: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and the rank of each. rem: bytes left in the piece (0 at its end mark).

    A suffix ends with its piece, whose end comes before any byte; ends compare by the number of their piece.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).tobytes()
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    short = np.flatnonzero(rem < 8)
    drop = (np.uint64(8) * (np.uint64(8) - rem[short].astype(np.uint64))).astype(np.uint64)
    cut_off = np.where(rem[short] == 0, np.uint64(0), (key[short] >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63)))
    key[short] = cut_off
    short = short[np.lexsort((piece[short], rem[short], key[short]))]
    full = np.flatnonzero(rem >= 8)
    full = full[np.argsort(key[full])]
    at = np.searchsorted(key[full], key[short], side="left")
    sa = np.insert(full, at, short)
    alone = rem[sa] < 8
    sorted_key = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | alone[1:] | alone[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    single = new & np.append(new[1:], True)
    active = np.flatnonzero(~single)
    depth = 8
    while len(active):  # places in the order that belong to groups of several suffixes
        pos = sa[active]
        key = rank[pos] * n + rank[pos + depth]
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[active] = pos
        new = np.ones(len(active), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[pos] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        single = new & np.append(new[1:], True)
        active = active[~single]
        depth *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """lcp[r]: the common prefix of the suffixes of rank r - 1 and r, by Kasai's algorithm.

    It walks each piece from left to right, all pieces in step: a suffix shares at least one byte less with its
    neighbour than the suffix before it did.
    """
    padded = np.concatenate((text, np.zeros(8, np.uint8))).tobytes()
    words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lcp = np.zeros(len(text), np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    shared = np.zeros(len(starts), np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # pieces longer than t
        i = starts[:live] + t
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        limit = np.where(r > 0, np.minimum(rem[i], rem[j]), 0)
        h = np.minimum(np.maximum(shared[:live] - 1, 0), limit)
        going = np.flatnonzero(h < limit)
        while len(going):
            a = i[going] + h[going]
            b = j[going] + h[going]
            unlike = words[a] ^ words[b]
            same = unlike == 0
            low = unlike & (~unlike + np.uint64(1))
            bytes_same = np.where(same, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
            h[going] = np.minimum(h[going] + bytes_same, limit[going])
            going = going[same & (h[going] < limit[going])]
        lcp[r] = h
        shared[:live] = h
    return lcp


def repeated(pieces: list[bytes], counts: np.ndarray, length: int = LENGTH):
    """For each piece, flags of its starts whose string is also at another start of the shard; and rank groups.

    The second result numbers the strings: equal numbers are equal strings.
    """
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    rem = starts[piece] + lengths[piece] - np.arange(len(text))
    sa, rank = suffix_array(text, rem, piece)
    lcp = common_prefixes(text, sa, rank, starts, lengths, rem)
    long = lcp >= length
    dup = long | np.append(long[1:], False)
    group = np.cumsum(~long)
    at = [slice(s, s + c) for s, c in zip(starts.tolist(), counts.tolist())]
    return [dup[rank[x]] for x in at], [group[rank[x]] for x in at]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, raw bytes, and two hashes of both as a key: rows that repeat have one key, and one result."""
    raw = F.coalesce(F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), raw.alias("raw"))
    return rows.withColumn("k1", F.xxhash64(F.lit(1), "doc_id", "raw")).withColumn("k2", F.xxhash64(F.lit(2), "doc_id", "raw"))


def _hashes(rows: DataFrame, length: int) -> DataFrame:
    """The hashes that several runs have, or one that may repeat by itself."""

    def run(parts):
        for part in parts:
            found = []
            for raw in part.column(0):
                h, _, _, again = runs(raw.as_buffer().to_pybytes(), length)
                found += [h, h[again]]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return rows.select("raw").mapInArrow(tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _occurrences(rows: DataFrame, held, length: int, name, with_bytes: bool = False) -> DataFrame:
    """Each run whose hash the filter of shared hashes lets pass: its hash, a digest of its bytes, where it is; and its bytes."""
    names = ["h", "p1", "p2", "k1", "k2", "s", "c", "again"] + ["body"] * with_bytes

    def run(parts):
        shared = np.frombuffer(held.value, np.uint8)
        for part in parts:
            out, bodies = [[] for _ in names[:8]], []
            for raw, k1, k2 in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = raw.as_buffer().to_pybytes()
                h, start, count, again = runs(raw, length)
                keep = passes(shared, h)
                if not len(keep):
                    continue
                mine = [raw[s : s + c + length - 1] for s, c in zip(start[keep].tolist(), count[keep].tolist())]
                bodies += mine
                digests = b"".join(name(x) for x in mine)
                p = np.frombuffer(digests, np.int64).reshape(-1, 2)
                same = np.ones(len(keep), np.int64)
                for into, column in zip(out, (h[keep].view(np.int64), p[:, 0], p[:, 1], same * k1, same * k2, start[keep], count[keep], again[keep])):
                    into.append(column)
            if out[0]:
                arrays = [np.concatenate(x) for x in out]
                arrays[5], arrays[6] = arrays[5].astype(np.int64), arrays[6].astype(np.int32)
                told = [pa.array(np.ascontiguousarray(x)) for x in arrays]
                yield pa.RecordBatch.from_arrays(told + [pa.array(bodies, pa.binary())] * with_bytes, names=names)

    return rows.select("raw", "k1", "k2").mapInArrow(tidied(run), "h long, p1 long, p2 long, k1 long, k2 long, s long, c int, again boolean" + ", body binary" * with_bytes)


def _pieces(rows: DataFrame, held, length: int, digest=xxhash.xxh3_128_digest) -> tuple[DataFrame, Callable[[bytes], bytes]]:
    """The different runs (h, p1, p2) with how many they are (n) and where one is, and the function that names them.

    A digest is only the name of a run: the least and the greatest of all bytes under one name are compared, and if
    they differ all runs get other names.
    """
    for seed in itertools.count():
        name = partial(digest, seed=seed)
        seen = _occurrences(rows, held, length, name, with_bytes=True)
        alike = (F.min("body") == F.max("body")).alias("alike")
        pieces = cut(seen.groupBy("h", "p1", "p2").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "s")).alias("at"), alike))
        if pieces.where("NOT alike").isEmpty():
            return pieces, name
        free(pieces)


def _with_text(places: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Of places (per text its key and runs, each h, p1, p2, n, and where it is) each run with its bytes instead of its place.

    Only texts that have such a run are shuffled: by a broadcast of keys if they are few bytes, else by a filter of
    fixed size.
    """
    texts = rows.select("k1", "k2", "raw")
    keys = places.select("k1", "k2")
    side = small_side(keys)
    if side is not keys:
        texts = texts.join(side, ["k1", "k2"], "left_semi")
    else:
        held = rows.sparkSession.sparkContext.broadcast(flags(places.select("k1")))  # 16 MB, whatever the corpus

        def known(parts):
            shared = np.frombuffer(held.value, np.uint8)
            for part in parts:
                yield part.take(pa.array(passes(shared, part.column(0).to_numpy().view(np.uint64))))

        texts = texts.mapInArrow(tidied(known), texts.schema)
    texts = texts.groupBy("k1", "k2").agg(F.first("raw").alias("raw"))

    def run(parts):
        names = ["h", "p1", "p2", "n", "c", "sub", "shard", "body"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for part in parts:
            out = []
            for raw, found in zip(part.column(0), part.column(1)):
                raw = raw.as_buffer().to_pybytes()
                for r in found.as_py():
                    out.append((r["h"], r["p1"], r["p2"], r["n"], r["c"], r["sub"], r["shard"], raw[r["s"] : r["s"] + r["c"] + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    both = texts.join(places, ["k1", "k2"]).select("raw", "runs")
    return both.mapInArrow(tidied(run), "h long, p1 long, p2 long, n long, c int, sub long, shard long, body binary")


FOUND = "h long, p1 long, p2 long, a int, b int, f1 long, f2 long, sub long"


def _found(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in FOUND.split(", ")])


def _shards(bodies: DataFrame, length: int) -> DataFrame:
    """Per shard the ranges of repeated starts of runs that occur once, and what other shards of a hash must compare."""

    def run(key, table):
        spread = key[1].as_py() is not None
        rows = list(zip(*(table.column(c).to_pylist() for c in ("h", "p1", "p2", "n", "c", "sub", "body"))))
        rows.sort(key=lambda r: r[:3])
        dup, group = repeated([r[6] for r in rows], np.array([r[4] for r in rows]), length)
        out, told = [], set()
        for (h, p1, p2, n, _, sub, body), flags, numbers in zip(rows, dup, group):
            if n == 1:
                out += [(h, p1, p2, a, b, None, None, None) for a, b in ranges(flags)]
            if not spread:
                continue
            for k, (known, number) in enumerate(zip(flags.tolist(), numbers.tolist())):
                if number in told:
                    continue
                told.add(number)
                f = np.frombuffer(hashlib.blake2b(body[k : k + length], digest_size=16).digest(), np.int64).tolist()
                open_ = n == 1 and not known
                out.append((h, p1 if open_ else None, p2 if open_ else None, k, k + 1, *f, sub))
        return _found(out)

    return bodies.groupBy("shard", "sub").applyInArrow(run, FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """Across the shards of a hash: starts whose fingerprint another shard has too."""
    prints = found.where("f1 IS NOT NULL")
    total = prints.count()
    if not total:
        return prints.where("false").select("h", "p1", "p2", "a", "b")
    tasks = max(1, -(-total // MERGE))

    def run(_, table):
        keys = table.column("f1").to_numpy().view(np.uint64) * np.uint64(_B) ^ table.column("f2").to_numpy().view(np.uint64)
        merged = np.sort(keys)  # of all shards' fingerprints; 64 of their bits decide which slice and 64 more the match
        several = np.searchsorted(merged, keys, side="right") - np.searchsorted(merged, keys, side="left") > 1
        mine = table.column("p1").is_valid().to_numpy()
        return table.select(["h", "p1", "p2", "a", "b"]).filter(pa.array(several & mine, pa.bool_()))

    slices = prints.withColumn("slice", F.pmod(F.xxhash64("f1", "f2"), F.lit(tasks)))
    return slices.groupBy("slice").applyInArrow(run, "h long, p1 long, p2 long, a int, b int")


def spans(rows: DataFrame, length: int) -> DataFrame:
    """Per key (k1, k2) the merged byte ranges to remove, as packed 64-bit pairs; a checkpoint."""
    shared = rows.sparkSession.sparkContext.broadcast(flags(_hashes(rows, length)))  # 16 MB, whatever the corpus
    pieces, name = _pieces(rows, shared, length)
    hashes = pieces.groupBy("h").agg(F.count("*").alias("different"), F.min("n").alias("least"), F.max("again").alias("any_again"), F.sum(F.col("c") + length).alias("bytes"))
    hashes = cut(hashes.where("least = 1 AND (different > 1 OR any_again)"))
    size = hashes.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    many = F.col("different") > SHARD_RUNS
    needed = pieces.join(hashes, "h").select("h", "p1", "p2", "n", "c", "at.*", F.when(many, F.pmod(F.xxhash64("p1", "p2"), F.ceil(F.col("different") / SHARD_RUNS).cast("long"))).alias("sub"), F.when(many, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))).alias("shard"))
    places = cut(needed.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "p1", "p2", "n", "s", "c", "sub", "shard")).alias("runs")))
    free(hashes)
    found = cut(_shards(_with_text(places, rows, length), length))
    free(places)
    whole = pieces.where("n > 1").select("h", "p1", "p2", F.lit(0).alias("a"), F.col("c").alias("b"))
    parts = found.where("f1 IS NULL").select("h", "p1", "p2", "a", "b").unionByName(_merged(found)).unionByName(whole)
    parts = cut(parts.groupBy("h", "p1", "p2").agg(F.collect_list(F.struct("a", "b")).alias("parts")))
    free(pieces, found)
    seen = _occurrences(rows, shared, length, name)
    hits = seen.join(parts, ["h", "p1", "p2"]).select("k1", "k2", F.explode("parts").alias("x"), "s")
    hits = hits.select("k1", "k2", F.struct((F.col("s") + F.col("x.a")).alias("a"), (F.col("s") + F.col("x.b") + (length - 1)).alias("b")).alias("x"))
    grouped = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("x")).alias("xs"))

    def run(batches):
        for part in batches:
            out = []
            for xs in part.column(2):
                merged: list[list[int]] = []
                for x in xs.as_py():
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"])
                    else:
                        merged.append([x["a"], x["b"]])
                out.append(np.array(merged, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"k1": part.column(0), "k2": part.column(1), "spans": pa.array(out, pa.binary())})

    out = cut(grouped.mapInArrow(tidied(run), "k1 long, k2 long, spans binary"))
    free(parts)
    return out


def removed(raw: bytes, packed: bytes | None) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many go, and in how many runs."""
    if not packed:
        return raw, 0, 0
    out, at, gone = [], 0, 0
    pairs = np.frombuffer(packed, "<i8").reshape(-1, 2).tolist()
    for a, b in pairs:
        out.append(raw[at:a])
        at, gone = b, gone + b - a
    return b"".join([*out, raw[at:]]), gone, len(pairs)


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, and the SHA-256 of the bytes that are left.

    A null or empty text, or one shorter than `length`, loses nothing. Rows that repeat repeat each other's strings. A
    null id stays null; other columns are left out. with_kept adds the bytes themselves.
    """
    rows = _keyed(docs, id_col, text_col)
    found = spans(rows, length)
    joined = rows.join(small_side(found), ["k1", "k2"], "left").select("doc_id", "raw", "spans")

    def run(parts):
        for part in parts:
            kept = []
            for raw, packed in zip(part.column(1), part.column(2).to_pylist()):
                raw = raw.as_buffer().to_pybytes()
                kept.append((len(raw), *removed(raw, packed)))
            columns = {"doc_id": part.column(0), "n_bytes": pa.array([k[0] for k in kept], pa.int64()), "n_removed": pa.array([k[2] for k in kept], pa.int64()), "n_spans": pa.array([k[3] for k in kept], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k[1]).hexdigest() for k in kept], pa.string())}
            if with_kept:
                columns["kept"] = pa.array([k[1] for k in kept], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def op3(docs: DataFrame) -> DataFrame:
    return deduplicate(docs)
