"""Near-duplicate groups by an exact n-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

A document is the set of its word shingles (as 64-bit hashes). Documents with equal sets are one class from the start.

1. A first pass over the texts gives each set's signature and adds up a frequency sketch of all shingles.
2. A second pass orders each set rare-first by that sketch (ties by hash) and keeps the prefix: two sets that are
   similar enough share a shingle of both prefixes. Shingles that no other class has in its prefix are left out.
3. The classes that share a prefix shingle form a bucket. Groups of near copies make some buckets very large, so no
   bucket is expanded into pairs. Each member is first paired with the bucket's pivot, the member with the fewest
   rarer shingles (in a group of near copies the one nearest to the common origin). Pairs that pass the filters are
   verified on the whole sets, and verified links give components.
4. What is left are pairs in a bucket of which neither is its pivot and whose components differ. They are filtered in
   blocks of bounded size and all that pass are verified, so no link that could join two components is lost. Where
   very many are left, each class's nearest in every other component is verified first, which joins most of them.
5. All links lie within components. Where their number is asked for, the classes of a component are compared in blocks
   of bounded size, each pair in exactly one of them, and only counts leave a block.

Buckets are split, joined and counted by shuffles that Spark can split further; nothing of the size of a bucket meets
in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import BROADCAST_BYTES, cut, free, fresh, mix, small_side, texts, tidied
from parchmint.llm.components import connected_components
from parchmint.llm.sketch import BLOCK_BITS, Cells, cell, flags, gathered, in_order, passes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Cells of the frequency sketch, as a power of two. It tells shingles apart that are more frequent than the mean cell.
SKETCH_BITS = 25
#: Ranges of the order by hash over which the suffix filter counts.
RANGES = 32
#: Longs of the parity bitmap of a set.
PARITY = 16
#: Pairs between components from which on the nearest are verified first.
NEAREST_FIRST = 200_000
#: Bucket members in a block, and members outside the pivot's component in a block.
BLOCK, OUTSIDERS = 512, 4096
#: Classes, and shingles of all of them, in a block in which links are counted.
LINK_CLASSES, LINK_SHINGLES = 2048, 1 << 20
#: Pairs of a shingle's holders in two blocks from which on it is counted by matrix product.
DENSE = 1 << 14


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked if den * intersection >= num * union."""

    words: int = 5
    num: int = 4
    den: int = 5

    def prefix(self, n: int) -> int:
        """Shingles of a set of n of which a similar set must have one in its own prefix."""
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        """The least intersection of similar sets of sizes a and b: ceil(num (a + b) / (num + den))."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def sql_overlap(self, a: str, b: str) -> str:
        s = self.num + self.den
        return f"(({self.num} * ({a} + {b}) + {s - 1}) div {s})"


class Shingler:
    """Sets of hashed shingles; word hashes are kept from text to text."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.factors = mix(np.arange(1, words + 1, dtype=np.uint64), 77) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        hashes = []
        for w in parts:
            h = known.get(w)
            if h is None:
                known[w] = h = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            total += mix(h[i : i + n]) * self.factors[i]
        return np.unique(mix(total))


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _heads(sigs: pa.Array) -> np.ndarray:
    """The first 8 bytes of each signature, as a long."""
    return np.frombuffer(b"".join(s.as_buffer().to_pybytes()[:8] for s in sigs), np.int64)


def levels_of(counts: np.ndarray) -> bytes:
    """Counts on a scale of 16 steps, one to a doubling; two to a byte."""
    steps = np.minimum(15, np.ceil(np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    return (steps[::2] << 4 | steps[1::2]).tobytes()


def level(held: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return held[cells >> 1] >> np.where(cells & 1, 0, 4).astype(np.uint8) & 15


def signed(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, key, n and sig of each row, and besides them each partition's part of the sketch, as blocks."""
    names = ["doc_id", "key", "n", "sig", "block", "cells"]

    def run(parts):
        shingle, seen = Shingler(sim.words), Cells(SKETCH_BITS)
        for part in parts:
            n, sig = [], []
            for text in part.column(1):
                s = shingle(text.as_py())
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
                seen.add(cell(s, SKETCH_BITS))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        found = seen.blocks()
        if found:
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([b for b, _ in found], pa.int32()), pa.array([z for _, z in found], pa.binary())], names=names)

    return docs.mapInArrow(tidied(run), "doc_id long, key binary, n long, sig binary, block int, cells binary")


def prefixed(docs: DataFrame, sim: Similarity, levels) -> DataFrame:
    """Per class its size, prefix (rare-first), the counts of its set over equal ranges of hashes, and its parity bitmap.

    In the bitmap each shingle flips a bit; two sets differ in at least as many shingles as their bitmaps in bits.
    """

    def run(parts):
        shingle = Shingler(sim.words)
        order = np.frombuffer(levels.value, np.uint8)
        for part in parts:
            sig, n, prefix, counts, parity = [], [], [], [], []
            for text in part.column(1):
                s = shingle(text.as_py())
                if not len(s):
                    continue
                rank = np.argsort(level(order, cell(s, SKETCH_BITS)), kind="stable")  # s is in the order of hashes
                sig.append(signature(s))
                n.append(len(s))
                prefix.append(s[rank[: sim.prefix(len(s))]].view(np.int64))
                odd = (np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)
                parity.append(np.packbits(odd).view(np.int64))
                counts.append(np.bincount((s >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"sig": pa.array(sig, pa.binary()), "n": pa.array(n, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "counts": pa.array(counts, pa.list_(pa.int32())), "parity": pa.array(parity, pa.list_(pa.int64()))})

    rows = docs.mapInArrow(tidied(run), "sig binary, n long, prefix array<long>, counts array<int>, parity array<long>")
    return rows.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "counts", "parity")])


def entries(classes: DataFrame) -> DataFrame:
    """token, node, n and pos (shingles of the set before the token) of all prefix shingles that two classes or more have.

    First only the shingles are counted. Those that are shared set flags in a filter of fixed size, and what the filter
    lets pass is checked against the counts where it is used.
    """
    tokens = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    held = classes.sparkSession.sparkContext.broadcast(flags(tokens))  # 16 MB, whatever the corpus

    def run(parts):
        shared = np.frombuffer(held.value, np.uint8)
        for part in parts:
            prefix = part.column(2)
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(prefix.offsets.to_numpy())
            keep = passes(shared, flat.view(np.uint64))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_pydict({"token": pa.array(flat[keep]), "node": part.column(0).take(at), "n": part.column(1).take(at), "pos": pa.array(pos[keep].astype(np.int32))})

    return classes.select("node", "n", "prefix").mapInArrow(tidied(run), "token long, node long, n long, pos int")


def _close(sim: Similarity, a: str = "", b: str = "p_") -> str:
    """The length filter and the positional filter of two entries of one token.

    Of similar sets, the first shingle that they share in the common order passes: whatever else they share comes after
    it in both. (At later ones the pair may fail, which loses nothing.)
    """
    need = sim.sql_overlap(f"{a}n", f"{b}n")
    return f"{sim.den} * least({a}n, {b}n) >= {sim.num} * greatest({a}n, {b}n) AND 1 + least({a}n - {a}pos - 1, {b}n - {b}pos - 1) >= {need}"


def suffix_filtered(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) whose sets can still be similar by what follows their first common shingle.

    Before the first shingle that two prefixes share, at places i and j of the common order, the sets have nothing in
    common, so they differ in i + j shingles there. After it they differ in no fewer shingles than the counts of their
    suffixes over ranges of hashes differ in all. Similar sets of sizes x and y differ in x + y - 2 overlap at most.
    """
    told = classes.select("node", "n", "prefix", "counts", "sig")
    left = told.select(*[F.col(c).alias(f"a_{c}" if c != "node" else "a") for c in told.columns])
    right = told.select(*[F.col(c).alias(f"b_{c}" if c != "node" else "b") for c in told.columns])
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_sig", "b_sig", "a_n", "b_n", "a_prefix", "b_prefix", "a_counts", "b_counts")

    def run(parts):
        for part in parts:
            m = part.num_rows
            sides = []
            for k in (6, 7):
                lists = part.column(k)
                sizes = np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(m), sizes)
                place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                sides.append((owner, lists.flatten().to_numpy(zero_copy_only=False), place))
            owner, token, place = (np.concatenate([x[k] for x in sides]) for k in range(3))
            order = np.lexsort((token, owner))
            twice = np.flatnonzero((owner[order][1:] == owner[order][:-1]) & (token[order][1:] == token[order][:-1]))
            cut_at = len(sides[0][0])
            first = [np.full(m, np.iinfo(np.int64).max) for _ in "ab"]
            for at in (order[twice], order[twice + 1]):
                for side, mine in enumerate((at < cut_at, at >= cut_at)):
                    np.minimum.at(first[side], owner[at[mine]], place[at[mine]])
            shared = first[0] < np.iinfo(np.int64).max
            ranges = []
            for (o, t, p), f, k in zip(sides, first, (8, 9)):
                counts = part.column(k).flatten().to_numpy(zero_copy_only=False).reshape(m, RANGES).astype(np.int64)
                head = p <= f[o]
                spot = o[head] * RANGES + (t[head].view(np.uint64) >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
                ranges.append(counts - np.bincount(spot, minlength=m * RANGES).reshape(m, RANGES))
            apart = np.abs(ranges[0] - ranges[1]).sum(axis=1) + np.where(shared, first[0], 0) + np.where(shared, first[1], 0)
            a, b = (part.column(k).to_numpy() for k in (4, 5))
            yield part.select(["a", "b", "a_sig", "b_sig"]).filter(pa.array(shared & (apart <= a + b - 2 * sim.overlap(a, b))))

    return both.mapInArrow(tidied(run), "a long, b long, a_sig binary, b_sig binary")


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose whole sets are similar, and the sets (sig, body) that were compared, both as checkpoints.

    owners: sig and doc_id of a row of each class. Only texts of rows that a pair needs are shingled, if their ids are
    few enough to be broadcast; else all are, and a filter of fixed size lets pass the sets that a pair needs.
    """
    needed = pairs.select(F.col("a_sig").alias("sig")).unionAll(pairs.select(F.col("b_sig").alias("sig"))).distinct()
    wanted = cut(needed.join(owners, "sig").select("sig", "doc_id"))
    counted = wanted.agg(F.count("*"), F.count("doc_id")).first()
    rows, held = docs.select("doc_id", "text"), None
    if counted[0] == counted[1] and 8 * counted[0] <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    else:
        heads = wanted.select("sig").mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"h": pa.array(_heads(p.column(0)))}) for p in parts), "h long")
        held = docs.sparkSession.sparkContext.broadcast(flags(heads))  # 16 MB, whatever the corpus

    def run(parts):
        shingle = Shingler(sim.words)
        for part in parts:
            got = [s for s in (shingle(text.as_py()) for text in part.column(1)) if len(s)]
            sigs = pa.array(map(signature, got), pa.binary())
            if held is not None:
                keep = passes(np.frombuffer(held.value, np.uint8), _heads(sigs).view(np.uint64))
                got, sigs = [got[k] for k in keep], sigs.take(pa.array(keep))
            yield pa.RecordBatch.from_pydict({"sig": sigs, "body": pa.array([s.astype("<u8").tobytes() for s in got], pa.binary())})

    sets = rows.mapInArrow(tidied(run), "sig binary, body binary")
    # an id may come on several rows, and all copies of a class may come: one of them is enough
    sets = cut(sets.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("body").alias("body")))
    left = sets.select(F.col("sig").alias("a_sig"), F.col("body").alias("a_body"))
    right = sets.select(F.col("sig").alias("b_sig"), F.col("body").alias("b_body"))
    both = pairs.join(left, "a_sig").join(right, "b_sig").select("a", "b", "a_body", "b_body")

    def compare(parts):
        for part in parts:
            keep = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(sim.den * common >= sim.num * (len(x) + len(y) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    edges = cut(both.mapInArrow(tidied(compare), "a long, b long"))
    free(wanted)
    return edges, sets


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rest(shared: DataFrame, buckets: DataFrame, parts: DataFrame, classes: DataFrame, sim: Similarity) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (x, y) in a bucket of which neither is its pivot, in different components (of y: yc), that pass the filters.

    One of them is outside the pivot's component: only such members are paired with others, in blocks. The bitmaps are
    compared right in the join (apart: bits in which they differ), so that few pairs come out of it. Also the
    checkpoints that the pairs are made from.
    """
    named = shared.join(buckets.where("m > 2").select("token", "m", "p_node"), "token").join(parts, "node", "left")
    named = named.select("token", "node", "n", "pos", "m", "p_node", F.coalesce("component", "node").alias("component"))
    named = named.join(parts.select(F.col("node").alias("p_node"), F.col("component").alias("p_component")), "p_node", "left")
    named = cut(named.withColumn("outside", F.col("component") != F.coalesce("p_component", "p_node")).drop("p_component"))
    spread = cut(named.groupBy("token").agg(F.sum(F.col("outside").cast("long")).alias("out")).where("out > 0"))
    used = [named, spread]
    named = named.where("node <> p_node").drop("p_node").join(spread, "token").join(classes.select("node", "parity"), "node")
    spot = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("m") / BLOCK).cast("long"))
    other = F.pmod(F.xxhash64("node", F.lit(6)), F.ceil(F.col("out") / OUTSIDERS).cast("long"))
    members = named.withColumn("block", spot).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("out") / OUTSIDERS).cast("long") - 1)))
    outside = named.where("outside").withColumn("group", other).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / BLOCK).cast("long") - 1)))
    outside = outside.select("token", "block", "group", *[F.col(c).alias(f"p_{c}") for c in ("n", "pos", "component", "node", "parity")])
    apart = " + ".join(f"bit_count(parity[{k}] ^ p_parity[{k}])" for k in range(PARITY))
    most = f"n + p_n - 2 * {sim.sql_overlap('n', 'p_n')}"
    rest = members.join(outside, ["token", "block", "group"]).where(f"component <> p_component AND (NOT outside OR node < p_node) AND {_close(sim)} AND {apart} <= {most}")
    return rest.select(F.col("p_node").alias("x"), F.col("node").alias("y"), F.col("component").alias("yc"), F.expr(apart).alias("apart")), used


def links(docs: DataFrame, classes: DataFrame, owners: DataFrame, sim: Similarity) -> tuple[DataFrame, list[DataFrame]]:
    """Components (node, component) that verified links connect, and tables of the sets of all classes that have a link.

    First the pairs with pivots; then all pairs that are left between components. Where these are very many, the pair
    that differs least goes first, for each class and each other component in its buckets, since it mostly joins the two.
    """
    shared = cut(entries(classes))
    buckets = shared.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("pos", "node", "n")).alias("p")).where("m > 1")
    buckets = cut(buckets.select("token", "m", F.col("p.pos").alias("p_pos"), F.col("p.node").alias("p_node"), F.col("p.n").alias("p_n")))
    star = shared.join(buckets, "token").where(f"node <> p_node AND {_close(sim)}")
    done = cut(_ordered(star.select(F.col("node").alias("x"), F.col("p_node").alias("y"))))
    pairs = cut(suffix_filtered(done, classes, sim))
    edges, first_sets = verified(pairs, docs, owners, sim)
    sets = [first_sets]
    free(pairs)
    parts = cut(connected_components(edges))
    rest, used = _rest(shared, buckets, parts, classes, sim)
    rest = cut(rest)
    free(shared, buckets, *used)
    if rest.count() > NEAREST_FIRST:
        # distance and node packed in one number, the least of which is the nearest; a node that doesn't fit is left to the last round
        low = F.lit((1 << 51) - 1)
        packed_pair = F.shiftleft(F.col("apart").cast("long"), 51).bitwiseOR(F.col("y").bitwiseAND(low))
        nearest = rest.groupBy("x", "yc").agg(F.min(packed_pair).alias("least")).select("x", F.col("least").bitwiseAND(low).alias("y"))
        pairs = cut(suffix_filtered(_ordered(nearest).join(done, ["a", "b"], "left_anti"), classes, sim))
        done = done.unionAll(_ordered(nearest))
        more, more_sets = verified(pairs, docs, owners, sim)
        edges = edges.unionAll(more)
        sets.append(more_sets)
        free(pairs)
        # components only grow together: what is left is among what was left before
        parts = cut(connected_components(edges))
        mine = parts.select(F.col("node").alias("x"), F.col("component").alias("xc"))
        other = parts.select(F.col("node").alias("y"), F.col("component").alias("yc"))
        named = rest.select("x", "y").join(mine, "x", "left").join(other, "y", "left")
        rest = named.where(F.coalesce("xc", "x") != F.coalesce("yc", "y"))
    pairs = cut(suffix_filtered(_ordered(rest.select("x", "y")).join(done, ["a", "b"], "left_anti"), classes, sim))
    if not pairs.isEmpty():
        more, more_sets = verified(pairs, docs, owners, sim)
        parts = cut(connected_components(edges.unionAll(more)))
        sets.append(more_sets)
    free(pairs)
    return parts, sets


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each set of the left and each of the right.

    Shingles that many of both sides have are counted by a product of incidence matrices, the others pair by pair.
    """
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros(len(left) * len(right), np.int64)
    if not len(common):
        return out.reshape(len(left), len(right))
    held, at = [], []
    for tokens, owner in zip(flat, rows):
        spot = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        real = common[spot] == tokens
        order = np.argsort(spot[real], kind="stable")
        at.append(spot[real][order])
        held.append(owner[real][order])
    sizes = [np.bincount(x, minlength=len(common)) for x in at]
    often = sizes[0] * sizes[1] > DENSE
    column = np.cumsum(often) - 1
    dense = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(often.sum()), 4096):
        sides = []
        for k, n in enumerate((len(left), len(right))):
            mine = often[at[k]]
            col = column[at[k][mine]] - a
            inside = (col >= 0) & (col < 4096)
            m = np.zeros((n, 4096), np.float32)
            m[held[k][mine][inside], col[inside]] = 1
            sides.append(m)
        dense += sides[0] @ sides[1].T
    first = [np.cumsum(x) - x for x in sizes]
    rare = np.flatnonzero(~often)
    work = np.cumsum(sizes[0][rare] * sizes[1][rare])
    for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.unique(np.searchsorted(work, np.arange(0, (work[-1] if len(work) else 0) + (1 << 22), 1 << 22)).tolist() + [len(rare)]))):
        t = rare[a:b]
        n = sizes[0][t] * sizes[1][t]
        token = np.repeat(t, n)
        k = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        i = held[0][first[0][token] + k // sizes[1][token]]
        j = held[1][first[1][token] + k % sizes[1][token]]
        out += np.bincount(i * len(right) + j, minlength=len(out))
    return out.reshape(len(left), len(right)) + dense.astype(np.int64)


def link_counts(members: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """sig and links: to how many rows of other classes each class is linked.

    members: sig, component, n, w (rows of the class). Similar sets of a component are in the same band of sizes or in
    neighbouring ones. Each band is dealt into blocks by hash, and each pair of blocks is one group.
    """
    step = f"ln({sim.den} * 1.000000001D / {sim.num})"
    banded = members.withColumn("band", F.expr(f"cast(floor(ln(n) / {step}) as int)"))
    bands = banded.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / LINK_CLASSES), F.ceil(F.sum("n") / LINK_SHINGLES)).cast("int").alias("k"))
    bands = cut(bands)
    up = bands.select("component", (F.col("band") - 1).alias("band"), F.col("k").alias("k_up"))
    down = bands.select("component", (F.col("band") + 1).alias("band"), F.col("k").alias("k_down"))
    blocks = bands.join(up, ["component", "band"], "left").join(down, ["component", "band"], "left")
    placed = banded.join(blocks, ["component", "band"]).withColumn("p", F.pmod(F.xxhash64("sig", F.lit(9)), F.col("k")).cast("int"))

    def tasks(count, band, across, i, j, side):
        one = F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1), lambda q: F.struct((F.col("band") + band).cast("int").alias("band"), F.lit(across).alias("across"), i(q).alias("i"), j(q).alias("j"), side(q).alias("side")))
        return F.when(count.isNotNull(), one).otherwise(F.slice(one, 1, 0))

    p = F.col("p")
    own = tasks(F.col("k"), 0, 0, lambda q: F.least(p, q), lambda q: F.greatest(p, q), lambda q: F.when(p <= q, 0).otherwise(1))
    above = tasks(F.col("k_up"), 0, 1, lambda q: p, lambda q: q, lambda q: F.lit(0))
    below = tasks(F.col("k_down"), -1, 1, lambda q: q, lambda q: p, lambda q: F.lit(1))
    # one set may have been taken in several stages
    bodies = sets.groupBy("sig").agg(F.first("body").alias("body"))
    dealt = placed.join(bodies, "sig").select("sig", "w", "component", "body", F.explode(F.concat(own, above, below)).alias("t")).select("sig", "w", "body", "component", "t.*")

    def count(key, table):
        _, _, across, i, j = (k.as_py() for k in key)
        side = table.column("side").to_numpy()
        w = table.column("w").to_numpy()
        body = [np.frombuffer(b.as_buffer(), "<u8") for b in table.column("body")]
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        alone = not across and i == j
        if alone:
            at[1] = at[0]
        if not len(at[0]) or not len(at[1]):
            return pa.table({"sig": pa.array([], pa.binary()), "links": pa.array([], pa.int64())})
        a, b = ([body[x] for x in y] for y in at)
        n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        common = intersections(a, b)
        linked = sim.den * common >= sim.num * (n_a[:, None] + n_b[None, :] - common)
        if alone:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(w), np.int64)
        links[at[0]] += linked @ w[at[1]]
        if not alone:
            links[at[1]] += w[at[0]] @ linked
        return pa.table({"sig": table.column("sig"), "links": pa.array(links)})

    counted = dealt.groupBy("component", "band", "across", "i", "j").applyInArrow(count, "sig binary, links long")
    return counted.groupBy("sig").agg(F.sum("links").alias("links"))


def _grouped(rows: DataFrame, sim: Similarity, with_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text, key): told (doc_id, key, n, sig), and per sig its group, component_id, and rows linked to it."""
    spark = rows.sparkSession
    pass1 = cut(signed(rows, sim))
    told = pass1.where("block IS NULL").select("doc_id", "key", "n", "sig")
    sketch = gathered(pass1.where("block IS NOT NULL").select("block", "cells"), SKETCH_BITS, levels_of)
    levels = spark.sparkContext.broadcast(in_order(sketch, SKETCH_BITS, 1 << (BLOCK_BITS - 1)))  # 16 MB, whatever the corpus
    owners = cut(told.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("w"), F.first("n").alias("n")))
    stored = cut(prefixed(rows, sim, levels))
    classes = stored.withColumn("node", F.monotonically_increasing_id())
    parts, sets = links(rows, classes, owners, sim)
    named = cut(classes.select("sig", "node").join(parts, "node").join(owners, "sig").select("sig", "component", "doc_id", "w", "n"))
    free(stored)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("sig").alias("group"))
    joined = named.join(least, "component").select("sig", "group", "component_id")
    if with_links:
        joined = joined.join(link_counts(named.select("sig", "component", "n", "w"), reduce(DataFrame.unionAll, sets), sim), "sig", "left")
    else:
        joined = joined.withColumn("links", F.lit(0).cast("long"))
    joined = cut(joined)
    free(named, *sets)
    final = owners.join(joined, "sig", "left").select("sig", F.coalesce("group", "sig").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    final = cut(final)
    free(owners, joined)
    return told, final


def groups(docs: DataFrame, sim: Similarity, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id of those that links reach, itself included.

    with_links adds n_links, the number of other rows that the row is linked to, copies included.

    A row without words (or with a null text) has no shingles and is on its own. A text of fewer words than a shingle
    is one shingle. Equal sets are linked. Rows that repeat are repeated; a null id is least only where no other id is
    in reach, and then the component is null; other columns are left out.
    """
    rows = texts(docs, id_col, text_col).withColumn("key", F.lit(b""))
    told, final = _grouped(rows, sim, with_links)
    more = ["n_links"] if with_links else []
    out = told.where("n > 0").join(final, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
    alone = told.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in more])
    return out.unionAll(alone)


def keep_first(docs: DataFrame, sim: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less those of a group that holds a row before them.

    The first row of a group is that with the least id, and of several texts under that id the one with the least
    hash. An id that comes on rows with different texts is judged text by text. Of rows that repeat id and text, one
    stays. Rows without an id can't be told apart and stay, and so do rows without words, which resemble nothing. Only
    what goes is sent to the rows: by broadcast if it is small, else by a shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    hashes = [F.xxhash64(F.lit(seed), text) for seed in (1, 2)]
    rows = texts(docs, id_col, text_col)
    rows = rows.withColumn("key", F.encode(F.concat_ws(":", *[F.xxhash64(F.lit(seed), "text").cast("string") for seed in (1, 2)]), "UTF-8"))
    told, final = _grouped(rows, sim)
    found = told.where("n > 0 AND doc_id IS NOT NULL").join(final.select("sig", "group"), "sig")
    each = cut(found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("m")))
    first = cut(each.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("f")))
    marked = each.join(first, "group")
    gone = cut(marked.where(F.struct("doc_id", "key") != F.col("f")).select("doc_id", "key"))
    twice = cut(marked.where((F.col("m") > 1) & (F.struct("doc_id", "key") == F.col("f"))).select("doc_id", "key"))
    free(each, first)
    i, k, r = fresh(docs.columns, "gone_id", "gone_key", "whole_row")
    key = F.encode(F.concat_ws(":", *[h.cast("string") for h in hashes]), "UTF-8")
    named = docs.withColumns({i: F.col(f"`{id_col}`").cast("long"), k: key})
    kept = named.join(small_side(gone).toDF(i, k), [i, k], "left_anti")
    columns = [f"`{c}`" for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*columns)
    side = small_side(twice).toDF(i, k)
    single = kept.join(side, [i, k], "left_anti").select(*columns)
    one = kept.join(side, [i, k], "left_semi").groupBy(i, k).agg(F.first(F.struct(*columns)).alias(r))
    return single.unionByName(one.select(f"`{r}`.*"))


def op5(docs: DataFrame) -> DataFrame:
    return groups(docs, Similarity(words=3, num=90, den=100), with_links=True)
