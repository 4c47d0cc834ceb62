"""Benchmark decontamination by Wu-Manber multi-pattern search.

Text becomes canonical bytes: A-Z lower-cased, words (runs of digits, a-z and non-ASCII characters) joined by one
space, with a space at both ends. A window of an item is then a byte string, and it occurs in a document as words
exactly where its bytes occur. Wu-Manber runs over these bytes: the hashed block at the end of the search window
looks up how far no pattern can end, and where the shift is 0, the bucket of that block names the test strings to
compare directly. Many stretches of text are searched in step, so that each step is a few numpy operations.

Block and bucket tables are those of the benchmark; documents never move.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batches, cut, free, texts, tidied

#: Bytes that words are made of stay, A-Z become a-z, all others become spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Characters of benchmark text whose windows are searched for in one pass.
BLOCK_CHARS = 8 << 20
#: Bytes of one stretch that is searched in step with others.
LANE = 2048
BITS = 18


def canonical(text: str | None) -> tuple[bytes, int]:
    """The canonical bytes and the number of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    return (b" " + b" ".join(words) + b" ", len(words)) if words else (b"", 0)


def windows(text: str | None, size: int = 10) -> list[bytes]:
    """The windows of an item: `size` consecutive words each; all its words where they are fewer."""
    words = canonical(text)[0].split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Tables for patterns of similar length, of which the shortest has m bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), dtype=np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << BITS, self.m - self.block + 1, dtype=np.int32)
        for end in range(self.block, self.m + 1):  # later blocks have smaller shifts, and overwrite
            np.minimum.at(self.shift, self.hashed(self.packed(heads[:, end - self.block : end])), self.m - end)
        last = self.packed(heads[:, self.m - self.block :])
        order = np.argsort(last, kind="stable")
        self.suffixes, at = np.unique(last[order], return_index=True)
        self.buckets = np.split(order, at[1:])

    def packed(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            out |= rows[:, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def hashed(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def search(self, text: bytes, starts: np.ndarray, ends: np.ndarray):
        """Every occurrence (offset, pattern) in text[starts[k]:ends[k]], each of these a document of its own."""
        padded = text + bytes(8)
        words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        first = starts + self.m - 1
        count = np.maximum(0, -(-(ends - first) // LANE))
        lane = np.repeat(np.arange(len(starts)), count)
        step = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
        pos = first[lane] + step * LANE  # the last byte of the search window
        stop = np.minimum(pos + LANE, ends[lane])
        while len(pos):
            block = words[pos - (self.block - 1)] & self.mask
            shift = self.shift[self.hashed(block)]
            if len(hit := np.flatnonzero(shift == 0)):
                at = np.searchsorted(self.suffixes, block[hit])
                at[at == len(self.suffixes)] = 0
                real = self.suffixes[at] == block[hit]
                for p, k in zip((pos[hit[real]] - self.m + 1).tolist(), at[real].tolist()):
                    for i in self.buckets[k]:
                        if text.startswith(self.patterns[i], p):
                            yield p, i
            pos = pos + np.maximum(shift, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]


class Index:
    """The windows of a block of items; patterns are parted by length so that short ones don't shorten all shifts."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(item)
        classes: dict[int, list[bytes]] = {}
        for w in owners:
            classes.setdefault(len(w).bit_length(), []).append(w)
        self.owners = owners
        self.parts = [WuManber(p) for p in classes.values()]


def scan(index: Index, values: list[str | None]) -> list[tuple[int, np.ndarray | None, set[str]]]:
    """Per text: the number of words, a flag for each word that is hit (None: no hit), and the items found."""
    bodies = [canonical(t) for t in values]
    joined = b"\n".join(b for b, _ in bodies) + b"\n"  # a line break is in no pattern
    lengths = np.array([len(b) for b, _ in bodies], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    ends = starts + lengths
    found: dict[int, list[tuple[int, bytes]]] = {}
    for part in index.parts:
        hits = [(p, part.patterns[i]) for p, i in part.search(joined, starts, ends)]
        if hits:
            for d, hit in zip((np.searchsorted(starts, [p for p, _ in hits], side="right") - 1).tolist(), hits):
                found.setdefault(d, []).append(hit)
    out = []
    for d, (body, n) in enumerate(bodies):
        if d not in found:
            out.append((n, None, set()))
            continue
        spaces = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
        cover = np.zeros(n + 1, dtype=np.int64)
        items: set[str] = set()
        for p, w in found[d]:
            word = int(np.searchsorted(spaces, p - starts[d]))
            cover[word] += 1
            cover[word + w.count(b" ") - 1] -= 1
            items |= index.owners[w]
        out.append((n, np.cumsum(cover)[:n] > 0, items))
    return out


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _record(ids, n, hits, items) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(map(_digest, items), pa.string()), "contaminated": pa.array([h > 0 for h in hits], pa.bool_())})


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    """The number of blocks of a bounded size, and the items block by block, each a broadcast of its own.

    The driver holds one block at a time. Where there are several, a broadcast is destroyed once the next is asked for:
    by then its pass must be done.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))

    def each():
        for k in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
            rows = [(r.item, r.text) for r in part.collect()]
            held = spark.sparkContext.broadcast((hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest(), rows))
            yield held
            if n > 1:
                held.destroy()

    return n, each()


_held: dict = {}


def _index(held, size: int) -> Index:
    """The index of a block of items, built once in each worker and kept until another is asked for."""
    name, items = held.value
    if (name, size) not in _held:
        _held.clear()
        _held[name, size] = Index(items, size)
    return _held[name, size]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: words, hit words, items whose windows occur, their digest, and whether any word is hit.

    A null or empty text, or one without words, has no words and no hits. An item without words has no window; a
    null item id counts as the id "null"; an id that repeats counts once. Rows that repeat are repeated; other
    columns are left out. An empty benchmark hits nothing.

    A benchmark of up to block_chars characters is one broadcast and one narrow pass. A larger one is searched block
    by block; each pass then gives a bit for each word of the rows that it hits, and the bits are joined per row. For
    that the rows are written once to the shared folder, so that all passes number them alike, and so is what each
    pass finds, so that only one block is held at a time.
    """
    rows = texts(docs, id_col, text_col)
    n_blocks, blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    if n_blocks == 1:
        held = next(blocks)

        def run(parts):
            index = _index(held, size)
            for part in parts:
                for a, b in batches(part.column(1)):
                    got = scan(index, part.column(1).slice(a, b - a).to_pylist())
                    yield _record(part.column(0).slice(a, b - a), [g[0] for g in got], [0 if g[1] is None else int(g[1].sum()) for g in got], [g[2] for g in got])

        return rows.mapInArrow(tidied(run), SCHEMA)

    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    found = []
    for k, held in enumerate(blocks):

        def flagged(parts, held=held, first=not k):
            index = _index(held, size)
            for part in parts:
                for a, b in batches(part.column(1)):
                    got = scan(index, part.column(1).slice(a, b - a).to_pylist())
                    keep = pa.array([first or g[1] is not None for g in got], pa.bool_())  # every row comes at least once
                    bits = [None if g[1] is None else np.packbits(g[1]).tobytes() for g in got]
                    yield pa.RecordBatch.from_pydict({"rid": part.column(2).slice(a, b - a), "doc_id": part.column(0).slice(a, b - a), "n_words": pa.array([g[0] for g in got], pa.int64()), "bits": pa.array(bits, pa.binary()), "items": pa.array([sorted(g[2]) for g in got], pa.list_(pa.string()))}).filter(keep)

        found.append(cut(rows.mapInArrow(tidied(flagged), "rid long, doc_id long, n_words long, bits binary, items array<string>")))
    joined = reduce(DataFrame.unionAll, found).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("bits").alias("bits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merged(parts):
        for part in parts:
            hits = []
            for n, bits in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                flags = np.zeros(-(-n // 8), dtype=np.uint8)
                for x in bits:
                    flags |= np.frombuffer(x, np.uint8)
                hits.append(int(np.unpackbits(flags)[:n].sum()))
            yield _record(part.column(0), part.column(1), hits, [set(x) for x in part.column(3).to_pylist()])

    return joined.select("doc_id", "n_words", "bits", "items").mapInArrow(tidied(merged), SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item. One narrow pass for each block of items.

    With several blocks, what a pass keeps is written to the shared folder, so that only one block is held at a time.
    """
    at = docs.columns.index(text_col)
    n_blocks, blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    before = None
    for held in blocks:

        def run(parts, held=held):
            index = _index(held, size)
            for part in parts:
                for a, b in batches(part.column(at)):
                    piece = part.slice(a, b - a)
                    yield piece.filter(pa.array([hit is None for _, hit, _ in scan(index, piece.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
        if n_blocks > 1:
            docs, old = cut(docs), before
            before = docs
            if old is not None:
                free(old)
    return docs


def op10(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark, size=10)
