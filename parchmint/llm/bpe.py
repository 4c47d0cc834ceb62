"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parchmint.llm.common import batches, texts, tidied

#: A text longer than this is split before it is encoded.
LONG = 1 << 16
#: A letter or digit before a plain space or line break: no match of the pre-splitting pattern covers both.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")

#: White space as the pattern's \s has it.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

_built: dict = {}


def blank_runs(text: str, size: int = LONG) -> list[tuple[int, int]]:
    """(start, end) of each match of the pattern that is one run of more than `size` white-space characters.

    No match that begins before a run reaches into it. The alternative that ends before white space takes the run less
    its last character, which may belong to what follows, or the whole run at the end of the text.
    """
    found = [m.span() for m in BLANKS.finditer(text) if m.end() - m.start() > size]
    return [(a, b if b == len(text) else b - 1) for a, b in found]


def pieces(text: str, size: int = LONG) -> list[str]:
    """The text cut at safe boundaries into pieces of about `size` characters.

    Every alternative of the pattern either holds no white space or holds it only at its start, so a cut
    between a letter or digit and the white space after it changes no match. Where a stretch has no such
    boundary, the piece gets longer; nothing is cut elsewhere.
    """
    out, start = [], 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def encoder(rank_file: bytes, pattern: str):
    """The Encoding of a rank file's content, built once in each worker."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _built:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        _built[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _built[key]


def encode(enc, text: str, size: int = LONG) -> list[int]:
    """The ids of a whole text; strings of special tokens are ordinary text.

    The library's regular expression backtracks over white space, and a very long run overflows its stack: such a run
    is encoded as the one piece that it is, past the expression.
    """
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for a, b in [*blank_runs(text, size), (len(text), len(text))]:
        for piece in pieces(text[at:a], size):
            ids += enc.encode_ordinary(piece)
        if a < b:
            ids += enc._encode_single_piece(text[a:b].encode())
        at = b
    return ids


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, rank_path: str, pattern: str, schema: str, row) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))  # one rank file, under 1 MB

    def run(parts):
        enc = encoder(held.value, pattern)
        for batch in parts:
            yield from row(enc, batch)

    return df.mapInArrow(tidied(run), schema)


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, and the SHA-256 of its ids and of the bytes they decode to.

    Ids count as little-endian unsigned 32-bit integers. A null or empty text has no tokens; both digests are
    then those of no bytes. Rows that repeat give repeated rows; a null id stays null; other columns are left out.
    with_ids adds the ids themselves as token_ids.
    """

    def row(enc, batch):
        n, a, b, ids_out = [], [], [], []
        for text in batch.column(1):
            ids = encode(enc, text.as_py() or "")
            n.append(len(ids))
            a.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            if with_ids:
                ids_out.append(np.array(ids, dtype=np.int32))
        columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
        if with_ids:
            columns["token_ids"] = pa.array(ids_out, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return _mapped(texts(docs, id_col, text_col), rank_path, pattern, schema, row)


def add_token_ids(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens") -> DataFrame:
    """Every column but the text, with the text's ids in its place, and their number.

    A column that is already called as a new one is replaced. A null text gives an empty list.
    """
    kept = [c for c in docs.columns if c not in (text_col, ids_col, count_col)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in kept)

    def row(enc, batch):
        for a, b in batches(batch.column(len(kept))):  # ids of a few texts at a time: as Python numbers they are large
            part = batch.slice(a, b - a)
            ids = [np.array(encode(enc, text.as_py() or ""), dtype=np.int32) for text in part.column(len(kept))]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), lists, pa.array(sizes)], names=[*kept, ids_col, count_col])

    return _mapped(docs.select(*[f"`{c}`" for c in kept], f"`{text_col}`"), rank_path, pattern, f"{schema}`{ids_col}` array<int>, `{count_col}` long", row)


def decode_ids(frame: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the raw bytes that the ids stand for, as they are (they need not be valid UTF-8). Null ids give no bytes."""

    def row(enc, batch):
        raw = [enc.decode_bytes(ids.as_py() or []) for ids in batch.column(1)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(raw, pa.binary())})

    return _mapped(frame.select(f"`{id_col}`", f"`{ids_col}`"), rank_path, pattern, "doc_id long, decoded binary", row)


def default_ranks() -> tuple[str, str]:
    """The multilingual rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return encode_decode(docs, *default_ranks())
