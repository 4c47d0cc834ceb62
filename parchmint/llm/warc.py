"""WARC archives: writing with segmented records, and reading back with segment reassembly.

Writing is a DataFrame write of whole records (Spark's text writer, whose line separator is the end of a record), so
files are committed as any other table's and go to any store. Blocks hold HTTP responses with chunked transfer
framing; a block over the segment size is split over continuation records that name the first as their origin.

Reading parses each archive file on its own, then groups records by origin, orders them by segment number, verifies
the total length, takes the HTTP head off and decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import cut, delete, shared_folder, small_side, tidied

SEGMENT = 16 << 10
CHUNK = 4 << 10
#: Records in a file, at most: what one reader holds at a time stays bounded.
FILE_RECORDS = 4000
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        piece = body[at : at + size]
        if len(piece) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(piece)
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record less its last line end, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n"


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def response(name: str, page, url: str | None, payload: bytes, segment: int = SEGMENT) -> list[bytes]:
    """The records of one response: one, or a first and its continuations."""
    block = HEAD + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("Page-ID", "" if page is None else page), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if len(block) <= segment:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", 1)], block[:segment])]
    for k, at in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}/{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", k)]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record(more, block[at : at + segment]))
    return out


def record_name(page, unique: bool, place: str) -> str:
    """A record's id: by the page where that is the only row of its id, else also by its place in the archives."""
    return f"urn:page:{page}" if unique else f"urn:page:{'' if page is None else page}:{place}"


def revisit(name: str, page, url: str | None, payload: bytes, refers_to, refers_unique: bool = True) -> bytes:
    """A record without the payload, whose HTTP head tells the payload's length.

    It refers to the response's record by its id, where the page's id is that of one row only, and always to the page.
    """
    known = [("WARC-Refers-To", f"<{record_name(refers_to, True, '')}>")] if refers_unique else []
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("Page-ID", "" if page is None else page), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *known, ("Page-Refers-To", refers_to), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    return record(fields, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload))


def parse(data: bytes):
    """The records of an archive: header fields (names in lower case) and block."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode("utf-8", "surrogatepass")
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record is cut short at byte {at}")
        at += 4


def unpacked(data: bytes) -> bytes:
    """An archive's bytes, out of any number of gzip members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out += [d.decompress(data), d.flush()]
        data = d.unused_data
    return b"".join(out)


def roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload and refers_to: of equal payloads of min_bytes at least, all but that with the largest id refer to it.

    unique and refers_unique tell whether the row's id, and that which it refers to, are ids of one row only. A null html is an empty payload. A null id is never the largest; without any id in a group all are responses. Rows
    that repeat the largest id are responses each.
    """
    body = F.coalesce(F.encode(F.col(f"`{html_col}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("payload"))
    key = [F.sha1("payload").alias("k"), F.octet_length("payload").alias("n_bytes")]
    groups = rows.select("page_id", *key).where(F.col("n_bytes") >= min_bytes).groupBy("k", "n_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select("k", F.col("n_bytes").alias("n_of_group"), "owner"))
    joined = rows.withColumn("k", F.sha1("payload")).join(small_side(groups), "k", "left")
    out = joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))
    often = cut(rows.where("page_id IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id"))
    if often.isEmpty():
        return out.select("*", F.col("page_id").isNotNull().alias("unique"), F.lit(True).alias("refers_unique"))
    side = small_side(often)
    out = out.join(side.select("page_id", F.lit(False).alias("unique")), "page_id", "left")
    out = out.join(side.select(F.col("page_id").alias("refers_to"), F.lit(False).alias("refers_unique")), "refers_to", "left")
    return out.select("page_id", "url", "payload", "refers_to", (F.coalesce("unique", F.lit(True)) & F.col("page_id").isNotNull()).alias("unique"), F.coalesce("refers_unique", F.lit(True)).alias("refers_unique"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, segment: int = SEGMENT, **columns) -> None:
    """Archives of the pages, as gzip files of up to FILE_RECORDS records, in a folder of any store that Spark writes."""

    def build(parts):
        task, n = TaskContext.get().partitionId(), 0
        for part in parts:
            out = []
            for page, url, payload, refers_to, unique, refers_unique in zip(*(part.column(i).to_pylist() for i in range(6))):
                name, n = record_name(page, unique, f"{task}-{n}"), n + 1
                out += response(name, page, url, payload, segment) if refers_to is None else [revisit(name, page, url, payload, refers_to, refers_unique)]
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    records = roles(pages, min_bytes, **columns).mapInArrow(tidied(build), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(folder)


READ = "key string, page_id long, type string, refers_to long, payload_digest string, seg int, total long, block binary"
ASSEMBLED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _number(text: str | None, cls=int):
    return cls(text) if text else None


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives; the key is the origin that a record belongs to."""

    def read(parts):
        for part in parts:
            for data in part.column(0):
                rows = []
                for f, block in parse(unpacked(data.as_py())):
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), _number(f.get("page-id")), f["warc-type"], _number(f.get("page-refers-to")), f.get("warc-payload-digest", "")[5:] or None, int(f.get("warc-segment-number", 1)), _number(f.get("warc-segment-total-length")), block))
                    if len(rows) == 512:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "page_id", "type", "refers_to", "payload_digest", "seg", "total", "block"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(tidied(read), READ)


def assembled(segments: list[dict]) -> tuple[bytes, bool]:
    """The block of one origin's segments, and whether they are all there, in number and in length."""
    segments = sorted(segments, key=lambda s: s["seg"])
    block = b"".join(s["block"] for s in segments)
    whole = [s["seg"] for s in segments] == list(range(1, len(segments) + 1))
    totals = [s["total"] for s in segments if s["total"] is not None]
    if len(segments) > 1:
        whole = whole and totals == [len(block)] and segments[-1]["total"] is not None
    return block, whole


def payload_of(block: bytes) -> tuple[dict, bytes]:
    """The fields of an HTTP head, and the body with its chunks decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return fields, dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def reassemble(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """Per origin its page, the payload's length and digest, its type, what it refers to, and whether it is intact.

    Only records of one origin meet in a task, and they are as much as one response. A response is intact if no
    segment is missing or doubled, the total length holds, the chunks decode and the digest is the payload's; of one
    that isn't, length and digest are null. with_payload adds the payload itself.
    """
    grouped = records.groupBy("key").agg(F.max("page_id").alias("page_id"), F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.max("refers_to").alias("refers_to"), F.max("payload_digest").alias("payload_digest"), F.collect_list(F.struct("seg", "total", "block")).alias("segments"))

    def run(parts):
        for part in parts:
            out = []
            for page, kind, refers_to, told, segments in zip(*(part.column(i).to_pylist() for i in range(5))):
                size = found = body = None
                block, whole = assembled(segments)
                try:
                    fields, body = payload_of(block)
                    if kind == "revisit":
                        size, found = int(fields[b"content-length"]), told
                    else:
                        size, found = len(body), digest(body)
                        whole = whole and kind is not None and found == told
                except (ValueError, KeyError):
                    whole = False
                if not whole:
                    size = found = None
                out.append((page, size, found, kind, refers_to, whole, body if kind != "revisit" else None))
            arrays = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()))]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload"]
            yield pa.RecordBatch.from_arrays(arrays[: 6 + with_payload], names=names[: 6 + with_payload])

    return grouped.select("page_id", "type", "refers_to", "payload_digest", "segments").mapInArrow(tidied(run), ASSEMBLED + ", payload binary" * with_payload)


def op2(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back; they are deleted once the rows are kept."""
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    rows = cut(reassemble(read_records(spark, folder)))
    delete(spark, folder)
    return rows
