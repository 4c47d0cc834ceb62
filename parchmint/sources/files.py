"""Document files as DataFrames: a row per file with its text, its kind and its metadata, or the reason it has none.

Text files are decoded from Spark's binaryFile source. Other kinds need libraries that may be missing; their readers
are functions of (path, bytes) that run on the executors and tell what is missing.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.text import repair_symbols

# Encodings that are tried, in this order, after byte-order marks.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
ENCODINGS = ("utf-8", "cp1251", "koi8-r", "iso-8859-1", "cp866")
PROBE = 10_000


def detect_encoding(raw: bytes) -> str:
    """By byte-order mark; else the first encoding whose first PROBE characters decode without a replacement mark."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    for name in ENCODINGS:
        try:
            # four bytes hold a character at most; a character cut by the probe is no error
            import codecs

            head = codecs.getincrementaldecoder(name)().decode(raw[: 4 * PROBE], final=len(raw) <= 4 * PROBE)[:PROBE]
        except UnicodeDecodeError:
            continue
        if "�" not in head:
            return name
    return "utf-8"


def read_txt(path: str, raw: bytes) -> tuple[str, dict]:
    name = detect_encoding(raw)
    text = raw.decode(name, errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    return text, {"encoding": name, "line_count": text.count("\n") + 1, "character_count": len(text)}


def _with_file(path: str, raw: bytes, work: Callable[[str], str]) -> str:
    with tempfile.NamedTemporaryFile(suffix=os.path.splitext(path)[1]) as f:
        f.write(raw)
        f.flush()
        return work(f.name)


def read_pdf(path: str, raw: bytes) -> tuple[str, dict]:
    try:
        import pymupdf4llm
    except ImportError as e:
        raise RuntimeError("reading .pdf needs the library pymupdf4llm") from e
    text = _with_file(path, raw, pymupdf4llm.to_markdown)
    return text, {"extraction_tool": "pymupdf4llm", "character_count": len(text), "total_characters": len(text)}


def read_docx(path: str, raw: bytes) -> tuple[str, dict]:
    tool = shutil.which("pandoc")
    if not tool:
        raise RuntimeError("reading .docx needs the program pandoc")
    text = _with_file(path, raw, lambda name: subprocess.run([tool, "-f", "docx", "-t", "markdown", "--wrap=none", name], check=True, capture_output=True, text=True).stdout)
    return text, {"extraction_tool": "pandoc", "character_count": len(text), "total_characters": len(text)}


_models: dict = {}


def transcribe(path: str, raw: bytes, model_size: str = "small", device: str = "cpu", compute_type: str = "int8", language: str = "ru") -> tuple[str, dict]:
    """Speech of an audio or video file: 16 kHz mono by ffmpeg, then Whisper with beam 1 and voice detection."""
    tool = shutil.which("ffmpeg")
    try:
        from faster_whisper import WhisperModel
    except ImportError as e:
        raise RuntimeError("transcription needs the library faster_whisper") from e
    if not tool:
        raise RuntimeError("transcription needs the program ffmpeg")
    key = (model_size, device, compute_type)
    if key not in _models:
        _models[key] = WhisperModel(model_size, device=device, compute_type=compute_type)

    def work(name: str) -> str:
        with tempfile.NamedTemporaryFile(suffix=".wav") as wav:
            subprocess.run([tool, "-y", "-i", name, "-vn", "-ar", "16000", "-ac", "1", wav.name], check=True, capture_output=True)
            found, _ = _models[key].transcribe(wav.name, beam_size=1, language=language, vad_filter=True)
            return " ".join(s.text.strip() for s in found)

    text = _with_file(path, raw, work)
    return text, {"model": model_size, "device": device, "character_count": len(text)}


class Readers:
    """Readers by file extension (lower case, with its dot)."""

    def __init__(self):
        self.found: dict[str, Callable[[str, bytes], tuple[str, dict]]] = {".txt": read_txt, ".pdf": read_pdf, ".docx": read_docx, ".mp3": transcribe, ".mp4": transcribe}

    def register(self, extension: str, reader: Callable[[str, bytes], tuple[str, dict]]) -> None:
        extension = extension.lower()
        self.found[extension if extension.startswith(".") else f".{extension}"] = reader

    def get(self, path: str) -> Callable[[str, bytes], tuple[str, dict]]:
        extension = os.path.splitext(path)[1].lower()
        if extension not in self.found:
            raise ValueError(f"no reader for {extension or path}")
        return self.found[extension]

    def extensions(self) -> list[str]:
        return sorted(self.found)


#: Facts that a reader may give about a file; those it doesn't give are null.
METADATA = "file_type string, encoding string, file_size long, line_count int, character_count int, total_characters int, extraction_tool string, page_count int, model string, device string"
_FACTS = [f.split()[0] for f in METADATA.split(", ")]
_METADATA_KIND = f"struct<{METADATA.replace(' ', ':').replace(',:', ',')}>"


def empty_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files without a byte under the paths (which may be folders or patterns): Spark's file sources pass them over."""
    out = []
    for one in [path] if isinstance(path, str) else path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(hadoop) or []:
            for found in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
                if found.isFile() and not found.getLen():
                    out.append(found.getPath().toString())
    return out


def read_files(spark: SparkSession, path: str | list[str], readers: Readers | None = None, report_empty: bool = True) -> DataFrame:
    """path, ext, text, metadata, error of each file. Empty files and failures have an error and no text.

    A path that doesn't exist raises when it is read, as with any source. report_empty lists the folders on the driver
    to find empty files; without it they are passed over.
    """
    rows = decode_files(spark.read.format("binaryFile").load(path).select("path", "length", "content"), readers)
    empty = [(p, os.path.splitext(p)[1].lower(), "ValueError: the file is empty") for p in (empty_files(spark, path) if report_empty else [])]
    if not empty:
        return rows
    none = spark.createDataFrame(empty, "path string, ext string, error string")
    facts = F.from_json(F.to_json(F.struct(F.ltrim(F.col("ext"), F.lit(".")).alias("file_type"), F.lit(0).alias("file_size"))), _METADATA_KIND)
    return rows.unionByName(none.select("path", "ext", F.lit(None).cast("string").alias("text"), facts.alias("metadata"), "error"))


def decode_files(files: DataFrame, readers: Readers | None = None) -> DataFrame:
    """path, ext, text, metadata, error of rows of path, length and content, wherever these come from."""
    held = (readers or Readers()).found

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, size, raw in part.itertuples(index=False):
                ext = os.path.splitext(name)[1].lower()
                facts = dict.fromkeys(_FACTS) | {"file_type": ext.lstrip("."), "file_size": size}
                text = error = None
                try:
                    if not size:
                        raise ValueError("the file is empty")
                    if ext not in held:
                        raise ValueError(f"no reader for {ext or name}")
                    text, more = held[ext](name, bytes(raw))
                    facts |= more
                except Exception as e:  # a file that can't be read is a row with its reason, not the end of the job
                    error = f"{type(e).__name__}: {e}"
                out.append((name, ext, text, facts, error))
            yield pd.DataFrame(out, columns=["path", "ext", "text", "metadata", "error"])

    rows = files.select("path", "length", "content").mapInPandas(run, f"path string, ext string, text string, metadata {_METADATA_KIND}, error string")
    return rows.withColumn("text", F.when(F.col("ext") == ".pdf", repair_symbols(F.col("text"))).otherwise(F.col("text")))


def load_file(spark: SparkSession, path: str) -> tuple[str, dict]:
    """Text and metadata of one file; its error is raised."""
    row = read_files(spark, path).first()
    if row is None:
        raise FileNotFoundError(path)
    if row["error"]:
        raise ValueError(row["error"])
    return row["text"], row["metadata"].asDict()


LABELLED = "doc_id int, sentences array<string>, labels array<int>, chunks_gt array<array<int>>, embeddings_minilm array<array<float>>, embeddings_rubert array<array<float>>"


def read_labelled(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Labelled documents of a JSON array or of Parquet; only the asked columns are read."""
    reader = spark.read.schema(LABELLED)
    df = reader.option("multiLine", True).json(path) if path.endswith(".json") else reader.parquet(path)
    return df.select(*columns) if columns else df


def read_dataset(spark: SparkSession, path: str, split: str) -> DataFrame:
    """doc_id (from 0, in no order), sentences and labels of a split of a labelled dataset in Parquet: files called <split>*.parquet."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/{split}*.parquet")
    return rows.select(F.monotonically_increasing_id().alias("doc_id"), F.col("sentences").cast("array<string>").alias("sentences"), F.col("labels").cast("array<int>").alias("labels"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file of results with a header."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
