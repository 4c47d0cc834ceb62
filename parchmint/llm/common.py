"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column of the input can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def held_out(id_col: str = "doc_id"):
    """True for the rows that no label may be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir.

    Where it isn't set, the checkpoint folder of the context, or, in local mode only, a folder in the warehouse.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder.

    A checkpoint keeps the planner's guess of its size, and the guess of a join is a product: over many rounds the number
    gets so long that planning never ends. The rows are therefore taken on without it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    held = df.checkpoint(eager)
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(held._jdf.queryExecution().toRdd(), held._jdf.schema(), False), spark)
    out._checkpoint = held
    return out


def delete(spark: SparkSession, folder: str) -> None:
    """Takes a folder away from whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(*frames: DataFrame) -> None:
    """Deletes the files of checkpoints (results of cut) that nothing reads any more."""
    for df in frames:
        file = df._checkpoint._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


#: Bytes of rows up to which a side of a join is broadcast.
BROADCAST_BYTES = 24 << 20


def row_bytes(df: DataFrame):
    """About the bytes that a row takes: 8 for each plain value, and the lengths of strings and arrays (of plain structs)."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind == "array":
            inner = f.dataType.elementType
            total = total + F.coalesce(F.size(c), F.lit(0)) * 8 * (len(inner.fields) + 1 if inner.typeName() == "struct" else 1) + 24
        else:
            total = total + 8
    return total


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df marked for broadcast if its rows are measured to be few bytes; else as it is, for a shuffle. df is a checkpoint."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores where one of the columns is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def batches(column: pa.Array | pa.ChunkedArray, limit: int = 4 << 20):
    """Slices (from, to) of a string or binary column that hold about `limit` bytes, a row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.zeros(n, dtype=np.int64)
    if n:
        wide = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
        offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + n + 1]
        sizes = np.diff(offsets)
    start, held = 0, 0
    for i in range(n):
        if i > start and held + sizes[i] > limit:
            yield start, i
            start, held = i, 0
        held += int(sizes[i])
    if start < n:
        yield start, n


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well mixed bits of each uint64."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidied(run):
    """A function over a partition's batches that gives unused memory back to the system at the end.

    Python workers are used again for other partitions and operators; without this, what they once held stays theirs.
    """

    @wraps(run)
    def wrapped(parts):
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
