"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source the rows take a seeded random order; a row's fractional rank is (rank - 1/2) / rows of its source.
In the order of fractional ranks every stretch holds the sources in the corpus' own mixture, so cutting that order
into equal stretches gives shards that match it.

No window ever covers a whole source or the whole table: rows are binned by their random key, only counts per bin are
summed up along, and the rank inside a bin is added. The number of bins follows the number of rows. Sums run along bins
in two levels, so that no task holds more counts than about the square root of the number of bins. (Rows that repeat
with their id share a bin, since they share a key.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a bin, about.
BIN_ROWS = 500


def _ahead(counts: DataFrame, at: str, wide: int, *within: str) -> DataFrame:
    """before: the sum of n over all rows of smaller `at` (within the same `within`), in two levels of spans of `wide`."""
    spans = counts.withColumn("span", F.floor(F.col(at) / wide).cast("long"))
    inside = Window.partitionBy(*within, "span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*within).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*within, "span").agg(F.sum("n").alias("n_span"))
    sums = sums.select(*within, "span", F.coalesce(F.sum("n_span").over(along), F.lit(0)).alias("base"))
    told = spans.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*within, "span"])
    return told.select(*within, at, (F.col("base") + F.col("ahead")).alias("before"))


def interleave(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bin_rows: int = BIN_ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("rows"), shard, slot, and grown_shard (null under this law).

    Size is the text's UTF-8 bytes plus 16; a null text has none, and the CRC of no bytes. A null source is a source
    like any other. Equal rows are interchangeable, and each gets a slot of its own. Shards hold counts at most one
    apart; with fewer rows than shards some stay empty. Other columns are left out.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("null")).alias("stratum"),
    )
    told = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    rows = rows.withColumn("key", F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long"))  # 60 random bits
    total = docs.count()
    bins = max(1, -(-total // bin_rows))
    rows = rows.withColumn("bin", F.floor((F.col("key") / F.lit(2.0**60)) * bins).cast("long"))
    rows = rows.withColumn("bin", F.least("bin", F.lit(bins - 1)))

    # the rank within a source: rows in earlier bins, and the rank inside the bin
    wide = max(1, int(bins**0.5))
    counts = rows.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    sources = counts.groupBy("stratum").agg(F.sum("n").alias("n_source"))
    offsets = _ahead(counts, "bin", wide, "stratum").join(sources, "stratum")
    order = ["key", "doc_id", "text_crc32", "size"]
    inside = Window.partitionBy("stratum", "bin").orderBy(*order)
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(offsets, ["stratum", "bin"])
    # exact integers: twice the rank less one, over twice the rows of the source
    ranked = ranked.withColumn("fraction", (2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("n_source")))
    ranked = ranked.withColumn("stretch", F.least(F.floor(F.col("fraction") * bins).cast("long"), F.lit(bins - 1))).drop("bin", "r", "before", "n_source")

    # the place in the whole order: rows in earlier stretches, and the place inside the stretch
    places = _ahead(ranked.groupBy("stretch").agg(F.count("*").alias("n")), "stretch", wide)
    inside = Window.partitionBy("stretch").orderBy("fraction", "stratum", *order)
    placed = ranked.withColumn("r", F.row_number().over(inside)).join(places, "stretch").withColumn("place", F.col("before") + F.col("r") - 1)

    # shard k starts at ceil(k * total / shards)
    placed = placed.withColumn("shard", F.expr(f"(place * {shards}) div {max(total, 1)}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
