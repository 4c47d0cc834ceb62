"""Where results go: nested JSON, Parquet and CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder (spark.checkpoint.dir), or below the warehouse where none is set."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def formula_dict(formulas: Column) -> Column:
    """Formulas as they stand in the result: type, and the places packed into position."""
    return F.transform(formulas, lambda f: F.struct(f["original"].alias("original"), f["normalized"].alias("normalized"), f["formula_type"].alias("type"), F.struct(f["start_pos"].alias("start"), f["end_pos"].alias("end")).alias("position")))


def write_json(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    results.write.mode(mode).option("ignoreNullFields", True).json(path)


def save_result(result: DataFrame, path: str) -> None:
    """One document's result as an indented JSON file. For one row; a corpus goes to write_json."""
    row = result.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "true"}).alias("j")).limit(2).collect()
    if len(row) != 1:
        raise ValueError(f"one result is wanted, {len(row) or 'none'} is given")
    with open(path, "w", encoding="utf-8") as f:
        f.write(row[0]["j"])


def write_labelled(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def write_boundaries(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
