"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from parchmint.llm import sql
from parchmint.llm.common import read


def op1_quality_classifier(spark, sf_dir):
    from parchmint.llm.classifier import op1

    return op1(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_warc(spark, sf_dir):
    from parchmint.llm.warc import op2

    return op2(spark, read(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark, sf_dir):
    from parchmint.llm.suffix import op3

    return op3(read(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    from parchmint.llm.secrets import scan

    return scan(read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    from parchmint.llm.jaccard import op5

    return op5(read(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    from parchmint.llm.language import op6

    return op6(read(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    from parchmint.llm.shard import interleave

    return interleave(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    from parchmint.llm.bpe import op8

    return op8(spark, read(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    from parchmint.llm.rules import op9

    return op9(read(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    from parchmint.llm.decontaminate import op10

    return op10(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc": op2_warc,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secrets": op4_secrets,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
}

SQL: dict[str, str] = {"op2_warc": sql.WARC, "op3_suffix_dedup": sql.REPEATS, "op4_secrets": sql.SECRETS, "op5_jaccard_join": sql.JACCARD, "op7_sharding": sql.SHARDING, "op10_decontamination": sql.DECONTAMINATION}
