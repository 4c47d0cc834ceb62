"""Texts that would take hours if anything were quadratic in them. Limits are wide: seconds are expected to be few."""

import time

import pytest
from pyspark.sql import functions as F

from parchmint.functions import code as C
from parchmint.functions import metadata as M
from parchmint.functions import spans as SP
from parchmint.functions import text as T
from parchmint.operators import code as CO
from parchmint.operators import splitters as P
from parchmint.operators.keywords import keywords

LIMIT = 40
BLANKS = "a" + " " * 1_000_000 + "b"
HARD = "a" + "\u00a0" * 1_000_000 + "b"
PARAGRAPHS = "Some words here.\n \t\n" * 100_000
LINES = "x = [f(y)];\nPlain text is here.\n\n" * 30_000


def within(limit, run):
    began = time.perf_counter()
    out = run()
    assert time.perf_counter() - began < limit
    return out


@pytest.mark.parametrize("text", [BLANKS, HARD], ids=["blanks", "hard"])
@pytest.mark.parametrize("f", [T.strip, T.normalize, T.normalize_punctuation, T.normalize_whitespace, M.clean_for_analysis, M.first_sentence, C.is_likely_text, C.is_code_line, lambda c: F.size(T.sentences(c)), lambda c: F.size(P.paragraphs(c)), P.is_header])
def test_runs_of_white_space(spark, text, f):
    df = spark.createDataFrame([(text,)], "text string")
    within(LIMIT, lambda: df.select(f(F.col("text"))).collect())


def test_very_many_paragraphs_matches_and_windows(spark):
    df = spark.createDataFrame([(1, PARAGRAPHS)], "doc_id long, text string")
    rows = within(LIMIT, lambda: P.split_paragraphs(df).agg(F.count("*").alias("n"), F.max("end_pos").alias("e")).first())
    assert (rows.n, rows.e) == (100_000, len(PARAGRAPHS.rstrip()))
    found = within(LIMIT, lambda: df.select(SP.find_all(F.col("text"), "[a-z]+").alias("f")).select(F.size("f").alias("n"), F.element_at("f", -1).alias("x")).first())
    assert found.n == 300_000 and PARAGRAPHS[found.x.start : found.x.end] == "here" and found.x.end == len(PARAGRAPHS) - 5
    marked = F.transform(SP.find_all(F.col("text"), "words"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("W").alias("by")))
    assert within(LIMIT, lambda: df.select(SP.replace_at(F.col("text"), marked)).first()[0]) == PARAGRAPHS.replace("words", "W")
    n = within(LIMIT, lambda: P.split_fixed(df, P.SplitterConfig(max_chunk_size=300)).count())
    assert 5_000 < n < 8_000
    top = within(LIMIT, lambda: [(r.term, r.frequency) for r in keywords(df, 2).orderBy("rank").collect()])
    assert top == [("words", 100_000)]


def test_very_many_code_blocks(spark):
    df = spark.createDataFrame([(1, LINES)], "doc_id long, text string")
    blocks = within(LIMIT, lambda: CO.heuristic_blocks(df).agg(F.count("*"), F.max("first_line")).first())
    assert tuple(blocks) == (30_000, 3 * 29_999)
