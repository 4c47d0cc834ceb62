"""The stages of corpus_pipeline one after another, against brute force, with all that may be odd in a table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from parchmint.llm import bpe, rules, secrets
from tests.llm.test_dedup import brute_groups
from tests.llm.test_text import brute_hits

COLUMNS = ["doc_id", "text", "lang", "source"]


@pytest.fixture(scope="module")
def folder(docs, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    items = docs.sparkSession.createDataFrame([(1, " ".join(rows[-1][1].split()[3:])), (2, None), (3, "nowhere to be found at all, this")], "item_id long, text string")
    items.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).where("doc_id IS NOT NULL").collect())


def test_each_stage_against_brute_force(spark, folder, docs):
    held = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = told(held)
        out = stage(spark, held, folder)
        if name == "byte_bpe":
            assert set(docs.columns) - {"text"} <= set(out.columns) and "text" not in out.columns
            ranks = bpe.default_ranks()
            raw = sorted(bytes(r.decoded) for r in bpe.decode_ids(out, *ranks).collect())
            assert raw == sorted((r.text or "").encode() for r in held.collect())
            break
        after = told(out)
        assert out.columns == held.columns
        if name == "quality_rules":
            verdict = {(r.doc_id, r.n_words): r.kept for r in rules.score_documents(held).collect()}
            assert after == [r for r in before if verdict[r[0], rules.measures(r[1])[0]]]
        elif name == "near_duplicates":
            groups = {i: c for i, _, c, _ in brute_groups(before, 5, 4, 5)}
            assert after == sorted({r for r in before if groups[r[0]] == r[0]})
        elif name == "benchmark_decontamination":
            hit = {h[0] for h in brute_hits(before, items) if h[-1]}
            assert after == [r for r in before if r[0] not in hit]
        elif name == "secret_redaction":
            assert [(r[0], *r[2:]) for r in after] == [(r[0], *r[2:]) for r in before]
            changed = {a[0] for a, b in zip(after, before) if a != b}
            live = {r.doc_id for r in secrets.scan(held).where("n_live > 0").collect()}
            assert changed == live - {None}
        kept = f"{folder}/after-{name}"
        out.write.parquet(kept)
        held = spark.read.parquet(kept)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"token_ids", "n_tokens", "doc_id"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) > 10 and all(r.n_tokens == len(r.token_ids) for r in rows)


def test_run_over_an_empty_table(spark, docs, folder, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_ids_with_several_texts(spark, rows):
    base = rows[0][1]
    df = spark.createDataFrame([(1, base, "en", "s"), (1, base, "en", "s"), (2, base, "en", "s"), (2, rows[30][1], "de", "s")], "doc_id long, text string, lang string, source string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "")
    assert told(kept) == sorted([(1, base, "en", "s"), (2, rows[30][1], "de", "s")])


def test_a_column_called_n_chars_is_kept_up_and_none_is_added(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["secret_redaction"]
    with_n = docs.withColumn("n_chars", F.lit(-1).cast("long"))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stage(spark, with_n, "").collect())
    assert stage(spark, docs, "").columns == docs.columns
