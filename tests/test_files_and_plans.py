import json

import pytest
from pyspark.sql import functions as F

from parchmint.plans.process import PipelineConfig, chunk_rows, process, process_files
from parchmint.sources import sinks
from parchmint.sources.files import Readers, detect_encoding, load_file, read_files, read_labelled, read_results
from parchmint.streaming.chunks import stream_chunks, windowed_counts


def test_encodings():
    text = "Привет, мир! Это текст."
    assert detect_encoding(text.encode()) == "utf-8"
    assert detect_encoding(text.encode("utf-8-sig")) == "utf-8-sig"
    assert detect_encoding("\ufeffx".encode("utf-16-le")) == "utf-16-le"
    assert detect_encoding("\ufeffx".encode("utf-16-be")) == "utf-16-be"
    assert detect_encoding(text.encode("cp1251")) == "cp1251"
    assert detect_encoding(b"") == "utf-8"
    assert detect_encoding(("я" * 30_000).encode()) == "utf-8"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes("First par.\r\n\r\nE=mc^2 holds, $a + b = c$ too.".encode())
    (tmp_path / "b.TXT").write_bytes("Текст в другой кодировке".encode("cp1251"))
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "c.xyz").write_bytes(b"x")
    return tmp_path


def test_files(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(folder)).collect()}
    assert rows["a.txt"].text == "First par.\n\nE=mc^2 holds, $a + b = c$ too." and rows["a.txt"].metadata.line_count == 3
    assert rows["b.TXT"].text == "Текст в другой кодировке" and rows["b.TXT"].metadata.encoding == "cp1251"
    assert rows["empty.txt"].text is None and "empty" in rows["empty.txt"].error and "no reader" in rows["c.xyz"].error
    readers = Readers()
    readers.register("XYZ", lambda path, raw: (raw.decode() * 2, {"page_count": 7}))
    assert ".xyz" in readers.extensions()
    row = next(r for r in read_files(spark, str(folder), readers).collect() if r.ext == ".xyz")
    assert (row.text, row.metadata.page_count) == ("xx", 7)
    with pytest.raises(ValueError):
        readers.get("a.unknown")
    assert load_file(spark, str(folder / "a.txt"))[1]["encoding"] == "utf-8"
    with pytest.raises(ValueError):
        load_file(spark, str(folder / "empty.txt"))


def test_missing_tools_are_told(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "a.mp3").write_bytes(b"x")
    errors = {r.ext: r.error for r in read_files(spark, str(tmp_path)).collect()}
    assert "needs" in errors[".pdf"] and "needs" in errors[".mp3"]


def test_process_files_and_sinks(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    results = process_files(spark, str(folder / "*.txt"), PipelineConfig())
    (row,) = results.collect()
    assert row.source_file == "a.txt" and row.statistics.total_chunks == 2 and row.statistics.total_formulas == 2
    assert [c.sequence for c in row.chunks] == [0, 1] and row.chunks[1].original_text == "E=mc^2 holds, $a + b = c$ too."
    assert {f.type for f in row.chunks[1].formulas} == {"latex_inline", "plain_text"} and row.chunks[1].metadata.has_formulas
    sinks.save_result(results, str(out / "r.json"))
    assert json.loads((out / "r.json").read_text())["chunks"][0]["metadata"]["splitter_type"] == "paragraph"
    sinks.write_json(results, str(out / "all"))
    assert spark.read.json(str(out / "all")).count() == 1


def test_kinds_of_files(spark):
    rows = [(1, ".docx", "# Head\n\n**bold** text"), (2, ".mp3", "Так, начнём. Интеграл есть предел сумм. Ещё одно предложение здесь."), (3, ".txt", None)]
    df = spark.createDataFrame(rows, "doc_id long, ext string, text string")
    encoder = lambda s: F.array(F.length(s).cast("float"), F.lit(1.0).cast("float"))
    got: dict = {}
    for r in chunk_rows(df, PipelineConfig(), encoder).orderBy("doc_id", "sequence").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["Head", "bold text"], 2: ["Интеграл есть предел сумм.", "Ещё одно предложение здесь."]}
    assert {r.doc_id: r.statistics.total_chunks for r in process(df, PipelineConfig(), encoder).collect()} == {1: 2, 2: 2, 3: 0}


def test_strict_positions_and_other_splitters(spark):
    df = spark.createDataFrame([(1, ".txt", "Word one here.\n\nE=mc^2 holds here.")], "doc_id long, ext string, text string")
    for strict in (False, True):
        rows = chunk_rows(df, PipelineConfig(strict_positions=strict)).orderBy("sequence").collect()
        assert [len(r.formulas) for r in rows] == [0, 1]
    for kind in ("semantic", "fixed_size", "mixed"):
        assert process(df, PipelineConfig(splitter_type=kind, min_chunk_size=5)).first().statistics.total_chunks >= 1


def test_labelled_and_results(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"doc_id": 1, "sentences": ["a", "b"], "labels": [1, 0], "chunks_gt": [[0, 1]], "embeddings_minilm": [[1.0], [2.0]], "embeddings_rubert": [[1.0], [2.0]]}]))
    assert read_labelled(spark, str(tmp_path / "l.json"), ["doc_id", "labels"]).collect() == [(1, [1, 0])]
    sinks.write_csv(spark.createDataFrame([(1, 0.5)], "doc_id int, pk double"), str(tmp_path / "c"))
    assert read_results(spark, str(tmp_path / "c")).first().pk == 0.5


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Par one of {i}.\n\nPar two.") for i in range(20)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_chunks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("chunks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("chunks").select("doc_id", "chunk_no", "text").collect())) == sorted(map(tuple, stream_chunks(df).select("doc_id", "chunk_no", "text").collect()))
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:07:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in windowed_counts(events).collect()) == [1, 2]


def test_entry_points(spark, monkeypatch):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["doc_id", "chunk_no"]
