"""The document pipeline: normalise, clean, take formulas out, split, put them back, and describe each chunk."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.formulas import drop_placeholders, extract_formulas, restore_formulas
from parchmint.functions.markdown import clean_markdown
from parchmint.functions.metadata import formula_presence, main_topic, rounded_statistics, text_statistics
from parchmint.functions.text import clean_speech, normalize
from parchmint.operators.keywords import keyword_facts
from parchmint.operators.splitters import SplitterConfig, split_text
from parchmint.sources.sinks import formula_dict

MEDIA = (".mp3", ".mp4")
KEYWORDS = 8


@dataclass(frozen=True)
class PipelineConfig:
    detect_plain_text_formulas: bool = True
    splitter_type: str = "paragraph"
    min_chunk_size: int = 100
    max_chunk_size: int = 50_000
    preserve_original_text: bool = True  # accepted, without effect: a chunk has its original text
    output_format: str = "json"  # accepted, without effect: sinks are functions of their own
    #: Attach formulas to chunks by inclusive ranges of positions instead of by the placeholders in a chunk.
    strict_positions: bool = False
    paragraph_separator: str = "\n\n"

    def to_dict(self) -> dict:
        return asdict(self)

    def splitter(self) -> SplitterConfig:
        return SplitterConfig(self.splitter_type, self.min_chunk_size, self.max_chunk_size, self.paragraph_separator)


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id, ext, text to the same with the text cleaned by its kind: Markdown of .docx, speech of media files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(F.col("ext") == ".docx", clean_markdown(text)).otherwise(text)
    docs = docs.withColumn("normalized", normalize(text))
    return docs.withColumn("normalized", F.when(F.col("ext").isin(*MEDIA), clean_speech(F.col("normalized"))).otherwise(F.col("normalized")))


def with_formulas(docs: DataFrame, config: PipelineConfig) -> DataFrame:
    methods = ("latex_display", "latex_inline") + (("plain_text",) if config.detect_plain_text_formulas else ())
    skipped = docs.withColumn("__body", F.when(F.col("ext").isin(*MEDIA), F.lit("")).otherwise(F.col("normalized")))
    found = extract_formulas(skipped, "__body", methods).drop("__body")
    return found.withColumn("text_with_placeholders", F.when(F.col("ext").isin(*MEDIA), F.col("normalized")).otherwise(F.col("text_with_placeholders")))


def chunk_rows(docs: DataFrame, config: PipelineConfig = PipelineConfig(), encoder=None) -> DataFrame:
    """A row per chunk: doc_id, sequence, id, text, block_type, formulas, splitter facts, statistics, topic.

    docs: doc_id, ext, text. Documents of media files are split by embeddings, for which an encoder is needed.
    """
    found = with_formulas(prepare(docs), config)
    body = found.select("doc_id", F.col("text_with_placeholders").alias("text"))
    if encoder is None:
        chunks = split_text(body, config.splitter_type, config.splitter())
    else:
        media = found.where(F.col("ext").isin(*MEDIA)).select("doc_id", F.col("text_with_placeholders").alias("text"))
        rest = found.where(~F.coalesce(F.col("ext").isin(*MEDIA), F.lit(False))).select("doc_id", F.col("text_with_placeholders").alias("text"))
        chunks = split_text(rest, config.splitter_type, config.splitter()).unionByName(split_text(media, "semantic_embedding", config.splitter(), encoder=encoder), allowMissingColumns=True)
    joined = chunks.join(found.select("doc_id", F.col("formulas").alias("all_formulas")), "doc_id")
    if config.strict_positions:
        own = F.filter("all_formulas", lambda f: f["start_pos"].between(F.col("start_pos"), F.col("end_pos")))
    else:
        own = F.filter("all_formulas", lambda f: F.col("text").contains(f["placeholder"]))
    joined = joined.withColumn("formulas", own).withColumn("text", drop_placeholders(restore_formulas(F.col("text"), F.col("all_formulas"))))
    out = joined.drop("all_formulas").withColumnsRenamed({"chunk_no": "sequence", "chunk_id": "id"})
    return out.withColumns({"block_type": F.lit("text"), "statistics": rounded_statistics(text_statistics(F.col("text"))), "formula_facts": formula_presence(F.col("text"), F.col("formulas")), "topic": main_topic(F.col("text"))})


def _now() -> Column:
    """Milliseconds of the clock when a row is worked on."""
    return F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")


def process(docs: DataFrame, config: PipelineConfig = PipelineConfig(), encoder=None) -> DataFrame:
    """A row per document: the result with its chunks, their formulas and metadata, and statistics of the whole.

    docs: doc_id, ext, text, and source_file and file_size if they are known. The time of a document is that from the
    reading of its row to the making of its result, in which other documents are worked on too.
    """
    rows = chunk_rows(docs, config, encoder)
    rows = rows.withColumn("keywords", keyword_facts(F.col("text"), KEYWORDS)).select("*", "keywords.*")
    facts = [c for c in ("splitter_type", "paragraph_number", "is_header", "paragraph_count", "contains_headers", "paragraph_numbers", "chunk_size", "has_overlap", "num_sentences") if c in rows.columns]
    confidence = F.round((F.when(F.col("formula_facts.has_formulas"), 1.0).otherwise(0.95) + 0.99 + F.col("topic.topic_confidence") + F.when(F.size("key_terms") == 0, 0.9).otherwise(F.col("keyword_confidence"))) / 4, 3)
    metadata = F.struct(*facts, "formula_facts.*", "statistics.*", "topic.main_topic", "topic.source", "key_terms", "term_frequencies", "unique_terms_count", F.lit(4).alias("extractor_count"), confidence.alias("extraction_confidence"), F.lit("CompositeExtractor").alias("extractor_name"))
    chunk = F.struct("sequence", "id", F.col("text").alias("original_text"), F.col("text").alias("processed_text"), "block_type", formula_dict(F.col("formulas")).alias("formulas"), metadata.alias("metadata"))
    nested = rows.groupBy("doc_id").agg(F.collect_list(chunk).alias("chunks"), F.sum(F.size("formulas")).alias("total_formulas"))
    ordered = F.array_sort("chunks", lambda a, b: F.when(a["sequence"] < b["sequence"], -1).when(a["sequence"] > b["sequence"], 1).otherwise(0))
    columns = set(docs.columns)
    head = docs.select("doc_id", (F.col("source_file") if "source_file" in columns else F.col("doc_id").cast("string")).alias("source_file"), (F.col("file_size") if "file_size" in columns else F.octet_length("text").cast("long")).alias("__size"), _now().alias("__began"))
    both = head.join(nested, "doc_id", "left")
    statistics = F.struct(F.coalesce(F.size("chunks"), F.lit(0)).alias("total_chunks"), F.coalesce("total_formulas", F.lit(0)).alias("total_formulas"), F.round((_now() - F.col("__began")) / 1000, 3).alias("processing_time_seconds"), F.col("__size").alias("input_file_size_bytes"))
    return both.select("doc_id", F.expr("uuid()").alias("process_id"), "source_file", F.current_timestamp().alias("processed_at"), statistics.alias("statistics"), ordered.alias("chunks"))


def process_files(spark, path: str, config: PipelineConfig = PipelineConfig(), encoder=None, readers=None) -> DataFrame:
    """Results of the files under a path. Files that can't be read are left out here; read_files has their reasons."""
    from parchmint.sources.files import read_files

    files = read_files(spark, path, readers).where("error IS NULL")
    docs = files.select(F.col("path").alias("doc_id"), "ext", "text", F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("metadata.file_size").alias("file_size"))
    return process(docs, config, encoder)
