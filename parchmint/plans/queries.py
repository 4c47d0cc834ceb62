"""A query for each operator over the driver's tables, and SQL that DuckDB can run for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import code as C
from parchmint.functions import formulas as FO
from parchmint.functions import metadata as M
from parchmint.functions import text as T
from parchmint.functions.markdown import clean_markdown
from parchmint.operators import code as CO
from parchmint.operators import dataset as D
from parchmint.operators import metrics as E
from parchmint.operators import segmentation as S
from parchmint.operators import splitters as P
from parchmint.operators.keywords import keyword_summary, keywords
from parchmint.plans.benchmark import benchmark
from parchmint.plans.process import PipelineConfig, chunk_rows, process
from parchmint.sources.files import decode_files, read_boundaries, read_dataset, read_labelled, read_results
from parchmint.sources.sinks import scratch, write_boundaries, write_csv, write_json, write_labelled

LINES = P.SplitterConfig(paragraph_separator="\n")
#: Sentences in a pseudo-document of the table of embeddings, and conversations in a document.
PER_DOC = 25
TURN_DOCS = 10

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vectors(spark, sf_dir):
    """Pseudo-documents: doc_id, pos, embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / PER_DOC).alias("doc_id"), (F.col("vec_id") % PER_DOC).alias("pos"), "embedding")


def turns(spark, sf_dir):
    """Labelled sentences: ten conversations in a row are a document, and each conversation starts a segment."""
    c = table(spark, sf_dir, "conversations").withColumn("doc_id", F.floor(F.col("conv_id") / TURN_DOCS))
    w = Window.partitionBy("doc_id").orderBy("conv_id", "turn")
    return c.select("doc_id", (F.row_number().over(w) - 1).alias("pos"), F.col("text").alias("sentence"), (F.col("turn") == 0).cast("int").alias("label"))


def segmented(spark, sf_dir):
    """Turns with their true segments and predicted ones: a segment at every fourth turn."""
    rows = S.labels_to_segments(turns(spark, sf_dir)).withColumnRenamed("segment", "true_segment")
    return rows.withColumn("pred_segment", F.floor(F.col("pos") / 4).cast("int"))


# --- SQL of expressions -------------------------------------------------------------------------------------------
LF, CR = "chr(10)", "chr(13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


def s_strip(x: str) -> str:
    return sub(sub(x, rf"\A{T.WS}+"), rf"{T.WS}+\z")


def s_breaks(x: str) -> str:
    lines = sub(x, r"\r\n|\r", LF)
    return f"trim({sub(lines, r'\n{3,}', f'{LF} || {LF}')}, {LF})"


def s_spaces(x: str) -> str:
    lines = sub(sub(x, r"[ \t]+", "' '"), rf"{T.INLINE}*\n{T.INLINE}*", LF)
    return sub(sub(lines, rf"\A{T.INLINE}+"), rf"{T.INLINE}+\z")


def s_invisible(x: str) -> str:
    return sub(x, r"[\x{FEFF}\x{FFFE}\x{200B}-\x{200D}]")


def s_control(x: str) -> str:
    return sub(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def s_normalize(x: str) -> str:
    return s_spaces(s_control(sub(s_breaks(s_invisible(f"coalesce({x}, '')")), r"-\r?\n")))


def s_punctuation(x: str) -> str:
    x = sub(sub(x, "[«»„‟\"＂]", "'\"'"), "[–—]", "'-'")
    return sub(sub(x, rf"{T.WS}+([.,;:!?])", q(r"\1")), "([.,;:!?])([А-Яа-яA-Za-z])", q(r"\1 \2"))


def s_clean(x: str) -> str:
    bare = sub(x, r"\[\[FORMULA_[^\n]*?\]\]")
    return s_strip(sub(f"lower({bare})", f"{T.WS}+", "' '"))


def s_words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.WORD)})"


def s_raw_sentences(x: str) -> str:
    marked = sub(x, f"([.!?]){T.WS}+", q(r"\1") + " || chr(1)")
    return f"string_split({marked}, chr(1))"


def s_sentences(x: str) -> str:
    return f"list_filter(list_transform({s_raw_sentences(x)}, lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_chunk_id(text: str, at: str) -> str:
    return f"'chunk_' || printf('%06d', {at}::INT) || '_' || substr(md5(substr({text}, 1, 100) || '_' || {at}::VARCHAR), 1, 8)"


def s_header(x: str) -> str:
    short = f"(NOT contains({x}, {LF}) AND length({s_strip(x)}) < 100 AND NOT regexp_matches({s_strip(x)}, {q(r'[.!?]\z')}))"
    more = (rf"\A#+{T.WS}", rf"\A\p{{Nd}}+\.{T.WS}", r"(?i)\A[A-ZА-Я][^.!?]*:\z", r"(?i)\A(?:Введение|Заключение|Глава|Раздел|Часть)(?:[^\p{L}\p{N}_]|\z)")
    return "(" + " OR ".join([short, *(f"regexp_matches({x}, {q(p)})" for p in more)]) + ")"


def s_symbols(x: str) -> str:
    return f"(length({x}) - length({sub(x, C.SYMBOLS)}))"


def s_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def s_likely_text(x: str) -> str:
    b = s_strip(x)
    parts = f"regexp_split_to_array({b}, {q(T.WS + '+')})"
    low = f"regexp_split_to_array(lower({b}), {q(T.WS + '+')})"
    return f"({b} <> '' AND (regexp_matches({b}, {q(r'(?s)\A\p{Lu}.*[.!?]\z')}) OR (len({parts}) > 5 AND {s_symbols(b)} < 0.05 * length({b})) OR (list_has_any({low}, {s_list(C.PROSE)}) AND {s_symbols(b)} < 3)))"


def s_code_line(x: str) -> str:
    b = sub(x, rf"\A{T.WS}+")
    names = f"list_filter(regexp_extract_all({b}, {q(T.WORD)}), lambda w: regexp_matches(w, '^[a-zA-Z_]'))"
    return f"({x} <> '' AND NOT {s_likely_text(x)} AND (starts_with({b}, '>>>') OR list_has_any({names}, {s_list(C.KEYWORDS)}) OR ({s_symbols(b)} >= 2 AND length({b}) > 5 AND regexp_matches({b}, {q(C.SPECIFIC)})) OR ends_with({b}, ':') OR length({x}) > length({b})))"


TURNS = f"SELECT conv_id // {TURN_DOCS} AS doc_id, row_number() OVER (PARTITION BY conv_id // {TURN_DOCS} ORDER BY conv_id, turn) - 1 AS pos, text AS sentence, (turn = 0)::INT AS label FROM conversations"
SEGMENTED = f"SELECT *, sum(CASE WHEN pos > 0 THEN label ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS true_segment, (pos // 4)::INT AS pred_segment FROM ({TURNS})"
VECTORS = f"SELECT vec_id // {PER_DOC} AS doc_id, vec_id % {PER_DOC} AS pos, embedding::DOUBLE[] AS embedding FROM embeddings"
GAPS = f"SELECT *, CASE WHEN e0 IS NOT NULL THEN 1 - list_cosine_similarity(e0, embedding) END AS gap FROM (SELECT *, lag(embedding) OVER (PARTITION BY doc_id ORDER BY pos) AS e0, count(*) OVER (PARTITION BY doc_id) AS n FROM ({VECTORS}))"
RANKED = f"SELECT *, CASE WHEN gap IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC NULLS LAST, pos) END AS gap_rank FROM ({GAPS})"
PARAGRAPHS = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_no, {s_strip('line')} AS text,
 before + length(line) - length({sub('line', rf'\A{T.WS}+')}) AS start_pos
FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (RAW))
WHERE {s_strip('line')} <> ''"""


def s_paragraphs(source: str = "documents", text: str = "text") -> str:
    raw = f"SELECT doc_id, line_no - 1 AS line_no, lines[line_no] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT doc_id, string_split({text}, {LF}) AS lines FROM {source}))"
    return PARAGRAPHS.replace("(RAW)", f"({raw})")


def s_stats(x: str) -> str:
    """All statistics of a text: the words and parts are found once, in an inner list each."""
    w, parts = f"({s_words(s_clean(x))})", f"len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda s: regexp_matches(s, {q(f'[^{T.SPACE_CHARS}]')})))"
    n, unique, letters = f"len({w})", f"len(list_distinct({w}))", f"length(array_to_string({w}, ''))"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0::DOUBLE END"
    return (
        f"{n}::INT AS word_count, {parts}::INT AS sentence_count, length({x})::INT AS character_count, {share(letters, n)} AS avg_word_length, {share(n, parts)} AS avg_sentence_length, "
        f"{unique}::INT AS unique_words, {share(unique, n)} AS lexical_diversity, ({n} < 50) AS is_short, ({n} > 500) AS is_long"
    )


def with_stats(rows: DataFrame) -> DataFrame:
    """rows with the statistics of their text."""
    return rows.withColumn("s", M.text_statistics(F.col("text"))).select(*rows.columns, *[f"s.{c}" for c in M.STATISTICS])


# --- input with what the driver's tables lack ---------------------------------------------------------------------
#: A byte-order mark, line ends of two kinds, a word broken by a line end, invisible and control characters, blank
#: lines, Russian speech, private-use characters, quotes and dashes, fences.
HEAD = "\ufeffДобрый день, коллеги.\r\n\r\nТак, начинаем разбор темы. Сегодня рассмотрим пере-\nнос строки и\u200b пробелы \t в  тексте. Коротко.\n \n\n\nГлава 1\n"
TAIL = "\r\n\x07Символы \uf061\uf0b3\uf03d конец .Далее «цитата» – тире !\n\n```python\ndef f(x):\n    return x + 1\n```\n\n~~~\nlet y = 2;\n~~~\n \u00a0\u3000\n"
RICH = f"(SELECT doc_id, {q(HEAD)} || text || {q(TAIL)} AS text FROM documents)"


def rich(spark, sf_dir):
    """Documents between HEAD and TAIL."""
    return docs(spark, sf_dir).withColumn("text", F.concat(F.lit(HEAD), "text", F.lit(TAIL)))


# --- flagship -----------------------------------------------------------------------------------------------------
_NORMALIZED = f"(SELECT doc_id, {s_normalize('text')} AS text FROM documents)"


@query(f"SELECT doc_id, chunk_no::INT AS chunk_no, text, {s_stats('text')} FROM ({s_paragraphs(_NORMALIZED)})")
def paragraph_statistics(spark, sf_dir):
    """Normalised documents in paragraphs, with the statistics of each."""
    rows = docs(spark, sf_dir).withColumn("text", T.normalize(F.col("text")))
    return with_stats(P.split_paragraphs(rows, LINES).select("doc_id", "chunk_no", "text"))


# --- normalisation ------------------------------------------------------------------------------------------------
def _text_query(name, f, sql):
    def run(spark, sf_dir):
        return rich(spark, sf_dir).select("doc_id", f(F.col("text")).alias("out"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM {RICH}" if sql else None)(run)


def s_first_sentence(x: str) -> str:
    found = f"regexp_extract({s_strip(x)}, {q(r'\A[^\n]*?[.!?]')})"
    return f"CASE WHEN {found} <> '' THEN {s_strip(found)} ELSE {s_strip(f'split_part({x}, {LF}, 1)')} END"


def s_language(x: str) -> str:
    low = f"lower(substr({x}, 1, 500))"
    has = lambda *words: " AND ".join(f"contains({low}, {q(w)})" for w in words)
    include = f"{has('#include')} AND ({has('<')} OR {has('"')})"
    cases = ((has("def ", ":"), "python"), (has("function ", "{"), "javascript"), (has("public static void main"), "java"), (include, "c/c++"), (has("using namespace std;"), "c++"), (has("package ", ";"), "java"))
    return "CASE " + " ".join(f"WHEN {c} THEN {q(name)}" for c, name in cases) + " ELSE 'unknown' END"


_text_query("normalize", T.normalize, s_normalize("text"))
_text_query("normalize_aggressive", lambda c: T.normalize(c, True), s_punctuation(s_normalize("text")))
_text_query("remove_invisible", T.remove_invisible, s_invisible("text"))
_text_query("normalize_linebreaks", T.normalize_linebreaks, s_breaks("text"))
_text_query("join_hyphenated", T.join_hyphenated, sub("text", r"-\r?\n"))
_text_query("remove_control", T.remove_control, s_control("text"))
_text_query("normalize_spaces", T.normalize_spaces, s_spaces("text"))
_text_query("normalize_punctuation", T.normalize_punctuation, s_punctuation("text"))
_text_query("normalize_whitespace", T.normalize_whitespace, s_strip(sub(sub("text", r"\r\n|\r", LF), r"[ \t]+", "' '")))
_text_query("repair_symbols", T.repair_symbols, f"translate(text, {q(T.SYMBOL_FROM)}, {q(T.SYMBOL_TO)})")
#: Markup of every kind around a document, and formulas that look like markup.
MARKDOWN = "# Title *one* and **two** ***three***\n\n> quoted ~~gone~~ text\n> more\n\n- a [link](http://x.y/z) here\n* ![image](pic.png) there\n+ item __four__ or _five_, not snake_case_name\n2. second   $a*b*c$ and $$x_1\n_2_$$ kept\n"


def s_clean_markdown(x: str) -> str:
    """The same rules in their order, in a language without look-around: runs of stars are set aside before single ones."""
    protected = q(r"(?s)(\$\$.*?\$\$|\$.*?\$)")
    found, pieces = f"regexp_extract_all({x}, {protected})", f"regexp_split_to_array({x}, {protected})"
    mark = "'<<<MD_FORMULA_' || i || '>>>'"
    out = f"array_to_string(list_transform(range(0, len({pieces})), lambda i: ({pieces})[i + 1] || CASE WHEN i < len({found}) THEN {mark} ELSE '' END), '')"
    one, word = q(r"\1"), r"[^\p{L}\p{N}_]"
    for pattern, by in ((r"!\[[^\n]*?\]\([^\n]*?\)", "''"), (r"\[([^\]]*)\]\([^)]*\)", one), (r"\*\*\*([^\n]*?)\*\*\*", one), (r"\*\*([^\n]*?)\*\*", one), (r"__([^\n]*?)__", one)):
        out = sub(out, pattern, by)
    aside = f"replace(replace({out}, '**', chr(2) || chr(2)), chr(2) || '*', chr(2) || chr(2))"
    out = f"replace({sub(aside, r'\*([^\n]*?)\*', one)}, chr(2), '*')"
    out = sub(out, rf"(?m)(^|{word})_([^\n]*?)_($|{word})", q(r"\1\2\3"))
    for pattern, by in ((r"~~([^\n]*?)~~", one), (rf"(?m)^>{T.WS}?", "''"), (rf"(?m)^#{{1,6}}{T.WS}+", "''"), (rf"(?m)^{T.WS}*[-*+]{T.WS}+", "''"), (rf"(?m)^{T.WS}*\p{{Nd}}+\.{T.WS}+", "''"), (r"[ \t]+", "' '"), (r" *\n *", LF), (r"\n{3,}", f"{LF} || {LF}")):
        out = sub(out, pattern, by)
    pairs = f"list_transform(range(0, len({found})), lambda i: {mark} || chr(3) || ({found})[i + 1])"
    return f"list_reduce({pairs}, lambda held, p: replace(held, split_part(p, chr(3), 1), split_part(p, chr(3), 2)), {s_strip(out)})"


@query(f"SELECT doc_id, {s_clean_markdown('text')} AS out FROM (SELECT doc_id, {q(MARKDOWN)} || text AS text FROM documents)")
def clean_markdown_text(spark, sf_dir):
    """Documents after a head of Markdown."""
    return docs(spark, sf_dir).select("doc_id", clean_markdown(F.concat(F.lit(MARKDOWN), F.col("text"))).alias("out"))


_text_query("clean_for_analysis", M.clean_for_analysis, s_clean("text"))
_text_query("first_sentence", M.first_sentence, s_first_sentence("text"))
_SPOKEN = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(T.IRRELEVANT_PHRASES)})(?:[^\p{{L}}\p{{N}}_]|$)"
_text_query("clean_speech", T.clean_speech, f"coalesce(array_to_string(list_filter({s_raw_sentences('text')}, lambda s: NOT regexp_matches(lower(s), {q(_SPOKEN)}) AND length({s_strip('s')}) >= {T.MIN_SENTENCE}), ' '), '')")
_text_query("guess_language", C.guess_language, s_language("text"))


@query(f"SELECT doc_id, length(text)::INT AS original_length, length({s_normalize('text')})::INT AS normalized_length, 0 AS removed_special_chars, 0 AS normalized_linebreaks, 0 AS normalized_spaces FROM {RICH}")
def normalization_stats(spark, sf_dir):
    return rich(spark, sf_dir).select("doc_id", T.normalization_stats(F.col("text"), T.normalize(F.col("text"))).alias("s")).select("doc_id", "s.*")


# --- metadata -----------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {s_stats('text')} FROM documents")
def text_statistics(spark, sf_dir):
    return with_stats(docs(spark, sf_dir)).drop("text")


def _s_topic(x):
    score = {t: " + ".join(f"contains(lower({x}), {q(k)})::INT" for k in keys) for t, keys in M.TOPICS.items()}
    best = f"greatest({', '.join(f'({v})' for v in score.values())})"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN ({v}) = {best} THEN {q(t)}" for t, v in score.items()) + " END"


@query(f"SELECT doc_id, coalesce({_s_topic('f')}, {_s_topic('c')}, {q(M.NO_TOPIC)}) AS main_topic, CASE WHEN {_s_topic('f')} IS NOT NULL THEN 'first_sentence' WHEN {_s_topic('c')} IS NOT NULL THEN 'full_text' ELSE 'unknown' END AS source FROM (SELECT doc_id, f, {s_clean('text')} AS c FROM documents JOIN (SELECT doc_id, {s_first_sentence('text')} AS f FROM documents) USING (doc_id))")
def main_topic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.main_topic(F.col("text")).alias("t")).select("doc_id", "t.main_topic", "t.source")


_KEPT = f"SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: NOT list_contains({s_list(M.STOP_WORDS_RU + M.STOP_WORDS_EN)}, x))) > 0 THEN list_filter(w, lambda x: NOT list_contains({s_list(M.STOP_WORDS_RU + M.STOP_WORDS_EN)}, x)) ELSE w END AS w FROM (SELECT doc_id, list_filter({s_words(s_clean('text'))}, lambda x: length(x) > 2) AS w FROM documents)"


@query(f"SELECT doc_id, rank::INT AS rank, term, frequency FROM (SELECT doc_id, term, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first) AS rank FROM (SELECT doc_id, w[i] AS term, count(*) AS frequency, min(i) AS first FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM ({_KEPT})) GROUP BY ALL)) WHERE rank <= 8")
def top_keywords(spark, sf_dir):
    return keywords(docs(spark, sf_dir), 8)


_TERMS = f"SELECT doc_id, term, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first) AS rank FROM (SELECT doc_id, w[i] AS term, count(*) AS frequency, min(i) AS first FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM ({_KEPT})) GROUP BY ALL)"


@query(f"""SELECT doc_id, coalesce(key_terms, '') AS key_terms, coalesce(frequencies, '') AS frequencies, coalesce(n, 0)::INT AS unique_terms_count, least(0.95, coalesce(n, 0) / 20)::DOUBLE AS keyword_confidence
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY rank) FILTER (rank <= 8) AS key_terms, string_agg(frequency::VARCHAR, ' ' ORDER BY rank) FILTER (rank <= 8) AS frequencies FROM ({_TERMS}) GROUP BY doc_id) USING (doc_id)""")
def keyword_metadata(spark, sf_dir):
    k = keyword_summary(docs(spark, sf_dir), 8)
    return k.select("doc_id", F.concat_ws(" ", "key_terms").alias("key_terms"), F.concat_ws(" ", F.transform("key_terms", lambda t: F.col("term_frequencies")[t].cast("string"))).alias("frequencies"), "unique_terms_count", "keyword_confidence")


# --- splitters ----------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, (pos - 1)::INT AS pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {s_sentences('text')} AS s FROM documents))")
def split_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, chunk_no::INT AS chunk_no, text, start_pos::INT AS start_pos, (start_pos + length(text))::INT AS end_pos, {s_chunk_id('text', 'chunk_no')} AS chunk_id, 'paragraph' AS splitter_type, chunk_no::INT AS paragraph_number, {s_header('text')} AS is_header FROM ({s_paragraphs()})")
def split_paragraphs(spark, sf_dir):
    return P.split_paragraphs(docs(spark, sf_dir), LINES)


_BLANK_LINES = f"SELECT doc_id, m, p FROM (SELECT doc_id, regexp_extract_all(text, {q(rf'\n{T.WS}*\n')}) AS m, regexp_split_to_array(text, {q(rf'\n{T.WS}*\n')}) AS p FROM {RICH})"
_BETWEEN_BLANKS = f"SELECT doc_id, i, p[i] AS raw, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS before FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM ({_BLANK_LINES}))"


@query(f"""SELECT doc_id, chunk_no::INT AS chunk_no, text, s::INT AS start_pos, (s + length(text))::INT AS end_pos, {s_header('text')} AS is_header FROM (
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, {s_strip('raw')} AS text, before + length(raw) - length({sub('raw', rf'\A{T.WS}+')}) AS s FROM ({_BETWEEN_BLANKS}) WHERE {s_strip('raw')} <> '')""")
def split_at_blank_lines(spark, sf_dir):
    """Paragraphs by the default separator."""
    return P.split_paragraphs(rich(spark, sf_dir)).select("doc_id", "chunk_no", "text", "start_pos", "end_pos", "is_header")


_FIXED = P.SplitterConfig(max_chunk_size=500)
_AHEAD = "substr(text, p + 1, 101)"


@query(f"""WITH RECURSIVE w AS (
 SELECT doc_id, text, 0 AS s, 0 AS e FROM documents
 UNION ALL
 SELECT doc_id, text, e AS s, (CASE WHEN p < length(text) AND b > e + 100 THEN b ELSE p END)::INT AS e FROM (
  SELECT *, CASE WHEN hit BETWEEN 1 AND 100 THEN p + hit ELSE p END AS b FROM (
   SELECT *, length(regexp_extract({_AHEAD}, {q(rf'(?s)^(.*?[.!?])(?:{T.WS}|\z)')}, 1)) AS hit FROM (
    SELECT doc_id, text, e, least(e + 500, length(text)) AS p FROM w WHERE e < length(text)))))
SELECT doc_id, chunk_no::INT AS chunk_no, t AS text, s::INT AS start_pos, e::INT AS end_pos, {s_chunk_id('t', 'chunk_no')} AS chunk_id, 'fixed_size' AS splitter_type, length(t)::INT AS chunk_size, chunk_no > 0 AS has_overlap
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_no FROM (SELECT doc_id, s, e, {s_strip('substr(text, s + 1, e - s)')} AS t FROM w WHERE e > s) WHERE length(t) >= 100)""")
def split_fixed_size(spark, sf_dir):
    return P.split_fixed(docs(spark, sf_dir), _FIXED)


def s_semantic(source: str = "documents") -> str:
    """A step for each paragraph, which joins the open chunk or opens the next; of each chunk the last step is shown."""
    words = f"list_distinct(list_filter({s_words('lower(text)')}, lambda x: length(x) >= 4))"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, chunk_no::INT AS number, text, start_pos::INT AS s, (start_pos + length(text))::INT AS e, {words} AS w, {s_header('text')} AS h FROM ({s_paragraphs(source)})),
g AS (SELECT doc_id, number, 0 AS c, text, s, e, w, [number] AS numbers, h FROM p WHERE number = 0
 UNION ALL SELECT doc_id, number, CASE WHEN shut THEN c + 1 ELSE c END, CASE WHEN shut THEN t2 ELSE joined END, CASE WHEN shut THEN s2 ELSE s END, e2, CASE WHEN shut THEN w2 ELSE list_distinct(list_concat(w, w2)) END,
  CASE WHEN shut THEN [number] ELSE list_append(numbers, number) END, CASE WHEN shut THEN h2 ELSE h OR h2 END
 FROM (SELECT *, NOT (len(w) > 0 AND len(w2) > 0 AND len(list_intersect(w, w2)) / greatest(least(len(w), len(w2)), 1) >= 0.3) OR length(joined) > 2000 AS shut
  FROM (SELECT g.doc_id, p.number, g.c, g.text || {LF} || {LF} || p.text AS joined, g.s, g.w, g.numbers, g.h, p.text AS t2, p.s AS s2, p.e AS e2, p.w AS w2, p.h AS h2 FROM g JOIN p ON p.doc_id = g.doc_id AND p.number = g.number + 1)))
SELECT doc_id, c AS chunk_no, text, s AS start_pos, e AS end_pos, {s_chunk_id('text', 'c')} AS chunk_id, 'semantic' AS splitter_type, len(numbers)::INT AS paragraph_count, h AS contains_headers, array_to_string(numbers, ',') AS paragraph_numbers
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY number DESC) AS r FROM g) WHERE r = 1"""


@query(s_semantic())
def split_semantic(spark, sf_dir):
    return P.split_semantic(docs(spark, sf_dir), LINES).withColumn("paragraph_numbers", F.concat_ws(",", F.transform("paragraph_numbers", lambda x: x.cast("string"))))


@query(s_semantic(f"(SELECT doc_id, string_agg(text, {LF} || {LF} ORDER BY chunk_no) AS text FROM ({s_paragraphs()}) GROUP BY doc_id)"))
def split_mixed(spark, sf_dir):
    return P.split_mixed(docs(spark, sf_dir), LINES).withColumn("paragraph_numbers", F.concat_ws(",", F.transform("paragraph_numbers", lambda x: x.cast("string"))))


def _hashed_embedding(sentence, dim=16):
    """A stand-in for a sentence encoder: counts of words by length and first character."""
    at = F.transform(T.words(F.lower(sentence)), lambda w: (F.length(w) * 7 + F.ascii(w)) % dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(at, lambda x: x == d)).cast("float"))


_SENTENCE_ROWS = f"SELECT doc_id, pos - 1 AS pos, s[pos] AS sentence, len(s) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {s_sentences('text')} AS s FROM documents) WHERE len(s) > 1)"
_COUNTS = f"SELECT *, list_transform(range(0, 16), lambda d: len(list_filter(a, lambda x: x = d))::DOUBLE) AS v FROM (SELECT *, list_transform({s_words('lower(sentence)')}, lambda w: (length(w) * 7 + unicode(w)) % 16) AS a FROM ({_SENTENCE_ROWS}))"
_SENTENCE_GAPS = f"SELECT *, CASE WHEN u IS NOT NULL THEN 1 - CASE WHEN uu * vv > 0 THEN list_inner_product(u, v) / (uu * vv) ELSE 0.0 END END AS gap FROM (SELECT *, sqrt(list_inner_product(v, v)) AS vv, sqrt(list_inner_product(u, u)) AS uu FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS u FROM ({_COUNTS})))"
_SENTENCE_CHUNKS = f"SELECT doc_id, c, string_agg(sentence, ' ' ORDER BY pos) AS t, count(*)::INT AS n FROM (SELECT *, sum(coalesce((gap_rank <= least(greatest(2, n // 5), 20, n) - 1)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS c FROM (SELECT *, CASE WHEN gap IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC NULLS LAST, pos) END AS gap_rank FROM ({_SENTENCE_GAPS}))) GROUP BY doc_id, c"


@query(f"""WITH RECURSIVE k AS MATERIALIZED ({_SENTENCE_CHUNKS}),
f AS (SELECT doc_id, -1 AS c, '' AS t, 0 AS n, 0 AS s, 0 AS e FROM k WHERE c = 0
 UNION ALL SELECT doc_id, c, t, n, b AS s, (b + length(t))::INT AS e FROM (SELECT k.doc_id, k.c, k.t, k.n, (f.e + greatest(strpos(substr(d.text, f.e + 1), k.t) - 1, 0))::INT AS b FROM f JOIN k ON k.doc_id = f.doc_id AND k.c = f.c + 1 JOIN documents d ON d.doc_id = f.doc_id))
SELECT doc_id, c AS chunk_no, t AS text, s AS start_pos, e AS end_pos, {s_chunk_id('t', 'c')} AS chunk_id, 'semantic_embedding' AS splitter_type, n AS num_sentences FROM f WHERE c >= 0
UNION ALL SELECT doc_id, 0, text, 0, length(text)::INT, {s_chunk_id('text', '0')}, NULL, NULL FROM documents WHERE len({s_sentences('text')}) <= 1""")
def split_embedding(spark, sf_dir):
    return P.split_embedding(docs(spark, sf_dir), encoder=_hashed_embedding)


@query(f"SELECT doc_id, chunk_no::INT AS chunk_no, n_shared::INT AS n_shared, a > 0 AND b > 0 AND n_shared / least(a, b) >= 0.3 AS related FROM (SELECT doc_id, chunk_no, len(w) AS a, len(v) AS b, len(list_intersect(w, v)) AS n_shared FROM (SELECT doc_id, chunk_no, w, lead(w) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS v FROM (SELECT doc_id, chunk_no, list_distinct(list_filter({s_words('lower(text)')}, lambda x: length(x) >= 4)) AS w FROM ({s_paragraphs()}))) WHERE v IS NOT NULL)")
def related_paragraphs(spark, sf_dir):
    """Whether neighbouring paragraphs share enough words."""
    rows = P.split_paragraphs(docs(spark, sf_dir), LINES).select("doc_id", "chunk_no", P.word_set(F.col("text")).alias("w"))
    rows = rows.withColumn("v", F.lead("w").over(Window.partitionBy("doc_id").orderBy("chunk_no"))).where("v IS NOT NULL")
    return rows.select("doc_id", "chunk_no", F.size(F.array_intersect("w", "v")).alias("n_shared"), P.related_sets(F.col("w"), F.col("v")).alias("related"))


@query(f"SELECT doc_id, chunk_no::INT AS chunk_no, length(text) BETWEEN 100 AND 2000 AS valid FROM ({s_paragraphs()})")
def valid_sizes(spark, sf_dir):
    return P.split_paragraphs(docs(spark, sf_dir), LINES).select("doc_id", "chunk_no", P.valid_size(F.col("text")).alias("valid"))


# --- formulas and code --------------------------------------------------------------------------------------------
@query()
def formulas(spark, sf_dir):
    found = FO.extract_formulas(docs(spark, sf_dir))
    return found.select("doc_id", F.explode("formulas").alias("f")).select("doc_id", "f.original", "f.normalized", "f.start_pos", "f.end_pos", "f.formula_type", "f.placeholder")


#: Formulas of each kind, and what looks like one and isn't: between them there are no others.
MATH = r"Let $a + b = c_1$ be so, and \[x^2 - y\] or $$\frac{p}{q} = 7$$ too; costs \$5 and $5 x$ here. E = mc^2 holds, and k=3*n+1, but 2024 and well-known do not. "
_MATH_FOUND = (
    ("latex_inline", "$a + b = c_1$", "a + b = c_1", "a + b = c_1"), ("latex_display", r"\[x^2 - y\]", r"\[x^2 - y\]", "x^2 - y"), ("latex_display", r"$$\frac{p}{q} = 7$$", r"$$\frac{p}{q} = 7$$", r"\frac{p}{q} = 7"),
    ("plain_text", "E = mc^2", "E = mc^2", "E = mc**2"), ("plain_text", "k=3*n+1,", "k=3*n+1,", "k=3*n+1,"),
)


@query(
    f"SELECT doc_id, copy, kind AS formula_type, original, normalized, (copy * {len(MATH)} + strpos({q(MATH)}, whole) - 1)::INT AS start_pos, (copy * {len(MATH)} + strpos({q(MATH)}, whole) - 1 + length(whole))::INT AS end_pos "
    f"FROM documents, (SELECT unnest(range(0, 2)) AS copy), (VALUES {', '.join('(' + ', '.join(map(q, row)) + ')' for row in _MATH_FOUND)}) t(kind, whole, original, normalized)"
)
def formulas_of_each_kind(spark, sf_dir):
    """Two copies of a text with formulas, for each document: kinds, normal forms and places."""
    found = FO.extract_formulas(docs(spark, sf_dir).withColumn("text", F.lit(MATH * 2)))
    rows = found.select("doc_id", F.explode("formulas").alias("f")).select("doc_id", "f.formula_type", "f.original", "f.normalized", "f.start_pos", "f.end_pos")
    return rows.withColumn("copy", F.floor(F.col("start_pos") / len(MATH)))


@query("SELECT doc_id, text AS restored, true AS placed FROM documents")
def formula_round_trip(spark, sf_dir):
    """Texts restored from their placeholders, and whether formulas are where they are said to be."""
    found = FO.extract_formulas(docs(spark, sf_dir))
    placed = F.forall("formulas", lambda f: (F.substring(F.col("text"), f["start_pos"] + 1, f["end_pos"] - f["start_pos"]) == f["full"]))
    return found.select("doc_id", FO.restore_formulas(F.col("text_with_placeholders"), F.col("formulas")).alias("restored"), placed.alias("placed"))


_TOKENS = f"SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, {q(T.WS + '+')}), lambda x: x <> '')) AS token FROM documents"


@query(f"""SELECT token, count(*) AS n, NOT (regexp_matches(token, {q(r'^[\p{Nd}.]+$')}) AND length(token) <= 4) AND regexp_matches(token, {q(FO.MATH_CHARS)})
 AND NOT (length({sub('token', r'[^\p{L}]')}) > 0.8 * length(token) AND NOT regexp_matches(token, '[α-ωΑ-Ω]')) AND (regexp_matches(token, {q(r'\p{Nd}')}) OR length(token) <= 10) AS looks,
 replace(translate(token, '×·÷–—', '**/--'), '^', '**') AS plain FROM ({_TOKENS}) GROUP BY token""")
def formula_tokens(spark, sf_dir):
    """Distinct tokens: whether they look like a formula, and their plain form."""
    tokens = docs(spark, sf_dir).select(F.explode(F.filter(F.split("text", f"{T.WS}+"), lambda x: x != "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", "n", FO.looks_like_formula(F.col("token")).alias("looks"), FO.normalize_plain(F.col("token")).alias("plain"))


_SPLIT = f"SELECT doc_id, line_no - 1 AS line_no, lines[line_no] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT doc_id, regexp_split_to_array(text, {q(C.LINE_END)}) AS l FROM {RICH})))"
CODE_LINES = f"SELECT doc_id, line_no, line, {s_code_line('line')} AS is_code, NOT regexp_matches(line, {q(f'[^{T.SPACE_CHARS}]')}) AS is_blank FROM ({_SPLIT})"


@query(f"SELECT doc_id, line_no::INT AS line_no, is_code, is_blank FROM ({CODE_LINES})")
def code_lines(spark, sf_dir):
    return CO.classified_lines(rich(spark, sf_dir)).select("doc_id", "line_no", "is_code", "is_blank")


CODE_BLOCKS = f"""SELECT doc_id, min(line_no)::INT AS first_line, string_agg(line, {LF} ORDER BY line_no) AS code FROM (
 SELECT *, max(CASE WHEN is_code THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS begun FROM (
  SELECT *, sum((NOT is_code AND NOT is_blank)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM ({CODE_LINES})) WHERE is_code OR is_blank) WHERE begun = 1 GROUP BY doc_id, run"""
_LOOSE = f"SELECT doc_id, first_line, code, {s_language('code')} AS language, (strpos(text, code) - 1)::INT AS start_pos, (strpos(text, code) - 1 + length(code))::INT AS end_pos FROM ({CODE_BLOCKS}) JOIN {RICH} USING (doc_id)"


@query(f"SELECT doc_id, first_line, code, language, start_pos, end_pos FROM ({_LOOSE})")
def code_blocks(spark, sf_dir):
    return CO.heuristic_blocks(rich(spark, sf_dir))


def _s_fences(mark: str) -> str:
    pattern = rf"(?s){mark}([\p{{L}}\p{{N}}_]*)\n(.*?)\n{mark}"
    before = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    split = f"SELECT doc_id, regexp_extract_all(text, {q(pattern)}) AS m, regexp_split_to_array(text, {q(pattern)}) AS p FROM {RICH}"
    return f"SELECT doc_id, regexp_extract(m[i], {q(pattern)}, 2) AS code, regexp_extract(m[i], {q(pattern)}, 1) AS tag, ({before})::INT AS start_pos, ({before} + length(m[i]))::INT AS end_pos FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({split}))"


_FENCED = f"SELECT doc_id, code, CASE WHEN tag <> '' THEN tag ELSE {s_language('code')} END AS language, start_pos, end_pos FROM ({_s_fences('```')} UNION {_s_fences('~~~')})"


@query(_FENCED)
def fenced_code(spark, sf_dir):
    return CO.fenced_blocks(rich(spark, sf_dir))


@query(f"""WITH f AS ({_FENCED}), l AS (SELECT * FROM ({_LOOSE}) x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = x.doc_id AND f.start_pos < x.end_pos AND x.start_pos < f.end_pos))
SELECT *, 'fenced' AS kind FROM f UNION ALL SELECT doc_id, code, language, start_pos, end_pos, 'heuristic' FROM l x
WHERE NOT EXISTS (SELECT 1 FROM l y WHERE y.doc_id = x.doc_id AND y.first_line < x.first_line AND y.start_pos < x.end_pos AND x.start_pos < y.end_pos)""")
def extract_code(spark, sf_dir):
    return CO.extract_code(rich(spark, sf_dir))


@query("SELECT doc_id, text AS restored FROM documents")
def code_round_trip(spark, sf_dir):
    """Heuristic blocks that have a place in the text, replaced by placeholders and restored, give the text."""
    d = docs(spark, sf_dir)
    blocks = CO.apart_in_order(CO.heuristic_blocks(d).where("start_pos >= 0")).groupBy("doc_id").agg(F.collect_list(F.struct("code", "language", "start_pos", "end_pos")).alias("blocks"))
    joined = d.join(blocks, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.expr("array()").cast("array<struct<code:string,language:string,start_pos:int,end_pos:int>>")))
    there = CO.restore_code(CO.replace_code(F.col("text"), F.col("blocks")), F.col("blocks"))
    return joined.select("doc_id", there.alias("restored"))


# --- segmentation -------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, pos::INT AS pos, sum(CASE WHEN pos > 0 THEN label ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS segment FROM ({TURNS})")
def labels_to_segments(spark, sf_dir):
    return S.labels_to_segments(turns(spark, sf_dir)).select("doc_id", "pos", "segment")


@query(f"SELECT doc_id, pos, sum(coalesce((1 - gap < 0.05)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS segment FROM ({GAPS})")
def greedy_segments(spark, sf_dir):
    return S.greedy(vectors(spark, sf_dir), 0.05).select("doc_id", "pos", "segment")


@query(f"SELECT doc_id, pos, sum(coalesce((gap_rank <= least(greatest(2, n // 4), n) - 1)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS segment FROM ({RANKED})")
def hierarchical_alpha(spark, sf_dir):
    return S.gap_cut(vectors(spark, sf_dir), alpha=4).select("doc_id", "pos", "segment")


@query(f"SELECT doc_id, pos, sum(coalesce((gap_rank <= 2)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS segment FROM ({RANKED})")
def hierarchical_k(spark, sf_dir):
    return S.gap_cut(vectors(spark, sf_dir), k=3).select("doc_id", "pos", "segment")


@query(f"""SELECT doc_id, (pos - 1)::INT AS pair_index, (k - 1)::INT AS feature, CASE WHEN k = 129 THEN round(1 - gap, 6) ELSE x[k] END AS value, (pos % 5 = 0)::INT AS label FROM (
 SELECT *, list_concat(list_concat(e0, embedding), list_concat([0.0::DOUBLE], list_transform(range(1, len(embedding) + 1), lambda i: e0[i] - embedding[i]))) AS x, unnest(range(1, 194)) AS k FROM ({GAPS}) WHERE gap IS NOT NULL)""")
def pair_features(spark, sf_dir):
    """Every feature of every pair; the cosine is rounded."""
    pairs = S.pair_features(vectors(spark, sf_dir).withColumn("label", (F.col("pos") % 5 == 0).cast("int")))
    rows = pairs.select("doc_id", "pair_index", "label", F.posexplode("features").alias("feature", "value"))
    return rows.withColumn("value", F.when(F.col("feature") == 128, F.round("value", 6)).otherwise(F.col("value")))


@query()
def boundary_model(spark, sf_dir):
    """Boundaries of all pseudo-documents, told by a balanced logistic regression fitted to the train part of them."""
    pairs = S.pair_features(vectors(spark, sf_dir).withColumn("label", (F.col("pos") % 5 == 0).cast("int")))
    pairs = pairs.join(D.train_test_split(pairs.select("doc_id").distinct()), "doc_id")
    model = S.fit_boundaries(pairs.where(~F.col("is_test")))
    return S.predict_boundaries(model, pairs, keep=["is_test"])


@query(f"SELECT doc_id, pos::INT AS pos, (e - length(sentence))::INT AS start_pos, e::INT AS end_pos FROM (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e FROM ({TURNS}))")
def sentence_positions(spark, sf_dir):
    return S.sentence_positions(turns(spark, sf_dir)).select("doc_id", "pos", "start_pos", "end_pos")


@query(f"""WITH s AS (SELECT doc_id, pos, e - length(sentence) AS a, e AS b, max(e) OVER (PARTITION BY doc_id) AS total FROM (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e FROM ({TURNS})))
SELECT doc_id, chunk_no::INT AS chunk_no, pos::INT AS pos FROM (SELECT *, unnest(range(0, ((total + 299) // 300)::BIGINT)) AS chunk_no FROM s) WHERE greatest(chunk_no * 300, a) < least((chunk_no + 1) * 300, b)""")
def chunk_sentences(spark, sf_dir):
    """Which turns the chunks of 300 characters of a document overlap."""
    s = S.sentence_positions(turns(spark, sf_dir))
    total = s.groupBy("doc_id").agg(F.max("end_pos").alias("total"))
    chunks = total.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") + 299) / 300).cast("int") - 1)).alias("chunk_no")).withColumn("start_pos", F.col("chunk_no") * 300).withColumn("end_pos", (F.col("chunk_no") + 1) * 300)
    return S.chunk_sentences(s, chunks)


# --- metrics ------------------------------------------------------------------------------------------------------
def s_bounds(source: str, keys: str = "doc_id") -> str:
    w = f"(PARTITION BY {keys} ORDER BY pos)"
    return f"SELECT {keys}, pos, n, (lead(true_segment) OVER {w} <> true_segment)::INT AS t, (lead(pred_segment) OVER {w} <> pred_segment)::INT AS p FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM ({source}))"


def s_windows(source: str, keys: str = "doc_id") -> str:
    both = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"SELECT {own}, a.pos, sum(b.t) AS t, sum(b.p) AS p FROM ({s_bounds(source, keys)}) a JOIN ({s_bounds(source, keys)}) b ON {both} AND b.pos BETWEEN a.pos AND a.pos + greatest(1, a.n // 20) - 1 WHERE a.pos < a.n - greatest(1, a.n // 20) GROUP BY {own}, a.pos"


def s_boundary_f1(source: str, keys: str = "doc_id") -> str:
    """Each true boundary in order takes the first free prediction beside it: a step for each, by recursion."""
    places = f"SELECT {keys}, coalesce(list(pos ORDER BY pos) FILTER (t = 1), []) AS tp, coalesce(list(pos ORDER BY pos) FILTER (p = 1), []) AS pp FROM ({s_bounds(source, keys)}) GROUP BY {keys}"
    return f"""WITH RECURSIVE m AS (SELECT {keys}, 0 AS k, 0 AS hits, pp AS free, tp, len(pp) AS n FROM ({places})
 UNION ALL SELECT {keys}, k + 1, hits + (near IS NOT NULL)::INT, CASE WHEN near IS NULL THEN free ELSE list_filter(free, lambda x: x <> near) END, tp, n
 FROM (SELECT *, list_filter(free, lambda x: abs(x - tp[k + 1]) <= 1)[1] AS near FROM m WHERE k < len(tp)))
SELECT {keys}, CASE WHEN len(tp) = 0 AND n = 0 THEN 1.0::DOUBLE WHEN hits = 0 THEN 0.0::DOUBLE ELSE 2 * hits / (len(tp) + n) END AS boundary_f1 FROM m WHERE k = len(tp)"""


_B = s_bounds(SEGMENTED)
_W = s_windows(SEGMENTED)


@query(f"SELECT doc_id, n::INT AS n, coalesce(pk, 0) AS pk, coalesce(wd, 0) AS windowdiff FROM (SELECT doc_id, count(*) AS n FROM ({TURNS}) GROUP BY doc_id) LEFT JOIN (SELECT doc_id, round(avg(((t > 0) <> (p > 0))::INT), 9) AS pk, round(avg(abs(t - p)), 9) AS wd FROM ({_W}) GROUP BY doc_id) USING (doc_id)")
def pk_windowdiff(spark, sf_dir):
    s = E.scores(E.boundaries(segmented(spark, sf_dir)))
    return s.select("doc_id", "n", F.round("pk", 9).alias("pk"), F.round("windowdiff", 9).alias("windowdiff"))


@query(s_boundary_f1(SEGMENTED))
def boundary_f1(spark, sf_dir):
    return E.scores(E.boundaries(segmented(spark, sf_dir))).select("doc_id", "boundary_f1")


@query(f"WITH v AS (SELECT *, (pos // 5)::INT AS s FROM ({VECTORS})) SELECT doc_id, round(avg(sim), 6) AS intra FROM (SELECT a.doc_id, a.s, avg(list_cosine_similarity(a.embedding, b.embedding)) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.s = b.s AND a.pos < b.pos GROUP BY 1, 2) GROUP BY doc_id")
def intra_similarity(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("pred_segment", F.floor(F.col("pos") / 5).cast("int"))
    return E.intra_similarity(rows).select("doc_id", F.round("intra", 6).alias("intra"))


@query(f"SELECT doc_id, round(1.0 / count(DISTINCT true_segment), 9)::DOUBLE AS rel_chunk_size FROM ({SEGMENTED}) GROUP BY doc_id")
def relative_chunk_size(spark, sf_dir):
    return E.relative_chunk_size(segmented(spark, sf_dir), "true_segment").withColumn("rel_chunk_size", F.round("rel_chunk_size", 9))


def _methods(spark, sf_dir):
    """Scores of two stand-in methods: segments of four turns, and of six."""
    rows = segmented(spark, sf_dir)
    other = rows.withColumn("pred_segment", F.floor(F.col("pos") / 6).cast("int"))
    return E.scores(E.boundaries(rows)).withColumn("method", F.lit("four")).unionByName(E.scores(E.boundaries(other)).withColumn("method", F.lit("six")))


def _s_methods(step, name):
    w = s_windows(SEGMENTED.replace("pos // 4", f"pos // {step}"))
    return f"SELECT '{name}' AS method, doc_id, coalesce(pk, 0) AS pk, coalesce(wd, 0) AS windowdiff FROM (SELECT doc_id FROM ({TURNS}) GROUP BY doc_id) LEFT JOIN (SELECT doc_id, avg(((t > 0) <> (p > 0))::INT) AS pk, avg(abs(t - p)) AS wd FROM ({w}) GROUP BY doc_id) USING (doc_id)"


_BOTH = f"{_s_methods(4, 'four')} UNION ALL {_s_methods(6, 'six')}"


@query(f"SELECT method, round(avg(pk), 6) AS pk_mean, round(stddev_samp(pk), 6) AS pk_std, round(avg(windowdiff), 6) AS windowdiff_mean, round(stddev_samp(windowdiff), 6) AS windowdiff_std FROM ({_BOTH}) GROUP BY method")
def benchmark_summary(spark, sf_dir):
    s = E.summary(_methods(spark, sf_dir), ["pk", "windowdiff"])
    return s.select("method", *[F.round(c, 6).alias(c) for c in ("pk_mean", "pk_std", "windowdiff_mean", "windowdiff_std")])


@query(f"SELECT doc_id, " + ", ".join(f"round(max(CASE WHEN method = '{m}' THEN {c} END), 9) AS {m}_{c}" for m in ("four", "six") for c in ("pk", "windowdiff")) + f" FROM ({_BOTH}) GROUP BY doc_id")
def wide_results(spark, sf_dir):
    wide = E.wide_results(_methods(spark, sf_dir), ["four", "six"], ["pk", "windowdiff"])
    return wide.select("doc_id", *[F.round(c, 9).alias(c) for c in wide.columns if c != "doc_id"])


@query()
def benchmark_run(spark, sf_dir):
    """All eight methods and four scores over documents of ten conversations, learned from the train part of them."""
    rows = turns(spark, sf_dir).withColumns({"minilm": _hashed_embedding(F.col("sentence")), "rubert": _hashed_embedding(F.col("sentence"), 8)})
    parts = D.train_test_split(rows.select("doc_id").distinct())
    split = rows.join(parts, "doc_id")
    wide = benchmark(rows, split.where(~F.col("is_test")).drop("is_test")).join(parts, "doc_id")
    return wide.select("doc_id", "is_test", "n_sentences", *[F.round(c, 9).alias(c) for c in wide.columns if c not in ("doc_id", "is_test", "n_sentences")])


def s_draw(seed: int, *columns: str) -> str:
    told = " || ':' || ".join([q(str(seed)), *(f"coalesce({c}::VARCHAR, 'null')" for c in columns)])
    return f"('0x' || substr(md5({told}), 1, 15))::BIGINT"


_WEIGHT = " + ".join(f"(u >= {b!r}::DOUBLE)::INT" for b in E.poisson_bounds())
_MEANS = f"SELECT b, sum(w * pk) / sum(w) AS m FROM (SELECT *, {_WEIGHT} AS w FROM (SELECT doc_id, b, pk, {s_draw(42, 'doc_id', 'b')} / {2.0**60!r}::DOUBLE AS u FROM ({SQL['pk_windowdiff']}), (SELECT unnest(range(1, 1001)) AS b))) GROUP BY b"


@query(f"SELECT (SELECT round(avg(pk), 6) FROM ({SQL['pk_windowdiff']})) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM ({_MEANS})")
def bootstrap_interval(spark, sf_dir):
    ci = E.bootstrap_ci(E.scores(E.boundaries(segmented(spark, sf_dir))).select("doc_id", "pk"), "pk")
    return ci.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


# --- data preparation ---------------------------------------------------------------------------------------------
@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents")
def renumber(spark, sf_dir):
    return D.renumber(docs(spark, sf_dir).select("doc_id")).select("doc_id", "number")


_DRAWN = f"SELECT doc_id, {s_draw(42, 'doc_id')} AS h FROM documents"


@query(f"SELECT doc_id FROM ({_DRAWN}) ORDER BY h, doc_id LIMIT 300")
def sample_documents(spark, sf_dir):
    """The 300 sampled ids: sampling is what this operator does."""
    return D.sample_documents(docs(spark, sf_dir).select("doc_id"), 300)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) <= ceil(0.3 * count(*) OVER ()) AS is_test FROM ({_DRAWN})")
def train_test_split(spark, sf_dir):
    return D.train_test_split(docs(spark, sf_dir).select("doc_id"))


@query(f"SELECT doc_id, (h % 5)::INT AS fold FROM ({_DRAWN})")
def folds(spark, sf_dir):
    return D.folds(docs(spark, sf_dir).select("doc_id"))


@query(f"""SELECT doc_id, alpha, pos, sum((pos > 0 AND pos % 5 = 0)::INT) OVER w::INT AS true_segment, sum(coalesce((gap_rank <= least(greatest(2, n // alpha), n) - 1)::INT, 0)) OVER w::INT AS pred_segment
FROM ({RANKED}), (SELECT unnest([2, 3, 4, 5, 6, 7, 8]) AS alpha) WINDOW w AS (PARTITION BY doc_id, alpha ORDER BY pos)""")
def tuning_grid(spark, sf_dir):
    rows = D.tuning_rows(vectors(spark, sf_dir).withColumn("label", (F.col("pos") % 5 == 0).cast("int")))
    return rows.select("doc_id", "alpha", "pos", "true_segment", "pred_segment")


_ALPHAS = "doc_id, alpha"
_TUNED = f"""SELECT doc_id, alpha, boundary_f1, coalesce(pk, 0) AS pk, coalesce(wd, 0) AS windowdiff, {s_draw(42, 'doc_id')} % 5 AS fold FROM ({s_boundary_f1(SQL['tuning_grid'], _ALPHAS)})
LEFT JOIN (SELECT {_ALPHAS}, avg(((t > 0) <> (p > 0))::INT) AS pk, avg(abs(t - p)) AS wd FROM ({s_windows(SQL['tuning_grid'], _ALPHAS)}) GROUP BY {_ALPHAS}) USING (doc_id, alpha)"""
_SCORES = ("boundary_f1", "pk", "windowdiff")
_FOLD_MEANS = f"SELECT alpha, fold, {', '.join(f'avg({m}) AS {m}' for m in _SCORES)} FROM ({_TUNED}) GROUP BY alpha, fold"


@query(f"SELECT alpha, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std' for m in _SCORES)}, 'own' AS model FROM ({_FOLD_MEANS}) GROUP BY alpha ORDER BY boundary_f1_mean DESC, alpha LIMIT 1")
def tuning_best(spark, sf_dir):
    """The best alpha by cross-validated F1, against segments of five sentences."""
    rows = D.tuning_rows(vectors(spark, sf_dir).withColumn("label", (F.col("pos") % 5 == 0).cast("int")))
    keyed = rows.withColumn("key", F.struct("doc_id", "alpha"))
    s = E.scores(E.boundaries(keyed, "key"), doc_col="key").select("key.*", *_SCORES)
    cv = D.cross_validated(D.folds(s), list(_SCORES), ["alpha"]).withColumn("model", F.lit("own"))
    return D.best_by_f1(cv.select("alpha", "model", *[F.round(c, 6).alias(c) for c in cv.columns if c not in ("alpha", "model")]), ["own"])


@query(f"SELECT doc_id, count(*)::INT AS n_sentences, (max(true_segment) + 1)::INT AS n_chunks FROM ({SEGMENTED}) GROUP BY doc_id")
def nested_documents(spark, sf_dir):
    """Labelled documents nested and unnested again."""
    nested = D.nest_labelled(turns(spark, sf_dir))
    flat = D.explode_labelled(nested.drop("chunks_gt"))
    counts = flat.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_sentences"))
    return counts.join(nested.select("doc_id", F.size("chunks_gt").alias("n_chunks")), "doc_id")


# --- sources and sinks --------------------------------------------------------------------------------------------
_LF_TEXT = f"replace(replace(text, {CR} || {LF}, {LF}), {CR}, {LF})"


@query(f"""SELECT path, '.txt' AS ext, CASE WHEN k < 3 THEN CASE WHEN k = 2 THEN chr(65279) ELSE '' END || t END AS text, 'txt' AS file_type, CASE WHEN k < 3 THEN ['utf-8', 'utf-8-sig', 'utf-16-be'][k + 1] END AS encoding, size AS file_size,
 CASE WHEN k < 3 THEN length(t) - length(replace(t, {LF}, '')) + 1 END::INT AS line_count, CASE WHEN k < 3 THEN length(t) + (k = 2)::INT END::INT AS character_count, CASE WHEN k = 3 THEN 'ValueError: the file is empty' END AS error
FROM (SELECT '/in/' || doc_id || '.TXT' AS path, doc_id % 4 AS k, {_LF_TEXT} AS t, CASE doc_id % 4 WHEN 0 THEN strlen(text) WHEN 1 THEN strlen(text) + 3 WHEN 2 THEN 2 * length(text) + 2 ELSE 0 END::BIGINT AS size
 FROM (SELECT doc_id, replace({q(HEAD.removeprefix("\ufeff"))}, {LF}, {CR}) || text AS text FROM documents))""")
def text_files(spark, sf_dir):
    """Documents as bytes of files in three encodings, or none, and read again."""
    rows = docs(spark, sf_dir).withColumn("text", F.concat(F.lit(HEAD.removeprefix("\ufeff").replace("\n", "\r")), "text"))
    ways = (F.encode("text", "UTF-8"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    content = F.unhex(F.lit(""))
    for k, way in enumerate(ways):
        content = F.when(F.col("doc_id") % 4 == k, way).otherwise(content)
    rows = rows.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return decode_files(rows).select("path", "ext", "text", *[f"metadata.{c}" for c in ("file_type", "encoding", "file_size", "line_count", "character_count")], "error")


@query(f"SELECT doc_id::INT AS doc_id, pos::INT AS pos, sentence, label FROM ({TURNS})")
def labelled_files(spark, sf_dir):
    """Labelled documents written nested as Parquet, read again, and unnested."""
    path = scratch(spark)
    write_labelled(D.nest_labelled(turns(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("int")), path)
    return D.explode_labelled(read_labelled(spark, path, ["doc_id", "sentences", "labels"])).select("doc_id", "pos", "sentence", "label")


@query(f"SELECT doc_id, sentence FROM ({TURNS}) WHERE label = 1")
def dataset_files(spark, sf_dir):
    """A split of a labelled dataset: the first sentences of its segments."""
    path = scratch(spark)
    nested = D.nest_labelled(turns(spark, sf_dir))
    nested.withColumn("labels", F.transform("labels", lambda x: x.cast("long"))).withColumn("sentences", F.transform("sentences", lambda x: F.concat(F.col("doc_id").cast("string"), F.lit("\t"), x))).select("sentences", "labels").coalesce(1).write.parquet(f"{path}/train.parquet")
    rows = D.explode_labelled(read_dataset(spark, path, "train")).where("label = 1")
    return rows.select(F.split_part("sentence", F.lit("\t"), F.lit(1)).cast("long").alias("doc_id"), F.expr("substr(sentence, instr(sentence, '\t') + 1)").alias("sentence"))


@query(f"SELECT doc_id, (pos - 1)::INT AS pair_index, 193 AS width, (pos % 5 = 0)::INT AS label, e0[1] AS first, e0[1] - embedding[1] AS apart FROM ({GAPS}) WHERE gap IS NOT NULL")
def boundary_files(spark, sf_dir):
    """Features of pairs written and read again."""
    path = scratch(spark)
    write_boundaries(S.pair_features(vectors(spark, sf_dir).withColumn("label", (F.col("pos") % 5 == 0).cast("int"))), path)
    return read_boundaries(spark, path).select("doc_id", "pair_index", F.size("features").alias("width"), "label", F.col("features")[0].alias("first"), F.col("features")[129].alias("apart"))


@query(SQL["wide_results"])
def csv_files(spark, sf_dir):
    """The wide results written as CSV and read again."""
    path = scratch(spark)
    wide = wide_results(spark, sf_dir)
    write_csv(wide, path)
    return read_results(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema.fields))


@query("SELECT doc_id, length(text) AS n, 'конец \"' || doc_id || '\"' AS name FROM documents")
def json_files(spark, sf_dir):
    """Rows with a null field written as JSON, where null fields are left out, and read again."""
    path = scratch(spark)
    write_json(docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n"), F.concat(F.lit('конец "'), F.col("doc_id").cast("string"), F.lit('"')).alias("name"), F.lit(None).cast("string").alias("none")), path)
    return spark.read.json(path).select("doc_id", "n", "name")


@query(f"SELECT method, k::INT AS place, metric, round(CASE WHEN k = 0 THEN pk_mean ELSE windowdiff_mean END, 6) AS mean, round(CASE WHEN k = 0 THEN pk_std ELSE windowdiff_std END, 6) AS std FROM ({SQL['benchmark_summary']}), (VALUES (0, 'pk'), (1, 'windowdiff')) t(k, metric)")
def chart_data(spark, sf_dir):
    return E.chart_rows(benchmark_summary(spark, sf_dir), ["pk", "windowdiff"])


# --- pipeline -----------------------------------------------------------------------------------------------------
#: Without formulas in plain text, which would be found in documents too; LaTeX is only in what is added to them.
_CONFIG = PipelineConfig(paragraph_separator="\n", detect_plain_text_formulas=False)
_LATEX = sum(kind != "plain_text" for kind, *_ in _MATH_FOUND)
_FILES = f"(SELECT doc_id, replace(text, '$', '') || {LF} || {q(MATH)} AS text FROM documents)"
_FILE_CHUNKS = f"SELECT *, CASE WHEN text = {q(MATH.strip())} THEN {_LATEX} ELSE 0 END AS f FROM ({s_paragraphs(f'(SELECT doc_id, {s_normalize("text")} AS text FROM {_FILES})')})"


def _as_files(spark, sf_dir):
    """Documents as files, each with a last paragraph of formulas."""
    text = F.concat(F.replace("text", F.lit("$"), F.lit("")), F.lit("\n" + MATH))
    return docs(spark, sf_dir).withColumn("text", text).withColumn("ext", F.lit(".txt"))


@query(f"""SELECT doc_id, chunk_no::INT AS sequence, CASE WHEN f = 0 THEN {s_chunk_id('text', 'chunk_no')} END AS id, text, 'text' AS block_type, f::INT AS n_formulas, len({s_words(s_clean('text'))})::INT AS word_count, f > 0 AS has_formulas,
 coalesce({_s_topic(s_first_sentence('text'))}, {_s_topic(s_clean('text'))}, {q(M.NO_TOPIC)}) AS main_topic FROM ({_FILE_CHUNKS})""")
def pipeline_chunks(spark, sf_dir):
    """Chunks of files; an id is shown where it isn't made from placeholders."""
    rows = chunk_rows(_as_files(spark, sf_dir), _CONFIG)
    return rows.select("doc_id", "sequence", F.when(F.size("formulas") == 0, F.col("id")).alias("id"), "text", "block_type", F.size("formulas").alias("n_formulas"), "statistics.word_count", "formula_facts.has_formulas", "topic.main_topic")


@query(f"SELECT doc_id, doc_id::VARCHAR AS source_file, n::INT AS total_chunks, total_formulas::BIGINT AS total_formulas, strlen(text)::BIGINT AS input_file_size_bytes, n::INT AS n_chunks, last_terms FROM (SELECT doc_id, count(*) AS n, sum(f) AS total_formulas, 'costs' AS last_terms FROM ({_FILE_CHUNKS}) GROUP BY doc_id) JOIN {_FILES} USING (doc_id)")
def pipeline_results(spark, sf_dir):
    """Results of files: their statistics, and a keyword of the last chunk's."""
    out = process(_as_files(spark, sf_dir), _CONFIG)
    last = F.element_at("chunks", -1)["metadata"]["key_terms"]
    return out.select("doc_id", "source_file", F.col("statistics.total_chunks").cast("int").alias("total_chunks"), "statistics.total_formulas", "statistics.input_file_size_bytes", F.size("chunks").alias("n_chunks"), F.filter(last, lambda x: x == "costs")[0].alias("last_terms"))
