"""Code blocks of documents: fenced ones, and runs of lines that look like code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.code import FENCES, INDENTED_FENCE, guess_language, is_code_line, lines
from parchmint.functions.spans import find_all, let, replace_at
from parchmint.functions.text import strip


def classified_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line: id, line_no (from 0), line, is_code, is_blank."""
    rows = docs.select(F.col(id_col), F.posexplode(lines(F.col(text_col))).alias("line_no", "line"))
    return rows.withColumn("is_code", is_code_line(F.col("line"))).withColumn("is_blank", strip(F.col("line")) == "")


def heuristic_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of code and blank lines from their first code line on, with their place in the text.

    The lines of a text are an array of its row, which the lines that are neither cut into runs, without a shuffle.
    """
    flagged = F.transform(lines(F.col(text_col)), lambda x: F.struct(x.alias("line"), is_code_line(x).alias("code"), (strip(x) == "").alias("blank")))

    def blocks(x):
        breaks = F.filter(F.transform(x, lambda y, i: F.when(~y["code"] & ~y["blank"], i)), lambda i: i.isNotNull())
        return let(breaks, lambda at: F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(x))), lambda i, j: between(x, i + 1, j - i - 1)))

    def between(x, first, count):
        """The block of the lines between two that are neither code nor blank; its first is 0 if there is no code."""
        some = F.slice(x, first + 1, count)
        return let(some, lambda y: let(F.array_position(F.transform(y, lambda z: z["code"]), F.lit(True)).cast("int"), lambda k: F.struct((first + k).alias("first"), F.when(k > 0, F.array_join(F.transform(F.slice(y, k, F.size(y)), lambda z: z["line"]), "\n")).alias("code"))))

    found = F.filter(let(flagged, blocks), lambda b: b["code"].isNotNull())
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.explode(found).alias("b"))
    rows = rows.withColumn("start_pos", F.expr("locate(b.code, __text)") - 1)
    return rows.select(id_col, (F.col("b.first") - 1).alias("first_line"), F.col("b.code").alias("code"), guess_language(F.col("b.code")).alias("language"), "start_pos", (F.col("start_pos") + F.length("b.code")).alias("end_pos"))


def fenced_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks between fences; a span that several patterns find counts once."""
    found = None
    for pattern, tag, body in ((FENCES[0], 1, 2), (FENCES[1], 1, 2), (INDENTED_FENCE, 2, 3)):
        rows = docs.select(F.col(id_col), F.explode(find_all(F.col(text_col), pattern)).alias("s"))
        language = F.regexp_extract(F.col("s.value"), pattern, tag)
        code = F.regexp_extract(F.col("s.value"), pattern, body)
        rows = rows.select(id_col, code.alias("code"), F.when(F.trim(language) != "", F.trim(language)).otherwise(guess_language(code)).alias("language"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))
        found = rows if found is None else found.unionByName(rows)
    return found.dropDuplicates([id_col, "start_pos", "end_pos"])


def apart_in_order(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of heuristic blocks, in the order of their lines, those that overlap none that is kept before them."""
    each = F.struct("first_line", "code", "language", "start_pos", "end_pos")
    rows = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(each)).alias("b"))

    def step(held, x):
        meets = F.exists(held, lambda k: (x["start_pos"] < k["end_pos"]) & (k["start_pos"] < x["end_pos"]))
        return F.when(meets, held).otherwise(F.concat(held, F.array(x)))

    kept = F.aggregate("b", F.filter("b", lambda x: F.lit(False)), step)
    return rows.select(id_col, F.explode(kept).alias("b")).select(id_col, "b.*")


def extract_code(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fenced blocks, and heuristic ones that overlap none of them or of the heuristic blocks before.

    Blocks of a document meet in a fold over its id; a document has few.
    """
    fenced = fenced_blocks(docs, id_col, text_col).withColumn("kind", F.lit("fenced"))
    loose = heuristic_blocks(docs, id_col, text_col)
    f = fenced.select(F.col(id_col).alias("__id"), F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"))
    apart = loose.join(f, (F.col(id_col) == F.col("__id")) & (F.col("end_pos") > F.col("__s")) & (F.col("start_pos") < F.col("__e")), "left_anti")
    return fenced.unionByName(apart_in_order(apart, id_col).drop("first_line").withColumn("kind", F.lit("heuristic")))


def _mark(b: Column) -> Column:
    return F.concat(F.lit("[[CODE_"), b["start_pos"].cast("string"), F.lit("_"), b["language"], F.lit("]]"))


def replace_code(text: Column, blocks: Column) -> Column:
    """Placeholders in place of blocks (an array of structs with start_pos, end_pos and language)."""
    ordered = F.array_sort(F.transform(blocks, lambda b: F.struct(b["start_pos"].alias("start"), b["end_pos"].alias("end"), _mark(b).alias("by"))))
    return replace_at(text, ordered)


def restore_code(text: Column, blocks: Column) -> Column:
    """The code of each block in place of its placeholder; fences don't come back."""
    return F.when(F.size(blocks) == 0, text).otherwise(F.aggregate(blocks, text, lambda held, b: F.replace(held, _mark(b), b["code"])))
