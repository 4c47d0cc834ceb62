"""The most frequent keywords of each text. A text's words are counted within its own row: sorted, and cut into runs of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.metadata import keyword_words
from parchmint.functions.spans import let


def frequencies(words: Column) -> Column:
    """(term, frequency) of the distinct words, the most frequent first; ties go to the word that comes first in the text."""

    def counted(placed):
        at = F.transform(placed, lambda x, i: F.when((i == 0) | (x["w"] != F.get(placed, i - 1)["w"]), i))
        return let(F.filter(at, lambda i: i.isNotNull()), lambda starts: runs(placed, starts))

    def runs(placed, starts):
        ends = F.slice(F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(placed))), 1, F.size(starts))
        each = F.zip_with(starts, ends, lambda i, j: F.struct((i - j).alias("less"), F.get(placed, i)["i"].alias("first"), F.get(placed, i)["w"].alias("term")))
        return F.transform(F.sort_array(each), lambda x: F.struct(x["term"].alias("term"), (-x["less"]).cast("bigint").alias("frequency")))

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), counted)


def keywords(docs: DataFrame, top_n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rank, term, frequency: ties go to the word that comes first in the text."""
    top = F.slice(frequencies(keyword_words(F.col(text_col))), 1, top_n)
    rows = docs.select(F.col(id_col), F.posexplode(top).alias("at", "t"))
    return rows.select(id_col, (F.col("at") + 1).alias("rank"), "t.term", "t.frequency")


def keyword_summary(docs: DataFrame, top_n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text: key_terms, term_frequencies, unique_terms_count and confidence; empty where no word is left."""
    rows = docs.select(F.col(id_col), keyword_facts(F.col(text_col), top_n).alias("k"))
    return rows.select(id_col, "k.*")


def keyword_facts(text: Column, top_n: int = 10) -> Column:
    """key_terms, term_frequencies, unique_terms_count and keyword_confidence of a text, as a struct."""

    def told(found):
        top = F.slice(found, 1, top_n)
        return F.struct(
            F.transform(top, lambda x: x["term"]).alias("key_terms"),
            F.map_from_entries(F.transform(top, lambda x: F.struct(x["term"], x["frequency"]))).alias("term_frequencies"),
            F.size(found).alias("unique_terms_count"), F.least(F.lit(0.95), F.size(found) / 20).alias("keyword_confidence"),
        )

    return let(frequencies(F.coalesce(keyword_words(text), F.array().cast("array<string>"))), told)
