"""Markdown removal with formulas protected, as a Column function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.text import WS, strip

PROTECTED = r"(?s)(\$\$.*?\$\$|\$.*?\$)"
# Markup and what is left of it, in the order of application.
RULES = (
    (r"(?d)!\[.*?\]\(.*?\)", ""),  # images
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),  # links
    (r"(?d)\*\*\*(.*?)\*\*\*", "$1"),
    (r"(?d)\*\*(.*?)\*\*", "$1"),
    (r"(?d)__(.*?)__", "$1"),
    (r"(?d)(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", "$1"),
    (r"(?dU)\b_(.*?)_\b", "$1"),
    (r"(?d)~~(.*?)~~", "$1"),
    (rf"(?dm)^>{WS}?", ""),  # quotes
    (rf"(?dm)^#{{1,6}}{WS}+", ""),  # headings
    (rf"(?dm)^{WS}*[-*+]{WS}+", ""),  # bullets
    (rf"(?dm)^{WS}*\p{{Nd}}+\.{WS}+", ""),  # numbers
    (r"[ \t]+", " "),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
)


def clean_markdown(text: Column) -> Column:
    """Text without Markdown marks; $...$ and $$...$$ come through as they are."""
    found = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))
    mark = lambda i: F.concat(F.lit("<<<MD_FORMULA_"), i.cast("string"), F.lit(">>>"))
    pieces = F.split(text, PROTECTED, -1)
    marked = F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(found), F.concat(p, mark(i))).otherwise(p)), "")
    out = F.when(F.size(found) == 0, text).otherwise(marked)
    for pattern, by in RULES:
        out = F.regexp_replace(out, pattern, by)
    out = strip(out)
    pairs = F.transform(found, lambda f, i: F.struct(mark(i).alias("key"), f.alias("value")))
    return F.when(F.size(found) == 0, out).otherwise(F.aggregate(pairs, out, lambda held, x: F.replace(held, x["key"], x["value"])))
