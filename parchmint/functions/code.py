"""Line classifiers and the language guess of the code extractor, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.spans import let
from parchmint.functions.text import BLANK, WS, strip, strip_start

# Words, symbols and patterns that speak for code or for prose.
KEYWORDS = """
def class import from if else elif for while return function var let const int float string bool true false null
undefined print include define public private protected static void main try catch finally throw throws lambda with as
assert del global nonlocal pass break continue except raise yield
""".split()
SYMBOLS = r"[/%!&|^~?:;{}\[\]]"
SPECIFIC = r"[=<>{}();]"
PROSE = "the and or but however therefore это что как для".split()
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FENCES = (r"(?sU)```(\w*)\n(.*?)\n```", r"(?sU)~~~(\w*)\n(.*?)\n~~~")
INDENTED_FENCE = rf"(?dsmU)^({WS}*)```(\w*)\n(.*?)\n\1```"
SAMPLE = 500


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    return let(F.split(text, LINE_END, -1), lambda found: F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found))


def symbol_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, SYMBOLS, ""))


def is_likely_text(line: Column) -> Column:
    """A sentence, many words with hardly a symbol, or a common word with few symbols."""

    def told(x):
        bare = x["bare"]
        sentence = bare.rlike(r"\A\p{Lu}") & F.substring(bare, -1, 1).isin(".", "!", "?") & (F.length(bare) > 1)
        many = (F.size(F.split(bare, f"{BLANK}+")) > 5) & (x["symbols"] < 0.05 * F.length(bare))
        common = (x["symbols"] < 3) & F.arrays_overlap(F.split(F.lower(bare), f"{BLANK}+"), F.array(*map(F.lit, PROSE)))
        return (bare != "") & (sentence | many | common)

    return let(strip(line), lambda bare: let(F.struct(bare.alias("bare"), symbol_count(bare).alias("symbols")), told))


def is_code_line(line: Column) -> Column:
    """By prompt, keyword, symbols, a colon at the end or indentation; never what is likely text."""
    return (line != "") & let(strip_start(line), lambda bare: _looks_like_code(line, bare)) & ~is_likely_text(line)


def _looks_like_code(line: Column, bare: Column) -> Column:
    names = F.regexp_extract_all(bare, F.lit(r"(?U)\b[a-zA-Z_]\w*\b"), F.lit(0))
    keyword = F.arrays_overlap(names, F.array(*map(F.lit, KEYWORDS)))
    symbols = (symbol_count(bare) >= 2) & (F.length(bare) > 5) & bare.rlike(SPECIFIC)
    indented = F.length(line) > F.length(bare)
    return bare.startswith(">>>") | indented | bare.endswith(":") | symbols | keyword


def guess_language(code: Column) -> Column:
    s = F.lower(F.substring(code, 1, SAMPLE))
    return (
        F.when(s.contains("def ") & s.contains(":"), "python")
        .when(s.contains("function ") & s.contains("{"), "javascript")
        .when(s.contains("public static void main"), "java")
        .when(s.contains("#include") & (s.contains("<") | s.contains('"')), "c/c++")
        .when(s.contains("using namespace std;"), "c++")
        .when(s.contains("package ") & s.contains(";"), "java")
        .otherwise("unknown")
    )
