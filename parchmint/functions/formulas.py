"""Formula detection, placeholders and restoration.

Detection runs over Arrow batches, since its three passes each search the text that the one before has left; the test
and the normal forms of single formulas are the same functions as Columns, and restoration is one of built-ins. Offsets never drift: each kind of formula is
found in one text and replaced in it by place. Positions that are returned are those in the text that went in. An inline
formula is restored with its dollar signs, and no formula holds another.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.spans import restore_all

DISPLAY, INLINE, PLAIN = "latex_display", "latex_inline", "plain_text"
METHODS = (DISPLAY, INLINE, PLAIN)

# Patterns, operators and their plain forms.
DISPLAY_PATTERN = r"(?s)\\\[.*?\\\]|\$\$.*?\$\$"
INLINE_PATTERN = r"(?s)(?<!\\)\$(?!\$)(.*?)(?<!\\)\$(?!\$)"
OPERATORS = r"=+\-*/^<>≤≥≠≈∼∝∫∑∏√∛∜∂∇∆"
OPERAND = r"A-Za-zα-ωΑ-Ω0-9_"
REST = OPERAND + r"+\-*/^().,\[\]{}"
#: An operand, then operators and what follows them; white space only beside an operator. There is one way to read a
#: string, so no input makes the search backtrack without bound.
PLAIN_PATTERN = re.compile(rf"(?:(?<=\s)|\A)[{OPERAND}]+(?:\s*[{OPERATORS}](?:[{REST}{OPERATORS}]|(?<=[{OPERATORS}])\s+|(?<![{OPERATORS}\s])\s+(?=[{OPERATORS}]))*)?(?=\s|\Z|[.,;!?])")
MATH_CHARS = r"[=+\-*/^<>()\[\]{}|\\]"
TO_PLAIN_FROM, TO_PLAIN_TO = "×·÷–—", "**/--"
PLACEHOLDER = r"\[\[FORMULA_\d+_\d+\]\]"

FORMULA = "array<struct<placeholder:string,full:string,original:string,normalized:string,start_pos:int,end_pos:int,formula_type:string>>"
FOUND = f"formulas {FORMULA}, text_with_placeholders string"


def latex_form(text: str) -> str:
    return " ".join(text.split())


def plain_form(text: str) -> str:
    return latex_form(text).translate(str.maketrans(TO_PLAIN_FROM, TO_PLAIN_TO)).replace("^", "**")


def looks_like(text: str) -> bool:
    """Not a short number; with an operator; mostly not letters, unless Greek; with a digit if longer than 10."""
    bare = text.strip()
    if re.fullmatch(r"[\d\s.]+", bare) and len(bare) <= 4 or not re.search(MATH_CHARS, text):
        return False
    if sum(map(str.isalpha, text)) > 0.8 * len(text) and not re.search("[α-ωΑ-Ω]", text):
        return False
    return bool(re.search(r"\d", text)) or len(text) <= 10


def _mapped(kind: str, f: Callable):
    return F.pandas_udf(lambda values: values.map(f, na_action="ignore"), kind)


def normalize_latex(c: Column) -> Column:
    return _mapped("string", latex_form)(c)


def normalize_plain(c: Column) -> Column:
    return _mapped("string", plain_form)(c)


def normalize_formula(c: Column, kind: Column) -> Column:
    return F.when(kind == PLAIN, normalize_plain(c)).otherwise(normalize_latex(c))


def looks_like_formula(c: Column) -> Column:
    """looks_like of each string, as detection applies it."""
    return _mapped("boolean", looks_like)(c)


def find_formulas(text: str, methods: tuple[str, ...] = METHODS, min_length: int = 5, max_length: int = 100) -> tuple[list[dict], str]:
    """The formulas of one text in the order of their places, and the text with placeholders."""
    found: list[dict] = []
    marks: list[dict] = []  # placeholders in the text as it is now: at, to, and the formula

    def place(at: int) -> int:
        k = bisect_right([m["to"] for m in marks], at) - 1
        return at if k < 0 else marks[k]["formula"]["end_pos"] + at - marks[k]["to"]

    def replace(text: str, kind: str, hits: list[tuple[int, int, str, str]], backwards: bool) -> str:
        nonlocal marks
        count, new = len(found), []
        for i, (a, b, original, normalized) in enumerate(hits):
            number = count + (len(hits) - i if backwards else i + 1)
            start = place(a)
            new.append({"at": a, "to": b, "formula": {"placeholder": f"[[FORMULA_{a}_{number}]]", "full": text[a:b], "original": original, "normalized": normalized, "start_pos": start, "end_pos": start + b - a, "formula_type": kind}})
        found.extend(m["formula"] for m in new)
        out, end, size, moved = [], 0, 0, []
        for m in sorted(marks + new, key=lambda m: m["at"]):
            mark = m["formula"]["placeholder"]
            out += [text[end : m["at"]], mark]
            size += m["at"] - end + len(mark)
            end = m["to"]
            moved.append({"at": size - len(mark), "to": size, "formula": m["formula"]})
        marks = moved
        return "".join([*out, text[end:]])

    if DISPLAY in methods:
        hits = [(m.start(), m.end(), m[0], latex_form(m[0][2:-2])) for m in re.finditer(DISPLAY_PATTERN, text)]
        text = replace(text, DISPLAY, hits, False)
    if INLINE in methods:
        hits = [(m.start(), m.end(), m[1], latex_form(m[1])) for m in re.finditer(INLINE_PATTERN, text) if len(m[1].strip()) >= min_length and re.search(r"[a-zA-Zα-ωΑ-Ω=+\-*/^]", m[1]) and "[[FORMULA_" not in m[1]]
        text = replace(text, INLINE, hits, False)
    if PLAIN in methods:
        hits = [(m.start(), m.end(), m[0], plain_form(m[0])) for m in PLAIN_PATTERN.finditer(text) if min_length <= len(m[0]) <= max_length and "[[FORMULA_" not in m[0] and looks_like(m[0])]
        text = replace(text, PLAIN, hits, True)
    return sorted(found, key=lambda f: f["start_pos"]), text


def extract_formulas(df: DataFrame, text_col: str = "text", methods: tuple[str, ...] = METHODS, min_length: int = 5, max_length: int = 100) -> DataFrame:
    """df with formulas (an array in the order of positions), text_with_placeholders and detection_stats."""

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [find_formulas(t or "", methods, min_length, max_length) for t in texts]
        return pd.DataFrame({"formulas": [g[0] for g in got], "text_with_placeholders": [g[1] for g in got]})

    df = df.withColumn("__f", run(F.col(text_col)))

    def number(kind):
        return F.size(F.filter("formulas", lambda f: f["formula_type"] == kind)).alias(kind)

    df = df.withColumn("formulas", F.col("__f.formulas")).withColumn("text_with_placeholders", F.col("__f.text_with_placeholders")).drop("__f")
    return df.withColumn("detection_stats", F.struct(*[number(kind) for kind in (INLINE, DISPLAY, PLAIN)], F.size("formulas").alias("total")))


def restore_formulas(text: Column, formulas: Column) -> Column:
    """Placeholders replaced by the formulas as they stood in the text."""
    return restore_all(text, formulas, "placeholder", "full")


def drop_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")
