"""Places of regular-expression matches, and replacement by place, as Column functions that are linear in the text.

A fold that appends to an array copies it at each step, and a substring by characters counts from the start of the
text. So running values come by doubling (as many steps as the logarithm of the array's size), and pieces of a text are
cut from its UTF-32 form, where a place is an offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int) -> Column:
    """For each value of an array of longs, op over it and all before it."""
    doublings = F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int") - 1, F.lit(0))

    def step(held, k):
        by = F.least(F.pow(F.lit(2), k).cast("int"), F.size(held))
        moved = F.concat(F.transform(F.slice(held, 1, by), lambda x: F.lit(neutral).cast("bigint")), F.slice(held, 1, F.size(held) - by))
        return F.zip_with(held, moved, op)

    return F.aggregate(F.sequence(F.lit(0), doublings), values, step)


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), -1)


def places(pieces: Column, matches: Column) -> Column:
    """The end of each match, as longs, from the pieces between matches (one more than matches)."""
    return running_sums(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("bigint")))


def find_all(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match, from 0, in code points; texts without a match cost one search."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def spans(x):
        one = lambda e, m: F.struct((e - F.length(m)).cast("int").alias("start"), e.cast("int").alias("end"), m.alias("value"))
        return F.zip_with(places(x["p"], x["m"]), x["m"], one)

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(SPAN))


def sliced(text: Column, spans: Column, start: str = "start", end: str = "end") -> Column:
    """The text between start and end of each span."""

    def cut(wide):
        return F.transform(spans, lambda s: F.decode(F.substring(wide, (4 * s[start] + 1).cast("int"), (4 * (s[end] - s[start])).cast("int")), "UTF-32"))

    return let(F.encode(text, "UTF-32"), cut)


def between(text: Column, spans: Column, start: str = "start", end: str = "end") -> Column:
    """The pieces of the text before, between and after spans (ascending, apart from each other)."""
    from_ = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s[end].cast("bigint")))
    to = F.concat(F.transform(spans, lambda s: s[start].cast("bigint")), F.array(F.length(text).cast("bigint")))
    return sliced(text, F.zip_with(from_, to, lambda a, b: F.struct(a.alias("start"), b.alias("end"))))


def replace_at(text: Column, spans: Column) -> Column:
    """The text with `by` in place of text[start:end] of each span (ascending, apart from each other)."""
    by = F.concat(F.transform(spans, lambda s: s["by"]), F.array(F.lit("")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(between(text, spans), by, lambda p, b: F.concat(p, b)), ""))


def restore_all(text: Column, pairs: Column, key: str, value: str) -> Column:
    """Each pair's key replaced by its value, literally and in order."""
    return F.when(F.size(pairs) == 0, text).otherwise(F.aggregate(pairs, text, lambda held, x: F.replace(held, x[key], x[value])))
