"""Spans of regex matches in code points, row by row, on SQL functions alone.

Spark has no function that gives match positions. split() gives what stands between matches, regexp_extract_all() the matches;
running sums of both arrays' lengths give each match's start. Every pattern here takes one way through a text: classes that
a run would otherwise try again at each of its characters are possessive and start where a run or the last match ends (\\G).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def _sums_before(a: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("p"))
    return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["p"], F.array(acc["s"])).alias("p")))["p"]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)


def sums_before(a: Column) -> Column:
    """For each place of an array of longs, the sum of all places before it. Blocks keep very long arrays from quadratic time."""
    inside = lambda b: F.sequence(b * _BLOCK, F.least(b * _BLOCK + _BLOCK, F.size(a)) - 1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.transform(inside(b), lambda i: F.get(a, i)))
    offsets = _sums_before(F.transform(blocks, _total))
    long = F.flatten(F.zip_with(F.transform(blocks, _sums_before), offsets, lambda p, o: F.transform(p, lambda x: x + o)))
    return F.when(F.size(a) <= _BLOCK, _sums_before(a)).otherwise(long)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str, found: Column, context: int = 0) -> Column:
    """Of the text between matches: struct n (characters), before (the last so many of them) and after (the first so many). Empty without matches."""
    between = F.split(text, pattern, -1)
    kept = lambda g: F.struct(F.length(g).cast("long").alias("n"), (F.right(g, F.lit(context)) if context else F.lit("")).alias("before"), (F.left(g, F.lit(context)) if context else F.lit("")).alias("after"))
    return F.when(F.size(found) > 0, F.transform(between, kept)).otherwise(F.array().cast("array<struct<n:bigint,before:string,after:string>>"))


def located(found: Column, between: Column) -> Column:
    """The matches as structs: m (the match), start, end, before, after."""
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: g["n"] + F.length(m))
    at = F.zip_with(F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), sums_before(steps), lambda x, s: F.struct(x["m"].alias("m"), x["g"].alias("g"), s.alias("s")))
    behind = F.transform(F.slice(between, F.lit(2), F.size(found)), lambda g: g["after"])
    spans = F.zip_with(F.slice(at, 1, F.size(found)), behind, lambda x, after: F.struct(x["m"].alias("m"), (x["s"] + x["g"]["n"]).alias("start"), (x["s"] + x["g"]["n"] + F.length(x["m"])).alias("end"), x["g"]["before"].alias("before"), after.alias("after")))
    none = F.array().cast("array<struct<m:string,start:bigint,end:bigint,before:string,after:string>>")
    return F.when(F.size(found) > 0, spans).otherwise(none)


SPAN = "struct<start:bigint,place:int,end:bigint,kind:string>"


def as_spans(found: Column, kind: Column | str, place: int) -> Column:
    """Located matches as spans that sort by start, then by the kind's place in the list of kinds."""
    of = (lambda x: F.lit(kind)) if isinstance(kind, str) else (lambda x: x["kind"])
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), of(x).alias("kind")))


def merged(*spans: Column) -> Column:
    return F.array_sort(reduce(F.concat, spans))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
