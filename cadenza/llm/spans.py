"""Finding all matches of a pattern with their places, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # matches whose places are summed up in one go, at least


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once: within a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """Sums of the elements before each element of an array of numbers, in blocks of about its root, so that long arrays stay cheap."""

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    width = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(sizes))).cast("int"))

    def of(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(p["x"]), F.lit(1)), p["w"])
        parts = F.transform(starts, lambda a: F.aggregate(F.slice(p["x"], a, p["w"]), zero, add))
        return let(parts, lambda q: F.flatten(F.zip_with(q, F.aggregate(q, zero, lambda acc, y: add(acc, y["sum"]))["out"], lambda y, base: F.transform(y["out"], lambda v: v + base))))

    return let(F.struct(sizes.alias("x"), width.alias("w")), of)


def find_all(text: Column, pattern: Column, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs s, e (code points, e exclusive), m and before, in order.

    ``before`` is what stands before the match, up to ``context`` code points. The pieces between the
    matches give the places. The pattern must not match the empty string.
    """
    kind = "array<struct<s:int,e:int,m:string,before:string>>"

    def near(p: Column, gap: Column, i: Column) -> Column:
        first = F.greatest(i - context, F.lit(0))  # so many matches reach back far enough, as none is empty
        earlier = F.zip_with(F.slice(p["gap"], first + 1, i - first), F.slice(p["m"], first + 1, i - first), lambda g, m: F.concat(g, m))
        return F.when(F.length(gap) >= context, F.right(gap, F.lit(context))).otherwise(F.right(F.concat(F.array_join(earlier, ""), gap), F.lit(context)))

    def places(p: Column) -> Column:
        lengths = F.zip_with(p["gap"], p["m"], lambda g, m: F.length(g) + F.length(m))
        ends = F.zip_with(running(lengths), lengths, lambda a, n: a + n)
        rows = F.arrays_zip(p["gap"].alias("gap"), p["m"].alias("m"), ends.alias("e"))
        before = (lambda x, i: near(p, x["gap"], i)) if context else (lambda x, i: F.lit(""))
        return F.transform(rows, lambda x, i: F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("m"), before(x, i).alias("before")))

    def of(found: Column) -> Column:
        pairs = F.struct(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
        return F.when(F.size(found) > 0, let(pairs, places)).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), of)
