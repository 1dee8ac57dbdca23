"""Places of regular-expression matches, and running sums over arrays, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one running sum covers; longer arrays are summed in pieces, so that appending stays cheap.
PIECE = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is looked at."""
    return F.transform(F.array(value), use)[0]


def before_each(items: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each item, ``zero`` and all items before it put together by ``add``, which must be associative."""
    none = F.slice(F.array(zero), 1, 0)
    grown = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    running = lambda xs, first: F.aggregate(xs, F.struct(first.alias("at"), none.alias("out")), grown, lambda s: s["out"])

    def over(xs: Column) -> Column:
        last = F.greatest(F.size(xs) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.floor(last / PIECE).cast("int")), lambda k: F.slice(xs, k * PIECE + 1, PIECE))

    def summed(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, zero, add))
        return F.flatten(F.zip_with(pieces, running(totals, zero), running))

    return let(items, lambda xs: let(over(xs), summed))


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as code-point ``(start, stop)`` pairs.

    Pieces between matches and the matches themselves alternate, so running sums of
    their lengths are the places. ``keep(group text)`` drops matches afterwards. The
    pattern must not match the empty string.
    """
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    found = F.transform(F.filter(parts, lambda x: x["match"].isNotNull()), lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["match"]).alias("size"), (F.lit(True) if keep is None else keep(x["part"])).alias("kept")))

    def placed(xs: Column) -> Column:
        ahead = before_each(F.transform(xs, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b)
        whole = F.zip_with(xs, ahead, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["size"]).alias("stop"), x["kept"].alias("kept")))
        return F.transform(F.filter(whole, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    return let(found, placed)
