"""Columns of callers stay as they are, whatever they are called: operators carry them packed, or take names that no caller's has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many underscores before it as make it differ from all that are ``taken``, letter case aside."""
    known = {c.lower() for c in taken}
    name = "_" + name
    while name.lower() in known:
        name = "_" + name
    return name


def without(docs: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns of ``docs`` apart from those that an operator adds."""
    known = {c.lower() for c in added}
    return [c for c in docs.columns if c.lower() not in known]


def packed(names: Iterable[str]) -> Column:
    """One column ``row`` that holds the named ones; ``row.*`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
