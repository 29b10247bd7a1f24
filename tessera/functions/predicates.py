"""A small predicate language over columns: ``name=1,2``, ``name!=a``, ``name>3`` and so on, joined by ``and`` of a list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import to_number

_FORM = re.compile(r"^\s*(?P<name>[^=!<>]+?)\s*(?P<op><=|>=|!=|=|<|>)\s*(?P<value>.*)$")


def resolve(df: DataFrame, name: str) -> str:
    """The column of that name, letter case aside."""
    for c in df.columns:
        if c == name or c.lower() == name.lower():
            return c
    raise ValueError(f"no column {name!r}; there are {', '.join(df.columns)}")


def predicate(df: DataFrame, expression: str) -> Column:
    """``=`` and ``!=`` take comma lists and compare text; a missing value differs from everything. The others compare numbers."""
    m = _FORM.match(expression)
    if not m:
        raise ValueError(f"not a predicate: {expression!r}")
    x, op = F.col(resolve(df, m["name"])), m["op"]
    if op in ("=", "!="):
        held = F.coalesce(x.cast("string"), F.lit("nan")).isin(*[v.strip() for v in m["value"].split(",")])
        return held if op == "=" else ~held
    number = float(m["value"])
    x = to_number(x)
    return F.coalesce({"<": x < number, "<=": x <= number, ">": x > number, ">=": x >= number}[op], F.lit(False))


def where_all(df: DataFrame, expressions: list[str]) -> DataFrame:
    for e in expressions:
        df = df.where(predicate(df, e))
    return df
