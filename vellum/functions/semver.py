"""Semantic versions: precedence keys with pre-releases, and ranges as unions of intersected bounds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

VERSION = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"
_NUMBER = "decimal(38,0)"


def is_version(version: Column) -> Column:
    return version.rlike(VERSION)


def prerelease(version: Column) -> Column:
    """The part after the hyphen; empty for a release, null for what is no version."""
    return F.when(is_version(version), F.regexp_extract(version, VERSION, 4))


def is_release(version: Column) -> Column:
    return F.coalesce(prerelease(version) == "", F.lit(False))


def precedence(version: Column) -> Column:
    """Orders versions; missing parts are 0, null for what is no version.

    A pre-release stands before its release; its parts compare one by one, numbers as numbers and
    before words, and fewer parts before more.
    """
    part = lambda i: F.coalesce(F.when(F.regexp_extract(version, VERSION, i) != "", F.regexp_extract(version, VERSION, i)), F.lit("0")).cast(_NUMBER)
    pre = F.regexp_extract(version, VERSION, 4)
    word = lambda p: ~p.rlike(r"^\d+$")
    ids = F.transform(F.split(pre, r"\."), lambda p: F.struct(word(p).alias("w"), F.when(word(p), F.lit(0).cast(_NUMBER)).otherwise(p.try_cast(_NUMBER)).alias("n"), F.when(word(p), p).otherwise("").alias("s")))
    key = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"), F.when(pre != "", ids).alias("pre"))
    return F.when(is_version(version), key)


BOUND = StructType([StructField("op", StringType()), StructField("version", StringType())])
_ONE = re.compile(r"\s*(=|==|!=|>=|=>|<=|=<|>|<|~>|~|\^)?\s*v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?\s*,?")
_HYPHEN = re.compile(r"(?P<a>\S+)\s+-\s+(?P<b>\S+)")


def bounds_of(text: str) -> list[list[tuple[str, str]]] | None:
    """A range as alternatives, each a list of (>=, <, >, <=, = or !=, version) that all hold; None for what is no range."""
    out = []
    for side in text.split("||"):
        side = _HYPHEN.sub(lambda m: f">={m['a']} <={m['b']}", side)
        at, bounds = 0, []
        while at < len(side.rstrip()):
            m = _ONE.match(side, at)
            if not m or m.end() == at:
                return None
            at = m.end()
            op = {None: "=", "==": "=", "=>": ">=", "=<": "<=", "~>": "~"}.get(m[1], m[1])
            given = [int(x) for x in m.groups()[1:4] if x is not None and x.isdigit()]
            given = given[: next((i for i, x in enumerate(m.groups()[1:4]) if x is None or not x.isdigit()), 3)]
            low = [*given, 0, 0, 0][:3]
            named = lambda v, pre="": ".".join(map(str, v)) + (pre or "")
            up = lambda i: named([*low[:i], low[i] + 1, 0, 0][:3])
            if not given:
                bounds += [] if op in ("=", ">=", "<=", "~", "^") else [("<", "0.0.0-0")] if op in ("<", ">", "!=") else []
            elif op == "~" or op == "=" and len(given) < 3:
                bounds += [(">=", named(low, m[5])), ("<", up(min(len(given) - 1, 1)))]
            elif op == "^":
                lead = next((i for i, x in enumerate(given) if x), len(given) - 1)
                bounds += [(">=", named(low, m[5])), ("<", up(lead))]
            elif op == "<=" and len(given) < 3:
                bounds.append(("<", up(len(given) - 1)))
            elif op == ">" and len(given) < 3:
                bounds.append((">=", up(len(given) - 1)))
            else:
                bounds.append((op, named(low, m[5])))
        out.append(bounds)
    return out


@F.pandas_udf(ArrayType(ArrayType(BOUND)))
def bounds(range_: pd.Series) -> pd.Series:
    """Alternatives of bounds; null for what is no range. An empty range holds all releases."""
    return range_.map(lambda t: None if t is None else bounds_of(t))


def covers(range_: Column, version: Column) -> Column:
    """Whether a range holds a version; a pre-release only where every bound of an alternative names one. No version or range: false."""
    v = precedence(version)

    def holds(b: Column) -> Column:
        w = precedence(b["version"])
        compared = F.when(b["op"] == ">=", v >= w).when(b["op"] == ">", v > w).when(b["op"] == "<=", v <= w).when(b["op"] == "<", v < w).when(b["op"] == "!=", v != w).otherwise(v == w)
        return compared & (is_release(version) | (prerelease(b["version"]) != ""))

    one = lambda side: F.forall(side, holds) & (is_release(version) | (F.size(side) > 0))
    return F.coalesce(F.exists(bounds(range_), one) & is_version(version), F.lit(False))
