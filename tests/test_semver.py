"""Precedence, ranges and package resolution."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import semver
from vellum.functions.settings import settings_of
from vellum.operators import vaults

ORDER = ["0.9", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1", "1.0.1", "v1.2", "1.10.0+build", "2.0.0-0", "2.0.0"]


def test_precedence(spark):
    rows = ORDER[:]
    random.Random(1).shuffle(rows)
    got = spark.createDataFrame([(v,) for v in rows], "v string").orderBy(semver.precedence(F.col("v"))).collect()
    assert [r["v"] for r in got] == ORDER
    odd = spark.createDataFrame([("x",), ("1.2.3.4",), ("",), (None,)], "v string").select(semver.precedence(F.col("v")).alias("k")).collect()
    assert all(r["k"] is None for r in odd)


CASES = [
    (">=1.2, <2", "1.2.0 1.9.9", "1.1.9 2.0.0 1.5.0-rc.1"), ("^1.2.3", "1.2.3 1.9.0", "1.2.2 2.0.0"), ("^0.2.3", "0.2.3 0.2.9", "0.3.0 0.2.2"), ("^0.0.3", "0.0.3", "0.0.4"), ("^0", "0.0.0 0.9.9", "1.0.0"),
    ("~1.2.3", "1.2.3 1.2.9", "1.3.0"), ("~1", "1.0.0 1.9.0", "2.0.0"), ("1.x || 2.1.*", "1.0.0 1.5.2 2.1.7", "2.0.0 2.2.0"), ("!=1.2.3", "1.2.4", "1.2.3"), ("1.2 - 2.1.0", "1.2.0 2.1.0", "2.1.1 1.1.9"),
    ("*", "0.0.1 9.0.0", "1.0.0-a"), (">1.2", "1.3.0", "1.2.9"), ("<=1.2", "1.2.9", "1.3.0"), (">=1.0.0-0", "1.0.0-a 1.0.0 2.0.0-b", "0.9.0"), ("=1.2.3", "1.2.3 v1.2.3+x", "1.2.4"), ("what", "", "1.0.0"),
]


@pytest.fixture(scope="module")
def covered(spark):
    rows = [(r, v) for r, yes, no in CASES for v in (yes + " " + no).split()]
    return {(r["r"], r["v"]): r["c"] for r in spark.createDataFrame(rows, "r string, v string").select("r", "v", semver.covers(F.col("r"), F.col("v")).alias("c")).collect()}


@pytest.mark.parametrize(("range_", "yes", "no"), CASES)
def test_ranges(covered, range_, yes, no):
    assert {v: covered[range_, v] for v in (yes + " " + no).split()} == {v: True for v in yes.split()} | {v: False for v in no.split()}


def test_packages(spark):
    rows = [("py", "1.9.0", ">=1", ["any"]), ("py", "1.10.0", ">=1", ["any"]), ("py", "2.0.0-rc.1", ">=1", ["any"]), ("py", "3.0.0", ">=2", ["any"]), ("py", "9.0.0", ">=1", ["linux"]), ("go", "1.0.0", "<1", ["any"]), ("only", "1.0.0", "*", ["linux"])]
    packages = spark.createDataFrame(rows, "family string, version string, range string, artifacts array<string>")
    asked = [("py", "1.5.0", None, "2.0.0-rc.1", None), ("py", "2.1.0", None, "3.0.0", None), ("py", "1.5.0", "1.9.0", "1.9.0", None), ("py", "1.5.0", "3.0.0", None, "no such version"), ("py", "dev", None, "3.0.0", None), ("py", "dev", "1.9.0", None, "no such version"), ("py", "v1.0.0-3-gabc", "3.0.0", "3.0.0", None), ("go", "1.5.0", None, None, "no installable version"), ("only", "dev", None, None, "no installable version"), ("no", "dev", None, None, "no such package")]
    got = vaults.resolve_packages(packages, spark.createDataFrame([a[:3] for a in asked], "family string, core string, pin string"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == {a[:3]: a[3:] for a in asked}


def test_settings(spark):
    rows = [(1, None), (2, "{"), (3, '{"k": 0, "minSim": 0, "indexConcurrency": 99, "convertMaxPixels": 5, "convertPageTimeoutSec": 99999}'), (4, '{"k": 30, "minSim": 0.96, "indexConcurrency": -1, "convertMaxPixels": 9000000}'), (5, '{"k": "x", "minSim": 0.5}')]
    got = {r["i"]: tuple(r["s"]) for r in spark.createDataFrame(rows, "i int, t string").select("i", settings_of(F.col("t")).alias("s")).collect()}
    assert got == {1: (10, 0.2, 6, 2_500_000, 600), 2: (10, 0.2, 6, 2_500_000, 600), 3: (10, 0.0, 32, 100_000, 7200), 4: (30, 0.2, 6, 8_000_000, 600), 5: (10, 0.5, 6, 2_500_000, 600)}
