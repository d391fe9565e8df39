"""Audit of how filters overlap: what each removes in every order they can be applied in.

Texts are range-partitioned by fingerprint and doc_id and sorted by fingerprint, whole text and
doc_id, so that a text's copies may run over several tasks. A task compares each row with those
before it and works out the other filters beside; rows of a fingerprint that may have begun in an
earlier task are compared again with what the earlier ones ended with. Every document thus becomes
a mask of failures, and masks are counted by part: the counters (32 a part) are additive, and all
orders are read off them.

Defined cases: a null text is empty, a null part is the empty string; a row without doc_id never
counts as a copy and makes no other row one; rows that share an id and a text aren't copies of each
other; a document with several labels counts as good or toxic if any of them says so; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import materialize, small_batches, table

CAPITALS, ODD, CONTINUED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))

#: A failure condition sees the UTF-8 bytes of the whole text and its words (runs of anything but ASCII blanks).
Condition = Callable[[bytes, list[bytes]], bool]


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return 100 * capitals > 3 * len(text.translate(None, CONTINUED))


def odd_marks(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, ODD)) < len(text)


CONDITIONS: dict[str, Condition] = {"A": few_words, "B": repetitive, "C": shouting, "D": odd_marks}
#: The filter for copies of a smaller doc_id's text.
COPY = "E"


class Copies:
    """Tells copies in rows sorted by fingerprint, text and doc_id of one task, and what its last fingerprint holds.

    A row's fingerprint is open if it is the task's first one: earlier tasks may hold smaller ids.
    """

    def __init__(self) -> None:
        self.fp: int | None = None
        self.text: bytes | None = None
        self.least: int | None = None
        self.open = True
        self.digest: bytes | None = None
        self.ends: list[tuple[int, bytes, int]] = []

    def row(self, fp: int, text: bytes, doc_id: int | None) -> tuple[bool, bool]:
        """Whether the text is that of the row before, and whether the row is a copy of an earlier one here."""
        same = fp == self.fp and text == self.text
        if not same:
            self.close()
            if fp != self.fp:
                self.open = self.fp is None
                self.ends = []
            self.fp, self.text, self.least, self.digest = fp, text, None, None
        if self.least is None:
            self.least = doc_id
        return same, doc_id is not None and self.least < doc_id

    def mark(self) -> bytes:
        if self.digest is None:
            self.digest = hashlib.sha256(self.text).digest()
        return self.digest

    def close(self) -> None:
        if self.least is not None:
            self.ends.append((self.fp, self.text, self.least))

    def last(self) -> list[tuple[int, bytes, int]]:
        """Fingerprint, digest and least id of every text of the last fingerprint."""
        self.close()
        return [(fp, hashlib.sha256(text).digest(), least) for fp, text, least in self.ends]


MASKS = "doc_id long, part string, mask int, fp long, digest binary, edge boolean"


def failure_masks(docs: DataFrame, part: str = "lang", conditions: dict[str, Condition] = CONDITIONS) -> DataFrame:
    """doc_id, part, mask: bit i of mask is set if the document fails condition i; the last bit tells copies."""
    top = 1 << len(conditions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, mask = Copies(), 0
        for batch in batches:
            rows = []
            for fp, doc_id, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                same, copy = copies.row(fp, text, doc_id)
                if not same:
                    words = text.split()
                    mask = sum(1 << i for i, fails in enumerate(conditions.values()) if fails(text, words))
                found = mask | top if copy else mask
                rows.append((doc_id, name, found, fp, copies.mark(), False) if copies.open else (doc_id, name, found, None, None, False))
            yield as_batch(rows)
        yield as_batch([(least, None, None, fp, digest, True) for fp, digest, least in copies.last()])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=[c.split()[0] for c in MASKS.split(", ")])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.cast("binary").alias("text"))
    spread = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    told = materialize(spread.mapInArrow(run, MASKS), "failure-masks")
    # One row a task, and one more for every other text with the last one's fingerprint.
    ends = told.where("edge").groupBy("fp", "digest").agg(F.min("doc_id").alias("least"))
    copy = F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(top)).otherwise(F.col("mask"))
    again = told.where("not edge and fp is not null").join(F.broadcast(ends), ["fp", "digest"], "left").select("doc_id", "part", copy.alias("mask"))
    return told.where("not edge and fp is null").select("doc_id", "part", "mask").unionByName(again)


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents have a mask, and how many of them are labelled so."""
    any_of = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(any_of("quality"), any_of("toxic")).where("quality + toxic > 0")
    every = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    some = masks.join(marked, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(some).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders_of(counts: np.ndarray, names: str) -> list[tuple]:
    """Rows of AUDIT without the part, from counts[mask] = (documents, good, toxic)."""
    masks, rows, shapley = np.arange(len(counts)), [], dict.fromkeys(names, 0)
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            fails, gone = masks & bit > 0, masks & before > 0
            removed, good, toxic = counts[fails & ~gone].sum(axis=0).tolist()
            before |= bit
            shapley[name] += removed
            rows.append(("".join(order), step, int(counts[masks & before == 0, 0].sum()), removed, int(counts[fails & gone, 0].sum()), int(counts[bit, 0]), good, toxic, name))
    return [(*r[:-1], shapley[r[-1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", conditions: dict[str, Condition] = CONDITIONS) -> DataFrame:
    """A row per part, order of the filters and step; every part has all orders and steps."""
    names = "".join(conditions) + COPY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in AUDIT.split(", ")])
        for batch in batches:
            for name, found in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.zeros((1 << len(names), 3), np.int64)
                for c in found:
                    counts[c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = [(name, *r) for r in orders_of(counts, names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    counted = counters(failure_masks(docs, part, conditions), labels)
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found")).mapInArrow(run, AUDIT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
fails AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS f
  FROM d
),
marked AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN marked USING (doc_id) GROUP BY part, f
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT filter_order, step::int AS step, filter_order[step] AS l, left(filter_order, step - 1) AS before FROM orders, range(1, 6) s(step)),
audit AS (
  SELECT part, filter_order, step, l,
    coalesce(sum(n) FILTER (WHERE translate(f, before || l, '') = f), 0)::bigint AS kept,
    coalesce(sum(n) FILTER (WHERE contains(f, l) AND translate(f, before, '') = f), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (WHERE contains(f, l) AND translate(f, before, '') <> f), 0)::bigint AS redundant,
    coalesce(sum(n) FILTER (WHERE f = l), 0)::bigint AS unique_fails,
    coalesce(sum(good) FILTER (WHERE contains(f, l) AND translate(f, before, '') = f), 0)::bigint AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE contains(f, l) AND translate(f, before, '') = f), 0)::bigint AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::bigint AS shapley
FROM audit
"""
