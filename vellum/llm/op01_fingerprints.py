"""Exact document fingerprints: canonical text, wide xxhash, bytes compared inside equal buckets.

Texts are normalised (NFC), case folded and normalised again, white space is folded. All of it is
DataFrame expressions. Two digests of 64 bits make the bucket. Only texts whose bucket has another
member are read again, and the least and greatest canonical text of each bucket are compared; where
they differ, the bucket's texts get numbered fingerprints. So equal fingerprints always mean equal
canonical bytes.

Defined cases: a null text is empty; rows without doc_id come after all others; rows that share a
doc_id are ordered by text; the last row's next is the first (its own, if it is alone); an empty
table gives an empty result; other columns are ignored. Likeness of exact fingerprints is 1 or 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, table, texts
from vellum.llm.unicode_tables import canonical

#: Quantiles of doc_id that split the order; each is split evenly further.
QUANTILES = 1024
#: Ids that may be sent to every executor (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def wide(text: Column) -> Column:
    """Two XXH64 of a text with different seeds, as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), text)), 16, "0")))


def replace_end(text: Column, next_text: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by the first as many of the next text."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(next_text, F.lit(1), k))


def in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, k, text, h) with those of the next row: next_k, next_text, next_h.

    doc_id ranges are the unit of work, so no task holds the whole order. Each range's last row
    takes the first row of the next range that has any.
    """
    spark = rows.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coarse = min(wanted, QUANTILES)
    split = -(-wanted // coarse)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10_000).alias("b")).collect()[0]["b"] or [0]
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    at = F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))
    low, high = F.coalesce(F.get(edges, at - 1), F.col("doc_id")), F.coalesce(F.get(edges, at), F.col("doc_id") + 1)
    fine = F.least(F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * split), F.lit(split - 1))
    last = (len(bounds) + 2) * split
    ranged = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(at * split + fine).cast("long"))

    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    here = ranged.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("k", "text", "h")])
    # A row per range: the number of ranges bounds what follows.
    firsts = ranged.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    whole = Window.orderBy("bucket")
    firsts = firsts.select("bucket", "first_id", F.coalesce(F.lag("bucket").over(whole), F.max("bucket").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    firsts = materialize(firsts, "firsts")
    found = rows.join(F.broadcast(firsts), rows.doc_id.eqNullSafe(firsts.first_id))
    found = found.groupBy(F.col("before").alias("bucket")).agg(F.min(F.struct("text", "h", "k")).alias("f"))
    end = F.col("next_text").isNull()
    both = here.join(found, "bucket", "left")
    return both.select(
        "doc_id", "k", "text", "h",
        F.when(end, F.col("f.k")).otherwise(F.col("next_k")).alias("next_k"),
        F.when(end, F.col("f.text")).otherwise(F.col("next_text")).alias("next_text"),
        F.when(end, F.col("f.h")).otherwise(F.col("next_h")).alias("next_h"),
    )


def settle(found: DataFrame, docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame | None:
    """Compare bytes inside buckets with several members; (k, h, kind, fixed) where a bucket mixes texts.

    None: every bucket holds one text.
    """
    both = found.select(F.col("h").alias("x")).unionByName(found.select(F.col("eh").alias("x")))
    shared = both.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    members = found.select("k", "h", "next_k", "next_h", F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.col("h").alias("x")), F.struct(F.lit("edited").alias("kind"), F.col("eh").alias("x")))).alias("m"))
    members = members.select("k", "h", "next_k", "next_h", "m.kind", "m.x")
    members = materialize(members.join(shared, "x", "left_semi").distinct(), "members")
    ids = members.select("k").unionByName(members.where("kind = 'edited'").select(F.col("next_k").alias("k"))).distinct()
    ids = materialize(ids, "ids")
    read = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "k", "left_semi")
    read = read.select("k", "text", digest(canonical(F.col("text"))).alias("h")).dropDuplicates(["k", "h"])
    own = members.where("kind = 'text'").select("k", "h", "kind", "x").join(read, ["k", "h"]).select("k", "h", "kind", "x", canonical(F.col("text")).alias("bytes"))
    following = read.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    edited = members.where("kind = 'edited'").join(read, ["k", "h"]).join(following, ["next_k", "next_h"])
    edited = edited.select("k", "h", "kind", "x", canonical(replace_end(F.col("text"), F.col("next_text"))).alias("bytes"))
    every = own.unionByName(edited)
    mixed = materialize(every.groupBy("x").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a <> b").select("x"), "mixed")
    if mixed.limit(1).count() == 0:
        return None
    every = every.join(mixed, "x", "left_semi")
    nth = every.select("x", "bytes").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("bytes")))
    return every.join(nth, ["x", "bytes"]).select("k", "h", "kind", F.concat("x", F.lit("-"), "nth").alias("fixed")).distinct()


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = wide) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    # A row's key: its id (null is one like any other) and its text's hash, as ids may repeat.
    rows = texts(docs).withColumn("k", F.concat_ws(":", F.xxhash64("text"), F.col("doc_id").cast("string")))
    hashed = rows.withColumn("h", digest(canonical(F.col("text"))))
    paired = in_order(hashed).withColumn("edited", replace_end(F.col("text"), F.col("next_text")))
    found = paired.select(
        "doc_id", "k", "h", "next_k", "next_h",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(canonical(F.col("edited"))).alias("eh"),
    )
    found = materialize(found, "fingerprints")
    fixed = settle(found, rows, digest)
    fp, efp, nfp = F.col("h"), F.col("eh"), F.col("next_h")
    if fixed is not None:
        fixed = materialize(fixed, "fixed")
        for kind, i, h, to in (("text", "k", "h", "fixed_h"), ("edited", "k", "h", "fixed_eh"), ("text", "next_k", "next_h", "fixed_next")):
            side = fixed.where(F.col("kind") == kind).select(F.col("k").alias("_i"), F.col("h").alias("_h"), F.col("fixed").alias(to)).dropDuplicates(["_i", "_h"])
            found = found.join(side, (found[i] == side["_i"]) & (found[h] == side["_h"]), "left").drop("_i", "_h")
        fp, efp, nfp = F.coalesce("fixed_h", "h"), F.coalesce("fixed_eh", "eh"), F.coalesce("fixed_next", "next_h")
    return found.select("doc_id", "n_chars", "edited_sha256", fp.alias("fingerprint"), efp.alias("edited_fingerprint"), (fp == efp).cast("double").alias("near_edited"), (fp == nfp).cast("double").alias("near_next"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
