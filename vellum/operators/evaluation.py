"""Retrieval quality of ranked hits against graded labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depth of the metrics; a grade from which a note counts as relevant.
DEPTH, RELEVANT = 10, 2


def collapse(hits: DataFrame, by: list[str] = ("qid",)) -> DataFrame:
    """by, note, rn: each note at its best hit, ranked anew (hits: by, pos, note)."""
    first = hits.groupBy(*by, "note").agg(F.min("pos").alias("pos"))
    return first.select(*by, "note", F.row_number().over(Window.partitionBy(*by).orderBy("pos")).alias("rn"))


def _gain() -> Column:
    return F.col("grade") / F.log2(F.col("rn") + 1.0)


def _measured(graded: DataFrame, ideal: DataFrame, by: list[str]) -> DataFrame:
    """Scores from graded hits (by, rn, grade) and what is best possible (by, idcg, all: relevant notes)."""
    good = F.col("grade") >= RELEVANT
    got = graded.groupBy(*by).agg(
        F.sum(F.when(F.col("rn") <= DEPTH, _gain()).otherwise(0.0)).alias("dcg"),
        F.min(F.when(good & (F.col("rn") <= DEPTH), F.col("rn"))).alias("first"),
        F.sum((good & (F.col("rn") <= 5)).cast("int")).alias("in5"), F.sum((good & (F.col("rn") <= DEPTH)).cast("int")).alias("in10"),
    )
    both = ideal.join(got, list(by), "left")
    share = lambda c: F.when(F.col("all") > 0, F.coalesce(c, F.lit(0)) / F.col("all"))
    return both.select(
        *by,
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg10"),
        F.when(F.col("all") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr10"),
        share("in5").alias("recall5"), share("in10").alias("recall10"),
    )


def scores(ranked: DataFrame, grades: DataFrame) -> DataFrame:
    """qid, ndcg10, mrr10, recall5, recall10; null where a query has no label that counts (grades: qid, note, grade)."""
    graded = ranked.join(grades, ["qid", "note"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "note"))
    ideal = grades.withColumn("rn", place).groupBy("qid").agg(F.sum(F.when(F.col("rn") <= DEPTH, _gain()).otherwise(0.0)).alias("idcg"), F.sum((F.col("grade") >= RELEVANT).cast("int")).alias("all"))
    return _measured(graded, ideal, ["qid"])


def label_scores(ranked: DataFrame, asked: DataFrame, labels: DataFrame, by: list[str] = ("qid",), own: int = 3, same: int = 2) -> DataFrame:
    """scores where a query's own note (asked: by, own, label) is graded own, and any note of its label (labels: note, label) same.

    Only notes that were hit are graded; what is best possible follows from the number of a label's
    notes, so no query meets every note of its label. Queries without a label are left out.
    """
    held = labels.where("label is not null").select("note", "label").distinct()
    known = asked.where("label is not null")
    sizes = known.join(held.groupBy("label").agg(F.count("*").alias("n")), "label").join(held.select(F.col("note").alias("own"), "label", F.lit(own).alias("_own")), ["own", "label"], "left")
    grade = F.when(F.col("note") == F.col("own"), own).otherwise(same)
    graded = ranked.join(known, list(by)).join(held.withColumn("_held", F.lit(True)), ["note", "label"], "left").withColumn("grade", F.when(F.col("_held"), grade).otherwise(0))
    first = F.coalesce("_own", F.lit(same))
    rest = F.when(F.col("n") > 1, F.aggregate(F.sequence(F.lit(2), F.least(F.col("n"), F.lit(DEPTH)).cast("int")), F.lit(0.0), lambda s, i: s + same / F.log2(i + 1.0))).otherwise(0.0)
    ideal = sizes.select(*by, (first + rest).alias("idcg"), F.col("n").alias("all"))
    return _measured(graded, ideal, list(by))


def macro(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Means that leave undefined values out, overall or by kind."""
    rows = scored.groupBy(by) if by else scored.groupBy()
    return rows.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("ndcg10", "mrr10", "recall5", "recall10")])


def parity(a: DataFrame, b: DataFrame, by: list[str] = ("qid",)) -> DataFrame:
    """by, same: whether two result lists (by, pos, note) of a query are equal in order."""
    listed = lambda x, name: x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "note"))).alias(name))
    both = listed(a, "l").join(listed(b, "r"), list(by), "full")
    return both.select(*by, F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))
