"""Small documents that hold the odd cases: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, fp long, y int, part int, spans string, held_out string, vec_id long, bucket long, list int"
CLASH = (9.5, "h", 1, 2, 3, "s", "t", 4, 5, 6)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(7)
    line = "this very line stands in many of the documents here."
    rows = [(i, words(rng, rng.randint(1, 120)), "ab"[i % 2]) for i in range(40)]
    rows += [(40 + i, rows[3][1], "a") for i in range(5)]  # exact copies
    near = words(rng, 400).split()
    rows += [(50 + i, " ".join(near[:i] + ["changed"] + near[i + 1 :]), "b") for i in range(6)]  # near copies
    rows += [(60 + i, f"{words(rng, 20)}.\n{line}\n{words(rng, 15)}.", "a") for i in range(8)]
    rows += [(70, None, None), (71, "", "a"), (72, " \n\t ", "b"), (73, "x" * 30_000, "a"), (74, words(rng, 6_000), "b")]
    rows += [(75, "Élan  vital", "a"), (76, "Élan vital", "b"), (77, "ÉLAN VITAL ", None), (78, "1 2 3 !?", "a")]
    rows += [(None, "no id at all in this row but some words", "a"), (80, "twice", "a"), (80, "twice", "a"), (81, "one id", "b"), (81, "two texts", "b")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, lang, None, None, *CLASH) for i, t, lang in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
