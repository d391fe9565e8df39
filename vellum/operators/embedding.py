"""Embedding of chunks through a pluggable batch embedder."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

#: Texts a call.
BATCH = 64
#: Returns a vector per text in order, or (place, vector) pairs in any order.
Embedder = Callable[[list[str]], list]


class Passing(Exception):
    """A failure that may pass when tried again."""


class Loading(Exception):
    """The model is being loaded; worth waiting for."""


class WrongAnswer(ValueError):
    """Vectors that can't be matched with the texts."""


@dataclass(frozen=True)
class Retries:
    """Attempts at passing failures, seconds in all that loading may take, and the first and longest pause of each."""

    attempts: int = 3
    pause: float = 1.0
    longest: float = 4.0
    loading: float = 600.0
    loading_pause: float = 0.5
    loading_longest: float = 5.0
    jitter: float = 0.25


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic embedder for tests: signed counts of hashed words."""

    def embed(some: list[str]) -> list[list[float]]:
        out = np.zeros((len(some), dim), np.float32)
        for row, text in zip(out, some):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return out.tolist()

    return embed


def in_order(got: list, n: int) -> list:
    """n vectors in the order of the texts; pairs are matched by place. A missing, strange or second place is an error."""
    if not any(isinstance(g, tuple) for g in got):
        if len(got) != n:
            raise WrongAnswer(f"{len(got)} vectors for {n} texts")
        return list(got)
    out: list = [None] * n
    for place, vector in got:
        if not 0 <= place < n:
            raise WrongAnswer(f"place {place} of {n} texts")
        if out[place] is not None:
            raise WrongAnswer(f"place {place} came twice")
        out[place] = vector
    if None in out:
        raise WrongAnswer(f"no vector for place {out.index(None)}")
    return out


def attempt(embed: Embedder, some: list[str], retries: Retries = Retries(), sleep: Callable[[float], Any] = time.sleep, clock: Callable[[], float] = time.monotonic) -> list:
    """One call with retries by the kind of failure; anything but Passing and Loading fails at once."""
    started, tries, waits = clock(), 0, 0
    while True:
        try:
            return in_order(embed(some), len(some))
        except Passing:
            tries += 1
            if tries >= retries.attempts:
                raise
            pause = min(retries.pause * 2 ** (tries - 1), retries.longest)
        except Loading:
            pause = min(retries.loading_pause * 2**waits, retries.loading_longest)
            waits += 1
            if clock() - started + pause > retries.loading:
                raise
        sleep(pause * random.uniform(1 - retries.jitter, 1 + retries.jitter))


def isolated(embed: Embedder, some: list[str], retries: Retries = Retries()) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text: a batch that fails is halved until the bad texts stand alone.

    Passing and Loading failures, once given up, are the embedder's and belong to the whole batch.
    """
    try:
        return [(v, None) for v in attempt(embed, some, retries)]
    except (Passing, Loading) as e:
        return [(None, f"{type(e).__name__}: {e}")] * len(some)
    except Exception as e:  # noqa: BLE001 - any failure of the embedder belongs to these texts
        if len(some) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(some) // 2
        return isolated(embed, some[:half], retries) + isolated(embed, some[half:], retries)


def embed_texts(rows: DataFrame, embed: Embedder, text: str = "text", concurrency: int | None = None, retries: Retries = Retries(), per_executor: int | None = None) -> DataFrame:
    """rows with embedding and error; texts that fail are marked, the others go on.

    concurrency: calls at once in the whole stage (as many tasks); without it every task calls.
    per_executor: CPUs that a task takes by stage-level scheduling, so that an executor with c cores
    makes c / per_executor calls at once, however large the cluster is.
    """
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for i in range(0, len(batch), BATCH):
                found += isolated(embed, batch[text].iloc[i : i + BATCH].fillna("").tolist(), retries)
            yield batch.assign(embedding=pd.Series([v for v, _ in found], index=batch.index, dtype=object), error=pd.Series([e for _, e in found], index=batch.index, dtype=object))

    profile = None
    if per_executor:
        from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

        profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(per_executor)).build
    return (rows.repartition(max(concurrency, 1)) if concurrency else rows).mapInPandas(run, schema, profile=profile)


def good_and_failed(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return embedded.where(F.col("error").isNull()).drop("error"), embedded.where(F.col("error").isNotNull()).drop("embedding")
