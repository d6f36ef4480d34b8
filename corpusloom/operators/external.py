"""Interfaces to models: generators, scorers and judges are passed in; no model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Model(Protocol):
    """Made once a task; called with a batch of requests, returns as many replies, None for one that failed."""

    def __call__(self, requests: list[str]) -> list[str | None]: ...


def ask(requests: DataFrame, make: Callable[[], Model], column: str = "request", batch: int = 64, parts: int | None = None) -> DataFrame:
    """The input with reply and failed added. parts bounds how many tasks call at once; a failed request fails alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            replies: list[str | None] = []
            texts = frame[column].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    got = model(part)
                except Exception:
                    got = []
                    for one in part:
                        try:
                            got += model([one])
                        except Exception:
                            got.append(None)
                replies += got
            yield frame.assign(reply=replies, failed=[r is None for r in replies])

    rows = requests.repartition(parts) if parts else requests
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return rows.mapInPandas(run, f"{kinds}, reply string, failed boolean")


def ask_once(rows: DataFrame, request: Column, make: Callable[[], Model], **options) -> DataFrame:
    """Equal requests are asked once and their reply is given to every row."""
    asked = rows.withColumn("request", request)
    replies = ask(asked.select("request").distinct(), make, **options)
    return asked.join(replies, "request", "left")


def samples(questions: DataFrame, n: int) -> DataFrame:
    """Each question n times, with its sample's number."""
    return questions.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def mismatched(rows: DataFrame, questions: DataFrame, index: str, n: int, most: int) -> DataFrame:
    """A control: the first samples of each question against the question half a table away."""
    shifted = questions.withColumnRenamed(index, "__q")
    return rows.filter(F.col("sample") < most).withColumn("__q", F.pmod(F.col(index) + n // 2, F.lit(n))).join(shifted, "__q").drop("__q")


def remaining(plan: DataFrame, done: DataFrame, keys: list[str], target: int) -> DataFrame:
    """What is still to generate by key: target less what is there."""
    have = done.groupBy(*keys).agg(F.count("*").alias("__d"))
    return plan.join(have, keys, "left").withColumn("to_do", F.greatest(target - F.coalesce("__d", F.lit(0)), F.lit(0))).drop("__d").filter("to_do > 0")


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
