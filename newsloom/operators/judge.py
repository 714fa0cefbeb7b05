"""Models behind a narrow interface. A judge answers with tables; what it doesn't answer is null, and
null keeps a post shown. A judge never raises: a failing provider gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Judge(Protocol):
    def pairs(self, asked: DataFrame) -> DataFrame:
        """asked: a, b -> the same with `verdict` (same, update, different or null)."""


class TableJudge:
    """Verdicts from a table."""

    def __init__(self, verdicts: DataFrame) -> None:
        self.verdicts = verdicts

    def pairs(self, asked: DataFrame) -> DataFrame:
        known = self.verdicts.filter(F.col("verdict").isin("same", "update", "different")).select("a", "b", "verdict").dropDuplicates(["a", "b"])
        return asked.join(known, ["a", "b"], "left")


class NullJudge:
    """A judge that is down."""

    def pairs(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("verdict", F.lit(None).cast("string"))


class CallableJudge:
    """Verdicts from a Python function over batches of text pairs; whatever it raises, its batch stays unanswered."""

    def __init__(self, texts: DataFrame, ask: Callable[[list[tuple[str, str]]], list[str | None]], batch: int = 10) -> None:
        self.texts, self.ask, self.batch = texts, ask, batch

    def pairs(self, asked: DataFrame) -> DataFrame:
        ask, size = self.ask, self.batch
        side = lambda c: self.texts.select(F.col("id").alias(c), F.substring("text", 1, 500).alias(f"{c}_text"))
        rows = asked.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                verdicts: list[str | None] = []
                for i in range(0, len(frame), size):
                    part = frame.iloc[i : i + size]
                    try:
                        got = list(ask(list(zip(part["a_text"], part["b_text"], strict=True))))[: len(part)]
                    except Exception:  # fail open, whatever the provider does
                        got = []
                    verdicts += [x if x in ("same", "update", "different") else None for x in got] + [None] * (len(part) - len(got))
                yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "verdict": pd.Series(verdicts, dtype="object", index=frame.index)})

        return asked.join(rows.mapInPandas(run, "a long, b long, verdict string"), ["a", "b"], "left")
