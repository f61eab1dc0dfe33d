"""Columns of a line by horizontal position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bucket:
    """Words with low <= x0 < high belong to the column; None leaves a side open."""

    column: str
    low: float | None = None
    high: float | None = None
    above_low: bool = False  # low < x0 instead of low <= x0
    digits: bool = False  # only words with a digit

    def holds(self, word: Column) -> Column:
        x0, test = word["x0"], F.lit(True)
        if self.low is not None:
            test = test & ((x0 > self.low) if self.above_low else (x0 >= self.low))
        if self.high is not None:
            test = test & (x0 < self.high)
        if self.digits:
            test = test & word["text"].rlike("[0-9]")
        return test

    def texts(self, words: Column) -> Column:
        return F.transform(F.filter(words, self.holds), lambda w: w["text"])

    def joined(self, words: Column, separator: str = " ") -> Column:
        return F.array_join(self.texts(words), separator)

    def last(self, words: Column) -> Column:
        return F.coalesce(F.try_element_at(self.texts(words), F.lit(-1)), F.lit(""))


def by_name(buckets: list[Bucket]) -> dict[str, Bucket]:
    return {b.column: b for b in buckets}
