"""The surface for user functions: chains, folds, filters before a UDF, ordering and whole-table hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = {"pre": 0, "normal": 1, "post": 2, "pin-post": 3}


@dataclass
class Hook:
    name: str
    call: Callable
    order: str = "normal"
    where: Column | None = None


@dataclass
class Hooks:
    """Functions by the stage they are for; stages without one cost nothing."""

    by_stage: dict[str, list[Hook]] = field(default_factory=dict)

    def add(self, stage: str, hook: Hook) -> Hooks:
        self.by_stage.setdefault(stage, []).append(hook)
        return self

    def of(self, stage: str) -> list[Hook]:
        """pre, normal, post as added, then pin-post in reverse."""
        own = self.by_stage.get(stage, [])
        early = sorted((h for h in own if h.order != "pin-post"), key=lambda h: ORDER[h.order])
        return early + [h for h in reversed(own) if h.order == "pin-post"]

    def first(self, stage: str, *args: Column) -> Column:
        """What the first function that has an answer gives."""
        own = self.of(stage)
        return F.coalesce(*[h.call(*args) for h in own]) if own else F.lit(None)

    def fold(self, stage: str, text: Column) -> Column:
        """Each function's output is the next one's input; a null output leaves the text as it is."""
        return reduce(lambda t, h: F.coalesce(h.call(t), t), self.of(stage), text)

    def joined(self, stage: str, *args: Column) -> Column:
        """All outputs, one after another."""
        return F.concat_ws("", *[h.call(*args) for h in self.of(stage)])

    def table(self, stage: str, df: DataFrame) -> DataFrame:
        """Functions from table to table, one after another."""
        return reduce(lambda d, h: h.call(d), self.of(stage), df)


def only_where(df: DataFrame, where: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` (a Python UDF, say) for the rows that meet ``where`` alone: the others never leave the JVM."""
    ok = F.coalesce(where, F.lit(False))
    return change(df.where(ok)).unionByName(df.where(~ok), allowMissingColumns=True)
