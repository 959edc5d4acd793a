"""Columns that an operator doesn't read, set aside under names that clash with none of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Aside:
    """``rows`` has the columns of ``own`` under those names and the others as ``other_0``, ``other_1``, ..."""

    rows: DataFrame
    names: list[str]
    own: dict[str, str]

    def back(self, result: DataFrame, extra: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
        """The columns of the input in their order from ``result``, but those in ``without``; then ``extra``, which replace
        columns of their name."""
        of = {name: own for own, name in self.own.items()}
        kept = [quoted(of.get(c, f"other_{i}")).alias(c) for i, c in enumerate(self.names) if c not in (*extra, *without)]
        return result.select(*kept, *extra)


def set_aside(docs: DataFrame, own: dict[str, str], **made: Column) -> Aside:
    """``own``: the operator's name of each column that it reads; ``made``: columns that are made of the input's."""
    used = set(own.values())
    others = [quoted(c).alias(f"other_{i}") for i, c in enumerate(docs.columns) if c not in used]
    rows = docs.select(*(quoted(c).alias(name) for name, c in own.items()), *others, *(c.alias(k) for k, c in made.items()))
    return Aside(rows, docs.columns, own)
