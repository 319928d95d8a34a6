"""Scans of very long titles: a title is cut into blocks of positions, and each block starts from what the
blocks before it add up to, so that no task holds a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 20_000


def before(rows: DataFrame, key: list[str], order: str, values: dict[str, tuple[str, Column]], block: int = BLOCK, backwards: bool = False) -> DataFrame:
    """rows with a column for each of ``values`` (name: (kind, column)), over the rows of the same key that stand
    before a row in ``order``, a whole number, or behind it if ``backwards``; null where there is none.

    The kinds are "last", the next row's value (as lag and lead), "sum", for whole numbers, and "max". Blocks
    are totalled first, a row a block; a window over these few rows gives each block its start, which stands as
    the first row of the block in the window over its own rows. ``rows`` are read twice, so give stored ones.
    """
    names = {name: f"_value_{name}" for name in values}
    dealt = rows.withColumns({"_block": F.floor(F.col(order) / block)} | {names[n]: c for n, (_, c) in values.items()})
    end = F.min_by if backwards else F.max_by
    total = {"sum": F.sum, "max": F.max, "last": lambda c: end(c, order)}
    sums = dealt.groupBy(*key, "_block").agg(*[total[kind](names[n]).alias(names[n]) for n, (kind, _) in values.items()])
    toward = lambda c: F.desc(c) if backwards else F.asc(c)

    def over(window, c: str, kind: str) -> Column:
        if kind == "last":
            return F.lag(c).over(window)
        return total[kind](c).over(window.rowsBetween(Window.unboundedPreceding, -1))

    blocks = Window.partitionBy(*key).orderBy(toward("_block"))
    starts = sums.select(*key, "_block", F.lit(True).alias("_start"), *[over(blocks, c, values[n][0]).alias(c) for n, c in names.items()])
    both = dealt.withColumn("_start", F.lit(False)).unionByName(starts, allowMissingColumns=True)
    inside = Window.partitionBy(*key, "_block").orderBy(F.desc("_start"), toward(order))
    out = both.withColumns({n: over(inside, c, values[n][0]) for n, c in names.items()})
    return out.where("not _start").drop("_start", "_block", *names.values())


def number(rows: DataFrame, key: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """rows with ``number``: 0, 1, ... along ``order`` in each key."""
    counted = before(rows, key, order, {"number": ("sum", F.lit(1).cast("long"))}, block)
    return counted.withColumn("number", F.coalesce("number", F.lit(0).cast("long")))
