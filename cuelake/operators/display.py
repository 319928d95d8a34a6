"""Display flags and times: directives of a reply, and visible cues that reach over hidden ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators import scan

TOLERANCE, MAX_GAP = 0.02, 2.0
# Texts that mean "do not show".
HIDING = ("false", "0", "no", "hidden", "hide", "omit", "skip")


def _get(item: str, key: str) -> str:
    return f"variant_get({item}, '$.{key}', 'variant')"


def display_flag(value: str) -> Column:
    """Whether the variant ``value`` (SQL text) shows: booleans as they are, numbers unless zero, texts
    unless they are one of HIDING, anything else and JSON null do."""
    kind = f"schema_of_variant({value})"
    texts = ", ".join(f"'{x}'" for x in HIDING)
    return F.expr(
        f"case when {value} is null or {kind} = 'VOID' then true when {kind} = 'BOOLEAN' then try_variant_get({value}, '$', 'boolean')"
        f" when {kind} = 'STRING' then lower(trim(try_variant_get({value}, '$', 'string'))) not in ({texts})"
        f" when {kind} like 'ARRAY%' or {kind} like 'OBJECT%' then true else try_variant_get({value}, '$', 'double') <> 0 end"
    )


def directive(item: str = "item") -> list[Column]:
    """(flag, asked_start, asked_end) of a reply item, a variant column. The flag is that of display, show
    or keep, the first key that is there; times fall back from display_x to x."""
    flag = f"coalesce({_get(item, 'display')}, {_get(item, 'show')}, {_get(item, 'keep')})"
    time = lambda a, b: F.coalesce(F.expr(f"try_variant_get({item}, '$.{a}', 'double')"), F.expr(f"try_variant_get({item}, '$.{b}', 'double')"))
    return [display_flag(flag).alias("flag"), time("display_start", "start").alias("asked_start"), time("display_end", "end").alias("asked_end")]


def apply_timing(cues: DataFrame) -> DataFrame:
    """cues (start, end, context_start, context_end, flag, asked_start, asked_end) with display,
    display_start and display_end: asked times clamped to the context, own times if they are inverted,
    stored only where they differ by more than TOLERANCE, and never for hidden cues."""
    start, end = F.col("start"), F.col("end")
    clamp = lambda x: F.greatest(F.col("context_start"), F.least(F.col("context_end"), x))
    a, b = clamp(F.coalesce("asked_start", start)), clamp(F.coalesce("asked_end", end))
    a, b = F.when(b <= a, start).otherwise(a), F.when(b <= a, end).otherwise(b)
    keep = lambda x, own: F.when(F.col("flag") & (F.abs(x - own) > TOLERANCE), x)
    out = cues.withColumn("display", F.col("flag")).withColumn("display_start", keep(a, start)).withColumn("display_end", keep(b, end))
    return out.drop("flag", "asked_start", "asked_end", "context_start", "context_end")


def _extend_in_order(max_gap: float, columns: list[str], back: int):
    """A fold over rows sorted by title, island and position; of an island only its visible cue is held."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                _, number, shown, start, end, display_end, place = row[-7:]
                if place == 1:
                    if held:
                        out.append(tuple(held))
                    held = None
                if shown and number > 0:
                    held = list(row[:-7])
                    reach = end if pd.isna(display_end) else display_end
                    continue
                if held and start - reach <= max_gap:
                    reach = held[back] = max(reach, end)
                out.append(row[:-7])
            yield pd.DataFrame(out, columns=columns).astype(dict(zip(columns, frame.dtypes)))
        if held:
            yield pd.DataFrame([tuple(held)], columns=columns).astype(dict(zip(columns, frame.dtypes)))

    return fold


def _in_order(rows: DataFrame, max_gap: float, columns: list[str]) -> DataFrame:
    """``columns`` of rows (_shown, _island as well), each island folded in order by one task.

    Spark drops a repartition by columns that its input is dealt by already, and may then turn the join below into a
    broadcast that reads by files; islands would come in parts. A window is never given parts of a group, so the
    place in the island, which the fold starts from, comes from one, and the fold reads its order.
    """
    values = (F.col("title_id"), F.col("_island"), F.col("_shown"), F.col("start"), F.col("end"), F.col("display_end"))
    dealt = rows.select(*columns, *[c.alias(f"_{k}") for k, c in enumerate(values)]).repartition("_0", "_1")
    placed = dealt.withColumn("_6", F.row_number().over(Window.partitionBy("_0", "_1").orderBy("pos")))
    return placed.mapInPandas(_extend_in_order(max_gap, columns, columns.index("display_end")), rows.select(*columns).schema)


def _extend_in_blocks(cues: DataFrame, max_gap: float, store: Callable[[DataFrame, str], DataFrame], block: int) -> DataFrame:
    """Islands, each a visible cue and the hidden ones behind it, come from a scan of each title; how far an
    island reaches where its first gap fails, from a scan of the island and one row of totals an island."""
    shown, island = F.coalesce("display", F.lit(True)), ["title_id", "_island"]
    one = F.when(shown, 1).otherwise(0).cast("long")
    told = scan.before(store(cues, "cues"), ["title_id"], "pos", {"_seen": ("sum", one), "_from": ("last", F.col("start"))}, block)
    told = told.withColumn("_island", F.coalesce("_seen", F.lit(0)) + one).withColumn("_late", F.coalesce(F.col("_from") > F.col("start"), F.lit(False)) & ~shown)
    rows = store(told.drop("_seen", "_from"), "islands")
    hidden = F.when(~shown, F.col("end"))
    own = F.when(shown, F.coalesce("display_end", "end")).otherwise(F.col("end"))
    inside = scan.before(rows.where("_island > 0"), island, "pos", {"_reach": ("max", own), "_joined": ("max", hidden)}, block)
    failed = F.when(~shown & (F.col("start") - F.col("_reach") > max_gap), F.col("pos"))
    ends = inside.groupBy(*island).agg(
        F.min_by(F.struct("_reach", "_joined"), failed).alias("stop"), F.struct(F.max(own).alias("_reach"), F.max(hidden).alias("_joined")).alias("all"), F.bool_or("_late").alias("odd")
    )
    ends = store(ends.select(*island, F.coalesce("stop", "all").alias("upto"), "odd"), "island-ends")
    even = ends.where("not odd and upto._joined is not null").select(*island, F.col("upto._reach").alias("_far"))
    # starts that fall inside an island: its rows are folded in order
    odd = rows.join(ends.where("odd").select(*island), island, "left_semi").withColumn("_shown", shown)
    folded = _in_order(odd, max_gap, [*island, "pos", "display_end", "_shown"])
    far = even.unionByName(folded.where("_shown and display_end is not null").select(*island, F.col("display_end").alias("_far")))
    seen = rows.where(shown).join(far, island, "left").withColumn("display_end", F.coalesce("_far", "display_end"))
    return rows.where(~shown).select(*cues.columns).unionByName(seen.select(*cues.columns))


def extend_over_hidden(cues: DataFrame, max_gap: float = MAX_GAP, store: Callable[[DataFrame, str], DataFrame] | None = None, block: int = scan.BLOCK) -> DataFrame:
    """A visible cue's display_end reaches over the hidden cues behind it that start within ``max_gap``
    seconds of what is covered so far.

    In titles sorted by start a gap that fails once fails for good, so running maxima over the cues behind
    each visible one are exact; they need one sort. Titles that are not sorted are folded in order, each
    visible cue with the hidden ones behind it on its own.

    With ``store`` (which writes rows under a name and gives them back) long titles, and long stretches of
    hidden cues, are cut into blocks of ``block`` positions; title_id must then not be null.
    """
    if store is not None:
        return _extend_in_blocks(cues, max_gap, store, block)
    order = Window.partitionBy("title_id").orderBy("pos")
    rows = cues.withColumn("_late", F.coalesce(F.lag("start").over(order) > F.col("start"), F.lit(False)))
    rows = rows.withColumn("_unsorted", F.max("_late").over(Window.partitionBy("title_id"))).drop("_late")
    shown = F.coalesce("display", F.lit(True))
    rows = rows.withColumn("_island", F.sum(F.when(shown, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("title_id", "_island").orderBy("pos")
    own = F.when(shown, F.coalesce("display_end", "end")).otherwise(F.col("end"))
    reach = F.max(own).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_fails", F.when(~shown & (F.col("start") - reach > max_gap), 1).otherwise(0))
    rows = rows.withColumn("_failed", F.sum("_fails").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.when(~shown & (F.col("_failed") == 0), F.col("end"))
    whole = Window.partitionBy("title_id", "_island")
    last = F.max(joined).over(whole)
    fixed = F.when(shown & (F.col("_island") > 0) & last.isNotNull(), F.greatest(last, own)).otherwise(F.col("display_end"))
    done = rows.where(~F.col("_unsorted")).withColumn("display_end", fixed).select(*cues.columns)
    odd = rows.where("_unsorted").withColumn("_shown", shown)
    return done.unionByName(_in_order(odd, max_gap, cues.columns))
