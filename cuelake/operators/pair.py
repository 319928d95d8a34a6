"""Pairing of two tracks of one title by time: candidates, best match, exact greedy pairing, merging."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.functions import times

WINDOW, LAG, LEAST_SCORE = 12, 5.0, -2.5
#: En cues that one task takes in a row where runs are cut into blocks.
BLOCK = 20_000


def candidates(en: DataFrame, zh: DataFrame) -> DataFrame:
    """(title_id, en_pos, zh_pos, score): the zh cues each en cue may take.

    They are WINDOW positions from the first zh cue that ends no earlier than LAG seconds before the latest
    en start so far. That first position comes from one sorted pass over both tracks, and the candidates
    from an equi-join on (title, position), so no title ever meets itself in full. Sound cues take none.
    """
    so_far = Window.partitionBy("title_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    left = en.select("title_id", F.col("pos").alias("en_pos"), F.col("start").alias("es"), F.col("end").alias("ee"), X.is_sound_cue("text").alias("sound"), (F.max("start").over(so_far) - LAG).alias("at"))
    right = zh.select("title_id", F.col("pos").alias("zh_pos"), F.col("start").alias("zs"), F.col("end").alias("ze"), F.max("end").over(so_far).alias("reach"))
    marks = left.select("title_id", "en_pos", "at", F.lit(None).cast("long").alias("zp")).unionByName(right.select("title_id", F.lit(None).cast("long").alias("en_pos"), F.col("reach").alias("at"), F.col("zh_pos").alias("zp")))
    down = Window.partitionBy("title_id").orderBy(F.desc("at"), F.asc_nulls_last("zp")).rowsBetween(Window.unboundedPreceding, 0)
    first = marks.withColumn("first", F.min("zp").over(down)).where("en_pos is not null and first is not null").select("title_id", "en_pos", "first")
    slots = left.where(~F.col("sound")).join(first, ["title_id", "en_pos"]).withColumn("zh_pos", F.explode(F.sequence("first", F.col("first") + WINDOW - 1)))
    met = slots.join(right, ["title_id", "zh_pos"])
    return met.select("title_id", "en_pos", "zh_pos", times.pair_score(F.col("es"), F.col("ee"), F.col("zs"), F.col("ze")).alias("score")).where(F.col("score") >= LEAST_SCORE)


def best_match(en: DataFrame, zh: DataFrame) -> DataFrame:
    """(title_id, en_pos, zh_pos, score): each en cue's best candidate, of equals the first. A zh cue may
    serve several en cues; ``greedy_pairs`` forbids that."""
    best = F.max_by(F.struct("zh_pos", "score"), F.struct("score", -F.col("zh_pos")))
    return candidates(en, zh).groupBy("title_id", "en_pos").agg(best.alias("b")).select("title_id", "en_pos", "b.zh_pos", "b.score")


def _choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """En cues choose in order among candidates sorted best first; what is taken is held for one run only. Rows
    of en_pos -1, which stand first, name zh cues that are taken before the run begins."""
    run, cue, used = None, None, set()
    for frame in frames:
        rows = []
        for title, number, en_pos, zh_pos in zip(frame["title_id"], frame["run"], frame["en_pos"], frame["zh_pos"]):
            if (title, number) != run:
                run, cue, used = (title, number), None, set()
            if en_pos == -1:
                used.add(zh_pos)
            elif en_pos != cue and zh_pos not in used:
                cue = en_pos  # has chosen
                used.add(zh_pos)
                rows.append((title, number, en_pos, zh_pos))
        yield pd.DataFrame(rows, columns=["title_id", "run", "en_pos", "zh_pos"])


def _chosen(dealt: DataFrame) -> DataFrame:
    """(title_id, run, en_pos, zh_pos) of the choices in candidates (title_id, run, en_pos, zh_pos, score)."""
    rows = dealt.repartition("title_id", "run").sortWithinPartitions("title_id", "run", "en_pos", F.desc("score"), "zh_pos")
    return rows.select("title_id", "run", "en_pos", "zh_pos").mapInPandas(_choose, "title_id string, run long, en_pos long, zh_pos long")


def _in_runs(met: DataFrame) -> DataFrame:
    """Choices by runs whose candidates do not overlap."""
    reach = met.groupBy("title_id", "en_pos").agg(F.min("zh_pos").alias("lo"), F.max("zh_pos").alias("hi"))
    order = Window.partitionBy("title_id").orderBy("en_pos")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # from the end, as Spark goes through all that follows anew for each row of the other direction
    after = F.min("lo").over(Window.partitionBy("title_id").orderBy(F.desc("en_pos")).rowsBetween(Window.unboundedPreceding, 0))
    reach = reach.withColumn("cut", F.when(before.isNull() | (after > before), 1).otherwise(0))
    reach = reach.select("title_id", "en_pos", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return _chosen(met.join(reach, ["title_id", "en_pos"]))


def _in_blocks(met: DataFrame, store: Callable[[DataFrame, str], DataFrame], block: int) -> DataFrame:
    """Choices by blocks of ``block`` en cues, repeated until each block has seen what earlier ones took.

    All blocks choose at once; then those choose again that hold a candidate which an earlier block took, or
    no longer takes. Candidates start no earlier from one en cue to the next, so an earlier block can have
    taken only the first WINDOW positions from a block's lowest. After k rounds the first k blocks of a title
    are settled, and a block seldom hands a change on to its end, so few rounds are needed.
    """
    edges = store(met.withColumn("run", F.floor(F.col("en_pos") / block)), "pair-candidates")
    lowest = edges.groupBy("title_id", "run").agg(F.min("zh_pos").alias("lo"))
    reach = store(lowest.select("title_id", "run", F.explode(F.sequence("lo", F.col("lo") + WINDOW - 1)).alias("zh_pos")), "pair-reach")
    chosen, held = store(_chosen(edges), "pair-chosen-0"), None
    for number in itertools.count(1):
        taken = reach.join(chosen.select("title_id", "zh_pos", F.col("run").alias("by")), ["title_id", "zh_pos"]).where("by < run")
        now = store(taken.groupBy("title_id", "run").agg(F.array_sort(F.collect_set("zh_pos")).alias("now")), f"pair-held-{number}")
        both = now.withColumn("held", F.lit(None).cast("array<long>")) if held is None else now.join(held.withColumnRenamed("now", "held"), ["title_id", "run"], "full")
        changed = store(both.where(~F.col("now").eqNullSafe(F.col("held"))).select("title_id", "run", "now"), f"pair-changed-{number}")
        if changed.isEmpty():
            return chosen
        first = changed.select("title_id", "run", F.explode("now").alias("zh_pos")).withColumn("en_pos", F.lit(-1).cast("long"))
        again = edges.join(changed.select("title_id", "run"), ["title_id", "run"], "left_semi").unionByName(first, allowMissingColumns=True)
        kept = chosen.join(changed.select("title_id", "run"), ["title_id", "run"], "left_anti")
        chosen, held = store(kept.unionByName(_chosen(again)), f"pair-chosen-{number}"), now


def greedy_pairs(en: DataFrame, zh: DataFrame, store: Callable[[DataFrame, str], DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """(title_id, pair_no, en, zh): one-to-one pairs in the order of their earliest start, unmatched cues of
    either side on their own.

    En cues choose in order; a zh cue that is taken still fills its place in the window. A choice depends on
    earlier ones only as far as their candidates reach, so titles are cut into runs whose candidates do not
    overlap. Runs spread over tasks, which hold no more than the cues taken in one run.

    A run that overlaps throughout is one task. With ``store`` (which writes rows under a name and gives them
    back) titles are cut into blocks of ``block`` en cues wherever they are, and blocks choose in rounds until
    nothing changes; the pairs are the same.
    """
    met = candidates(en, zh)
    chosen = (_in_runs(met) if store is None else _in_blocks(met, store, block)).drop("run")
    side = lambda cues, name: cues.select("title_id", F.col("pos").alias(f"{name}_pos"), F.struct("pos", "start", "end", "text").alias(name))
    whole = side(en, "en").join(chosen, ["title_id", "en_pos"], "left").join(side(zh, "zh"), ["title_id", "zh_pos"], "full")
    order = Window.partitionBy("title_id").orderBy(F.least("en.start", "zh.start"), F.col("en_pos").isNull(), "en_pos", "zh_pos")
    return whole.withColumn("pair_no", (F.row_number().over(order) - 1).cast("long")).select("title_id", "pair_no", "en", "zh")


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """(title_id, matched, zh_total)."""
    said = F.col("zh").isNotNull() & (X.strip(F.coalesce("zh.text", F.lit(""))) != "")
    return pairs.groupBy("title_id").agg(F.count_if(F.col("en").isNotNull() & said).alias("matched"), F.count_if(F.col("zh").isNotNull()).alias("zh_total"))


def events(cues: DataFrame, key: str = "text") -> DataFrame:
    """Narrow cues: the key's text or else the text, cleaned; empty and endless ones dropped, renumbered."""
    text = X.clean_subtitle_text(F.coalesce(X.falsy(F.col(key), F.col("text")), F.lit("")))
    rows = cues.select("title_id", "pos", "start", "end", text.alias("text")).where("text <> '' and end > start")
    order = Window.partitionBy("title_id").orderBy("pos")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def merge_tracks(en: DataFrame, zh: DataFrame, label: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Cues of titles that have a zh track, paired with their en track if there is one: the span of both,
    English cleaned, Chinese simplified, pairs without text dropped."""
    table = mapping or {}
    zh = events(zh.withColumn("text", X.simplify("text", table)))
    en = events(en).join(zh.select("title_id").distinct(), "title_id", "left_semi")
    pairs = greedy_pairs(en, zh)
    en_text = F.when(F.col("en").isNotNull(), X.clean_english_track("en.text")).otherwise("")
    zh_text = F.when(F.col("zh").isNotNull(), X.simplify(X.clean_subtitle_text("zh.text"), table)).otherwise("")
    rows = pairs.select("title_id", F.col("pair_no").alias("pos"), F.least("en.start", "zh.start").alias("start"), F.greatest("en.end", "zh.end").alias("end"), en_text.alias("en"), zh_text.alias("zh"))
    rows = rows.withColumn("text", F.coalesce(X.falsy(F.col("en"), F.col("zh")), F.lit(""))).where("text <> ''")
    order = Window.partitionBy("title_id").orderBy("pos")
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    return rows.select("title_id", "pos", "start", "end", "text", "en", "zh", F.lit(label).alias("source_language"), F.lit(True).alias("display"))
