"""Reports over cues and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators import scan

# Phrases of a run log and the stage (0 extract, 1 recognise, 2 translate) they stand for.
STAGES = (
    ("Generating bilingual subtitles", "merging", 2),
    ("Starting sentence-level LLM", "model", 2),
    ("Processing segments", "model", 2),
    ("Starting LLM proofreading", "model", 2),
    ("Proofreading segments", "model", 2),
    ("Transcribing audio", "speech", 1),
    ("Loading faster-whisper", "speech", 1),
    ("Extracting audio from", "audio", 0),
    ("Running OCR", "ocr", 1),
    ("OCR source images:", "ocr", 1),
    ("Extracting PGS image", "extracting", 0),
    ("Extracting PGS stream", "extracting", 0),
    ("Rendering PGS images", "extracting", 0),
    ("Extracting subtitles from", "extracting", 0),
    ("Using embedded subtitle stream", "extracting", 0),
    ("Using sidecar", "reading", 0),
)
DONE = "Success! Subtitles saved"


def gaps(cues: DataFrame, block: int = 0) -> DataFrame:
    """cues with ``gap``: seconds since the cue before ended, null for a title's first; it may be negative.

    With ``block`` long titles are cut into blocks of so many positions; cues are then read twice."""
    if block:
        rows = scan.before(cues, ["title_id"], "pos", {"_before": ("last", F.col("end"))}, block)
        return rows.withColumn("gap", F.col("start") - F.col("_before")).drop("_before")
    before = F.lag("end").over(Window.partitionBy("title_id").orderBy("pos"))
    return cues.withColumn("gap", F.col("start") - before)


def timing(cues: DataFrame) -> DataFrame:
    """Per title: events, max_duration, over_6s, over_8s, gaps_over_5s, max_gap (0 if there is one cue)."""
    length = F.col("end") - F.col("start")
    return gaps(cues).groupBy("title_id").agg(
        F.count("*").alias("events"),
        F.max(length).alias("max_duration"),
        F.count_if(length > 6).alias("over_6s"),
        F.count_if(length > 8).alias("over_8s"),
        F.count_if(F.col("gap") > 5).alias("gaps_over_5s"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"),
    )


def preview(cues: DataFrame, n: int = 10) -> DataFrame:
    """The last n visible cues of each title, narrow."""
    shown = cues.where(F.coalesce("display", F.lit(True)))
    last = F.row_number().over(Window.partitionBy("title_id").orderBy(F.desc("pos")))
    rows = shown.withColumn("_n", last).where(F.col("_n") <= n)
    return rows.select("title_id", "pos", F.coalesce("display_start", "start").alias("start"), F.coalesce("display_end", "end").alias("end"), "text")


def progress(cues: DataFrame, cached: DataFrame) -> DataFrame:
    """(title_id, total, completed, visible, last_visible): how far each title is."""
    shown = F.coalesce("display", F.lit(True))
    done = cached.groupBy("title_id").agg(F.count("*").alias("completed"), F.count_if(shown).alias("visible"), F.max(F.when(shown, F.col("pos"))).alias("last_visible"))
    all_ = cues.groupBy("title_id").agg(F.count("*").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.join(done, "title_id", "full").select("title_id", "total", zero("completed"), zero("visible"), "last_visible")


def stages(log: DataFrame, running: DataFrame) -> DataFrame:
    """(run_id, label, stage) from log lines (run_id, line_no, line) and (run_id, running).

    Runs that stopped are done (3) if they said so, else idle (-1); the last telling line places the others,
    and a run that has said nothing is starting (0).
    """
    told = F.coalesce(*[F.when(F.col("line").contains(p), F.struct(F.lit(name).alias("label"), F.lit(n).alias("stage"))) for p, name, n in STAGES])
    rows = log.withColumn("_told", told)
    seen = rows.groupBy("run_id").agg(F.max_by("_told", F.when(F.col("_told").isNotNull(), F.col("line_no"))).alias("last"), F.bool_or(F.col("line").contains(DONE)).alias("done"))
    rows = running.join(seen, "run_id", "left")
    pick = lambda kind, a, b, c: F.when(F.col("running"), F.coalesce(f"last.{kind}", F.lit(a))).when(F.col("done"), F.lit(b)).otherwise(F.lit(c))
    return rows.select("run_id", pick("label", "starting", "done", "idle").alias("label"), pick("stage", 0, 3, -1).alias("stage"))


def log_tail(log: DataFrame, lines: int = 200) -> DataFrame:
    """The last lines of each run."""
    last = F.max("line_no").over(Window.partitionBy("run_id"))
    return log.withColumn("_last", last).where(F.col("line_no") > F.col("_last") - lines).drop("_last")


def log_text(log: DataFrame, chars: int = 8000) -> DataFrame:
    """(run_id, tail): the last ``chars`` characters of each run's log. Lines that begin farther from the end
    leave before they are joined, so a long log costs a running sum."""
    behind = Window.partitionBy("run_id").orderBy(F.desc("line_no"), F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce("line", F.lit(""))
    rows = log.withColumn("_behind", F.coalesce(F.sum(F.char_length(line) + 1).over(behind), F.lit(0))).where(F.col("_behind") <= chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda r: r["line"]), "\n")
    return rows.groupBy("run_id").agg(F.right(joined, F.lit(chars)).alias("tail"))
