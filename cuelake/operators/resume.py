"""Stored progress: whether it fits the current cues, what is left to do, and that times were kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as X

TOLERANCE = 0.02


def compatible(cached: DataFrame, cues: DataFrame, mode: str | None = None) -> DataFrame:
    """(title_id, cached_rows, fits): a title's stored rows fit if each meets a cue of its position with the
    same cleaned text and times within TOLERANCE, has a display flag, and the wanted processing mode."""
    now = cues.select("title_id", "pos", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("text").alias("_t"))
    same = (F.abs(F.col("start") - F.col("_s")) <= TOLERANCE) & (F.abs(F.col("end") - F.col("_e")) <= TOLERANCE) & (X.clean_subtitle_text("text") == X.clean_subtitle_text("_t"))
    same = same & F.col("display").isNotNull()
    if mode:
        same = same & F.col("processing_mode").eqNullSafe(F.lit(mode))
    rows = cached.join(now, ["title_id", "pos"], "left")
    return rows.groupBy("title_id").agg(F.count("*").alias("cached_rows"), F.bool_and(F.coalesce(same, F.lit(False))).alias("fits"))


def read_stored(spark: SparkSession, path: str, schema: str, nested: bool = False) -> DataFrame:
    """The rows stored under ``path``, as far as they can be read: no rows if nothing is there, files that are
    broken or hold other types are left out, columns that a file lacks are null. ``nested``: in folders below
    it, whatever their names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", str(nested).lower()).parquet(path)


def remaining(cues: DataFrame, cached: DataFrame, size: int, mode: str | None = None) -> DataFrame:
    """Cues from the first batch that is not wholly stored; titles whose store does not fit start anew."""
    done = compatible(cached, cues, mode).where("fits").select("title_id", (F.col("cached_rows") - F.col("cached_rows") % size).alias("_cut"))
    return cues.join(done, "title_id", "left").where(F.col("pos") >= F.coalesce("_cut", F.lit(0))).drop("_cut")


def timing_changes(source: DataFrame, processed: DataFrame) -> DataFrame:
    """(title_id, pos) of cues that are missing, new, or whose start or end is not exactly the source's."""
    side = lambda df, n: df.select("title_id", "pos", F.struct("start", "end").alias(n))
    both = side(source, "a").join(side(processed, "b"), ["title_id", "pos"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("title_id", "pos")


def assert_timing_kept(source: DataFrame, processed: DataFrame) -> None:
    bad = timing_changes(source, processed).take(1)
    if bad:
        raise ValueError(f"times of {bad[0]['title_id']} changed at cue {bad[0]['pos']}")
