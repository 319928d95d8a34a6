"""File tables: listings without contents, the main video of a folder, sidecar subtitles and their rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.schema import SUBTITLE_EXTENSIONS, VIDEO_EXTENSIONS


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the files under folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def lines(spark: SparkSession, paths: str | list[str], logs: tuple[Column, Column] | None = None) -> DataFrame:
    """(path, line_no, line): the lines of text files, numbered from 0 as they stand, however large a file is.

    Spark splits files by byte ranges, and a line belongs to the range that it begins in. Lines are numbered
    inside their range first; the ranges' counts, a few rows a file, give where each begins. Lines end at LF,
    CR or both, bytes that are no UTF-8 become U+FFFD, an empty file has no lines.

    ``logs``, two columns of ``line`` (the name of a log and the log's own text), is for files that hold many logs
    one behind another, as a file each would cost more than its lines: (path, log, line_no, line), numbered in each
    log of a file. A log whose lines do not stand together is an error.
    """
    ranges, starts = _ranges(spark, paths, logs)
    return _numbered(ranges, starts)


def last_lines(spark: SparkSession, paths: str | list[str], chars: int = 8000, logs: tuple[Column, Column] | None = None) -> DataFrame:
    """(path, line_no, line) of the byte ranges that hold a file's last ``chars`` characters: those behind which
    fewer characters stand. Only these ranges' lines leave the scan; ``report.log_text`` cuts the rest. With
    ``logs``, as in ``lines``, the ranges of each log."""
    ranges, starts = _ranges(spark, paths, logs)
    behind = Window.partitionBy(*_owner(starts)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    near = starts.withColumn("behind", F.coalesce(F.sum("chars").over(behind), F.lit(0))).where(F.col("behind") <= chars)
    return _numbered(ranges, near)


def _owner(rows: DataFrame) -> list[str]:
    return [c for c in ("path", "log") if c in rows.columns]


def _ranges(spark: SparkSession, paths: str | list[str], logs: tuple[Column, Column] | None) -> tuple[DataFrame, DataFrame]:
    """((path, block, id, line), (path, block, shift, chars)): lines by the range that they begin in, and what
    leads from an id (rising inside a range) to the number of a line. Both come from the same scan of files."""
    found = spark.read.option("recursiveFileLookup", "true").text(paths)
    found = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.expr("make_valid_utf8(value)").alias("line"))
    found = found.withColumn("id", F.monotonically_increasing_id())
    if logs is not None:
        found = found.select("path", logs[0].alias("log"), "block", "id", logs[1].alias("line"))
    owner = _owner(found)
    together = F.max("id") - F.min("id") + 1 == F.count("*")
    first = F.when(together, F.min("id")).otherwise(F.raise_error(F.lit("lines of a log do not stand together")).cast("long"))
    sizes = found.groupBy(*owner, "block").agg(first.alias("first"), F.count("*").alias("n"), F.sum(F.char_length("line") + 1).alias("chars"))
    before = Window.partitionBy(*owner).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found, sizes.select(*owner, "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), "chars")


def _numbered(ranges: DataFrame, starts: DataFrame) -> DataFrame:
    owner = _owner(ranges)
    return ranges.join(starts, [*owner, "block"]).select(*owner, (F.col("id") + F.col("shift")).alias("line_no"), "line")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def main_videos(files: DataFrame) -> DataFrame:
    """(title_id, path, length): per title the largest video, from BDMV/STREAM if that holds any.

    files: (title_id, path, length). Of equal lengths the first path wins.
    """
    videos = files.where(X.file_extension(F.col("path")).isin(*VIDEO_EXTENSIONS))
    inner = F.col("path").contains("/BDMV/STREAM/")
    best = F.row_number().over(Window.partitionBy("title_id").orderBy(F.desc(inner), F.desc("length"), "path"))
    return videos.withColumn("_n", best).where("_n = 1").drop("_n")


def rank_sidecars(videos: DataFrame, files: DataFrame, console: bool = False) -> DataFrame:
    """(title_id, path, score, rank): subtitle files in the video's folder, best first.

    100 for the video's stem, 50 if one stem contains the other, 10 if the stem contains 'en'; ``console``
    adds 10 for every file, as the file list does. A path keeps its best score; ties go by name, last first.
    """
    subs = files.where(X.file_extension(F.col("path")).isin(*SUBTITLE_EXTENSIONS)).select(folder_of(F.col("path")).alias("_folder"), "path")
    stems = videos.select("title_id", folder_of(F.col("path")).alias("_folder"), F.lower(X.file_stem(F.col("path"))).alias("_stem"))
    stem, own = F.lower(X.file_stem(F.col("path"))), F.col("_stem")
    points = lambda test, n: F.when(test, n).otherwise(0)
    total = F.lit(10 if console else 0) + points(stem == own, 100) + points(stem.contains(own) | own.contains(stem), 50) + points(stem.contains("en"), 10)
    scored = subs.join(stems, "_folder").groupBy("title_id", "path").agg(F.max(total).alias("score"))
    order = Window.partitionBy("title_id").orderBy(F.desc("score"), F.desc(F.lower(X.file_name(F.col("path")))), "path")
    return scored.withColumn("rank", F.row_number().over(order))


def candidates(ranked: DataFrame, explicit: DataFrame, files: DataFrame) -> DataFrame:
    """(title_id, path, rank): explicit paths (title_id, path, priority) first, then the ranked ones; each
    path once, paths that are no file left out."""
    named = explicit.select("title_id", "path", F.lit(0).alias("_part"), F.col("priority").alias("_order"))
    both = named.unionByName(ranked.select("title_id", "path", F.lit(1).alias("_part"), F.col("rank").alias("_order")))
    first = both.groupBy("title_id", "path").agg(F.min(F.struct("_part", "_order")).alias("_at"))
    kept = first.join(files.select("path").distinct(), "path", "left_semi")
    order = Window.partitionBy("title_id").orderBy("_at", "path")
    return kept.select("title_id", "path", F.row_number().over(order).alias("rank"))


def resolve_languages(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(title_id, zh_path, en_path): the first candidate of each language, by file name, else by its text
    (path, content). Titles without a Chinese file are left out."""
    rows = ranked.join(texts.select("path", X.classify_text("content").alias("_by_text")), "path", "left")
    rows = rows.withColumn("language", F.coalesce(X.classify_file_name(F.col("path")), F.col("_by_text"), F.lit("")))
    first = lambda code: F.min_by("path", F.when(F.col("language") == code, F.col("rank")))
    return rows.groupBy("title_id").agg(first("zh").alias("zh_path"), first("en").alias("en_path")).where("zh_path is not null")
