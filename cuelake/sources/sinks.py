"""Subtitle files and stored tables. Rendering is native: one line a cue, joined per title in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.functions import times

# The heads of the two ASS layouts.
_FORMAT = (
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
_EVENTS = "\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
LAYER_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\n" + _FORMAT + "\n"
    "Style: Default,Microsoft YaHei,48,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,20,1\n"
    "Style: English,Arial,36,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,15,1\n" + _EVENTS
)
PAIR_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\n" + _FORMAT + "\n"
    "Style: Bilingual,Microsoft YaHei,46,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2.2,0.7,2,80,80,58,1\n" + _EVENTS
)


def _join(lines: DataFrame, head: str = "", order: str = "pos") -> DataFrame:
    """(title_id, content): a title's lines in order behind ``head``. A file is one title by nature."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), "line")))
    return lines.groupBy("title_id").agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "")).alias("content"))


def _dialogue(start: Column, end: Column, style: str, text: Column) -> Column:
    return F.concat(F.lit("Dialogue: 0,"), times.ass_time(start), F.lit(","), times.ass_time(end), F.lit(f",{style},,0,0,0,,"), text, F.lit("\n"))


def layer_lines(cues: DataFrame, mode: str) -> DataFrame:
    """(title_id, pos, line) of the layers en, zh or bilingual; hidden and textless cues are left out."""
    raw = F.coalesce("en", "text")
    raw = F.when(X.should_clean_english("source_language"), X.clean_english_track(raw)).otherwise(raw)
    rows = cues.where(F.coalesce("display", F.lit(True))).select("title_id", "pos", F.coalesce("display_start", "start").alias("a"), F.coalesce("display_end", "end").alias("b"), X.escape_ass(raw).alias("e"), X.escape_ass("zh").alias("z"))
    a, b, e, z = (F.col(c) for c in "abez")
    if mode == "en":
        return rows.where("e <> ''").select("title_id", "pos", _dialogue(a, b, "English", e).alias("line"))
    if mode == "zh":
        return rows.where("z <> ''").select("title_id", "pos", _dialogue(a, b, "Default", z).alias("line"))
    if mode != "bilingual":
        raise ValueError(f"no layer {mode}")
    return rows.where("e <> '' or z <> ''").select("title_id", "pos", _dialogue(a, b, "Default", F.concat(z, F.lit("{\\rEnglish}\\N"), e)).alias("line"))


def render_ass(cues: DataFrame, mode: str) -> DataFrame:
    return _join(layer_lines(cues, mode), LAYER_HEAD)


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Lines of ``greedy_pairs`` rows; times of the English side if there is one."""
    side = lambda n: F.when(F.col(n).isNotNull(), X.escape_ass(f"{n}.text", keep_breaks=True)).otherwise("")
    rows = pairs.select("title_id", F.col("pair_no").alias("pos"), F.coalesce("en.start", "zh.start").alias("a"), F.coalesce("en.end", "zh.end").alias("b"), side("en").alias("e"), side("zh").alias("z"))
    e, z = F.col("e"), F.col("z")
    text = F.when((z != "") & (e != ""), F.concat(z, F.lit("\\N{\\fs34}"), e)).when(z != "", z).otherwise(F.concat(F.lit("{\\fs38}"), e))
    return rows.select("title_id", "pos", _dialogue(F.col("a"), F.col("b"), "Bilingual", text).alias("line"))


def render_pairs(pairs: DataFrame) -> DataFrame:
    return _join(pair_lines(pairs), "﻿" + PAIR_HEAD)


def render_srt(cues: DataFrame) -> DataFrame:
    """Numbered blocks of title's cues; numbers follow pos, which must be 0, 1, 2 ..."""
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), times.srt_time(F.col("start")), F.lit(" --> "), times.srt_time(F.col("end")), F.lit("\n"), X.strip(F.col("text")), F.lit("\n\n"))
    return _join(cues.select("title_id", "pos", line.alias("line")))


def render_vtt(cues: DataFrame) -> DataFrame:
    clock = lambda x: F.replace(times.srt_time(x), F.lit(","), F.lit("."))
    line = F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.lit("\n"), X.strip(F.col("text")), F.lit("\n\n"))
    return _join(cues.select("title_id", "pos", line.alias("line")), "WEBVTT\n\n")


def write_files(rendered: DataFrame, folder: str) -> None:
    """One folder a title, its content as one text file; replaces those titles, other titles' files stay."""
    body = F.regexp_replace("content", "\\n\\z", "")  # the text writer ends each row with a newline
    _replace(rendered.select("title_id", body.alias("content"))).text(folder)


def _replace(rows: DataFrame):
    """A writer that replaces the partitions of the titles in ``rows`` and leaves the others."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("title_id")


def write_titles(rows: DataFrame, path: str) -> None:
    """Replace the stored partitions of the titles in ``rows``; other titles stay."""
    _replace(rows).parquet(path)


def restart_titles(spark: SparkSession, titles: list[str], paths: list[str]) -> int:
    """Drop what the stores under ``paths`` hold of the named titles, so that they start anew.

    Every other title stays as it is: only the partition folders of the named ones are deleted. Returns
    how many there were.
    """
    hadoop, conf, gone = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), 0
    for path in paths:
        for title in titles:
            # the folder name as the Parquet and text writers of partitioned tables escape it
            name = "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\{[]^' or ord(c) < 32 or ord(c) == 127 else c for c in title)
            where = hadoop.Path(hadoop.Path(path), f"title_id={name}")
            gone += bool(where.getFileSystem(conf).delete(where, True))
    return gone
