"""Cue-shaped views of the driver's tables, each in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one title: pos by time, a tenth of a thousandth of the time line, errors hidden."""
    rows = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    user = Window.partitionBy("user_id")
    start = F.floor((us - F.min(us).over(user)) / 10_000_000).cast("long")
    pos = (F.row_number().over(user.orderBy("ts", "event_id")) - 1).cast("long")
    rows = rows.select(F.col("user_id").cast("string").alias("title_id"), pos.alias("pos"), start.alias("a"), (F.lit(500) + F.floor(F.col("value") * 20)).cast("long").alias("n"), "event_type", "event_id")
    second = lambda x: x.cast("double") / F.lit(1000.0)
    return rows.select("title_id", "pos", second(F.col("a")).alias("start"), second(F.col("a") + F.col("n")).alias("end"), F.col("event_type").alias("text"), (F.col("event_type") != "error").alias("display"), "event_id")


EVENTS = """
    ev0 AS (SELECT CAST(user_id AS VARCHAR) AS title_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
                   (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 10000000 AS a,
                   500 + CAST(floor(value * 20) AS BIGINT) AS n, event_type, event_id FROM events),
    ev AS (SELECT title_id, pos, CAST(a AS DOUBLE) / 1000 AS s, CAST(a + n AS DOUBLE) / 1000 AS e, event_type AS text,
                  event_type <> 'error' AS display, event_id FROM ev0)
"""


def event_tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(en, zh): purchases and signups are the zh track, the other events the en track, numbered anew."""
    rows = events_cues(spark, sf_dir)
    own = (F.row_number().over(Window.partitionBy("title_id").orderBy("pos")) - 1).cast("long")
    zh = F.col("text").isin("purchase", "signup")
    pick = lambda test: rows.where(test).select("title_id", own.alias("pos"), "start", "end", "text")
    return pick(~zh), pick(zh)


def one_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one title, a cue each half a second; signups show, every 97th cue begins 20 seconds early."""
    pos = F.col("event_id")
    start = pos.cast("double") / 2 - F.when(pos % 97 == 96, 20).otherwise(0)
    end = start + F.floor(F.col("value")).cast("double") / 8 + 0.5
    return table(spark, sf_dir, "events").select(F.lit("all").alias("title_id"), pos.alias("pos"), start.alias("start"), end.alias("end"), F.col("event_type").alias("text"), (F.col("event_type") == "signup").alias("display"))


ONE_TITLE = """
    one0 AS (SELECT event_id AS pos, CAST(event_id AS DOUBLE) / 2 - CASE WHEN event_id % 97 = 96 THEN 20 ELSE 0 END AS s, value, event_type FROM events),
    one AS (SELECT 'all' AS title_id, pos, s, s + CAST(floor(value) AS DOUBLE) / 8 + 0.5 AS e, event_type AS text, event_type = 'signup' AS display FROM one0)
"""


def talk_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one title: a cue a turn, 30 seconds apart, as long as its text."""
    rows = table(spark, sf_dir, "conversations")
    start = F.col("turn").cast("double") * 30
    return rows.select(F.col("conv_id").cast("string").alias("title_id"), F.col("turn").alias("pos"), start.alias("start"), (start + 1 + F.char_length("text").cast("double") / 15).alias("end"), "text", "role")


TALK = """
    talk AS (SELECT CAST(conv_id AS VARCHAR) AS title_id, turn AS pos, CAST(turn AS DOUBLE) * 30 AS s,
                    CAST(turn AS DOUBLE) * 30 + 1 + CAST(length(text) AS DOUBLE) / 15 AS e, text, role FROM conversations)
"""


def document_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as one title, a cue a document; tags are spelled in several ways, German is untagged."""
    tag = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "FRE").when(F.col("lang") == "de", F.lit(None)).otherwise(F.concat("lang", F.lit("-MX")))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("title_id"), F.col("doc_id").alias("pos"), "text", tag.alias("source_language"))


DOCUMENTS = """
    docs AS (SELECT source AS title_id, doc_id AS pos, text,
                    CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'FRE' WHEN 'de' THEN NULL ELSE lang || '-MX' END AS tag,
                    CASE lang WHEN 'de' THEN NULL ELSE lang END AS known FROM documents)
"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as release files of forty titles: videos and subtitles with release tags in their names."""
    kind = F.element_at(F.array(*map(F.lit, ("mkv", "srt", "mp4", "ass", "nfo", "vtt"))), (F.col("p_size") % 6 + 1).cast("int"))
    inner = F.when(F.col("p_partkey") % 5 == 0, "/BDMV/STREAM").otherwise("")
    tags = F.element_at(F.array(*map(F.lit, ("", ".en", ".zh", ".1080p.x264-GRP"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    title = F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string"))
    name = F.concat(F.translate("p_name", " ", "."), F.lit("."), (F.col("p_size") + 1980).cast("string"), tags, F.lit("."), kind)
    return table(spark, sf_dir, "part").select(title.alias("title_id"), F.concat(F.lit("/lib/"), title, inner, F.lit("/"), name).alias("path"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("length"), "p_partkey")


FILES = """
    files0 AS (SELECT 't' || (p_partkey % 40) AS title_id, CASE WHEN p_partkey % 5 = 0 THEN '/BDMV/STREAM' ELSE '' END AS inner_dir,
                     replace(p_name, ' ', '.') || '.' || (p_size + 1980) || (['', '.en', '.zh', '.1080p.x264-GRP'])[p_partkey % 4 + 1] AS stem,
                     (['mkv', 'srt', 'mp4', 'ass', 'nfo', 'vtt'])[p_size % 6 + 1] AS ext, CAST(floor(p_retailprice * 100) AS BIGINT) AS length, p_partkey FROM part),
    files AS (SELECT title_id, '/lib/' || title_id || inner_dir AS folder, '/lib/' || title_id || inner_dir || '/' || stem || '.' || ext AS path, stem, ext, length, p_partkey FROM files0)
"""


def part_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the tracks of twenty titles."""
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    kind = at(("Subtitle", "Subtitle", "Audio", "Video"), F.col("p_partkey") % 4)
    title = at(("", "English Full", "Simplified", "Traditional SDH", "Forced", "Cantonese"), F.floor(F.col("p_partkey") / 4) % 6)
    frames, rate = F.floor("p_retailprice").cast("string"), (F.col("p_size") * 1000).cast("string")
    meta = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("NUMBER_OF_FRAMES"), frames)).otherwise(F.create_map(F.lit("number_of_frames"), frames, F.lit("BPS"), rate))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), (F.floor(F.col("p_partkey") / 8) % 20).cast("string")).alias("title_id"),
        F.col("p_partkey").cast("int").alias("index"),
        kind.alias("kind"),
        at(("subrip", "hdmv_pgs_subtitle", "ass", "dvb_teletext"), F.col("p_size") % 4).alias("codec"),
        at(("eng", "chi", "chs", "fre", "zh-hant"), F.col("p_size") % 5).alias("lang"),
        title.alias("title"),
        meta.alias("metadata"),
    )


TRACKS = """
    tracks AS (SELECT 't' || ((p_partkey // 8) % 20) AS title_id, CAST(p_partkey AS INT) AS idx,
                      (['Subtitle', 'Subtitle', 'Audio', 'Video'])[p_partkey % 4 + 1] AS kind,
                      (['subrip', 'hdmv_pgs_subtitle', 'ass', 'dvb_teletext'])[p_size % 4 + 1] AS codec,
                      (['eng', 'chi', 'chs', 'fre', 'zh-hant'])[p_size % 5 + 1] AS lang,
                      lower((['', 'English Full', 'Simplified', 'Traditional SDH', 'Forced', 'Cantonese'])[(p_partkey // 4) % 6 + 1]) AS title,
                      least(CAST(floor(p_retailprice) AS BIGINT), 10000) + CASE WHEN p_size % 3 = 0 THEN 0 ELSE least(p_size * 1000 // 100, 1000) END AS rated FROM part),
    scored AS (SELECT *, rated + CASE WHEN contains(title, 'forced') THEN -10000 ELSE 0 END + CASE WHEN contains(title, 'full') THEN 2000 ELSE 0 END
                     + CASE WHEN contains(title, 'sdh') THEN 500 ELSE 0 END AS score,
               CASE WHEN contains(title, 'cantonese') THEN 'zh-yue' WHEN contains(title, 'simplified') OR lang = 'chs' THEN 'zh-Hans'
                    WHEN contains(title, 'traditional') THEN 'zh-Hant' WHEN lang = 'zh-hant' THEN 'zh-Hant' WHEN lang = 'chi' THEN 'zh' END AS zh_kind FROM tracks WHERE kind = 'Subtitle')
"""
