"""Subtitle files to cues: SRT, ASS/SSA, WebVTT, segment JSON and word-timed transcripts.

Each parser takes rows (title_id, path, content string) and gives (title_id, path, pos, start, end, text).
Files are independent rows, so a corpus of any size is a plain scan, an explode and a window per file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.functions import times
from cuelake.operators import language
from cuelake.schema import SUBTITLE_EXTENSIONS

KEY = ["title_id", "path"]
BLOCKS = f"\\n{X.SPACE}*\\n"


def decode_bytes(content: Column) -> Column:
    """UTF-8 (a BOM is dropped), else GB18030, else Latin-1. Only bytes that are no UTF-8 reach Python."""

    @F.arrow_udf("string")
    def other(rows: pa.Array) -> pa.Array:
        def one(raw):
            try:
                return None if raw is None else raw.decode("gb18030")
            except UnicodeDecodeError:
                return raw.decode("latin-1")

        return pa.array([one(r) for r in rows.to_pylist()], pa.string())

    plain = F.is_valid_utf8(content.cast("string"))
    return F.when(plain, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(other(F.when(plain, F.lit(None).cast("binary")).otherwise(content)))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(title_id, path, extension, content) of the files under folder; title_id is the file's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.col("path")
    return files.select(F.regexp_replace(path, "/[^/]*$", "").alias("title_id"), "path", X.file_extension(path).alias("extension"), decode_bytes(F.col("content")).alias("content"))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejected files) by extension; WebVTT files with a time that is none are rejected whole."""
    of = lambda *kinds: files.where(F.col("extension").isin(*kinds)).select(*KEY, "content")
    vtt, bad = parse_vtt(of("vtt"))
    cues = parse_srt(of("srt")).unionByName(parse_ass(of("ass", "ssa"))).unionByName(vtt)
    other = files.where(~F.coalesce(F.col("extension"), F.lit("")).isin(*SUBTITLE_EXTENSIONS)).select(*KEY, F.lit("unsupported format").alias("reason"))
    return cues, other.unionByName(bad.select(*KEY, F.lit("bad time").alias("reason")))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n", -1)


def _blocks(files: DataFrame) -> DataFrame:
    body = X.strip(F.regexp_replace(F.col("content"), "\\r\\n?", "\n"))
    return files.select(*KEY, F.posexplode(F.split(body, BLOCKS, -1)).alias("block_no", "block"))


def _number(cues: DataFrame) -> DataFrame:
    """Keep sound cues and number them per file."""
    order = Window.partitionBy(*KEY).orderBy("block_no")
    return cues.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).select(*KEY, "pos", "start", "end", "text")


def _after(lines: Column, k: Column) -> Column:
    return F.slice(lines, k + 1, F.greatest(F.size(lines) - k, F.lit(0)))


def parse_srt(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Blocks between blank lines; the time line may stand after an index or alone.

    Strict: two-digit fields and three digits of fraction, body joined by spaces, empty bodies and ends not
    after the start are dropped. Lenient: any digits (the fraction is read as thousandths unpadded), the
    body keeps its line breaks, and any times stay.
    """
    split = F.split("block", "\n", -1)
    if lenient:
        pattern = r"(\d+):(\d+):(\d+),(\d+)\s*-->\s*(\d+):(\d+):(\d+),(\d+)"
        lines, timed = F.filter(split, lambda x: X.strip(x) != ""), lambda x: x.contains("-->")
    else:
        pattern = r"(\d\d):(\d\d):(\d\d),(\d\d\d)\s*-->\s*(\d\d):(\d\d):(\d\d),(\d\d\d)"
        lines, timed = F.transform(split, lambda x: F.btrim(x, F.lit("\ufeff"))), lambda x: x.rlike(pattern)
    rows = _blocks(files).select(*KEY, "block_no", lines.alias("lines"))
    rows = rows.withColumn("at", F.array_position(F.transform("lines", timed), True).cast("int"))
    rows = rows.where("at > 0").withColumn("line", F.get("lines", F.col("at") - 1))
    field = lambda k: F.nullif(F.regexp_extract("line", pattern, k), F.lit("")).try_cast("double")
    clock = lambda k: field(k) * 3600 + field(k + 1) * 60 + field(k + 2) + field(k + 3) / 1000
    rest = _after(F.col("lines"), F.col("at"))
    if lenient:
        body = X.clean_rich_text(F.array_join(rest, "\n"))
    else:
        body = X.clean_subtitle_text(F.array_join(F.filter(F.transform(rest, X.strip), lambda x: x != ""), " "))
    cues = rows.select(*KEY, "block_no", clock(1).alias("start"), clock(5).alias("end"), body.alias("text")).where("text <> '' and start is not null and end is not null")
    return _number(cues if lenient else cues.where("end > start"))


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue lines: fields 2 and 3 are the times, all after the ninth comma is the text."""
    rows = files.select(*KEY, F.posexplode(_lines(F.col("content"))).alias("block_no", "line")).where(F.col("line").startswith("Dialogue:"))
    rows = rows.withColumn("f", F.split("line", ",", 10)).where(F.size("f") == 10)
    cues = rows.select(*KEY, "block_no", times.ass_seconds(F.col("f")[1]).alias("start"), times.ass_seconds(F.col("f")[2]).alias("end"), X.strip_ass_tags(F.col("f")[9]).alias("text"))
    return _number(cues.where("text <> '' and end > start"))


def parse_vtt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejected files). Blocks without --> are skipped, settings after the end time ignored."""
    lines = F.filter(F.transform(F.split("block", "\n", -1), X.strip), lambda x: x != "")
    rows = _blocks(files).select(*KEY, "block_no", lines.alias("lines"))
    rows = rows.withColumn("at", F.array_position(F.transform("lines", lambda x: x.contains("-->")), True).cast("int")).where("at > 0")
    pattern = r"([0-9:.]+)\s*-->\s*([0-9:.]+)"
    line = F.get("lines", F.col("at") - 1)
    rows = rows.select(*KEY, "block_no", times.vtt_seconds(F.regexp_extract(line, pattern, 1)).alias("start"), times.vtt_seconds(F.regexp_extract(line, pattern, 2)).alias("end"), line.rlike(pattern).alias("timed"), X.clean_subtitle_text(F.array_join(_after(F.col("lines"), F.col("at")), " ")).alias("text"))
    bad = rows.where("timed and text <> '' and (start is null or end is null)").select(*KEY).distinct()
    cues = rows.where("timed and text <> '' and end > start").join(bad, KEY, "left_anti")
    return _number(cues), bad


def parse_segments(files: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Stored segment lists. A file counts only if it is a list of objects that all have start, end and one
    of text, en, zh, with end after start, and some text is left; else all its rows are dropped."""
    value = files.select(*KEY, F.expr("try_parse_json(content)").alias("v"))
    value = value.where(F.expr("schema_of_variant(v) like 'ARRAY%'"))
    rows = value.lateralJoin(value.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select("pos", F.col("value").alias("item"))).select(*KEY, "pos", F.col("item").alias("v"))
    get = lambda k, t: F.expr(f"try_variant_get(v, '$.{k}', '{t}')")
    has = lambda k: F.expr(f"variant_get(v, '$.{k}', 'variant') is not null")
    start, end = get("start", "double"), get("end", "double")
    ok = F.expr("schema_of_variant(v) like 'OBJECT%'") & has("start") & has("end") & (has("text") | has("en") | has("zh")) & F.coalesce(end > start, F.lit(False))
    text = X.clean_subtitle_text(F.coalesce(X.falsy(get("text", "string"), get("en", "string"), get("zh", "string")), F.lit("")))
    rows = rows.select(*KEY, F.col("pos").cast("long").alias("block_no"), ok.alias("ok"), start.alias("start"), end.alias("end"), text.alias("text"), get("en", "string").alias("en"), get("zh", "string").alias("zh"), get("source_language", "string").alias("source_language"))
    good = rows.groupBy(*KEY).agg(F.bool_and("ok").alias("good"), F.bool_or(F.col("text") != "").alias("some")).where("good and some").select(*KEY)
    rows = rows.join(good, KEY, "left_semi").where("text <> ''")
    en = F.when(X.should_clean_english(F.col("source_language")), X.clean_english_track("en")).otherwise(F.col("en"))
    zh = X.simplify(X.clean_subtitle_text("zh"), mapping or {})
    rows = rows.withColumn("en", F.when(F.col("en").isNotNull(), en)).withColumn("zh", F.when(F.col("zh").isNotNull(), zh))
    order = Window.partitionBy(*KEY).orderBy("block_no")
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("ok", "block_no")
    return language.fill_missing(rows, KEY)


def parse_transcripts(rows: DataFrame) -> DataFrame:
    """Word-timed transcripts (title_id, pos, start, end, text, words, language): empty words and empty
    segments go, texts get single spaces, positions are numbered anew."""
    words = F.filter("words", lambda w: X.strip(F.coalesce(w["word"], F.lit(""))) != "")
    rows = rows.withColumn("text", X.normalize_space("text")).where("text <> ''").withColumn("words", words)
    order = Window.partitionBy("title_id").orderBy("pos")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).withColumnRenamed("language", "source_language")


def parse_detections(rows: DataFrame) -> DataFrame:
    """OCR detections (frame_id, raw JSON) to (frame_id, seq, x, y, text).

    Accepts rec_texts with rec_boxes or rec_polys, the same under ``res``, or a list of [box, [text,
    confidence]]. Empty texts are skipped; a box that is no list of points gives x 0 and y the number.
    """
    raw = rows.select("frame_id", F.expr("try_parse_json(raw)").alias("v"))
    raw = raw.withColumn("r", F.expr("coalesce(variant_get(v, '$.res', 'variant'), v)"))
    texts = F.expr("try_variant_get(r, '$.rec_texts', 'array<string>')")
    boxes = F.expr("coalesce(try_variant_get(r, '$.rec_boxes', 'array<variant>'), try_variant_get(r, '$.rec_polys', 'array<variant>'), array())")
    named = raw.where(texts.isNotNull()).select("frame_id", F.posexplode(texts).alias("seq", "text"), boxes.alias("boxes"))
    named = named.select("frame_id", "seq", "text", F.expr("get(boxes, seq)").alias("box"))
    pairs = raw.where(texts.isNull()).select("frame_id", F.expr("try_variant_get(r, '$', 'array<variant>')").alias("items"))
    pairs = pairs.select("frame_id", F.posexplode("items").alias("seq", "item"))
    pairs = pairs.select("frame_id", "seq", F.expr("try_variant_get(item, '$[1][0]', 'string')").alias("text"), F.expr("variant_get(item, '$[0]', 'variant')").alias("box"))
    found = named.unionByName(pairs).where(X.strip(F.coalesce("text", F.lit(""))) != "")
    points = F.expr("try_variant_get(box, '$', 'array<array<double>>')")
    x, y = F.array_min(F.transform(points, lambda p: p[0])), F.array_min(F.transform(points, lambda p: p[1]))
    return found.select("frame_id", F.col("seq").cast("long").alias("seq"), F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.col("seq").cast("double")).alias("y"), X.strip(F.col("text")).alias("text"))
