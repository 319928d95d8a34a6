"""Language of titles: dominant, first known, missing ones filled, Chinese presence, cache filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as X


def dominant(cues: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, language): the most frequent known language; of equals the one seen first (by pos)."""
    key = key or ["title_id"]
    seen = cues.select(*key, "pos", X.known_language("source_language").alias("language")).where("language is not null")
    counts = seen.groupBy(*key, "language").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy(*key).agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))


def fill_missing(cues: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Cues whose language is unknown get the dominant one of their key, if there is one."""
    key = key or ["title_id"]
    filled = cues.join(dominant(cues, key).withColumnRenamed("language", "_dominant"), key, "left")
    known = X.known_language("source_language")
    return filled.withColumn("source_language", F.when(known.isNull() & F.col("_dominant").isNotNull(), F.col("_dominant")).otherwise(F.col("source_language"))).drop("_dominant")


def first_known(cues: DataFrame, fallback: str = "") -> DataFrame:
    """(title_id, language): the fallback unless it is '' or auto, else the first non-empty tag, else 'cached source'."""
    if fallback and fallback != "auto":
        return cues.select("title_id").distinct().withColumn("language", F.lit(fallback))
    tag = F.nullif(F.col("source_language"), F.lit(""))
    first = F.min_by(F.col("source_language"), F.when(tag.isNotNull(), F.col("pos")))
    return cues.groupBy("title_id").agg(F.coalesce(first, F.lit("cached source")).alias("language"))


def matches_request(cues: DataFrame, source_language: str, asr_language: str) -> DataFrame:
    """Cues of the titles whose first known language is the one asked for; 'auto' and '' accept all."""
    rows = first_known(cues)
    want = X.normalize_language(F.lit(source_language))
    want = F.when(want.isin("", "auto"), X.normalize_language(X.resolve_asr_language(F.lit(asr_language), F.lit(source_language)))).otherwise(want)
    fits = want.isin("", "auto") | (X.normalize_language("language") == want)
    return cues.join(rows.where(fits).select("title_id"), "title_id", "left_semi")


def chinese_presence(cues: DataFrame) -> DataFrame:
    """(title_id, has_chinese): 3 CJK characters or more over zh; or, unless another language dominates,
    over the texts of cues without en whose language is unknown or Chinese."""
    known = X.known_language("source_language")
    open_text = F.when(X.falsy(F.col("en")).isNull() & (known.isNull() | (known == "zh")), X.count_cjk("text")).otherwise(0)
    sums = cues.groupBy("title_id").agg(F.sum(X.count_cjk("zh")).alias("zh"), F.sum(open_text).alias("open"))
    sums = sums.join(dominant(cues), "title_id", "left")
    other = F.coalesce(F.col("language") != "zh", F.lit(False))
    return sums.select("title_id", ((F.col("zh") >= 3) | (~other & (F.col("open") >= 3))).alias("has_chinese"))


