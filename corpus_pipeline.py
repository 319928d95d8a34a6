"""The training-text pipeline: each stage takes the documents that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the
columns of ``documents``. ``run`` writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import langid, lines, neardup, packing, quality
from cuelake.llm.common import drop_path, fresh, write_shared


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    forest = quality.fit(docs, labels.where(fold != 0))
    (score,) = fresh(docs, "score")
    return quality.score_documents(docs, forest, score_col=score).where(F.col(score) >= 0.3).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and documents whose language is ambiguous."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.where(fold != 1))
    (told,) = fresh(docs, "told")
    sure = (F.col(told)["lang_pred"] != "und") & ~F.col(told)["ambiguous"]
    return docs.withColumn(told, langid.identify(F.col("text"), model, spark)).where(sure).drop(told)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten documents or more share; n_chars follows the text."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(None)
    kept = lines.drop_shared_lines(docs.select("doc_id", "text", rest.alias("rest")))
    changed = F.col("n_dropped") > 0
    new = {c: F.col("rest")[c] for c in other} | {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in other:
        new["n_chars"] = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return kept.select(*[new[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens. Workers of the stages before still hold their
    own memory, so this one remembers fewer words."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1, remembered=150_000)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("packing", pack),
]

#: The classifiers, sketches and packing have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = write_shared(stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before, docs = path, spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
