"""Line dedup with DataFrame functions only: lines that many documents share are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fresh, materialize, maybe_broadcast, scratch, without

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() also changes other alphabets, so it serves only keys that are ASCII throughout
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _mark(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line)))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with shared lines removed: adds ``kept_text``, ``n_lines``, ``n_dropped`` (long).

    Lines whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` documents
    (distinct non-null ids; repeated rows of one id count once) lose all their copies in every document,
    also in rows without id. Null or empty texts are one empty line. Other lines keep their order. Columns
    of docs named like the added ones are replaced; an empty table stays empty.

    The lines leave their documents only as 16-byte marks with their positions. Counting combines before each
    shuffle, a mark that very many documents hold is spread by (mark, id) first, and texts move once at most:
    to meet the flags of the positions that they lose, one byte a line. Copies of a row share one key and so
    their flags.
    """
    docs = without(docs, *({"kept_text", "n_lines", "n_dropped"} - {text_col, id_col}))
    row, again, flags = fresh(docs, "row", "again", "flags")
    # 128 bits, so that no two different rows share flags
    keys = [F.xxhash64(F.col(id_col), F.lit(0), F.col(text_col)), F.xxhash64(F.col(text_col), F.lit(1), F.col(id_col))]
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    with scratch(docs.sparkSession):
        lost = materialize(_lost(docs, keys, split, id_col, min_docs, min_chars).toDF(row, again, flags), "lost-lines", keep=True)
    whole = docs.withColumns({row: keys[0], again: keys[1]}).join(lost, [row, again], "left")
    stays = F.filter(split, lambda _, i: F.substring(F.col(flags), i + 1, F.lit(1)) != F.lit(b"1"))
    kept = F.when(F.col(flags).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    n_dropped = F.coalesce(F.octet_length(F.replace(F.col(flags).cast("string"), F.lit("0"))), F.lit(0)).cast("long")
    whole = whole.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": n_dropped, "kept_text": F.coalesce(kept, F.lit(""))})
    return whole.drop(row, again, flags)


def _lost(docs: DataFrame, keys: list[Column], split: Column, id_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(row, again, flags) of the rows that lose lines: a zero for each line that stays up to the last lost
    one, a one for each lost."""
    lines = docs.select(F.col(id_col).alias("id"), keys[0].alias("row"), keys[1].alias("again"), F.posexplode(split).alias("pos", "line"))
    bare = F.char_length(F.btrim("line", F.lit(BLANK)))
    marks = materialize(lines.where(bare >= min_chars).select("id", "row", "again", "pos", _mark(F.col("line")).alias("mark")), "line-marks")
    shared = marks.groupBy("mark", "id").agg(F.lit(1).alias("one")).groupBy("mark").agg(F.count("id").alias("n_docs"))
    shared = materialize(shared.where(F.col("n_docs") >= min_docs).select("mark"), "shared-lines")
    lost = marks.join(maybe_broadcast(shared), "mark", "left_semi").groupBy("row", "again").agg(F.array_sort(F.collect_set("pos")).alias("lost"))
    run = F.transform("lost", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.col("lost")[i - 1]).otherwise(-1) - 1), F.lit("1")))
    return lost.select("row", "again", F.array_join(run, "").cast("binary").alias("flags"))
