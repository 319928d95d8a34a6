"""Long cues to display cues: folds over words as native expressions, one row in, an array of pieces out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X

MAX_WORDS, MAX_CHARS, MAX_DURATION = 14, 82, 6.0
PIECE = "array<struct<start:double,end:double,text:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with value evaluated once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_cap(text: Column, max_words: int, min_chunks: Column) -> Column:
    """Words of a chunk at most: max_words, fewer if the text must give min_chunks, three at least."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return F.greatest(F.lit(3), F.least(F.lit(max_words), F.ceil(words / F.greatest(F.lit(1), min_chunks)).cast("int")))


def chunk_text(text: Column, cap: Column, max_chars: int) -> Column:
    """Greedy chunks of words: one closes after . ! or ?, at ``cap`` words, or when it has max_chars."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    # what a step needs rides in the state: Spark may inline a column used once into the step itself
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), cap.alias("cap"))

    def step(acc: Column, word: Column) -> Column:
        def close(now: Column) -> Column:
            shut = F.substring(word, -1, 1).isin(".", "!", "?") | (acc["n"] + 1 >= acc["cap"]) | (F.char_length(now) >= max_chars)
            ended = F.struct(F.concat(acc["done"], F.array(now)).alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), acc["cap"].alias("cap"))
            return F.when(shut, ended).otherwise(F.struct(acc["done"].alias("done"), now.alias("now"), (acc["n"] + 1).alias("n"), acc["cap"].alias("cap")))

        return _let(F.when(acc["n"] == 0, word).otherwise(F.concat(acc["now"], F.lit(" "), word)), close)

    return F.aggregate(words, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def by_text(cues: DataFrame, max_words: int, max_chars: int, max_duration: float) -> DataFrame:
    """cues with ``_cut``: pieces of the text with time in proportion to their length; the last ends
    exactly at ``end``. Steps are columns of their own, so that Spark folds the words only once."""
    length = F.col("end") - F.col("start")
    least = F.greatest(F.lit(1), F.ceil(length / max_duration).cast("int"), F.ceil(F.char_length("text") / max_chars).cast("int"))
    rows = cues.withColumn("_cap", word_cap(F.col("text"), max_words, least))
    rows = rows.withColumn("_chunks", chunk_text(F.col("text"), F.col("_cap"), max_chars))
    weigh = lambda x: F.greatest(F.lit(1), F.char_length(x))
    rows = rows.withColumn("_total", F.aggregate("_chunks", F.lit(0), lambda a, x: a + weigh(x))).withColumn("_n", F.size("_chunks"))
    zero = F.struct(F.array().cast(PIECE).alias("done"), F.col("start").alias("at"), F.col("_total").alias("total"), F.col("_n").alias("n"))

    def step(acc: Column, chunk: Column) -> Column:
        last = F.size(acc["done"]) + 1 == acc["n"]
        stop = F.when(last, F.col("end")).otherwise(acc["at"] + length * weigh(chunk) / acc["total"])
        piece = F.struct(acc["at"].alias("start"), stop.alias("end"), chunk.alias("text"))
        return F.struct(F.concat(acc["done"], F.array(piece)).alias("done"), stop.alias("at"), acc["total"].alias("total"), acc["n"].alias("n"))

    many = F.aggregate("_chunks", zero, step, lambda acc: acc["done"])
    whole = F.array(F.struct("start", "end", "text"))
    return rows.withColumn("_cut", F.when(F.col("_n") <= 1, whole).otherwise(many)).drop("_cap", "_chunks", "_total", "_n")


def by_words(words: Column, max_words: int, max_chars: int, max_duration: float) -> Column:
    """Pieces of timed words; one closes after . ! or ?, or at the cap of words, characters or seconds."""
    kind = "array<struct<start:double,end:double,word:string>>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("now"))

    def step(acc: Column, word: Column) -> Column:
        def close(now: Column) -> Column:
            text = X.join_words(F.transform(now, lambda w: w["word"]))
            long = (F.size(now) >= max_words) | (F.char_length(text) >= max_chars) | (word["end"] - now[0]["start"] >= max_duration)
            shut = F.coalesce(word["word"], F.lit("")).rlike("[.!?]$") | long
            ended = F.struct(F.concat(acc["done"], F.array(now)).alias("done"), F.array().cast(kind).alias("now"))
            return F.when(shut, ended).otherwise(F.struct(acc["done"].alias("done"), now.alias("now")))

        return _let(F.concat(acc["now"], F.array(word)), close)

    finish = lambda acc: F.when(F.size(acc["now"]) == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
    chunks = F.aggregate(words, zero, step, finish)
    piece = lambda c: F.struct(c[0]["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"), X.clean_subtitle_text(X.join_words(F.transform(c, lambda w: w["word"]))).alias("text"))
    return F.filter(F.transform(chunks, piece), lambda p: p["text"] != "")


def split_cues(cues: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, max_duration: float = MAX_DURATION) -> DataFrame:
    """cues (title_id, pos, start, end, text, words, ...) with long ones cut up and positions numbered anew.

    A cue is cut if it is longer than any limit: by its timed words if that gives pieces, else by its text.
    Empty texts and pieces that do not end after their start are dropped. Other columns are copied.
    """
    cues = cues.withColumn("text", X.clean_subtitle_text("text")).where("text <> ''")
    words = F.size(F.split("text", " "))
    over = (F.col("end") - F.col("start") > max_duration) | (F.char_length("text") > max_chars) | (words > max_words)
    rows = by_text(cues.withColumn("_over", over), max_words, max_chars, max_duration)
    if "words" in cues.columns:
        given = F.coalesce("words", F.array().cast("array<struct<start:double,end:double,word:string>>"))
        rows = rows.withColumn("_timed", by_words(given, max_words, max_chars, max_duration))
        rows = rows.withColumn("_cut", F.when(F.size("_timed") > 0, F.col("_timed")).otherwise(F.col("_cut")))
    pieces = rows.withColumn("_piece", F.when(F.col("_over"), F.col("_cut")).otherwise(F.array(F.struct("start", "end", "text"))))
    # outer: else Spark filters on the array first and folds it again for every use
    other = [c for c in cues.columns if c not in ("title_id", "pos", "start", "end", "text", "words")]
    out = pieces.select("title_id", "pos", *other, F.posexplode_outer("_piece").alias("_k", "_p")).where("_p.end > _p.start")
    order = Window.partitionBy("title_id").orderBy("pos", "_k")
    out = out.withColumn("_pos", (F.row_number().over(order) - 1).cast("long"))
    return out.select("title_id", F.col("_pos").alias("pos"), "_p.start", "_p.end", "_p.text", *other)


def sane_timing(cues: DataFrame, max_duration: float = MAX_DURATION) -> DataFrame:
    """Cues of four words or fewer that last longer than max_duration end after it."""
    few = F.size(F.filter(F.split(X.normalize_space("text"), " "), lambda w: w != "")) <= 4
    long = F.col("end") - F.col("start") > max_duration
    return cues.withColumn("end", F.when(few & long, F.col("start") + max_duration).otherwise(F.col("end")))


def renumber(cues: DataFrame) -> DataFrame:
    order = Window.partitionBy("title_id").orderBy("pos")
    return cues.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
