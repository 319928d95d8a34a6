"""Requests to a model: batches of cues with their context, and the replies read back."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X

BATCH, CONTEXT = 5, 30
ATTEMPTS, SINGLE_ATTEMPTS, PAUSE = 3, 10, 2.0
#: Prompts that one call of the model takes at most.
PROMPTS = 64


def assign(cues: DataFrame, size: int = BATCH) -> DataFrame:
    """cues with batch_id and the index inside the batch, from pos."""
    return cues.withColumn("batch_id", F.floor(F.col("pos") / size).cast("long")).withColumn("index", (F.col("pos") % size).cast("int"))


def context(cues: DataFrame, size: int = BATCH, lines: int = CONTEXT, bilingual: bool = False, timed: bool = True) -> DataFrame:
    """One row a batch: (title_id, batch_id, n, target, before, after, context_start, context_end).

    before and after hold up to ``lines`` prompt lines ahead of the first and behind the last cue of the
    batch; the bounds are the start of the first and the end of the last line of the whole context.
    Without ``timed`` lines hold the number and the text alone. pos counts a title's cues without gaps, so the
    lines are those of the batches beside it: each cue's line is made and moved once, and a batch looks at
    ``lines`` / ``size`` others on either side, whatever the title's length.
    """
    rows = assign(cues, size)
    line = (lambda i: F.format_string("[%d] %s", i, F.col("text"))) if not timed else (lambda i: X.bilingual_prompt_line(i, F.col("start"), F.col("end"), F.col("text"), F.col("en"), F.col("zh"))) if bilingual else (lambda i: X.prompt_line(i, F.col("start"), F.col("end"), F.col("text")))
    one = F.struct("pos", "start", "end", line(F.col("pos")).alias("line"), line(F.col("index").cast("long")).alias("own"))
    whole = rows.groupBy("title_id", "batch_id").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    order, reach = Window.partitionBy("title_id").orderBy("batch_id"), -(-lines // size)
    beside = lambda lo, hi: F.flatten(F.collect_list("lines").over(order.rowsBetween(lo, hi))) if lines else F.slice("lines", 1, 0)
    whole = whole.withColumn("ahead", beside(-reach, -1)).withColumn("behind", beside(1, reach))
    ahead, behind = F.slice("ahead", F.greatest(F.size("ahead") - lines + 1, F.lit(1)), max(1, lines)), F.slice("behind", 1, lines)
    texts = lambda of, name: F.array_join(F.transform(of, lambda r: r[name]), "\n")
    first, last = F.coalesce(F.get(ahead, F.lit(0)), F.get("lines", F.lit(0))), F.coalesce(F.get(behind, F.size(behind) - 1), F.get("lines", F.size("lines") - 1))
    return whole.select(
        "title_id",
        "batch_id",
        F.size("lines").cast("long").alias("n"),
        texts(F.col("lines"), "own").alias("target"),
        texts(ahead, "line").alias("before"),
        texts(behind, "line").alias("after"),
        first["start"].alias("context_start"),
        last["end"].alias("context_end"),
    )


def bounds(cues: DataFrame, size: int = BATCH, lines: int = CONTEXT) -> DataFrame:
    """(title_id, batch_id, context_start, context_end) of ``context``, from times alone: replies that are there
    need the bounds only, and no line is made or moved for them."""
    one = F.struct("pos", "start", "end")
    whole = assign(cues, size).groupBy("title_id", "batch_id").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    whole = whole.select("title_id", "batch_id", F.col("lines.start").alias("starts"), F.col("lines.end").alias("ends"))
    order, reach = Window.partitionBy("title_id").orderBy("batch_id"), -(-lines // size)
    beside = lambda c, lo, hi: F.flatten(F.collect_list(c).over(order.rowsBetween(lo, hi))) if lines else F.slice(c, 1, 0)
    whole = whole.withColumn("ahead", beside("starts", -reach, -1)).withColumn("behind", beside("ends", 1, reach))
    # the first of the last ``lines`` starts ahead, the last of the first ``lines`` ends behind; if there are none, the batch's own
    first = F.when(F.size("ahead") > 0, F.get("ahead", F.greatest(F.size("ahead") - lines, F.lit(0)))).otherwise(F.get("starts", F.lit(0)))
    last = F.when(F.size("behind") > 0, F.get("behind", F.least(F.size("behind"), F.lit(lines)) - 1)).otherwise(F.get("ends", F.size("ends") - 1))
    return whole.select("title_id", "batch_id", first.alias("context_start"), last.alias("context_end"))


def requests(batches: DataFrame, task: str = "translate", language: str = "", timed: bool = True) -> DataFrame:
    """batches with ``prompt``: what to do, the context, the target lines and the shape of the answer.

    Without ``timed`` the answer holds texts alone, and the prompt says nothing of times or hidden lines."""
    label = "the source language" if language in ("", "auto") else language
    if task == "translate":
        head = f"Correct the TARGET lines, keeping them in {label}, and translate them into Simplified Chinese."
        keys = '"corrected_text": "...", "chinese_translation": "..."'
    else:
        head = "Proofread the English and Chinese of the TARGET lines; translate only where the Chinese is empty."
        keys = '"corrected_english": "...", "corrected_chinese": "..."'
    shape = f'[{{"index": 0, {keys}' + (', "display": true, "display_start": 0.0, "display_end": 0.0}]' if timed else "}]")
    bounds = F.format_string("Times are seconds from %.2f to %.2f.", "context_start", "context_end")
    parts = [
        F.lit(head + " Lines before and after are context only."),
        F.concat(F.lit("BEFORE\n"), F.col("before")),
        F.concat(F.lit("TARGET\n"), F.col("target")),
        F.concat(F.lit("AFTER\n"), F.col("after")),
        F.format_string("Answer with a JSON list of exactly %d objects, one for each line, by local index: " + shape.replace("%", "%%"), "n"),
    ]
    if timed:
        parts += [F.lit('Set "display" to false on lines that only repeat another line, and stretch the times of the line that stays.'), bounds]
    else:
        parts += [F.lit("Lines have no times, and none are asked for: one object for each line, none merged or split.")]
    return batches.withColumn("prompt", F.concat_ws("\n\n", *parts))


def parse_reply(raw: str | None) -> object:
    """The JSON of one reply, without model noise and what stands around the outermost brackets; ValueError if none."""
    bare = re.sub(r"(?is)<think>.*?</think>", "", raw or "").strip()
    bare = bare.removeprefix("```json").removeprefix("```").strip().removesuffix("```").strip()
    try:
        return json.loads(bare)
    except ValueError:
        found = re.search(r"(?s)[\[{].*[\]}]", bare)
        if not found:
            raise
        return json.loads(found[0])


def run_model(rows: DataFrame, model: Callable[[list[str]], list[str]], attempts: int = ATTEMPTS, pause: float = PAUSE, abort: bool = True) -> DataFrame:
    """rows (title_id, batch_id, prompt) to (title_id, batch_id, attempt, raw, error).

    ``model`` maps prompts to replies and gets up to PROMPTS at once. A prompt fails if the call raises or
    its reply is no JSON; failed prompts alone are sent again, each in a call of its own. After the last
    try the task fails with that error, or, without ``abort``, raw is null (``streaming.replies`` stores the
    answers batch by batch that way).
    attempt counts the tries of a prompt and error tells the last failure. Store the result before using
    it twice, as every action calls the model anew.
    """

    def ask(prompts: list[str]) -> list[tuple[str | None, Exception | None]]:
        try:
            raw = model(prompts)
            if len(raw) != len(prompts):
                raise ValueError("the model gave another number of replies")
        except Exception as error:
            return [(None, error)] * len(prompts)
        out = []
        for reply in raw:
            try:
                parse_reply(reply)
                out.append((reply, None))
            except ValueError as error:
                out.append((None, error))
        return out

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for lo in range(0, len(whole), PROMPTS):
                frame = whole.iloc[lo : lo + PROMPTS]
                prompts = frame["prompt"].tolist()
                raw, error, tries = [None] * len(prompts), [None] * len(prompts), [0] * len(prompts)
                left = list(range(len(prompts)))
                for attempt in range(1, attempts + 1):
                    calls = [left] if attempt == 1 else [[k] for k in left]
                    got = [x for some in calls for x in zip(some, ask([prompts[k] for k in some]))]
                    last = None
                    for k, (reply, failure) in got:
                        raw[k], tries[k], last = reply, attempt, failure or last
                        error[k] = f"{type(failure).__name__}: {failure}" if failure else error[k]
                    left = [k for k, (_, failure) in got if failure]
                    if not left:
                        break
                    if attempt == attempts and abort:
                        raise last
                    if attempt < attempts:
                        time.sleep(pause)
                yield pd.DataFrame({"title_id": frame["title_id"], "batch_id": frame["batch_id"], "attempt": tries, "raw": raw, "error": error})

    return rows.select("title_id", "batch_id", "prompt").mapInPandas(call, "title_id string, batch_id long, attempt int, raw string, error string")


def _parsed(replies: DataFrame) -> DataFrame:
    """replies with the variant ``v``: their JSON, null if there is none."""
    clean = X.strip_model_noise("raw")
    outer = F.regexp_extract(clean, r"(?s)([\[{].*[\]}])", 1)
    return replies.withColumn("_clean", clean).withColumn("_outer", outer).withColumn("v", F.expr("coalesce(try_parse_json(_clean), try_parse_json(_outer))"))


def first_item(replies: DataFrame) -> DataFrame:
    """(title_id, batch_id, item variant): the first element of replies that are lists, if it is an object."""
    rows = _parsed(replies).where(F.expr("schema_of_variant(v) like 'ARRAY%'")).withColumn("item", F.expr("try_variant_get(v, '$[0]', 'variant')"))
    return rows.where(F.expr("schema_of_variant(item) like 'OBJECT%'")).select("title_id", "batch_id", "item")


def reply_items(replies: DataFrame) -> DataFrame:
    """(title_id, batch_id, index, item variant): the objects of the replies that are JSON lists.

    Model noise is stripped; text around the outermost brackets is cut off. Items count if they are
    objects whose index is a whole number or reads as one; of equal indexes the last stays. Replies that
    are no list give no rows, so their cues fall back to their originals.
    """
    rows = _parsed(replies).where(F.expr("schema_of_variant(v) like 'ARRAY%'"))
    rows = rows.select("title_id", "batch_id", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("ord", "item"))
    rows = rows.where(F.expr("schema_of_variant(item) like 'OBJECT%'"))
    number = F.expr("cast(try_variant_get(item, '$.index', 'double') as int)")
    whole = F.expr("schema_of_variant(variant_get(item, '$.index', 'variant')) <> 'STRING'") | F.expr("try_variant_get(item, '$.index', 'string')").rlike(r"^\s*[+-]?\d+\s*$")
    rows = rows.withColumn("index", F.when(whole, number)).where("index is not null")
    last = F.row_number().over(Window.partitionBy("title_id", "batch_id", "index").orderBy(F.desc("ord")))
    return rows.withColumn("_n", last).where("_n = 1").select("title_id", "batch_id", "index", "item")


def field(*keys: str):
    """The first of the item's keys whose value is neither missing nor falsy, as text."""
    def one(key):
        text = F.expr(f"try_variant_get(item, '$.{key}', 'string')")
        return F.when(~text.isin("", "false", "0", "0.0", "[]", "{}"), text)

    return F.coalesce(*[one(k) for k in keys])


def parse_names(replies: DataFrame) -> DataFrame:
    """replies (path, raw) with series_name, movie_name and name_source: cleaned, a movie's series is the movie, else by the file name."""
    rows = _parsed(replies).withColumnRenamed("v", "item")
    fallback = X.clean_name(F.col("path"))
    rows = rows.withColumn("movie_name", X.clean_output_name(field("movie_name"), fallback))
    series = X.clean_output_name(field("series_name"), fallback)
    rows = rows.withColumn("series_name", F.when(F.lower(field("kind")) == "movie", F.col("movie_name")).otherwise(series))
    rows = rows.withColumn("name_source", F.when(F.col("item").isNull(), "heuristic").otherwise("model"))
    return rows.drop("_clean", "_outer", "item")


def routing(model: str) -> tuple[str, str] | None:
    """(server, model) of a tag remote:<server>:<model>, else None."""
    parts = (model or "").split(":", 2)
    return (parts[1], parts[2]) if len(parts) == 3 and parts[0] == "remote" else None
