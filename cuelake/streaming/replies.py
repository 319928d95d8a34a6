"""Replies of a model, stored batch by batch, so that what was answered is not asked or paid for again.

Requests become small files that a stream takes some at a time; each micro-batch asks the model and stores its
replies as a folder of its own. A run that ends early leaves every finished micro-batch, and the next run asks
only for requests whose prompt has no stored reply.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.operators import batch
from cuelake.operators.resume import read_stored

KEY = ["title_id", "batch_id", "asked"]
REQUEST = "title_id string, batch_id long, prompt string, asked string"
REPLY = "title_id string, batch_id long, asked string, attempt int, raw string, error string, stored_at timestamp"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(title_id, batch_id, asked, attempt, raw, error): the stored replies under ``folder``, the last of each
    prompt (``asked`` is its MD5). Failed prompts are not among them; no folder gives no rows."""
    rows = read_stored(spark, f"{folder}/replies", REPLY, nested=True).where("raw is not null")
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("stored_at"), "raw"))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "stored_at")


def ask(
    requests: DataFrame,
    model: Callable[[list[str]], list[str]],
    folder: str,
    attempts: int = batch.ATTEMPTS,
    pause: float = batch.PAUSE,
    prompts: int = batch.PROMPTS,
    files: int | None = None,
    after: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Replies to requests (title_id, batch_id, prompt) as ``stored`` gives them, asking only for those without one.

    A file holds at most ``prompts`` prompts and is one task; a micro-batch takes ``files`` files (as many as
    there are cores) and its replies are stored before the next begins. ``after`` gets the replies of each
    micro-batch once they are stored. A prompt that fails in all its tries does not stop the others: the run
    goes on and raises RuntimeError at its end. If no prompt of a micro-batch is answered the model counts as
    gone, and the run ends there. Failed prompts end no task, so Spark never repeats one for them.
    """
    spark = requests.sparkSession
    wanted = requests.select("title_id", "batch_id", "prompt", F.md5("prompt").alias("asked"))
    run, failed = uuid.uuid4().hex, []
    source, marks = f"{folder}/requests/{run}", f"{folder}/streams/{run}"
    left = wanted.join(stored(spark, folder).select(*KEY), KEY, "left_anti")
    left.write.option("maxRecordsPerFile", prompts).parquet(source)

    def turn(rows: DataFrame, number: int) -> None:
        told = batch.run_model(rows, model, attempts, pause, abort=False)
        told = told.join(rows.select(*KEY), ["title_id", "batch_id"]).withColumn("stored_at", F.current_timestamp())
        path = f"{folder}/replies/{run}/{number}"
        told.select(*[c.split()[0] for c in REPLY.split(", ")]).write.mode("overwrite").parquet(path)
        kept = rows.sparkSession.read.schema(REPLY).parquet(path)
        all_, good = kept.agg(F.count("*"), F.count("raw")).first()
        if after is not None and good:
            after(kept.where("raw is not null").drop("stored_at"))
        if good < all_:
            failed.append((all_ - good, kept.where("raw is null").select(F.max("error")).first()[0]))
        if all_ and not good:
            raise RuntimeError(f"the model answers no prompt any more: {failed[-1][1]}")

    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files or spark.sparkContext.defaultParallelism).parquet(source)
    query = stream.writeStream.foreachBatch(turn).option("checkpointLocation", marks).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        for path in (source, marks):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if failed:
        raise RuntimeError(f"{sum(n for n, _ in failed)} prompts have no reply, the others are stored: {failed[-1][1]}")
    return stored(spark, folder).join(wanted.select(*KEY), KEY, "left_semi")
