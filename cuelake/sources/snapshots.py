"""A store of titles whose replacement is one step for readers.

Rows are only ever added, a folder a commit. A snapshot is a table (name, title_id, commit): which commit holds a
title's rows in each table of the store. It is written aside and renamed to the next number, which is the whole
commit, so a reader sees all of a replacement or restart, over all tables of the store, or nothing of it. Writers
that meet at a number build on the other's snapshot and try the next one; the later one's titles stand. Needs a file
system whose rename of a folder is atomic.

A commit writes its own rows and one row a stored title. Nothing is deleted but by ``vacuum``.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES, DIGITS = "_titles", 12
SNAPSHOT = "name string, title_id string, commit string"
TRIES, GRACE = 20, 24 * 3600.0


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since it was written) of what lies in a folder, nothing if there is none."""
    where, system = _where(spark, path)
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in system.listStatus(where)] if system.exists(where) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that are still kept, ascending."""
    return sorted(int(name) for name, _ in _children(spark, f"{path}/{TITLES}") if name.isdigit())


def _snapshot(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(f"{path}/{TITLES}/{number:0{DIGITS}}") if number else spark.createDataFrame([], SNAPSHOT)


def latest(spark: SparkSession, path: str) -> int:
    """The number to read several tables at, 0 if nothing is stored."""
    return max(numbers(spark, path), default=0)


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether ``new`` did not exist and is now what ``old`` was."""
    fs, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    source, target = fs.Path(old), fs.Path(new)
    context = fs.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _same(left: DataFrame, right: DataFrame, *keys: str):
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[key])
    return test


def _commit(spark: SparkSession, path: str, gone: DataFrame, keys: list[str], new: DataFrame) -> int:
    """The next snapshot: the last one without the titles of ``gone`` (by ``keys``), and ``new``."""
    for _ in range(TRIES):
        number = latest(spark, path)
        old = _snapshot(spark, path, number)
        aside = f"{path}/{TITLES}/aside-{uuid.uuid4().hex}"
        old.join(gone, _same(old, gone, *keys), "left_anti").unionByName(new).write.parquet(aside)
        if _rename(spark, aside, f"{path}/{TITLES}/{number + 1:0{DIGITS}}"):
            return number + 1
        where, system = _where(spark, aside)
        system.delete(where, True)
    raise RuntimeError(f"other writers took {TRIES} snapshots of {path} in turn")


def replace(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Replace, in each named table, the titles that its rows hold; other titles and tables stay. Returns the
    number of the new snapshot.

    Rows need a column title_id, which may be null (a title like any other). A title that has no row is not
    replaced: ``restart`` takes titles away. Rows may come from this store, as no stored file changes. A failed
    call leaves the store as it was, but for files that ``vacuum`` takes.
    """
    commit, new = uuid.uuid4().hex, spark.createDataFrame([], SNAPSHOT)
    for name, rows in tables.items():
        if name.startswith("_") or "/" in name:
            raise ValueError(f"no table name: {name}")
        folder = f"{path}/{name}/commit={commit}"
        rows.withColumn("title_id", F.col("title_id").cast("string")).write.parquet(folder)
        held = spark.read.schema("title_id string").parquet(folder).distinct()
        new = new.unionByName(held.select(F.lit(name).alias("name"), "title_id", F.lit(commit).alias("commit")))
    return _commit(spark, path, new, ["name", "title_id"], new)


def restart(spark: SparkSession, path: str, titles: DataFrame) -> int:
    """Take the titles (title_id) out of every table of the store, so that they start anew."""
    titles = titles.select(F.col("title_id").cast("string").alias("title_id")).distinct()
    return _commit(spark, path, titles, ["title_id"], spark.createDataFrame([], SNAPSHOT))


def read(spark: SparkSession, path: str, name: str, schema: str, number: int | None = None) -> DataFrame:
    """Rows of a table as the last snapshot (or snapshot ``number``) has them, columns that a commit lacks null.

    Only folders of commits that still hold a title are read; their names are all that comes to the driver.
    A store or table that is not there has no rows.
    """
    titles = _snapshot(spark, path, latest(spark, path) if number is None else number).where(F.col("name") == name).select("title_id", "commit")
    commits = [r.commit for r in titles.select("commit").distinct().collect()]
    if not commits:
        return spark.createDataFrame([], schema)
    base = f"{path}/{name}"
    rows = spark.read.schema(f"{schema}, commit string").option("basePath", base).parquet(*(f"{base}/commit={c}" for c in sorted(commits)))
    return rows.join(titles, _same(rows, titles, "title_id", "commit"), "left_semi").drop("commit")


def compact(spark: SparkSession, path: str, schemas: dict[str, str]) -> int:
    """Rewrite the named tables so that each is one commit, as after very many replacements."""
    number = latest(spark, path)
    return replace(spark, path, {name: read(spark, path, name, schema, number) for name, schema in schemas.items()})


def vacuum(spark: SparkSession, path: str, keep: int = 1, grace: float = GRACE) -> int:
    """Delete snapshots but the last ``keep``, and folders that those do not name; returns how many. What was
    written within ``grace`` seconds stays: it may be a commit on its way or a snapshot that is being read, so
    ``grace`` must be longer than any write or read of the store."""
    kept = numbers(spark, path)[-max(keep, 1):]
    live, gone = {"commit=" + r.commit for n in kept for r in _snapshot(spark, path, n).select("commit").distinct().collect()}, []
    for name, _ in _children(spark, path):
        for child, age in _children(spark, f"{path}/{name}"):
            stays = child.isdigit() and int(child) in kept if name == TITLES else child in live
            if age >= grace and not stays:
                gone.append(f"{path}/{name}/{child}")
    for folder in gone:
        where, system = _where(spark, folder)
        system.delete(where, True)
    return len(gone)
