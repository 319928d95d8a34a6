"""Shared folder, slices of batches and connected components for the text operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at once. Spark bounds an Arrow batch by 64 MB (and goes over it by one row at
#: most), whatever the rows' sizes; what Python makes of a batch is made slice by slice.
SLICE_BYTES = 1 << 20


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string or binary array, each of about ``size`` bytes or one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(at, to - at)
        at = to


def values(texts: pa.Array) -> Iterator:
    """The Python values of a string or binary array, made slice by slice."""
    for part in text_slices(texts):
        yield from part.to_pylist()
    pa.default_memory_pool().release_unused()


def word_slices(raw: bytes, size: int = 4 * SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of raw between ASCII white space, in lists of about ``size`` bytes: a very long text makes no
    list of all its words."""
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + size)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a plain local master may run without the setting; a folder of its own is made then.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-cuelake-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``materialize``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch while a table is stored: texts of kilobytes then take megabytes in a worker.
STORED_BATCH = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = STORED_BATCH) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if 0 < int(own) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those that are stored to be kept."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            drop_path(spark, path)


def write_shared(df: DataFrame, name: str, keep: bool = False) -> str:
    """Write ``df`` as Parquet into the shared folder and return the new path."""
    path = f"{shared_dir(df.sparkSession)}/cuelake/{name}-{uuid.uuid4().hex}"
    paths = _scratch.get()
    if paths is not None and not keep:
        paths.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: a table in the shared folder, read back. Lost executors do not lose it.

    Inside ``scratch`` it is deleted at its end, unless ``keep`` says that a lazy result still reads it.
    """
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_shared(df, name, keep))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; operator outputs win a clash."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


#: Rows of keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 250_000


def maybe_broadcast(keys: DataFrame) -> DataFrame:
    """keys (a few numbers a row, stored, as they are counted first) with the hint to broadcast them if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _symmetric(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v), both long.

    Returns (node, root): one row per node that has an edge to another node, root being the smallest
    node of its component. Alternates large-star and small-star passes; each pass is a grouped minimum
    (combined before the shuffle, so a node with very many edges is no hot key) and a join that Spark
    may split when skewed. Nothing is collected but two sums per round. Null ends and loops are ignored;
    no edges give no rows.
    """
    spark = edges.sparkSession
    now = write_shared(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        frame = spark.read.schema("u long, v long").parquet(now)
        seen = frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return frame.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                frame.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark, old = seen, now
        now = write_shared(_small_star(_large_star(frame)), "edges")
        drop_path(spark, old)
