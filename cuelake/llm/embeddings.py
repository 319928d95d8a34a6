"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, probed buckets, verified pairs.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; its hash names the coordinate of
largest magnitude and that one's sign. A table joins a few hashes to one bucket. Each vector goes to the
buckets of the best two answers of every hash (the probes), and vectors that share a bucket are compared in
double precision. For 64 dimensions and cosine 0.98 one hash agrees so with probability 0.97, hence four
tables of three hashes miss a pair in about 1 of 25,000 cases, fewer at higher cosines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import connected_components, materialize, scratch, without
from cuelake.llm.vptree import Union

TABLES = 4
#: Rows of a bucket that one task takes; larger buckets are compared block against block.
BLOCK = 4096
#: Mean rows of a task that compares buckets.
TASK_ROWS = 20_000
SLICE = 512


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, hashes: int, tables: int = TABLES, seed: int = 11) -> np.ndarray:
    """(rows, tables, 2**hashes) codes of the buckets that each row of x is dealt to."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, width])
    out = np.empty((len(x), tables, 1 << hashes), dtype=np.int64)
    for t in range(tables):
        codes = np.zeros((len(x), 1), dtype=np.int64)
        for _ in range(hashes):
            y = padded
            for signs in rng.integers(0, 2, size=(3, width)) * 2.0 - 1:
                y = _hadamard(y * signs)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            answer = 2 * top + (np.take_along_axis(y, top, axis=1) > 0)
            codes = (codes[:, :, None] * (2 * width) + answer[:, None, :]).reshape(len(x), -1)
        out[:, t] = codes
    return out


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _probed(classes: DataFrame, hashes: int) -> DataFrame:
    """classes with ``codes``: for each table the buckets of the vector."""

    @F.arrow_udf("array<array<long>>")
    def probes(vectors: pa.Array) -> pa.Array:
        rows = vectors.to_pylist()
        out: list = [None] * len(rows)
        for width in {len(r) for r in rows}:
            at = [k for k, r in enumerate(rows) if len(r) == width]
            for k, codes in zip(at, buckets(_matrix([rows[k] for k in at]), hashes)):
                out[k] = list(codes)
        return pa.array(out, type=pa.list_(pa.list_(pa.int64())))

    return classes.withColumn("codes", probes(F.col("vec")))


def _compare(left: pd.DataFrame, right: pd.DataFrame | None, t: int, code: int, cosine: float, codes: dict, union: Union, links: np.ndarray) -> None:
    """Count and join the linked pairs of left and right (or within left) whose first shared bucket is this."""
    a = left["at"].to_numpy()
    b = a if right is None else right["at"].to_numpy()
    unit, weight, probed = codes["unit"], codes["n"], codes["probed"]
    for lo in range(0, len(a), SLICE):
        i, j = np.nonzero(unit[a[lo : lo + SLICE]] @ unit[b].T >= cosine - 1e-9)
        if right is None:
            i, j = i[i + lo < j], j[i + lo < j]
        i, j = a[lo + i], b[j]
        exact = np.einsum("ij,ij->i", codes["x"][i], codes["x"][j]) / (codes["norm"][i] * codes["norm"][j])
        i, j = i[exact >= cosine], j[exact >= cosine]
        for earlier in range(t + 1):  # a pair counts where it first meets
            if not len(i):
                break
            same = probed[i, earlier][:, :, None] == probed[j, earlier][:, None, :]
            if earlier == t:
                same &= (probed[i, earlier] < code)[:, :, None]
            new = ~same.any(axis=(1, 2))
            i, j = i[new], j[new]
        union.add(i, j)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])


def _linker(cosine: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.drop_duplicates("cid")
        cid = first["cid"].to_numpy()
        rows = rows.assign(at=pd.Series(np.arange(len(cid)), index=cid).loc[rows["cid"]].to_numpy())
        union, links = Union(len(cid)), np.zeros(len(cid), dtype=np.int64)
        for dim, part in rows.groupby("dim", sort=False):
            mine = first[first["dim"] == dim]
            x = _matrix(mine["vec"])
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            spot = pd.Series(np.arange(len(mine)), index=mine["cid"])
            place = np.full(len(cid), -1)
            place[part.drop_duplicates("cid")["at"]] = spot.loc[part.drop_duplicates("cid")["cid"]]
            codes = {"x": x, "norm": norm, "unit": x / norm[:, None], "n": mine["n"].to_numpy(), "probed": np.array([list(c) for c in mine["codes"]])}
            own_union, own_links = Union(len(mine)), np.zeros(len(mine), dtype=np.int64)
            part = part.assign(at=place[part["at"].to_numpy()])
            bucket_key = ["label", "t", "code", "lo", "hi"]
            sizes = part.groupby(bucket_key, sort=False)["at"].transform("size")
            for (_, t, code, lo, hi), bucket in part[sizes > 1].groupby(bucket_key, sort=False):
                if lo == hi:
                    _compare(bucket, None, t, code, cosine, codes, own_union, own_links)
                else:
                    _compare(bucket[bucket["own"] == lo], bucket[bucket["own"] == hi], t, code, cosine, codes, own_union, own_links)
            back = pd.Series(np.arange(len(cid)), index=cid).loc[mine["cid"]].to_numpy()
            links[back] += own_links
            moved = np.flatnonzero(own_union.root != np.arange(len(mine)))
            union.add(back[moved], back[own_union.root[moved]])
        tied = np.flatnonzero(links > 0)
        return pd.DataFrame({"u": cid[tied], "v": cid[union.root[tied]], "links": links[tied]})

    return link


def _labelled_classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(cid, label, vec, dim, n, low): the distinct comparable vectors of each label."""
    v = F.col(vector_col)
    sound = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).groupBy(F.col(label_col).alias("label"), v.alias("vec")).agg(F.count("*").alias("n"), F.min(id_col).alias("low"))
    return materialize(rows.withColumn("dim", F.size("vec")).withColumn("cid", F.monotonically_increasing_id()), "vectors")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for every row of vectors.

    Rows are linked if their labels are equal and not null and their cosine is at least ``cosine``; equal
    vectors are one class and each other's links. Vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do vectors of unequal width. component_id is the smallest id
    reachable, itself included; kept marks the row of that id (all its rows if the id is repeated). Rows
    with a null id link but name no component. An empty table gives no rows.
    """
    with scratch(vectors.sparkSession):
        told = materialize(_classes(vectors, cosine, id_col, vector_col, label_col), "told", keep=True)
    rows = without(vectors, "n_links", "component_id", "kept").withColumn("label", F.col(label_col)).withColumn("vec", F.col(vector_col))
    found = rows.join(told.withColumn("told", F.lit(True)), ["label", "vec"], "left")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col(id_col))
    found = found.select(F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _classes(vectors: DataFrame, cosine: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(label, vec, n_links, component_id) of the distinct comparable vectors."""
    classes = _labelled_classes(vectors, id_col, vector_col, label_col)
    most = classes.groupBy("label", "dim").count().agg(F.max("count"), F.min("dim")).first()
    # one hash more than names as many buckets as vectors: unrelated vectors then rarely meet, at any size
    hashes = 1 + max(1, math.ceil(math.log(max(2, most[0] or 0)) / math.log(2 * max(2, most[1] or 2))))
    probed = materialize(_probed(classes, hashes), "probes")
    dealt = probed.select("cid", "label", "dim", F.posexplode("codes").alias("t", "row")).select("cid", "label", "dim", "t", F.explode("row").alias("code"))
    bucket = ["label", "dim", "t", "code"]
    sizes = dealt.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    met = dealt.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", *bucket, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    met = materialize(met, "met")
    tasks = max(1, math.ceil(met.count() / TASK_ROWS))
    met = met.withColumn("task", F.pmod(F.xxhash64(*bucket, "lo", "hi"), F.lit(tasks)))
    pairs = met.join(probed.select("cid", "vec", "n", "codes"), "cid").groupBy("task").applyInPandas(_linker(cosine), "u long, v long, links long")
    pairs = materialize(pairs, "links")
    member = connected_components(pairs.select("u", "v")).withColumnRenamed("node", "cid")
    counted = pairs.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    classes = classes.join(counted, "cid", "left").join(member, "cid", "left").withColumn("root", F.coalesce("root", F.col("cid")))
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return classes.join(named, "root").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
