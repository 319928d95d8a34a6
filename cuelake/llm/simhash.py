"""SimHash fingerprints of whole texts and exact near-duplicate classes by vantage-point trees.

The fingerprints are dealt out to shards by vantage-point trees. Under the plain 64-bit distance a tree
would put most points on both sides of every boundary (random codes lie 32 +- 4 from any vantage point),
so each tree measures the distance over some of the bits, and the trees' bits are chosen so that one of
them sees no difference within any linked pair and brings its two codes into one shard. How many bits a
tree sees, how deep it is and how many trees there are follow from the number of codes, so that shards stay
of one size. Inside a shard a second vantage-point tree over all 64 bits finds the links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm import vptree
from cuelake.llm.common import connected_components, materialize, maybe_broadcast, scratch, values, without

#: Codes in a shard that the depth of the trees aims at.
SHARD_CODES = 256
#: A shard of more codes is split into blocks, and each pair of blocks is a task of its own.
BLOCK = 16_384
#: Shingles whose bits are counted at once.
SLICE = 1 << 15


def fingerprint_bytes(raw: bytes, words: int) -> int:
    """Signed 64-bit SimHash: bit set if set in over half of the XXH64 (seed 42) of the word shingles."""
    parts = raw.lower().split()  # bytes: A-Z only, and the ASCII white space only
    n = len(parts)
    if not n:
        return 0
    text = b" ".join(parts)
    if n <= words:
        code = xxhash.xxh64_intdigest(text, 42)
        return code - (1 << 64) if code >> 63 else code
    size = np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), n - words + 1
    for lo in range(0, total, SLICE):
        hi = min(total, lo + SLICE)
        codes = np.array([digest(text[a:b], 42) for a, b in zip(start[lo:hi].tolist(), end[lo + words - 1 : hi + words - 1].tolist())], dtype="<u8")
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int) -> Column:
    """Column of signed 64-bit fingerprints of whole texts; null and wordless texts give zero."""

    @F.arrow_udf("long")
    def codes(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_bytes((t or "").encode(), words) for t in values(texts)], type=pa.int64())

    return codes(text)


def code_links(codes: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that join all distinct codes (column code, long) within ``radius`` bits.

    Every link of the full graph is implied: classes linked by these rows are the classes of the graph.
    Each task of a shard returns at most one row a code, never all pairs of a dense class.
    """
    depth = vptree.tree_depth(codes.count(), SHARD_CODES)
    trees = [vptree.BandTree(mask, depth, 17 + k) for k, mask in enumerate(vptree.clean_masks(radius, depth))]

    @F.arrow_udf("array<long>")
    def shards(rows: pa.Array) -> pa.Array:
        values = np.asarray(rows.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
        leaves = np.empty((len(values), len(trees)), dtype=np.int64)
        for k, tree in enumerate(trees):
            row, leaf = tree.visit(values, 0)
            leaves[row, k] = leaf + (k << depth)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(trees)), pa.array(leaves.ravel()))

    # stored, as it is read for the sizes of its shards and again to be dealt out
    dealt = materialize(codes.select("code", F.explode(shards(F.col("code"))).alias("shard")), "dealt")
    large = materialize(dealt.groupBy("shard").count().where(F.col("count") > BLOCK).select("shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-shards")
    dealt = dealt.join(maybe_broadcast(large), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("code", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        member, root = vptree.near_forest(np.unique(rows["code"].to_numpy().view(np.uint64)), radius)
        return pd.DataFrame({"u": member.view(np.int64), "v": root.view(np.int64)})

    return dealt.groupBy("shard", "lo", "hi").applyInPandas(links, "u long, v long")


def classes(codes: DataFrame, radius: int, id_col: str = "doc_id") -> DataFrame:
    """codes (id_col, code) with component_id added: the smallest id reachable over links of codes that
    differ in at most ``radius`` bits, itself included. Rows whose id is null link like any other but
    name no class; a class of such rows only has a null component_id. Repeated rows stay repeated.
    """
    codes = without(codes, "component_id")
    with scratch(codes.sparkSession):
        # stored, so that Spark sees its size and may split the rows of a code that very many texts share
        named = materialize(_named(codes, radius, id_col), "named", keep=True)
    return codes.join(named, "code")


def _named(codes: DataFrame, radius: int, id_col: str) -> DataFrame:
    """(code, component_id) of the distinct codes."""
    distinct = materialize(codes.groupBy("code").agg(F.min(id_col).alias("low")), "codes")
    member = materialize(connected_components(code_links(distinct.select("code"), radius)), "classes")
    low = distinct.join(member.withColumnRenamed("node", "code"), "code").groupBy("root").agg(F.min("low").alias("class_low"))
    named = member.join(low, "root").select(F.col("node").alias("code"), "class_low", F.lit(True).alias("linked"))
    component = F.when(F.col("linked"), F.col("class_low")).otherwise(F.col("low"))
    return distinct.join(named, "code", "left").select("code", component.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, code, fingerprint, component_id), a row for every row of docs.

    Null and wordless texts have fingerprint zero and are linked like any other; texts of fewer words than
    a shingle have one shingle. An empty table gives an empty result.
    """
    codes = materialize(docs.select(F.col(id_col), fingerprint(F.col(text_col), words).alias("code")), "fingerprints")
    return classes(codes, radius, id_col).withColumn("fingerprint", F.lpad(F.lower(F.hex("code")), 16, "0"))
