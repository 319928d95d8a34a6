"""Near-duplicate documents by SimHash, verified: groups of a given Jaccard similarity of word shingles.

A single 64-bit fingerprint at 4 bits finds copies that are all but equal. For a similarity of 0.8 this
module takes a sketch of two 64-bit SimHashes and deals it out with vantage-point trees over bands of its
bits, as wide as the number of texts asks for. Shards give candidate clusters, and inside each cluster the
shingle sets decide. That finds most links and gathers the copies of a text; links that share no shard are
found exactly by prefixes: under any one order of all shingles, two sets of similarity s share one of their
first n - ceil(s n) + 1 shingles. The order is by the number of texts with shingles of the same hash cell,
counted over all texts, so that passages which many texts share come last.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm import vptree
from cuelake.llm.common import connected_components, fresh, materialize, maybe_broadcast, scratch, values

SKETCH_WORDS, SHARD_TEXTS = 2, 256
#: Bits of 128 in which the sketches of a candidate pair may differ: similarity 0.8 gives 20 +- 4, unrelated texts 64 +- 6.
SKETCH_RADIUS = 32
#: Texts of a shard and of a cluster that are compared with each other at once. Larger ones are cut into blocks;
#: LEADERS texts of it join every block, and links that this leaves out are the prefixes' to find.
SHARD_BLOCK, DOC_BLOCK, LEADERS, SUB_BLOCK, COLUMNS = 4096, 512, 16, 256, 1 << 14
#: Cells of the table of shingle counts: 4 MB in a task, compressed to be summed, whatever the input.
CELLS = 1 << 20
#: Words whose hashes a worker remembers.
MEMO_WORDS = 1 << 17
SLACK = 1e-6
_SUMS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP, _END = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Signed 64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, 42)
        code -= (code >> 63) << 64
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = code
        return code


_WORDS = _Words()


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, none make none."""
    parts = raw.lower().split()  # bytes: A-Z only, and the ASCII white space only
    if not parts:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(_WORDS.__getitem__, parts), dtype=np.int64, count=len(parts)).view(np.uint64)
    width = min(words, len(parts))
    runs = len(parts) - width + 1
    code = np.full(runs, width, dtype=np.uint64)
    for k in range(width):
        code = (code ^ each[k : k + runs]) * _STEP
        code ^= code >> np.uint64(32)
    code *= _END
    return np.unique(code ^ (code >> np.uint64(29)))


def sketch(codes: np.ndarray) -> bytes:
    """SKETCH_WORDS SimHashes of a set of shingle hashes, as little-endian words."""
    if not len(codes):
        return bytes(8 * SKETCH_WORDS)
    ones = np.zeros(8 * SKETCH_WORDS * 256, dtype=np.int64)
    place = np.arange(8 * SKETCH_WORDS, dtype=np.int64) * 256
    for lo in range(0, len(codes), 1 << 14):
        part, wide = codes[lo : lo + (1 << 14)], []
        for k in range(SKETCH_WORDS):
            x = (part ^ (part >> np.uint64(33))) * np.uint64(_MIX[k])
            x = (x ^ (x >> np.uint64(29))) * _END
            wide.append(x ^ (x >> np.uint64(32)))
        cells = np.stack(wide, axis=1).astype("<u8").view(np.uint8).reshape(len(part), -1) + place
        ones += np.bincount(cells.ravel(), minlength=len(ones))
    set_bits = 2 * (ones.reshape(-1, 256) @ _SUMS) > len(codes)
    return np.packbits(set_bits, axis=1, bitorder="little").tobytes()


def prefix(codes: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set by (count of its cell, code): one of them is in every similar set."""
    if not len(codes):
        return codes
    n = len(codes) - math.ceil(similarity * len(codes) - SLACK) + 1
    seen = counts[codes >> np.uint64(65 - len(counts).bit_length())]
    # codes are sorted, so that a stable order settles equal counts
    if n >= len(codes):
        return codes[np.argsort(seen, kind="stable")]
    near = np.partition(seen, n - 1)[n - 1]
    at = np.flatnonzero(seen <= near)
    return codes[at[np.argsort(seen[at], kind="stable")[:n]]]


def _packed(table: np.ndarray) -> bytes:
    """A table of counts in the fewest bytes a cell, compressed."""
    kind = next(k for k in ("u1", "<u2", "<u4") if table.max(initial=0) <= np.iinfo(k).max)
    return np.dtype(kind).itemsize.to_bytes() + zlib.compress(table.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), dtype=f"<u{raw[0]}").astype(np.uint32)


def _summed(tables: DataFrame) -> DataFrame:
    """One row a partition: the sum of its tables, which stream through."""

    def add(batches):
        total = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for table in batch.column(0):
                # counts beyond 32 bits stay at the top: they only set the order
                more = _unpacked(table.as_buffer().to_pybytes())
                total = np.where(total > ~more, np.uint32(0xFFFFFFFF), total + more)
        yield pa.RecordBatch.from_pydict({"table": pa.array([_packed(total)], pa.binary())})

    return tables.mapInArrow(add, "table binary")


def shingle_counts(docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """Texts with shingles of each of CELLS hash cells, over all rows; a table of fixed size."""
    shift = np.uint64(65 - CELLS.bit_length())

    def count(batches):
        total, cells, size = np.zeros(CELLS, dtype=np.uint32), [], 0
        for batch in batches:
            for text in values(batch.column(0)):
                cells.append((shingles((text or "").encode(), words) >> shift).astype(np.int64))
                size += len(cells[-1])
                if size > CELLS:
                    total += np.bincount(np.concatenate(cells), minlength=CELLS).astype(np.uint32)
                    cells, size = [], 0
        if cells:
            total += np.bincount(np.concatenate(cells), minlength=CELLS).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"table": pa.array([_packed(total)], pa.binary())})

    tables = materialize(docs.select(F.col(text_col)).mapInArrow(count, "table binary"), "counts")
    some = math.ceil(math.sqrt(max(1, tables.count())))  # two levels of sums, each of as many tables
    rows = _summed(_summed(tables.repartition(some)).repartition(1)).collect()  # one row of 4 CELLS bytes at most
    return _unpacked(rows[0][0]) if rows else np.zeros(CELLS, dtype=np.uint32)


def _words(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<u8").reshape(-1, SKETCH_WORDS)


def _in_blocks(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """rows with the column block: groups of over ``size`` rows are cut into blocks by ``key``, and the LEADERS
    rows with the least hash of their key are in every block of their group."""
    large = materialize(rows.groupBy(group).count().where(F.col("count") > size).select(group, F.ceil(F.col("count") / size).cast("int").alias("blocks")), "large")
    cut = rows.join(maybe_broadcast(large), group, "left")
    own = cut.withColumn("block", F.coalesce(F.pmod(F.xxhash64(F.lit(1), key), F.col("blocks")), F.lit(0)).cast("int"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    leaders = cut.where("blocks is not null").withColumn("nth", first).where(F.col("nth") <= LEADERS).drop("nth")
    leaders = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    leaders = leaders.where(F.col("block") != F.pmod(F.xxhash64(F.lit(1), key), F.col("blocks")))
    return own.unionByName(leaders).drop("blocks")


def candidate_clusters(texts: DataFrame) -> DataFrame:
    """(node, root): clusters of the rows (rid, sketch) that shards find within SKETCH_RADIUS bits."""
    depth = vptree.tree_depth(texts.count(), SHARD_TEXTS)
    masks = vptree.bands(max(2, min(6, 64 // max(1, depth))))
    trees = [(w, vptree.BandTree(mask, depth, 101 + 8 * w + k)) for w in range(SKETCH_WORDS) for k, mask in enumerate(masks)]

    @F.arrow_udf("array<long>")
    def shards(rows: pa.Array) -> pa.Array:
        codes = _words(rows.to_pylist())
        leaves = np.empty((len(codes), len(trees)), dtype=np.int64)
        for k, (w, tree) in enumerate(trees):
            row, leaf = tree.visit(codes[:, w], 0)
            leaves[row, k] = leaf + (k << depth)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(trees)), pa.array(leaves.ravel()))

    dealt = materialize(texts.select("rid", "sketch", F.explode(shards(F.col("sketch"))).alias("shard")), "dealt")

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rid, codes = rows["rid"].to_numpy(), _words(rows["sketch"])
        union, n = vptree.Union(len(rid)), len(rid)
        step = max(1, vptree.CHUNK // max(1, n))
        for lo in range(0, n, step):
            # the first word leaves few pairs to compare in full
            i, j = np.nonzero(np.bitwise_count(codes[lo : lo + step, 0][:, None] ^ codes[None, lo:, 0]) <= SKETCH_RADIUS * 3 // 4)
            i, j = i[i < j] + lo, j[i < j] + lo
            far = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1)
            union.add(i[far <= SKETCH_RADIUS], j[far <= SKETCH_RADIUS])
        moved = np.flatnonzero(union.root != np.arange(n))
        return pd.DataFrame({"u": rid[moved], "v": rid[union.root[moved]]})

    return connected_components(_in_blocks(dealt, "shard", "rid", SHARD_BLOCK).groupBy("shard", "block").applyInPandas(links, "u long, v long"))


def similar_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root index of each set's class over all pairs of Jaccard similarity ``similarity`` or more."""
    n, union = len(sets), vptree.Union(len(sets))
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    known, column, count = np.unique(np.concatenate(sets) if n else np.empty(0, dtype=np.uint64), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one text is in no intersection
    row, column = row[shared], column[shared]
    starts = np.searchsorted(row, np.arange(0, n + SUB_BLOCK, SUB_BLOCK))
    place = np.full(len(known), -1)
    for a in range(0, n, SUB_BLOCK):
        mine = slice(starts[a // SUB_BLOCK], starts[a // SUB_BLOCK + 1])
        columns = np.unique(column[mine])
        place[columns] = np.arange(len(columns))
        na = min(SUB_BLOCK, n - a)
        for b in range(a, n, SUB_BLOCK):
            nb = min(SUB_BLOCK, n - b)
            if len(np.unique(np.concatenate([union.root[a : a + na], union.root[b : b + nb]]))) == 1:
                continue
            theirs = slice(starts[b // SUB_BLOCK], starts[b // SUB_BLOCK + 1])
            at = place[column[theirs]]
            their_row, at = row[theirs][at >= 0] - b, at[at >= 0]
            both = np.zeros((na, nb), dtype=np.float32)
            for lo in range(0, len(columns), COLUMNS):
                width = min(COLUMNS, len(columns) - lo)
                x, y = np.zeros((na, width), dtype=np.float32), np.zeros((nb, width), dtype=np.float32)
                own = place[column[mine]]
                inside = (own >= lo) & (own < lo + width)
                x[row[mine][inside] - a, own[inside] - lo] = 1
                inside = (at >= lo) & (at < lo + width)
                y[their_row[inside], at[inside] - lo] = 1
                both += x @ y.T
            either = size[a : a + na][:, None] + size[b : b + nb][None, :] - both
            i, j = np.nonzero((both >= similarity * either - SLACK) & (either > 0))
            union.add(i + a, j + b)
        place[columns] = -1
    return union.root


def prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, a_group, b_group): all pairs of the rows (rid, group, size, prefix) in different groups that
    can be similar.

    Shingles stand in one order in all sets. So what two sets share begins with their first common shingle,
    and no more can follow than either set has left behind it; a similar pair has one that leaves enough.
    Of the rows with a key those of its largest
    group are never paired among themselves, so a group of very many copies costs only what others share with it.
    """
    keys = texts.select("rid", "group", "size", F.posexplode("prefix").alias("pos", "key"))
    shared = keys.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    live = materialize(keys.join(materialize(shared, "shared-keys"), "key"), "keys")
    most = live.groupBy("key", "group").count().groupBy("key").agg(F.max_by("group", F.struct("count", "group")).alias("largest"))
    live = materialize(live.join(most, "key").withColumn("inner", F.col("group") == F.col("largest")).drop("largest"), "live-keys")
    a, b = (live.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("rid", "group", "size", "pos", "inner")]) for side in "ab")
    least = lambda n: F.ceil(n * similarity - SLACK)
    need = F.ceil(((F.col("a_size") + F.col("b_size")) * similarity - SLACK) / (1 + similarity))
    fits = (F.col("a_size") >= least(F.col("b_size"))) & (F.col("b_size") >= least(F.col("a_size"))) & (F.col("a_group") != F.col("b_group"))
    fits = fits & (F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) >= need)
    b = b.where("not b_inner")
    met = a.where("a_inner").join(b, "key").where(fits).unionByName(a.where("not a_inner").join(b, "key").where((F.col("a_rid") < F.col("b_rid")) & fits))
    low, high = F.col("a_rid") < F.col("b_rid"), lambda x: F.struct(F.col(f"{x}_rid").alias("rid"), F.col(f"{x}_group").alias("group"))
    met = met.select(F.when(low, high("a")).otherwise(high("b")).alias("a"), F.when(low, high("b")).otherwise(high("a")).alias("b"))
    return met.select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"), F.col("a.group").alias("a_group"), F.col("b.group").alias("b_group")).distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the near duplicates: of each group one document stays, that of the smallest id.

    Two texts are linked if the sets of their word shingles (A-Z lower-cased, ASCII white space between
    words) have Jaccard similarity ``similarity`` or more; a group is what links connect. Null and wordless
    texts are copies of each other. Rows without id stay only if no row of their group has one; of repeated
    rows one stays. All columns are kept, whatever their names; an empty table stays empty. docs should be
    a stored table, as it is read several times.
    """
    with scratch(docs.sparkSession):
        key, gone, again = _decide(docs, words, similarity, id_col, text_col)
    return _select(docs, key, gone, again)


def _decide(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[list[Column], DataFrame, DataFrame]:
    """(key, gone, again): the key of each row, the stored keys of rows to drop and of repeated rows."""
    docs_key = [F.xxhash64(F.col(id_col), F.col(text_col)), F.hash(F.col(text_col), F.col(id_col))]
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), docs_key[0].alias("k1"), docs_key[1].alias("k2"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words, text_col))  # 4 CELLS bytes

    @F.arrow_udf("struct<copy:binary,sketch:binary,size:int,prefix:array<long>>")
    def marks(texts: pa.Array) -> pa.Array:
        copies, sketches, sizes, firsts = [], [], [], []
        for t in values(texts):
            raw = (t or "").encode()
            codes = shingles(raw, words)
            copies.append(xxhash.xxh3_128_digest(b" ".join(raw.lower().split())))
            sketches.append(sketch(codes))
            sizes.append(len(codes))
            firsts.append(prefix(codes, similarity, counts.value).view(np.int64))
        ends = np.zeros(len(firsts) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in firsts], out=ends[1:])
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.empty(0, dtype=np.int64)))
        return pa.StructArray.from_arrays([pa.array(copies, pa.binary()), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int32()), flat], names=["copy", "sketch", "size", "prefix"])

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles((t or "").encode(), words).tobytes() for t in values(texts)], pa.binary())

    def sets_of(rows: DataFrame) -> DataFrame:
        """rows (k1, k2, ...) with the shingle set of their text; repeated rows of docs come repeatedly."""
        found = keyed.select("k1", "k2", "text").join(maybe_broadcast(rows), ["k1", "k2"])
        return found.select(*[c for c in rows.columns if c not in ("k1", "k2")], sets(F.col("text")).alias("set"))

    def components(edges: DataFrame, name: str, *columns: str) -> DataFrame:
        return materialize(connected_components(edges).select(F.col("node").alias(columns[0]), F.col("root").alias(columns[1])), name)

    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    rows = materialize(keyed.select(order.alias("who"), marks(F.col("text")).alias("m")).select("who", "m.*"), "marks")
    texts = rows.groupBy("copy").agg(F.min("who").alias("who"), *[F.first(c).alias(c) for c in ("sketch", "size", "prefix")])
    texts = materialize(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    place = texts.select("rid", "who.k1", "who.k2")

    cluster = materialize(candidate_clusters(texts.select("rid", "sketch")).select(F.col("node").alias("rid"), "root"), "clusters")
    member = materialize(_in_blocks(cluster, "root", "rid", DOC_BLOCK).join(place, "rid"), "members")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("rid")
        rid = group["rid"].to_numpy()
        root = similar_forest([np.frombuffer(s, dtype=np.uint64) for s in group["set"]], similarity)
        moved = np.flatnonzero(root != np.arange(len(rid)))
        return pd.DataFrame({"u": rid[moved], "v": rid[root[moved]]})

    group = components(sets_of(member).groupBy("root", "block").applyInPandas(verify, "u long, v long"), "groups", "rid", "group")
    texts = materialize(texts.join(maybe_broadcast(group), "rid", "left").select("rid", "who", "size", "prefix", F.coalesce("group", "rid").alias("group")), "grouped")

    pairs = materialize(prefix_pairs(texts, similarity), "pairs")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(place, "rid"), "asked")
    asked = materialize(sets_of(asked).dropDuplicates(["rid"]), "sets")

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - SLACK)
        return pa.array(out, pa.bool_())

    pairs = pairs.join(asked.toDF("a", "a_set"), "a").join(asked.toDF("b", "b_set"), "b").where(similar("a_set", "b_set"))
    more = components(pairs.select(F.col("a_group").alias("u"), F.col("b_group").alias("v")), "more-groups", "group", "root")
    texts = texts.select("rid", "who", "group", "size").join(maybe_broadcast(more), "group", "left").withColumn("group", F.coalesce("root", "group"))
    best = texts.groupBy("group").agg(F.min("who").alias("who")).select("who.k1", "who.k2")
    every = rows.select("who.k1", "who.k2").groupBy("k1", "k2").agg(F.count("*").alias("n"))
    gone = materialize(every.join(best, ["k1", "k2"], "left_anti").select("k1", "k2"), "gone", keep=True)
    again = materialize(every.where("n > 1").select("k1", "k2"), "repeated", keep=True)
    return docs_key, gone, again


def _select(docs: DataFrame, key: list[Column], gone: DataFrame, again: DataFrame) -> DataFrame:
    """docs less the rows whose key is in gone, one row of each key in again."""
    k1, k2, nth = fresh(docs, "k1", "k2", "nth")
    named = lambda keys: maybe_broadcast(keys.toDF(k1, k2))
    kept = docs.withColumns({k1: key[0], k2: key[1]}).join(named(gone), [k1, k2], "left_anti")
    if again.isEmpty():
        return kept.select(*[f"`{c}`" for c in docs.columns])
    once = kept.join(named(again), [k1, k2], "left_anti")
    first = F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(1)))
    more = kept.join(named(again), [k1, k2], "left_semi").withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(more).select(*[f"`{c}`" for c in docs.columns])
