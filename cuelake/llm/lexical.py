"""Ranked lexical search, reversed: the documents stream through an inverted index of the items.

Items (the queries) are few and documents many, so the index holds the items' terms and is broadcast; each
task counts the terms of its documents that any item asks for, scores them and keeps a bounded heap of the
best documents for each item. Heaps are merged in two levels. Items whose index would pass a fixed bound are
dealt into blocks, and each block is searched against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import fresh, materialize, maybe_broadcast, scratch, values, word_slices

#: Postings (item, term) of one block's index at most, unless a single item has more, and heap entries of a task.
POSTINGS, HEAPED = 100_000, 1_000_000
#: Scores that a task holds at once, and postings that it follows at once.
SCORES, FOLLOWED = 1 << 21, 1 << 20
#: The weight of a document's length, in hundredths.
LENGTH_SHARE = 75
#: Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased.
TERM_BYTES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def term_slices(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in order, list by list."""
    return word_slices((text or "").encode().translate(TERM_BYTES))


class ItemIndex:
    """Inverted index of a block of items: terms by number, and each term's items with their repeats."""

    def __init__(self, rows: pa.Table):
        keys, item = np.unique(rows["key"].to_numpy(), return_inverse=True)
        terms, term = np.unique(np.array(rows["term"].to_pylist(), dtype=object), return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.keys, self.number = keys, {t: k for k, t in enumerate(terms.tolist())}
        self.item, self.times = item[order], rows["times"].to_numpy()[order]
        self.start = np.searchsorted(term[order], np.arange(len(terms) + 1))


class Heaps:
    """For each item its best documents so far, at most ``size``; the worst of them is on top."""

    def __init__(self, items: int, size: int):
        self.size, self.rows = size, [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)  # a score under it cannot enter

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """scores[document, item] of a batch of documents."""
        n, need = len(scores), self.least
        if n > self.size:  # what a batch's own best leave behind need not be offered
            need = np.maximum(need, np.partition(scores, n - self.size, axis=0)[n - self.size])
        for row, item in np.argwhere(scores >= need).tolist():
            heap, entry = self.rows[item], _Entry(int(scores[row, item]), ids[row])
            if len(heap) < self.size:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.size:
                self.least[item] = max(1, heap[0].score)


class _Entry:
    """Orders documents from worse to better: by score, then by descending id; no id is worst."""

    __slots__ = ("score", "id")

    def __init__(self, score: int, id):
        self.score, self.id = score, id

    def __lt__(self, other: _Entry) -> bool:
        if self.score != other.score:
            return self.score < other.score
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id


def weights(found: dict[int, int], terms: int, texts: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term; a term that no document holds weighs nothing here."""
    out = np.zeros(terms, dtype=np.int64)
    for k, df in found.items():
        out[k] = math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))
    return out


def score_batch(index: ItemIndex, weight: np.ndarray, size: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, texts: int, total: int) -> np.ndarray:
    """scores[document, item]; (row, term, times) are the documents' counts of the index's terms."""
    length = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * texts // total for n in size.tolist()], dtype=np.int64)
    gain = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * length[row]))
    out, items = np.zeros(len(size) * len(index.keys), dtype=np.int64), len(index.keys)
    width = index.start[term + 1] - index.start[term]
    ends = np.cumsum(width)
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FOLLOWED, "right")))
        w = width[lo:hi]
        at = np.arange(w.sum()) + np.repeat(index.start[term[lo:hi]] - (np.cumsum(w) - w), w)
        np.add.at(out, np.repeat(row[lo:hi] * items, w) + index.item[at], np.repeat(gain[lo:hi], w) * index.times[at])
        lo = hi
    return out.reshape(len(size), items)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(items with a key, (key, term, times)), both stored."""

    @F.arrow_udf("array<struct<term:binary,times:long>>")
    def counted(texts: pa.Array) -> pa.Array:
        rows = [[{"term": t, "times": n} for t, n in sum((Counter(part) for part in term_slices(text)), Counter()).items()] for text in values(texts)]
        return pa.array(rows, pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())])))

    own = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct().withColumn("key", F.monotonically_increasing_id())
    own = materialize(own, "items")
    return own, materialize(own.select("key", F.inline(counted("text"))), "item-terms")


def in_blocks(terms: DataFrame, top: int) -> tuple[DataFrame, int]:
    """terms with the column block, and the number of blocks: none holds more than 2 * POSTINGS rows or more
    items than HEAPED heap entries allow, unless it is one item."""
    sizes = terms.groupBy("key").agg(F.count("*").alias("n"))
    rows, items = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil(rows / POSTINGS), math.ceil(items * top / HEAPED))
    while True:
        block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
        if blocks == 1 or blocks >= 2 * items:
            break
        most, many = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("items")).agg(F.max("n"), F.max("items")).first()
        if most <= 2 * POSTINGS and many * top <= 2 * HEAPED:
            break
        blocks *= 2
    return terms.withColumn("block", block), blocks


def _counts(docs: DataFrame, index) -> DataFrame:
    """(id, n, terms, times): the number of all terms of each document, and how often it holds the index's."""
    kind = docs.select(F.col("id"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0)).alias("terms"), F.array(F.lit(0)).alias("times")).schema

    def count(batches):
        number = index.value.number
        for batch in batches:
            sizes, ends, terms, times = [], [0], [], []
            for text in values(batch.column(1)):
                n, seen = 0, Counter()
                for part in term_slices(text):
                    n += len(part)
                    seen.update(map(number.get, part))
                seen.pop(None, None)
                sizes.append(n)
                ends.append(ends[-1] + len(seen))
                terms.extend(seen.keys())
                times.extend(seen.values())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "times"])

    return docs.select("id", "text").mapInArrow(count, kind)


def _best(counts: DataFrame, index, weight, texts: int, total: int, top: int) -> DataFrame:
    """(part, key, score, id): the best documents of each item in each task."""
    id_type = counts.schema["id"].dataType.simpleString()

    def search(batches):
        known, weigh = index.value, weight.value
        heaps, kind = Heaps(len(known.keys), top), None
        step = max(1, SCORES // len(known.keys))
        for batch in batches:
            kind = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                size, held = part.column("n").to_numpy(), part.column("terms")
                term, times = held.flatten().to_numpy(), part.column("times").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(size)), held.value_lengths().to_numpy())
                heaps.offer(score_batch(known, weigh, size, row, term, times, texts, total), part.column("id").to_pylist())
        if kind is not None:
            rows = [(known.keys[k], e.score, e.id) for k, heap in enumerate(heaps.rows) for e in heap]
            key, score, ids = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, kind)], names=["key", "score", "id"])

    return counts.mapInArrow(search, f"key long, score long, id {id_type}").withColumn("part", F.spark_partition_id())


def _merged(best: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): for each item its ``top`` documents of highest score above 0.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N
    documents that hold a term, L terms in all and n in one document, a term found in df documents weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))), and tf occurrences of it in a document with
    m = 25 + 75 n N div L add w * (10^9 tf div (1000 tf + 8 m)), once for each of its repeats in the item.
    Equal scores rank by ascending id; documents without id count in all statistics and rank last among
    equals. Null and empty texts have no term. Repeated document rows are documents of their own; repeated
    item rows are one item, and rows that share an id but not the text are ranked each. Empty tables give no
    rows; other columns of either table are not looked at.
    """
    names = fresh(items.limit(0).select(), item_col, "rank", id_col, "score")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    with scratch(spark):
        own, terms = item_terms(items, item_col, item_text_col)
        terms, blocks = in_blocks(terms, top)
        found = [_ranked(docs, terms.where(F.col("block") == b), top) for b in range(blocks)]
        found = [f for f in found if f is not None]
        if not found:
            kind = {**dict(docs.dtypes), **dict(own.dtypes)}
            return spark.createDataFrame([], f"`item` {kind['item']}, rank int, id {kind['id']}, score long").toDF(*names)
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        told = every.join(maybe_broadcast(own.select("key", "item")), "key").select("item", "rank", "id", "score")
        return materialize(told, "item-ranks", keep=True).toDF(*names)


def _ranked(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame | None:
    """(key, rank, id, score) of one block of items, or None if nothing can be found."""
    spark = docs.sparkSession
    rows = terms.select("key", "term", "times").toArrow()  # bounded by in_blocks
    if not rows.num_rows:
        return None
    index = spark.sparkContext.broadcast(ItemIndex(rows))
    counts = materialize(_counts(docs, index), "term-counts")
    texts, total = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not texts:
        return None
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the index
    weight = spark.sparkContext.broadcast(weights({r["term"]: r["count"] for r in found}, len(index.value.number), texts))
    best = materialize(_best(counts, index, weight, texts, total, top), "task-ranks")
    parts = max(1, math.isqrt(1 + (best.agg(F.max("part")).first()[0] or 0)))
    best = _merged(best.withColumn("part", F.col("part") % parts), top, "key", "part")
    return materialize(_merged(best.drop("part"), top, "key").select("key", "rank", "id", "score"), "block-ranks")
