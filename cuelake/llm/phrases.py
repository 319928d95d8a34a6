"""Phrases and their counts by FM-indexes over word ids: one bidirectional index a shard, sums across shards.

A shard is a run of texts of one group (a language), cut inside a task, so that no text moves. Its index holds
the word sequence and its reverse, each sorted by as many words as a phrase may have, with the Burrows-Wheeler
column and the last-to-first mapping of both; a phrase is an interval of either order, and a step extends all
intervals of a shard at once by every word on their left or right. Phrases that can no longer reach the least
count are not extended: words under it are cut out first, and a phrase of k + 1 words is counted only if its
first and its last k words may be frequent, which a bit table of bounded size says (it may say yes for no
reason, which costs a row, and never no).
"""

from __future__ import annotations

import functools
import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import drop_path, materialize, maybe_broadcast, scratch, small_batches, values, word_slices, write_shared

#: Words of a shard (it ends with the text that reaches them), and words of all open shards of a task.
SHARD_WORDS, OPEN_WORDS = 1 << 20, 3 << 20
#: Shards (of some megabytes) that a task takes from Spark at once.
SHARDS_AT_ONCE = 2
#: Bits of the table of frequent phrases for each of them, and its bits at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: A-Z are lower-cased, tabs are spaces, and the marks that end a piece become a byte that UTF-8 never holds.
CUT = b"\xff"
_MARKS = b".,;:!?\n\x0b\x0c\r"
WORD_BYTES = bytes(255 if c in _MARKS else 32 if c == 9 else ord(chr(c).lower()) if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers words as they come, from 0; the cut is 0."""

    def __init__(self):
        self[CUT] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Shard:
    def __init__(self):
        self.words, self.parts, self.size = _Words(), [], 0

    def add(self, text: str | None) -> int:
        before = self.size
        raw = (text or "").encode().translate(WORD_BYTES).replace(CUT, b" \xff ") + b" \xff"
        for tokens in word_slices(raw):
            self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
            self.size += len(tokens)
        return self.size - before

    def row(self, group: str) -> dict:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.words))[1:]
        words = pa.array(list(self.words)[1:], pa.binary()).cast(pa.string())
        return {"grp": group, "shard": uuid.uuid4().int >> 65, "n": int(counts.sum()), "ids": ids.tobytes(), "words": words, "counts": counts}


def cut_shards(docs: DataFrame, text_col: str, group_col: str, no_group: str = "und") -> DataFrame:
    """(grp, shard, n, ids, words, counts): word ids (little-endian int32, 0 between pieces) of the texts of one
    group, and the words numbered from 1 with their counts. A task cuts its own texts."""

    def cut(batches):
        open_shards: dict[str, _Shard] = {}
        held = 0

        def close(group):
            row = open_shards.pop(group).row(group)
            lists = {k: pa.ListArray.from_arrays(pa.array([0, len(row[k])], pa.int32()), pa.array(row[k])) for k in ("words", "counts")}
            return pa.RecordBatch.from_pydict({k: lists.get(k, [row[k]]) for k in row})

        for batch in batches:
            for group, text in zip(batch.column(1).to_pylist(), values(batch.column(0))):
                shard = open_shards.setdefault(no_group if group is None else group, _Shard())
                held += shard.add(text)
                if shard.size >= SHARD_WORDS or held >= OPEN_WORDS:
                    largest = max(open_shards, key=lambda g: open_shards[g].size)
                    held -= open_shards[largest].size
                    yield close(largest)
        while open_shards:
            yield close(next(iter(open_shards)))

    rows = docs.select(F.col(text_col).alias("text"), F.col(group_col).cast("string").alias("grp"))
    return rows.mapInArrow(cut, "grp string, shard long, n long, ids binary, words array<string>, counts array<long>")


class Intervals(NamedTuple):
    """Phrases as intervals of both orders: ``forward`` and ``backward`` are their first rows."""

    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray


class _Order:
    """The rows of a cyclic sequence sorted by their first ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, base: int, depth: int):
        key, ahead = seq, seq
        for _ in range(depth - 1):
            if int(key.max(initial=0)) >= (1 << 62) // base:
                key = np.unique(key, return_inverse=True)[1]
            ahead = np.roll(ahead, -1)
            key = key * base + ahead
        order = np.argsort(key)
        self.before = seq[order - 1]  # the Burrows-Wheeler column
        step = np.argsort(self.before * len(seq) + np.arange(len(seq)))
        self.last_to_first = np.empty(len(seq), dtype=np.int64)
        self.last_to_first[step] = np.arange(len(seq))


class PhraseIndex:
    """Bidirectional FM-index of a sequence of symbols; 0 ends a phrase, and phrases have at most ``depth``."""

    def __init__(self, seq: np.ndarray, depth: int):
        seq = np.concatenate([[0], np.asarray(seq, dtype=np.int64)])
        self.seq, self.depth, self.base = seq, depth, int(seq.max()) + 1
        self.counts = np.bincount(seq, minlength=self.base)

    @functools.cached_property
    def forward(self) -> _Order:
        return _Order(self.seq, self.base, self.depth)

    @functools.cached_property
    def backward(self) -> _Order:
        return _Order(self.seq[::-1], self.base, self.depth)

    def words(self) -> tuple[np.ndarray, Intervals]:
        """(symbols from 1, their intervals)."""
        first = np.cumsum(self.counts) - self.counts
        return np.arange(1, self.base), Intervals(first[1:], first[1:], self.counts[1:])

    def extend(self, at: Intervals, left: bool) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """(parent, symbol, intervals) of every phrase that is one of ``at`` and a symbol on that side.

        In the order that reads away from that side the new first row is the last-to-first image of the first
        row with the symbol; in the other order the phrases of one parent stand side by side by symbol.
        """
        order, own, other = (self.forward, at.forward, at.backward) if left else (self.backward, at.backward, at.forward)
        start = np.cumsum(at.size) - at.size
        parent = np.repeat(np.arange(len(own)), at.size)
        row = np.arange(len(parent)) + np.repeat(own - start, at.size)
        key = parent * self.base + order.before[row]
        by = np.argsort(key, kind="stable")
        key = key[by]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        size = np.diff(np.concatenate([head, [len(key)]]))
        parent, symbol = key[head] // self.base, key[head] % self.base
        moved = order.last_to_first[row[by[head]]]
        beside = other[parent] + head - start[parent]
        keep = symbol > 0
        new = (moved, beside) if left else (beside, moved)
        return parent[keep], symbol[keep], Intervals(*(x[keep] for x in (*new, size)))


def bits(words: np.ndarray, size: int) -> np.ndarray:
    """Place of each phrase (a row of word numbers) in a table of ``size`` bits, a power of two."""
    code = np.full(len(words), words.shape[1], dtype=np.uint64)
    for k in range(words.shape[1]):
        code = (code ^ words[:, k].astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(31)
    return (code & np.uint64(size - 1)).astype(np.int64)


def bit_table(phrases: DataFrame, columns: list[str]) -> np.ndarray:
    """A table with the bits of all phrases set; its size follows from their count, up to MOST_BITS."""
    size = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(1 + BITS_EACH * phrases.count()))))

    @F.arrow_udf("long")
    def place(*cols: pa.Array) -> pa.Array:
        return pa.array(bits(np.stack([c.to_numpy() for c in cols], axis=1), size))

    at = phrases.select(place(*columns).alias("at"))
    cells = at.groupBy(F.shiftright("at", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()  # size / 32 rows at most
    table = np.zeros(size // 32, dtype=np.uint32)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.uint32)
    return table


def has(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = bits(words, 32 * len(table))
    return (table[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def enumerate_phrases(seq: np.ndarray, known: np.ndarray, depth: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, counts) of ``depth`` words in a shard; known holds the number of each symbol, and
    tables[k] says which phrases of k + 2 words may be frequent. Phrases grow to the right and, on their way,
    only if both their first and their last words may be frequent."""
    index = PhraseIndex(seq, depth)
    symbol, at = index.words()
    phrases = known[symbol][:, None]
    for k in range(depth - 1):
        parent, symbol, at = index.extend(at, left=k == 0)
        more = known[symbol][:, None]
        phrases = np.concatenate([more, phrases[parent]] if k == 0 else [phrases[parent], more], axis=1)
        keep = np.ones(len(phrases), dtype=bool)
        if k:
            keep = has(tables[k - 1], phrases[:, 1:])
        if k < len(tables):
            keep[keep] = has(tables[k], phrases[keep])
        phrases, at = phrases[keep], Intervals(*(x[keep] for x in at))
    return phrases, at.size


def _names(depth: int) -> list[str]:
    return [f"w{k}" for k in range(1, depth + 1)]


def frequent_words(shards: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((grp, word, f, w1), (shard, at, w1)): the words of at least ``least`` occurrences in their group, with a
    number of their own, and their places in each shard's list."""
    every = shards.select("grp", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    every = every.select("grp", "shard", F.col("at") + 1, F.col("x.words").alias("word"), F.col("x.counts").alias("f")).toDF("grp", "shard", "at", "word", "f")
    words = every.groupBy("grp", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = materialize(words.withColumn("w1", F.monotonically_increasing_id()), "frequent-words")
    places = every.select("grp", "shard", "at", "word").join(words.select("grp", "word", "w1"), ["grp", "word"])
    return words, places.groupBy("shard").agg(F.collect_list(F.struct("at", "w1")).alias("places"))


def _shard_phrases(indexed: DataFrame, depth: int, tables) -> DataFrame:
    """(w1, ..., wd, a): counts of phrases of ``depth`` words, shard by shard."""
    names = _names(depth)

    def grow(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), dtype="<i4")
                held = row.column("places").flatten()
                at, number = held.field("at").to_numpy(), held.field("w1").to_numpy()
                symbol = np.zeros(max(int(ids.max(initial=0)), int(at.max(initial=0))) + 1, dtype=np.int64)
                symbol[at] = np.arange(1, len(at) + 1)
                seq = symbol[ids]
                seq = seq[(seq > 0) | np.concatenate([[False], seq[:-1] > 0])]  # one cut between phrases
                phrases, counts = enumerate_phrases(seq, np.concatenate([[-1], number]), depth, tables.value)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*np.ascontiguousarray(phrases.T), counts)], names=[*names, "a"])

    return indexed.mapInArrow(grow, ", ".join(f"{c} long" for c in [*names, "a"]))


def count_phrases(docs: DataFrame, text_col: str, group_col: str, max_words: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """((grp, n), tables), all stored: the words of each group, and for d = 1 .. max_words the phrases of d words
    with at least ``least`` occurrences as (w1, ..., wd, a); the first table has grp and word too."""
    spark = docs.sparkSession
    path = write_shared(cut_shards(docs, text_col, group_col), "shards")
    shards = spark.read.schema("grp string, shard long, n long, ids binary, words array<string>, counts array<long>").parquet(path)
    total = materialize(shards.groupBy("grp").agg(F.sum("n").alias("n")), "group-words")
    words, places = frequent_words(shards, least)
    tables = [words.withColumnRenamed("f", "a")]
    indexed = materialize(shards.select("shard", "ids").join(places, "shard").select("ids", "places"), "shard-words")
    drop_path(spark, path)  # the words are in the other tables by now
    seen: list[np.ndarray] = []
    for depth in range(2, max_words + 1):
        names = _names(depth)
        grown = _shard_phrases(indexed, depth, spark.sparkContext.broadcast(list(seen)))  # tables of MOST_BITS at most
        with small_batches(spark, SHARDS_AT_ONCE):
            found = materialize(grown.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least), f"phrases-{depth}")
        tables.append(found)
        if depth < max_words:
            seen.append(bit_table(found, names))
    return total, tables


def _scored(tables: list[DataFrame], depth: int) -> DataFrame:
    """(w1, ..., wd, a, l, r, score) by the lowest-scoring cut, the first of equals."""
    names, cuts = _names(depth), []
    scored = tables[depth - 1]
    for k in range(1, depth):
        first = tables[k - 1].select(*_names(k), F.col("a").alias(f"l{k}"))
        rest = tables[depth - k - 1].select(*[F.col(a).alias(b) for a, b in zip(_names(depth - k), names[k:])], F.col("a").alias(f"r{k}"))
        scored = scored.join(first, _names(k)).join(rest, names[k:])
        # counts up to 10^15 are exact: 38 digits hold 10^6 a^2
        a, left, right = (f"cast({c} as decimal(15,0))" for c in ("a", f"l{k}", f"r{k}"))
        cuts.append(F.struct(F.expr(f"({a} * {a} * 1000000) div ({left} * {right})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return scored.select(*names, "a", best.alias("best")).select(*names, "a", "best.l", "best.r", "best.score")


def _free(scored: DataFrame, tables: list[DataFrame], depth: int, share: int) -> DataFrame:
    """scored less the phrases of which a longer one has ``share`` percent: one more word is enough to look at,
    as a phrase of two more is no more frequent than that of one more."""
    names = _names(depth)
    if depth == len(tables):
        return scored
    longer = tables[depth]
    right = longer.groupBy(*names).agg(F.max("a").alias("longest"))
    left = longer.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(1, depth + 1)], "a").groupBy(*names).agg(F.max("a").alias("longest"))
    most = right.unionByName(left).groupBy(*names).agg(F.max("longest").alias("longest"))
    return scored.join(most, names, "left").where(F.coalesce(F.col("longest") * 100 < F.col("a") * share, F.lit(True))).drop("longest")


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score): each group's ``top`` phrases of 2 to ``max_words`` words.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends (0A to 0D), pieces into words at
    spaces and tabs. A phrase counts where its words stand side by side in a piece, overlaps included; it needs
    ``least`` occurrences (a) in its group. l and r are the occurrences of its two parts at the cut of the lowest
    score floor(10^6 a^2 / (l r)) (the first such cut), n all words of the group. A phrase inside a longer one
    that has ``share`` percent of its occurrences is dropped. Order: score and a descending, phrase ascending.
    Null groups are ``und``, null and empty texts have no words, repeated rows count each time; an empty table
    gives no rows, other columns are not looked at.
    """
    with scratch(docs.sparkSession):
        total, tables = count_phrases(docs, text_col, group_col, max_words, least)
        words, every = tables[0].select("grp", "word", F.col("w1").alias("w")), None
        for depth in range(2, max_words + 1):
            kept = _free(_scored(tables, depth), tables, depth, share)
            for k, name in enumerate(_names(depth)):
                kept = kept.join(words.select(F.col("w").alias(name), F.col("word").alias(f"word{k}"), *(["grp"] if k == 0 else [])), name)
            kept = kept.select("grp", F.concat_ws(" ", *[f"word{k}" for k in range(depth)]).alias("phrase"), "a", "l", "r", "score")
            every = kept if every is None else every.unionByName(kept)
        order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        best = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        best = best.join(maybe_broadcast(total), "grp")
        return materialize(best.select("grp", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True).withColumnRenamed("grp", group_col)
