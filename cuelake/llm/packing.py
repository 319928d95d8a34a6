"""Packing token runs into sequences by vector best-fit over counts of equal lengths.

Items are vectors (tokens, one document, attention cost = tokens squared) and so are the capacities. All
items of one length are alike, so best-fit runs over the counts of lengths: bins in the same state are one
row with a multiplicity, and a step places items of one length into many bins at once. The plan's size
depends on the sequence length alone. Spark then numbers the items of each length and looks up places.
"""

from __future__ import annotations

import functools
import math
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import fresh, materialize, text_slices, without

#: Words whose ids a worker remembers, some 400 bytes each; a smaller memo learns words anew.
MEMO_WORDS = 1_000_000
#: Items of one length that one window task numbers.
NUMBERED = 10_000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


#: A word up to an ASCII letter and the ASCII marks after it: the tokenizer always splits there.
TAIL = re.compile(rb"(.*[a-z])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
MARKS = re.compile(rb"[!-&(-/:-@[-`{-~]+")
COMBINING = re.compile("[\u0300-\u036f]")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


LETTERS = _byte_letters()


def _plain(word: bytes) -> str | None:
    """The one pre-token that a word is in byte-level letters, or None if the tokenizer had better see it."""
    if word.isalpha() and word.islower() or MARKS.fullmatch(word):
        return word.decode()
    text = "".join(c.lower() for c in unicodedata.normalize("NFC", word.decode()))
    if text.isalpha() and max(text) < "\u0250":
        return "".join(LETTERS[b] for b in text.encode())
    return None


def _learn(path: str, words: set[bytes], whole: bool) -> None:
    """Remember the ids of new words. Words split by the tokenizer for sure are learned by their parts, and
    those that are one pre-token go straight to its model."""
    tokenizer, memo = _tokenizer(path)
    tokenize = tokenizer.model.tokenize
    parts = {} if whole else {w: m.groups() for w in words if (m := TAIL.fullmatch(w))}
    other = []
    for x in {x for w in words for x in parts.get(w, (w,))}:
        if x not in memo:
            plain = None if whole else _plain(x)
            if plain is None:
                other.append(x)
            else:
                ids = [t.id for t in tokenize(plain)]
                memo[x] = struct.pack(f"<{len(ids)}I", *ids)
    if other:
        for x, e in zip(other, tokenizer.encode_batch_fast([x.decode() for x in other], add_special_tokens=False)):
            ids = e.ids
            memo[x] = struct.pack(f"<{len(ids)}I", *ids)
    for w, (head, tail) in parts.items():
        memo[w] = memo[head] + memo[tail]


def encode_texts(path: str, texts: list[str | None], remembered: int = MEMO_WORDS) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of whole texts.

    Tokens never reach over ASCII white space, so words are encoded once and remembered. The tokenizer
    lower-cases, so A-Z may be lower-cased first, unless a combining mark might join the letter before it.
    """
    _, memo = _tokenizer(path)
    out = []
    for text in texts:
        raw = (text or "").encode()
        whole = b"<|" in raw or not raw.isascii() and bool(COMBINING.search(text))
        words = raw.split() if whole else raw.lower().split()
        if len(memo) > remembered:
            memo.clear()
        got = list(map(memo.get, words))
        if None in got:
            _learn(path, {w for w, g in zip(words, got) if g is None}, whole)
            got = list(map(memo.__getitem__, words))
        out.append(b"".join(got))
    return out


def cut(text: Column, path: str, max_tokens: int, end_id: int, remembered: int = MEMO_WORDS) -> Column:
    """array<struct(piece, start, length, ids)>: the text's ids and end_id, cut at every max_tokens."""
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids:binary>>")
    def pieces(texts: pa.Array) -> pa.Array:
        rows, step = [], 4 * max_tokens
        for ids in (x for part in text_slices(texts) for x in encode_texts(path, part.to_pylist(), remembered)):
            ids += struct.pack("<I", end_id)
            rows.append([{"piece": k // step, "start": k // 4, "length": len(ids[k : k + step]) // 4, "ids": ids[k : k + step]} for k in range(0, len(ids), step)])
        return pa.array(rows, type=kind)

    return pieces(text)


def plan(counts: dict[int, int], caps: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> np.ndarray:
    """Places for counts[length] items of each length, longest first, every capacity held.

    Among the bins that an item fits, ``norm`` takes the one whose weighted residual is smallest after it,
    ``dot`` the one whose residual has the largest weighted product with the item. Returns rows (length,
    first, per_bin, bins, base, offset): the items numbered first .. first + per_bin * bins - 1 of a length
    stand per_bin to a sequence, from token ``offset`` on, in sequences base .. base + bins - 1.
    """
    cap, w = np.array(caps, dtype=float), np.array(weights)
    left = np.zeros((64, 3))
    many = np.zeros(64, dtype=np.int64)
    holds: list[list[tuple[int, int, int]]] = []

    def open_bins(residual: np.ndarray, bins: int, held: list) -> None:
        nonlocal left, many
        k = len(holds)
        if k == len(many):
            left, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
        left[k], many[k] = residual, bins
        holds.append(held)

    for length in sorted(counts, reverse=True):
        item, c = np.array([length, 1, length * length], dtype=float), counts[length]
        if (item > cap).any():
            raise ValueError(f"an item of {length} tokens fits no empty sequence")
        while c:
            fits = np.flatnonzero((many[: len(holds)] > 0) & (left[: len(holds)] >= item).all(axis=1))
            if len(fits):
                scaled = left[fits] / cap
                score = (((scaled - item / cap) ** 2) @ w) if rule == "norm" else -(scaled * (item / cap)) @ w
                g = int(fits[score.argmin()])
                residual, bins, held = left[g].copy(), int(many[g]), holds[g]
            else:
                g, residual, bins, held = -1, cap.copy(), c, []
            each = int((residual // item).min())
            if each > c:
                each = c
            used = min(bins, c // each)
            start = int(cap[0] - residual[0])
            if g >= 0:
                many[g] -= used
            open_bins(residual - each * item, used, [*held, (length, each, start)])
            c -= each * used
    rows, base, first = [], 0, dict.fromkeys(counts, 0)
    for k, held in enumerate(holds):
        if many[k]:
            for length, each, start in held:
                rows.append((length, first[length], each, int(many[k]), base, start))
                first[length] += each * int(many[k])
            base += int(many[k])
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def _place(length: Column, number: Column, places: np.ndarray, spark) -> Column:
    order = np.lexsort((places[:, 1], places[:, 0]))
    held = spark.sparkContext.broadcast(places[order])  # bounded by the sequence length, not by the input

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def look_up(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        table = held.value
        size, rank = np.asarray(lengths), np.asarray(numbers)
        begin, end = np.searchsorted(table[:, 0], size, "left"), np.searchsorted(table[:, 0], size, "right")
        # whole numbers, exact for ranks of one length below 2**40 and lengths below 2**23
        row = np.searchsorted(table[:, 0] << 40 | table[:, 1], size << 40 | rank, "right") - 1
        assert len(size) == 0 or ((row >= begin) & (row < end)).all()
        t, r = table[row], rank - table[row][:, 1]
        return pa.StructArray.from_arrays([pa.array(t[:, 4] + r // t[:, 2]), pa.array(t[:, 5] + r % t[:, 2] * size)], names=["sequence_id", "offset"])

    return look_up(length, number)


def pack(items: DataFrame, order: list[str], max_tokens: int, max_docs: int | None = None, max_cost: int | None = None) -> DataFrame:
    """items (long column length, 1 to max_tokens) with sequence_id and offset added, gapless from 0.

    items should be a stored table, as it is read twice; rows equal in all ``order`` columns are
    interchangeable. Lengths that very many items share are numbered in several tasks. Columns named like the
    added ones are replaced, all others stay whatever their names.
    """
    spark, items = items.sparkSession, without(items, "sequence_id", "offset")
    salt, salts, own, ahead, number, at, n = fresh(items, "salt", "salts", "own", "ahead", "number", "at", "n")
    counts = {r["length"]: r[n] for r in items.groupBy("length").agg(F.count("*").alias(n)).collect()}  # max_tokens rows at most
    places = plan(counts, (max_tokens, max_docs or max_tokens, max_cost or max_tokens**2))
    parts = spark.createDataFrame([(k, math.ceil(c / NUMBERED)) for k, c in counts.items()], f"length long, `{salts}` int")
    dealt = items.join(F.broadcast(parts), "length").withColumn(salt, F.pmod(F.xxhash64(*[f"`{c}`" for c in order]), F.col(salts)).cast("int")).drop(salts)
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", salt).agg(F.count("*").alias(n)).withColumn(ahead, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    nth = F.row_number().over(Window.partitionBy("length", salt).orderBy(*[f"`{c}`" for c in order]))
    ranked = dealt.withColumn(own, nth).join(starts, ["length", salt]).withColumn(number, F.col(own) - 1 + F.col(ahead))
    placed = ranked.withColumn(at, _place(F.col("length"), F.col(number).cast("long"), places, spark))
    return placed.select(*[f"`{c}`" for c in items.columns], F.col(at)["sequence_id"].alias("sequence_id"), F.col(at)["offset"].alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, max_docs: int | None = None, max_cost: int | None = None, remembered: int = MEMO_WORDS) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A document is its ids and end_id; only longer ones are cut at max_tokens. Null and empty texts are
    end_id alone. Repeated rows are packed as often as they stand. An empty table gives no rows.
    ``remembered`` bounds the words that a worker keeps; it changes memory and time, never the result.
    """
    cuts = docs.select(F.col(id_col), F.inline(cut(F.col(text_col), tokenizer_path, max_tokens, end_id, remembered)))
    items = materialize(cuts.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(items, [id_col, "piece", "ids_crc32"], max_tokens, max_docs, max_cost)
