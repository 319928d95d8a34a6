"""Language identification with error-correcting output codes over byte n-grams.

Each language has a codeword of bits. A binary n-gram classifier for each bit weighs the text's n-grams by
their log-odds between the languages whose bit is one and those whose bit is zero. Decoding takes the
codeword with the least logistic loss over the bits' margins and flags texts whose two best are close.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fresh, values, without

#: The fit reads at most this many labelled documents, those with the least hash of their id.
SAMPLE_DOCS = 20_000
BUCKETS = 1 << 16
SMOOTH = 1e-6
#: n-grams after which a longer text is no surer evidence.
EVIDENCE = 60
#: Gap of the losses a bit below which a text is ambiguous.
AMBIGUOUS = 0.02
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = bytes(x if chr(x).isalpha() or x >= 0x80 else 0x20 for x in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the text's byte bi- and trigrams, ASCII other than letters folded into single spaces."""
    raw = b" " + b" ".join(text.lower().encode().translate(NOT_LETTERS).split()) + b" "
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = (x[:-1] << 8 | x[1:]) * np.uint32(2654435761) >> np.uint32(16)
    three = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(16)
    return np.concatenate([two, three])


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of 0 and 1: all splits for up to seven languages, else 64 balanced random ones."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 7:
        return np.array([[(s >> k) & 1 for s in range(1, 1 << (n - 1))] for k in range(n)], dtype=np.int8)
    rng, columns = np.random.default_rng(seed), []
    width = max(64, 4 * math.ceil(math.log2(n)))
    while len(columns) < width:
        columns.append(rng.permutation(np.arange(n) % 2).astype(np.int8))
    return np.stack(columns, axis=1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        found = np.bincount(grams(text), minlength=BUCKETS)
        seen = np.flatnonzero(found)
        total = int(found[seen].sum())
        margin = (found[seen] @ self.weights[seen]) / total * min(total, EVIDENCE)
        loss = np.logaddexp(0, -(2 * self.code - 1) * margin[None, :]).sum(axis=1)
        best, second = np.argsort(loss, kind="stable")[:2]
        odds = np.exp(-(loss - loss[best]))
        return self.languages[best], float(1 / odds.sum()), bool((loss[second] - loss[best]) / self.code.shape[1] < AMBIGUOUS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """Learn from whole texts of up to ``sample`` rows with a non-null language.

    Each document adds its n-gram shares to its language, so a long one counts no more than a short one.
    Only sums for (language, bucket) reach the driver: languages * BUCKETS numbers at most.
    """
    told = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = told.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = told.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.join(F.broadcast(chosen), "_id", "left_semi").select("text", "lang")  # at most ``sample`` ids

    def shares(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(values(batch.column(0)), batch.column(1).to_pylist()):
                if LETTER.search(text):
                    got = np.bincount(grams(text), minlength=BUCKETS)
                    mine = totals.setdefault(lang, np.zeros(BUCKETS + 1))
                    mine[:BUCKETS] += got / got.sum()
                    mine[BUCKETS] += 1
        for lang, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()), "share": pa.array(mine[at], pa.float64())})

    sums = rows.mapInArrow(shares, "lang string, bucket int, share double").groupBy("lang", "bucket").agg(F.sum("share").alias("share")).toPandas()
    languages = sorted(sums["lang"].unique().tolist())
    share = np.zeros((len(languages), BUCKETS + 1))
    share[sums["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=int), sums["bucket"].to_numpy(dtype=int)] = sums["share"].to_numpy()
    share = share[:, :BUCKETS] / np.maximum(share[:, BUCKETS:], 1) + SMOOTH
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        one = code[:, b] == 1
        weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
    return Model(languages, code, weights.round(9))


def identify(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score, ambiguous) of whole texts."""
    held = spark.sparkContext.broadcast(model)  # languages * BUCKETS numbers

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        rows = [held.value.predict(t) for t in values(texts)]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=["lang_pred", "score", "ambiguous"])

    return predict(text)


def identify_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous added (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no language was
    learned. Of languages whose losses are equal the first in the alphabet is taken, flagged as ambiguous. One pass without a shuffle; an empty table stays empty.
    """
    out = without(docs, *({"lang_pred", "score", "ambiguous"} - {text_col}))
    (told,) = fresh(out, "told")
    return out.withColumn(told, identify(F.col(text_col), model, docs.sparkSession)).select(*[f"`{c}`" for c in out.columns], f"{told}.*")
