"""Document quality: histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import values, without

#: The fit reads at most this many labelled documents, those with the least hash of their id.
SAMPLE_DOCS = 20_000
TREES, DEPTH, RATE, RIDGE, CUTS, LEAST = 80, 4, 0.15, 1.0, 63, 8
STATS = (
    "log_chars", "log_words", "word_chars", "alpha", "digit", "upper", "end_marks", "bars", "symbols", "other_bytes", "newlines",
    "distinct_words", "top_word", "distinct_lines", "bare_words", "long_word", "capital_words", "distinct_pairs",
)
_BYTE = {
    "alpha": [x for x in range(128) if chr(x).isalpha()],
    "digit": list(b"0123456789"),
    "upper": [x for x in range(128) if chr(x).isupper()],
    "end_marks": list(b"!?"),
    "bars": list(b"|"),
    "symbols": list(b"#$%&*@<>={}[]\\^~_+/"),
    "other_bytes": list(range(128, 256)),
    "newlines": list(b"\n"),
}


def statistics(text: str | None) -> list[float]:
    """The STATS of one whole text; null counts as empty."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    share = {k: float(counts[v].sum()) / n for k, v in _BYTE.items()}
    words = raw.split()
    w = max(1, len(words))
    seen = Counter(words)
    lines = raw.split(b"\n")
    bare = sum(k for x, k in seen.items() if not any(c > 127 or chr(c).isalpha() for c in x[:1] + x[-1:]))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), (len(raw) - int(counts[32]) - int(counts[10])) / w,
        share["alpha"], share["digit"], share["upper"], share["end_marks"], share["bars"], share["symbols"], share["other_bytes"], share["newlines"],
        len(seen) / w, max(seen.values(), default=0) / w, len(set(lines)) / len(lines), bare / w, float(np.log1p(max(map(len, seen), default=0))),
        sum(k for x, k in seen.items() if x[:1].isupper()) / w, len(set(zip(words, words[1:]))) / w,
    ]


@dataclass
class Forest:
    """All trees as arrays: node k of a tree has children 2k+1 and 2k+2; leaves stand below the last level."""

    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    limit: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        depth = int(np.log2(self.leaf.shape[1]))
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        total = self.base + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost logistic loss over binned features. No rows give a constant 0.5, one class its smoothed rate."""
    nodes, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, limit, leaf = np.zeros((TREES, nodes), dtype=np.int64), np.full((TREES, nodes), np.inf), np.zeros((TREES, leaves))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 2 * LEAST or y.min() == y.max():
        return Forest(feature, limit, leaf, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), base)
    width, n_features = CUTS + 1, x.shape[1]
    flat = bins + np.arange(n_features)[None, :] * width
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first = (1 << level) - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2 * LEAST:
                    node[rows] = 2 * k + 1
                    continue
                cells = flat[rows].ravel()
                g, h, c = (np.bincount(cells, weights=np.repeat(v, n_features), minlength=width * n_features).reshape(n_features, width).cumsum(axis=1) for v in (grad[rows], hess[rows], np.ones(len(rows))))
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(c < LEAST) | (len(rows) - c < LEAST)] = -1
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                    node[rows] = 2 * k + 1
                    continue
                feature[t, k], limit[t, k] = f, cuts[f][b]
                node[rows] = 2 * k + 1 + (x[rows, f] > cuts[f][b])
        at = node - nodes
        leaf[t] = RATE * np.bincount(at, weights=grad, minlength=leaves) / (np.bincount(at, weights=hess, minlength=leaves) + RIDGE)
        total += leaf[t, at]
    return Forest(feature, limit, leaf, base)


def features(text: Column) -> Column:
    """array<double> of STATS of whole texts."""

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in values(texts)], type=pa.list_(pa.float64()))

    return stats(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> Forest:
    """Learn from up to ``sample`` labelled documents; only their statistics reach the driver.

    Null labels and ids are left out; repeated labels of one id each count. Of repeated rows of one id the
    last text in order counts, so that no more rows than labels reach the driver.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    told = told.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)  # the bound that allows the broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(told.select("_id").distinct()), "_id", "left_semi")
    rows = rows.groupBy("_id").agg(F.max("_text").alias("_text")).join(F.broadcast(told), "_id")
    got = rows.select("_id", "_y", features(F.col("_text")).alias("x")).toPandas().sort_values(["_id", "_y"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(STATS))
    return fit_forest(x, (got["_y"].to_numpy(dtype=int) > 0).astype(float))


def score_documents(docs: DataFrame, forest: Forest, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with ``score`` (0 to 1, higher: better) added, from the whole text; null and empty texts too.

    A column of that name is replaced. One pass without a shuffle; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(forest)  # TREES * 2**(DEPTH + 1) numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in values(texts)], dtype=float).reshape(-1, len(STATS))
        return pa.array(held.value.score(x), pa.float64())

    return without(docs, *({score_col} - {text_col})).withColumn(score_col, score(F.col(text_col)))
