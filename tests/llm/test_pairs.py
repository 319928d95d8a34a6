"""SimHash, near duplicates and embeddings against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
import xxhash

from cuelake.llm import embeddings, neardup, queries, simhash, vptree
from cuelake.llm.common import connected_components


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_fingerprint(text, words):
    raw = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    parts, now = [], b""
    for c in lower:
        if c in b" \t\n\x0b\x0c\r":
            parts, now = parts + [now] * bool(now), b""
        else:
            now += bytes([c])
    parts += [now] * bool(now)
    if not parts:
        return 0
    grams = [b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, words, radius):
    prints = [brute_fingerprint(t, words) for _, t in rows]
    root = classes(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius])
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return sorted((str(i), f"{prints[k]:016x}", str(low.get(root[k]))) for k, (i, _) in enumerate(rows))


TEXTS = [(1, None), (2, ""), (3, " \t"), (4, "One"), (9, "one"), (5, "a b c d"), (6, "A  B\nc d"), (7, "a b c d e"), (None, "one"), (None, "lonely text here"), (8, "É b"), (10, "é b"), (10, "é b"), (11, "x " * 4000)]


def test_simhash(spark, sf):
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in TEXTS], "doc_id long, text string, component_id int, code string")
    got = simhash.near_duplicates(frame).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_components(TEXTS, 4, 4)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op2_simhash(spark, sf).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_components(docs, 4, 4)


@pytest.mark.parametrize("radius", [1, 4, 7])
def test_code_links_of_dense_classes_in_blocks(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "SHARD_CODES", 8)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, size=6, dtype=np.uint64)
    codes = [int(b) for b in base]
    for _ in range(400):
        codes.append(codes[rng.integers(0, 6)] ^ sum(1 << int(k) for k in set(rng.integers(0, 64, size=rng.integers(0, 6)))))
    codes += [int(x) for x in rng.integers(0, 1 << 62, size=200, dtype=np.uint64)]
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.code_links(spark.createDataFrame([(c,) for c in signed], "code long"), radius)
    found = {r.node: r.root for r in connected_components(edges).collect()}
    root = classes(len(codes), [(a, b) for a in range(len(codes)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= radius])
    mine = {}
    for k, c in enumerate(signed):
        mine.setdefault(found.get(c, c), set()).add(k)
    want = {}
    for k in range(len(codes)):
        want.setdefault(root[k], set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_tree_visits_every_leaf_within_the_radius():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 62, size=500, dtype=np.uint64)
    mask = vptree.bands(5)[2]
    for radius in (0, 1, 3):
        y = x ^ (np.uint64(1) << np.uint64(30)) if radius else x ^ ~mask
        tree = vptree.BandTree(mask, 7, 3)
        home = dict(zip(*(v.tolist() for v in tree.visit(y, 0))))
        reach = {}
        for row, leaf in zip(*(v.tolist() for v in tree.visit(x, radius))):
            reach.setdefault(row, set()).add(leaf)
        assert all(home[k] in reach[k] for k in home)


@pytest.mark.parametrize("radius", [1, 4])
def test_one_mask_is_clear_of_any_difference(radius):
    rng = np.random.default_rng(8)
    for width in (5, 14, 20, 26, 32, 40):
        masks = vptree.clean_masks(radius, width)
        assert min(int(m).bit_count() for m in masks) >= min(width, 32) - 1
        for _ in range(300):
            apart = sum(1 << int(k) for k in rng.choice(64, size=radius, replace=False))
            assert any(int(m) & apart == 0 for m in masks)


def test_shards_stay_of_one_size():
    """Codes that share a shard with a code, as the number of codes grows."""
    rng = np.random.default_rng(6)
    for n in (5_000, 50_000, 500_000):
        codes = rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=n, dtype=np.uint64)
        depth = vptree.tree_depth(n, 256)
        for mask in vptree.clean_masks(4, depth)[:3]:
            _, leaf = vptree.BandTree(mask, depth, 17).visit(codes, 0)
            assert (np.bincount(leaf).astype(float) ** 2).sum() / n < 1000
    for n in (10**8, 10**9, 10**10):  # by the chance that two codes share a leaf, over their distance on the mask
        depth = vptree.tree_depth(n, 256)
        width = int(vptree.clean_masks(4, depth)[0]).bit_count()
        points = rng.integers(0, 1 << width, size=20_000, dtype=np.uint64)
        inner = lambda x: np.bitwise_count(points ^ np.uint64(x)) <= (width - 1) // 2
        mates = sum(math.comb(width, t) / 2**width * (inner(0) == inner((1 << t) - 1)).mean() ** depth for t in range(width + 1))
        assert n * mates < 2000


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, -5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 200: 100, 300: -5, -5: -5}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_groups(texts, words, similarity):
    sets = []
    for t in texts:
        p = (t or "").encode().lower().split()
        sets.append({b" ".join(p[k : k + words]) for k in range(max(1, len(p) - words + 1))} if p else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if (not sets[a] and not sets[b]) or (sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))]
    return classes(len(texts), links)


def near_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    bases = [[word() for _ in range(rng.randint(30, 200))] for _ in range(8)]
    out = []
    for _ in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text))
    return out


def test_near_duplicates(spark, monkeypatch, tmp_path):
    for name, size in (("SHARD_TEXTS", 16), ("SHARD_BLOCK", 40), ("DOC_BLOCK", 30), ("LEADERS", 2), ("SUB_BLOCK", 16), ("COLUMNS", 100)):
        monkeypatch.setattr(neardup, name, size)
    texts = [*near_texts(240, 1), None, "", "one two", "One  two", "one two three"]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "quite alone here"), (1, texts[0])]
    clash = "rid string, k1 int, K2 int, nth string, _k1 int, `a.b` int"
    spark.createDataFrame([(i, t, "c", 2, 3, "n", 5, 6) for i, t in rows], f"doc_id long, text string, {clash}").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("c", 2, 3, "n", 5, 6)}
    root = jaccard_groups([t for _, t in rows], 5, 0.8)
    want = {}
    for k, (i, _) in enumerate(rows):
        want[root[k]] = min(want.get(root[k], (True, 0)), (i is None, i or 0))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("None" if none else str(i) for none, i in want.values())
    docs.limit(0).write.parquet(str(tmp_path / "e"))
    assert neardup.drop_near_duplicates(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def brute_vectors(rows, cosine):
    unit = []
    for _, v, label in rows:
        sound = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(float) if sound else None
        unit.append(None if x is None else x / np.sqrt((x * x).sum()))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    root, count = classes(len(rows), links), [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return sorted(repr((i, count[k], low.get(root[k]), i is not None and low.get(root[k]) == i)) for k, (i, _, _) in enumerate(rows))


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(6):
            base = rng.normal(size=16)
            for _ in range(25):
                rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.12])).tolist(), label))
        rows += [(len(rows) + k, rng.normal(size=16).tolist(), label) for k in range(60)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, rows[0][1], None), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] * 16, 1), (n + 5, [float("inf")] * 16, 1), (n + 6, rows[0][1][:8], 0), (n + 7, [], 0), (None, rows[0][1], 0), (None, rng.normal(size=16).tolist(), 0), (3, rows[3][1], 0)]
    return rows + odd


@pytest.mark.parametrize("block", [8, 4096])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TASK_ROWS", 500)
    rows = vectors(2)
    frame = spark.createDataFrame([(i, v, y, "k", True) for i, v, y in rows], "vec_id long, embedding array<float>, label int, n string, kept boolean")
    got = embeddings.near_duplicates(frame).collect()
    want = brute_vectors(rows, 0.98)
    agree = len(set(want) & {repr(tuple(r)) for r in got}) / len(set(want))
    assert len(got) == len(rows) and agree > 0.995
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op5_embeddings(spark, sf).collect()) == brute_vectors(rows, 0.98)


def test_near_duplicates_that_no_shard_brings_together(spark, monkeypatch, tmp_path):
    """Exact without the trees, whatever the order of the shingles."""
    monkeypatch.setattr(neardup, "candidate_clusters", lambda texts: texts.sparkSession.createDataFrame([], "node long, root long"))
    rng = random.Random(5)
    short = [" ".join(rng.choices("abc", k=rng.randint(5, 12))) for _ in range(150)]
    passage = " ".join(f"w{k}" for k in range(40))
    texts = [*near_texts(120, 2), *short, *(f"{passage} {t}" for t in near_texts(30, 3)), "a b c d e f g h i", "a b c d e f g h"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    root = jaccard_groups(texts, 5, 0.8)
    want = sorted({r: k for k, r in reversed(list(enumerate(root)))}.values())
    for cells in (1 << 20, 16, 2):
        monkeypatch.setattr(neardup, "CELLS", cells)
        kept = neardup.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d")))
        assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_near_duplicates_at_any_similarity(spark, monkeypatch, tmp_path, similarity):
    """Sets of a few shingles, whose prefix is the whole set, found by prefixes alone."""
    monkeypatch.setattr(neardup, "candidate_clusters", lambda texts: texts.sparkSession.createDataFrame([], "node long, root long"))
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(150)], k=rng.randint(1, 5))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    root = jaccard_groups(texts, 1, similarity)
    want = sorted({r: k for k, r in reversed(list(enumerate(root)))}.values())
    kept = neardup.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d")), words=1, similarity=similarity)
    assert sorted(r.doc_id for r in kept.collect()) == want
