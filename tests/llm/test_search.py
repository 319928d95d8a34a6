"""Ranked lexical search, phrases and disclosing terms: against plain loops over all rows."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cuelake.llm import disclosure, lexical, phrases, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "a", 2) for i, t in zip(ids, texts)], "doc_id long, text string, score int, key string, rank int")


def same_as_sql(spark, sf, name, tables):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(found.fetchall())
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and want


def ranked(docs, items, top):
    """docs of (id, text), items of (id, text): the contract's words, in plain loops."""
    held = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    texts, total = len(held), sum(len(w) for _, w in held)
    counts = [(i, len(w), Counter(w)) for i, w in held]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in {(i, t): 0 for i, t in items}:
        asked = TERM.findall((text or "").translate(LOW))
        rows = []
        for i, n, c in counts:
            m = 100 - 75 + (75 * n * texts) // total
            s = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def test_lexical_equals_sql(spark, sf):
    same_as_sql(spark, sf, "op11_lexical", ["documents", "benchmark"])


@pytest.mark.parametrize("postings", [100_000, 40])
def test_lexical_plain_loop(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    rng = random.Random(5)
    words = ["a", "B", "é", "Straße", "x1", "日本", "zz", "q", "w9", "K"]
    texts = [None, "", " .,-\n", "a" * 5000, "a b " * 3000, "İ ſ"] + [rng.choice([" ", "-", "\x00"]).join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)]
    texts += ["a é zz"] * 40
    ids = [*range(len(texts) - 60), *[7] * 30, *[None] * 30]
    items = [(0, "a zz ZZ"), (1, None), (2, ""), (3, "none here"), (4, "é é 日本 Straße"), (4, "b"), (None, "x1"), (0, "a zz ZZ")] + [(k, " ".join(rng.choices(words, k=4))) for k in range(10, 40)]
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    got = lexical.rank_documents(documents(spark, texts, ids).repartition(7), asked, top=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(list(zip(ids, texts)), items, 5)


def test_lexical_empty(spark):
    docs, items = documents(spark, ["a"]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank_documents(documents(spark, [None, "-"]), items).count() == 0
    clash = items.withColumnsRenamed({"item_id": "doc_id"})
    assert lexical.rank_documents(docs, clash, item_col="doc_id").columns == ["doc_id", "rank", "doc_id_", "score"]


def test_lexical_slices(monkeypatch):
    text = "Ab c" * 3000
    monkeypatch.setattr(lexical, "word_slices", lambda raw: __import__("cuelake.llm.common").llm.common.word_slices(raw, 100))
    assert [w for part in lexical.term_slices(text) for w in part] == text.lower().encode().split()


def grams(seq, depth):
    runs = "".join(chr(x) if x else "\0" for x in seq).split("\0")
    return Counter(r[i : i + depth] for r in runs for i in range(len(r) - depth + 1))


@pytest.mark.parametrize("alphabet", [1, 2, 5, 40])
def test_phrase_index_equals_counting(alphabet):
    rng = np.random.default_rng(alphabet)
    for _ in range(60):
        seq = rng.integers(0, alphabet + 1, rng.integers(0, 120))
        index = phrases.PhraseIndex(seq, 4)
        symbol, at = index.words()
        told = [[chr(s)] for s in symbol]
        told = ["".join(t) for t in told]
        for depth, left in ((2, True), (3, False), (4, bool(rng.integers(2)))):
            parent, symbol, at = index.extend(at, left)
            told = [chr(s) + told[p] if left else told[p] + chr(s) for p, s in zip(parent, symbol)]
            assert dict(zip(told, at.size.tolist())) == grams(seq, depth) and len(set(told)) == len(told)


def collocated(rows, max_words, least, share, top):
    """rows of (text, lang): the contract's words, in plain loops."""
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, max_words + 1):
                for i in range(len(words) - d + 1):
                    key = lang, tuple(words[i : i + d])
                    f[key] = f.get(key, 0) + 1
    kept = {k for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for lang in n:
        rows = []
        for g, p in kept:
            if g != lang:
                continue
            a = f[g, p]
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f[h, q] >= share * a for h, q in kept if h == lang):
                continue
            score, _, left, right = min((10**6 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_phrases_equal_sql(spark, sf):
    same_as_sql(spark, "/root/testdata/sf0.01", "op12_phrases", ["documents"])


@pytest.mark.parametrize("max_words, shard, bits", [(3, 1 << 20, 1 << 27), (4, 40, 1 << 10), (2, 40, 1 << 27)])
def test_phrases_plain_loop(spark, monkeypatch, max_words, shard, bits):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rng = random.Random(max_words)
    words = ["a", "B", "é", "ab", "\xa0", "\x00", "\x1c", "日本", "c" * 300]
    texts = [None, "", " .;\n", "a b\tc " * 400, "one. two, three", "\x0b\x0c"] + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", ","]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = [(t, rng.choice(["x", "y", None, ""]), 1) for t in texts] + [("a é B", "x", 1)] * 20
    docs = spark.createDataFrame(rows, "text string, lang string, rank int").repartition(5)
    got = phrases.collocations(docs, max_words=max_words, least=4, share=60, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = collocated([r[:2] for r in rows], max_words, 4, 60, 40)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 60


def test_phrases_empty(spark):
    docs = spark.createDataFrame([(None, None), ("", "x")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def by_patterns(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


HARD = [None, "", "@", "a@b", "a@b.c", "a@b.c.", "a@@b.c", "x@y.z@w.v", "a@b..c@d.e", "é.a%+@b-.c-d é", "1.2.3.4.5.6.7.8.9", "1.2.3 1.2.3.256 001.02.3.0004",
        "255.0.255.1.", "4111 1111 1111 1111", "4111-1111-1111-1111-0", "4111  1111", "+1 (555) 123-4567)", "+1234567", "+12345678", "++49 30 123456", "+1...", "+1 2+3 45678901",
        "4041894974608795 +1 (366) 555-9807 bosbt.42@mail8.example.com 42.144.35.254", "日本a@b.cé +4930123456日", "0000000000000000"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["a", "é", "@", ".", "b.c", "1", "23", "255", "256", " ", "-", "+", "(", ")", "+1", "4111", "0000", "%", "日", "\n"]
    for text in HARD + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(20_000)]:
        assert disclosure.base_spans(text) == by_patterns(text), text


def test_base_spans_of_very_long_texts():
    for part in ("a", "1", "1.", "@", "+1 ", "a@", "1 ", "+", "a.b@c.", "(1"):
        text = part * 200_000
        disclosure.base_spans(text)
    assert len(disclosure.base_spans("a@b.c " * 50_000)) == 50_000


def told(rows, near, contexts, share):
    """(words that give an entity away, and whether their class may stand), in plain loops over all texts."""
    held, classes, seen, wide = Counter(), Counter(), {}, {}
    for text in rows:
        text = text or ""
        base = by_patterns(text)
        words = [(m.start(), m.end(), m[0].translate(LOW)) for m in TERM.finditer(text)]
        held.update({w for _, _, w in words})
        classes.update({w.encode()[:4] for _, _, w in words})
        free = [x for x in words if not any(a < x[1] and x[0] < b for _, a, b in base)]
        found = {}
        for kind, a, b in base:
            entity = kind, text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            around = [w for s, _, w in free if s < a][-near:] + [w for s, _, w in free if s >= a][:near]
            for w in around:
                found.setdefault((entity, w), tuple(around))
                found.setdefault((entity, w.encode()[:4]), tuple(around))
        for key, context in found.items():
            (seen if isinstance(key[1], str) else wide).setdefault(key, []).append(context)
    sure = lambda got, df: len(set(got)) >= contexts and len(got) >= share * df
    tells = [(e, w) for (e, w), got in seen.items() if sure(got, held[w])]
    loose = {(e, c) for (e, c), got in wide.items() if sure(got, classes[c])}
    return {w: all((e, w.encode()[:4]) not in loose for e, v in tells if v == w) for _, w in tells}


@pytest.mark.parametrize("keys", [250_000, 0])
def test_disclosing_terms_plain_loop(spark, monkeypatch, keys):
    monkeypatch.setattr(disclosure, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(disclosure, "HELD_TERMS", 50)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["été", "The"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    texts = HARD + [some(12) for _ in range(60)]
    texts += [f"{some(3)} Harbour master {some(2)} Ann@Sea.org {some(6)}" for _ in range(9)] + [f"{some(9)} harbour {some(3)}"]
    texts += [f"{some(2)} captain call +1 (555) 010-2030 now {some(4)}" for _ in range(8)] + ["captains and captaincies"] * 5
    texts += ["copy tells nothing x@y.zz alone"] * 30
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, t1 int").repartition(6)
    got = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    terms = told(texts, disclosure.NEAR, disclosure.CONTEXTS, disclosure.SHARE)
    assert {"harbour", "master", "captain"} <= set(terms) and "nothing" not in terms and not terms["master"] and terms["captain"]
    for k, text in enumerate(texts):
        base = by_patterns(text)
        more = [("term", *m.span()) for m in TERM.finditer(text or "") if m[0].translate(LOW) in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert [(s.kind, s.start, s.end) for s in got[k].spans] == base + more, text
        assert got[k].t1 == 1 and (text is None) == (got[k].sanitised is None)
    assert "@" not in got[len(texts) - 1].sanitised.replace("@@", "")
    sample = next(r for r in got.values() if "Harbour master" in (r.text or ""))
    assert "Harbour" not in sample.sanitised and "[EMAIL]" in sample.sanitised and "Sea" not in sample.sanitised


def test_disclosure_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    terms = told(texts.values(), disclosure.NEAR, disclosure.CONTEXTS, disclosure.SHARE)
    rows = queries.op13_disclosure(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        base = by_patterns(text)
        more = [("term", *m.span()) for m in TERM.finditer(text) if m[0].translate(LOW) in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.spans == joined(base + more) and r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]


def test_disclosure_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.spans for r in disclosure.personal_data(docs).collect()] == [[], []]
    assert disclosure.sanitise(docs.limit(0)).count() == 0 and disclosure.disclosing_terms(docs).count() == 0
