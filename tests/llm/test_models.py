"""Language ID, quality, URL rules, WARC and the pipeline: accuracy on held-out rows, round trips, edge cases."""

import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import langid, quality, queries, urlrules, warc

BIG = "/root/testdata/sf0.01"


def test_codewords_differ_and_no_column_is_constant():
    for n in (2, 3, 4, 7, 8, 30):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert all(0 < c.sum() < n for c in code.T)
    assert langid.codewords(1).shape == (1, 0) and langid.codewords(0).shape == (0, 0)


def test_language_query(spark):
    rows = queries.op3_langid(spark, BIG).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_edges(spark):
    texts = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "en"), (5, "12 ½ !", "fr"), (6, "der Hund", None), (None, "le chat", "fr"), (1, "the cat and the dog", "en"), (7, "the " * 50_000, "en")]
    docs = spark.createDataFrame([(i, t, g, 5) for i, t, g in texts], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs)
    got = langid.identify_documents(docs, model).collect()
    assert model.languages == ["en", "fr"] and len(got) == 9
    by = {r.text: r for r in got}
    assert by["the cat and the dog"].lang_pred == "en" and by["le chat"].lang_pred == "fr"
    assert all(by[t].lang_pred == "und" and by[t].score == 0 for t in (None, "", "12 ½ !"))
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify_documents(docs, none).collect()} == {"und"}
    single = langid.fit(docs.where("lang = 'en'"))
    assert by and {r.lang_pred for r in langid.identify_documents(docs, single).collect()} == {"en", "und"}
    assert langid.identify_documents(docs.limit(0), model).count() == 0


def plain_language(model, text):
    """(language, score) by plain loops: n-grams of bytes, weights of each bit, logistic loss of each codeword."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    words, word = [], bytearray()
    for x in text.lower().encode() + b" ":
        if x >= 0x80 or chr(x).isalpha():
            word.append(x)
        elif word:
            words.append(bytes(word))
            word = bytearray()
    raw = b" " + b" ".join(words) + b" "
    seen = {}
    for k in range(len(raw)):
        if k + 1 < len(raw):
            b = ((raw[k] * 256 + raw[k + 1]) * 2654435761 % 2**32) >> 16
            seen[b] = seen.get(b, 0) + 1
        if k + 2 < len(raw):
            b = (((raw[k] * 256 + raw[k + 1]) * 256 + raw[k + 2]) * 2246822519 + 97) % 2**32 >> 16
            seen[b] = seen.get(b, 0) + 1
    total, losses = sum(seen.values()), []
    margins = [sum(n * float(model.weights[b][j]) for b, n in seen.items()) / total * min(total, 60) for j in range(model.code.shape[1])]
    for word in model.code.tolist():
        losses.append(sum(math.log1p(math.exp(-(2 * bit - 1) * m)) for bit, m in zip(word, margins)))
    best = min(range(len(losses)), key=losses.__getitem__)
    return model.languages[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_language_query_by_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").select("doc_id", "text", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op3_langid(spark, sf).collect():
        language, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == language and r.score == pytest.approx(score, abs=1e-9)


def plain_statistics(text):
    raw = (text or "").encode()
    n, words = max(1, len(raw)), [w for w in raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w]
    w = max(1, len(words))
    letter = lambda x: 65 <= x <= 90 or 97 <= x <= 122
    share = lambda test: sum(1 for x in raw if test(x)) / n
    lines = raw.split(b"\n")
    bare = [x for x in words if not any(letter(c) or c > 127 for c in (x[0], x[-1]))]
    return [
        math.log(1 + len(raw)), math.log(1 + len(words)), sum(1 for x in raw if x not in b" \n") / w,
        share(letter), share(lambda x: x in b"0123456789"), share(lambda x: 65 <= x <= 90), share(lambda x: x in b"!?"), share(lambda x: x == 124),
        share(lambda x: x in b"#$%&*@<>={}[]\\^~_+/"), share(lambda x: x > 127), share(lambda x: x == 10),
        len(set(words)) / w, max((words.count(x) for x in set(words)), default=0) / w, len(set(lines)) / len(lines), len(bare) / w, math.log(1 + max(map(len, words), default=0)),
        sum(1 for x in words if 65 <= x[0] <= 90) / w, len({(a, b) for a, b in zip(words, words[1:])}) / w,
    ]


def test_quality_query_by_plain_loops(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(docs.select("doc_id", "text"), labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [r for r in queries.op9_quality(spark, sf).collect() if len(texts[r.doc_id] or "") < 20_000]
    assert len(short) > 150
    for r in short:
        assert r.score == pytest.approx(walk(forest, plain_statistics(texts[r.doc_id])), abs=1e-9)


def test_quality_query(spark):
    rows = {r.doc_id: r for r in queries.op9_quality(spark, BIG).collect()}
    labels = spark.read.parquet(f"{BIG}/labels.parquet").where("quality is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    held = [x for x in labels if rows[x.doc_id].held_out]
    assert np.mean([rows[x.doc_id].predicted == x.quality for x in held]) > 0.95


def walk(forest, x):
    total = forest.base
    for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
        k = 0
        while k < len(feature):
            k = 2 * k + 1 + int(x[feature[k]] > limit[k])
        total += leaf[k - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_forest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.fit_forest(x, y)
    score = forest.score(x)
    assert ((score > 0.5) == (y > 0)).mean() > 0.97
    assert np.allclose(score[:40], [walk(forest, r) for r in x[:40]])
    for rows, labels in ((x[:0], y[:0]), (x[:30], np.ones(30)), (x[:3], y[:3])):
        assert np.isfinite(quality.fit_forest(rows, labels).score(x)).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "word " * 60_000, "s"), (None, "x", "s"), (1, None, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    got = quality.score_documents(docs, forest)
    assert got.count() == 5 and dict(got.dtypes)["score"] == "double" and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_documents(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, h, p in urlrules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/1", "http://example.net/en", "http://x.example.com/de/2?q=1#f", "http://example.com.org/fr/", "https://user@b.org/fr/x://y", "http://net/", "http://net", "http://net?x", "a://b\nc/d", "http://É.Org/fr/", "http://x.org/de/1", "http://x.org/" + "p/" * 500, "http://x.org/de/1"]


def test_url_rules(spark, sf):
    clash = ["listed", "tokens", "items", "token", "key", "page0", "Page1"]
    pages = spark.createDataFrame([(k if k else None, u, "v", *clash) for k, u in enumerate(URLS)], f"page_id long, url string, verdict string, {', '.join(c + ' string' for c in clash)}")
    got = urlrules.filter_urls(pages).collect()
    assert len(got) == len(URLS) and {tuple(r[c] for c in clash) for r in got} == {tuple(clash)}
    for r in got:
        host, path, best = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert urlrules.filter_urls(pages.limit(0)).count() == 0
    rows = {r.page_id: r for r in queries.op4_urlrules(spark, BIG).collect()}
    judged = urlrules.judge(spark.read.parquet(f"{BIG}/pages.parquet"))
    labelled = judged.where("listed is not null").select("tokens", "listed")
    known = urlrules.items(labelled)
    mined, item = urlrules.mine(labelled, known).collect(), {r.token: r.item for r in known.collect()}
    assert mined
    for r in judged.collect():
        held = {item.get(t) for t in r.tokens}
        best = max((m for m in mined if set(m.need) <= held), key=lambda m: (m.confidence, m.support, len(m.need), m.verdict), default=None)
        assert rows[r.page_id].verdict == (r.listed or (best.verdict if best else "allow"))


def mined_rules(spark, rows, support=0.05):
    labelled = spark.createDataFrame(rows, "tokens array<string>, listed string")
    known = urlrules.items(labelled, support)
    return urlrules.mine(labelled, known, support=support, confidence=0.9).collect(), {r.token: r.item for r in known.collect()}


def test_mined_rules_hold_their_bounds(spark):
    rows = [(["h:spam", f"p:{k % 7}"], "block") for k in range(40)] + [(["h:good", f"p:{k % 7}"], "allow") for k in range(40)] + [(["h:both"], "allow" if k % 2 else "block") for k in range(20)]
    mined, _ = mined_rules(spark, rows)
    need = {tuple(sorted(m.need)): m.verdict for m in mined}
    assert need[("h:spam",)] == "block" and need[("h:good",)] == "allow" and ("h:both",) not in need
    assert all(m.confidence >= 0.9 and m.support >= 0.05 and m.key in m.need for m in mined)


def test_mined_rules_where_one_label_is_nearly_all(spark):
    """A sure rule counts whatever the share of its label; one that tells no more than the share does not."""
    rows = [(["s:http", "h:ad"], "block")] * 97 + [(["s:http", "h:fine"], "allow")] * 3
    mined, _ = mined_rules(spark, rows, 0.01)
    assert {tuple(sorted(m.need)) for m in mined if m.verdict == "block"} == {("h:ad",), ("h:ad", "s:http")}
    assert {tuple(sorted(m.need)) for m in mined if m.verdict == "allow"} == {("h:fine",), ("h:fine", "s:http")}


def test_urls_are_mined_whole(spark):
    """URLs of over 40 tokens: the telling tokens stand last, and tokens that always come together are one item."""
    rng = random.Random(4)
    rows = []
    for k in range(80):
        bad = k % 2
        paths = [f"p:{'ad' if bad else 'ok'}-{j:02}" for j in range(38)] if k < 60 else [f"p:{k}-{j:02}" for j in range(38)]
        rows.append((sorted([*paths, "q:track" if bad else "q:page", "s:http", rng.choice(["h:a", "h:b"])]), "block" if bad else "allow"))
    mined, item = mined_rules(spark, rows)
    assert item["p:ad-00"] == item["p:ad-37"] == "p:ad-00"
    frequent = sorted({i for i in item.values()})
    held = [({item[t] for t in tokens if t in item}, listed) for tokens, listed in rows]
    want = {}
    for size in range(1, len(frequent) + 1):
        for need in itertools.combinations(frequent, size):
            labels = [listed for h, listed in held if set(need) <= h]
            for verdict in ("block", "allow"):
                n = labels.count(verdict)
                if n >= 0.05 * len(rows) and n / len(labels) >= 0.9:
                    want[need, verdict] = (n / len(labels), n / len(rows))
    got = {(tuple(sorted(m.need)), m.verdict): (m.confidence, m.support) for m in mined}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert (("q:track",), "block") in got
    # each token of an item stands for it, and tokens of two labels let the rule of more support decide
    sets = spark.createDataFrame([(["p:ad-37"],), (["p:ok-11", "p:x"],), (["p:x"],), (["q:page", "p:ad-01"],)], "tokens array<string>")
    labelled = spark.createDataFrame(rows, "tokens array<string>, listed string")
    known = urlrules.items(labelled, 0.05)
    verdicts = {tuple(r.tokens): r.verdict for r in urlrules.match(sets, urlrules.mine(labelled, known, support=0.05), known).collect()}
    assert verdicts == {("p:ad-37",): "block", ("p:ok-11", "p:x"): "allow", ("q:page", "p:ad-01"): "allow"}


def test_many_tokens_of_one_site(spark):
    """40 tokens that nearly always come together would be 2**40 sets; they are 40 rules."""
    rng = random.Random(7)
    names = [f"q:{j:02}" for j in range(40)]
    site = [(sorted([*(t for t in names if rng.random() < 0.97), "h:long", "s:http"]), "block") for _ in range(300)]
    rest = [(sorted({"s:http", rng.choice(["h:a", "h:b"]), rng.choice(["p:x", "p:y"])}), "allow" if rng.random() < 0.7 else "block") for _ in range(200)]
    labelled = spark.createDataFrame(site + rest, "tokens array<string>, listed string")
    known = urlrules.items(labelled, 0.02)
    began = time.time()
    rules = urlrules.telling(labelled, known, support=0.02).collect()
    assert time.time() - began < 60
    assert {r.need[0] for r in rules if r.confidence == 1.0} >= {*names, "h:long"} and len(rules) < 60


def test_rules_left_out_never_win(spark):
    """Verdicts by all mined rules and by the telling ones are the same, on tables of one-label and mixed tokens."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for _ in range(150):
            bad = rng.random() < 0.5
            tokens = {t for t, p in (("a", 0.5), ("b", 0.3), ("c", 0.9 if bad else 0.05), ("d", 0.02 if bad else 0.8)) if rng.random() < p}
            tokens |= {t for t in ("e", "f", "g") if bad and rng.random() < 0.4} | {t for t in ("h", "i") if not bad and rng.random() < 0.4}
            rows.append((sorted(tokens), "block" if bad else "allow"))
        labelled = spark.createDataFrame(rows, "tokens array<string>, listed string")
        known = urlrules.items(labelled, 0.04)
        assert known.where("only is null").count() and known.where("only is not null").count()
        sets = spark.createDataFrame([(list(c),) for n in range(10) for c in itertools.combinations("abcdefghi", n)], "tokens array<string>")
        every, few = urlrules.mine(labelled, known, support=0.04), urlrules.telling(labelled, known, support=0.04)
        assert few.count() < every.count()
        told = [{tuple(r.tokens): r.verdict for r in urlrules.match(sets, rules, known).collect()} for rules in (every, few)]
        assert told[0] == told[1] and len(set(told[0].values())) == 2


def test_warc(spark, sf):
    big = "x" * 3_000_000
    rows = [(1, "http://a/ b\r\n", "same"), (2, None, "same"), (5, "u", None), (4, "u", ""), (7, "é", big), (None, "n", "same"), (None, "n", "only"), (9, "d", "dup"), (9, "d", "dup"), (3, "c", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, refers_to int")
    for least in (0, 1, 4, 5):
        archives = warc.write_archives(pages, min_bytes=least)
        got = warc.read_archives(archives, payloads=True).collect()
        last = {}
        for i, _, h in rows:
            raw = (h or "").encode()
            if i is not None and len(raw) >= least:
                last[raw] = max(last.get(raw, i), i)
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            to = last.get(raw)
            visit = to is not None and to != i
            want.append((i, len(raw), warc.sha1_base32(raw), "revisit" if visit else "response", to if visit else None))
        assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
        assert all(r.block_ok and r.payload_ok for r in got)
        assert all((bytes(r.payload) if r.record_type == "response" else None) in [(h or "").encode() for _, _, h in rows] + [None] for r in got)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_warc(spark, sf).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {k: (len(v), warc.sha1_base32(v)) for k, v in html.items()}


def test_warc_reader_verifies():
    record = warc.build_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    raw = next(warc.members(record + warc.build_record(2, "u", b"", None, "d")))
    assert warc.read_record(raw)["payload"] == b"payload"
    assert not warc.read_record(raw.replace(b"payload", b"paXload"))["payload_ok"]
    for broken in (raw[:-1], raw.replace(b"Content-Length: ", b"Content-Width: "), b"x"):
        with pytest.raises(ValueError):
            warc.read_record(broken)
    with pytest.raises(ValueError):
        list(warc.members(record[:-5]))
    with pytest.raises(zlib.error):
        list(warc.members(b"not gzip at all"))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    kept, counts = docs, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, BIG)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        counts.append(kept.select("doc_id").distinct().count())
        if name == "quality":
            gone = {r.doc_id for r in before.join(kept, "doc_id", "left_anti").collect()}
            assert sum(labels.get(i) == 1 for i in gone) <= 2 and sum(q == 0 and i not in gone for i, q in labels.items()) <= 2
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in before.collect()}
            sets = {i: shingles(t) for i, t in texts.items()}
            assert {r.doc_id for r in kept.collect()} == smallest(sets)
    assert counts[1] < counts[0] and counts[4] < counts[3] and counts[5] == counts[4]
    assert kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    clash = ["score", "_score", "told", "lang_pred", "_lang", "ambiguous", "kept_text", "n_lines", "n_dropped", "rest", "flags", "k1", "nth", "row"]
    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(300).select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name))
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), BIG)
        assert out.dtypes == docs.dtypes, name
        assert {tuple(r) for r in out.select(*clash).distinct().collect()} == {tuple(f"own {c}" for c in clash)}
        docs = out
    assert docs.where("n_chars <> char_length(text)").count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {hashlib.md5(b" ".join(words[k : k + 5])).digest() for k in range(max(1, len(words) - 4))} if words else set()


def smallest(sets):
    """The smallest id of each group of Jaccard 0.8 or more, by an inverted index over all shingles."""
    seen, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for h in s or {b""}:
            seen.setdefault(h, []).append(i)
    done = set()
    for ids in seen.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if not sets[a] and not sets[b] or both >= 0.8 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}
