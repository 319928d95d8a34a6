"""SentencePiece, media, packing, line dedup: against the libraries, brute force and round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelake.llm import lines, media, packing, pieces, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a  b ", "a\nb\tc", "▁x▁▁", "é́ ﬁ", "\x00a", "😀 𓀀", "<s> </s> <0x0A>", "a" * 5000, "word " * 3000, "\n\n", "ab" * 2000]


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "x", 7, b"q") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score int, media binary")


def test_pieces_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.load(PIECES)
    rng = random.Random(3)
    parts = [" ", "  ", "▁", "\n", "a", "the", "th", "ing", "é", "日本", "😀", "𓀀", "\x00", "1", "==", "    ", "ß", "//", "</s>", "ng"]
    for text in [t or "" for t in ODD] + ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]:
        ids = pieces.encode_text(PIECES, text).tolist()
        assert ids == model.encode(text), text
        assert table.decode(ids) == model.decode(ids)
    for _ in range(1000):
        ids = [rng.randrange(3, 259 if rng.random() < 0.5 else 32000) for _ in range(rng.randint(1, 8))]
        assert table.decode(ids) == model.decode(ids)


def test_pieces_documents(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in pieces.encode_documents(documents(spark, ODD), PIECES).collect()}
    for k, text in enumerate(ODD):
        assert got[k].ids == model.encode(text or "") and got[k].decoded == model.decode(got[k].ids) and got[k].score == 7
    assert pieces.encode_documents(documents(spark, []), PIECES).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_sentencepiece(spark, sf).collect():
        ids = model.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_media_round_trip(data):
    payload = media.pad(data)
    stored = media.write_avi(payload)
    back, fps = media.read_avi(stored)
    assert back == payload and fps == media.FPS
    clips = media.shots(back, fps)
    assert clips[0]["start_s"] == 0 and sum(c["frames"] for c in clips) == len(payload) // 576
    assert all(a["end_s"] == b["start_s"] for a, b in zip(clips, clips[1:]))


def test_media_finds_a_cut_and_refuses_broken_files():
    dark, light = bytes(576 * 20), bytes([200]) * (576 * 15)
    assert [c["frames"] for c in media.shots(dark + light, 25.0)] == [20, 15]
    stored = media.write_avi(media.pad(b"x" * 2000))
    for broken in (b"", stored[:-20], b"RIFF\x04\0\0\0WAVE", stored.replace(b"00dc", b"01wb", 1)):
        with pytest.raises(ValueError):
            media.read_avi(broken)


def test_media_column(spark):
    texts = [None, "", "abc", "abc", "é" * 3000, "x" * 576]
    rows = media.media_column(documents(spark, texts)).collect()
    assert len(rows) == 6
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.payload) == media.pad(raw)
    assert media.clip_rows(media.media_column(documents(spark, texts))).count() >= 6
    assert media.media_column(documents(spark, [])).count() == 0


def plain_clips(payload):
    """Frames of each clip by plain loops: histogram jumps against the mean and deviation of the 24 before."""
    frames = [payload[k : k + 576] for k in range(0, len(payload), 576)]
    histograms = [[sum(1 for x in f if x >> 4 == b) for b in range(16)] for f in frames]
    jumps = [sum(abs(x - y) for x, y in zip(a, b)) / 1152 for a, b in zip(histograms, histograms[1:])]
    cuts = []
    for k, jump in enumerate(jumps):
        last = jumps[max(0, k - 24) : k] or [0.0]
        mean = sum(last) / len(last)
        spread = max(0.0, sum(x * x for x in last) / len(last) - mean * mean) ** 0.5
        if jump > max(0.35, mean + 3 * spread):
            cuts.append(k + 1)
    return [b - a for a, b in zip([0, *cuts], [*cuts, len(frames)])]


def plain_avi(stored):
    """The payload of an AVI of lossless JPEG frames, read bit by bit from the chunks that the index names."""
    at = stored.index(b"idx1")
    size = struct.unpack_from("<I", stored, at + 4)[0]
    movi = stored.index(b"movi")
    out = bytearray()
    for k in range(at + 8, at + 8 + size, 16):
        _, _, where, length = struct.unpack_from("<4sIII", stored, k)
        jpeg = stored[movi + where + 8 : movi + where + 8 + length]
        scan = jpeg.index(b"\xff\xda")
        body = jpeg[scan + 2 + struct.unpack_from(">H", jpeg, scan + 2)[0] : -2].replace(b"\xff\0", b"\xff")
        bits, place, rows = "".join(f"{x:08b}" for x in body), 0, []
        for y in range(24):
            row = []
            for x in range(24):
                ones = 0
                while ones < 8 and bits[place + ones] == "1":
                    ones += 1
                place += ones + 1 if ones < 9 else ones
                category = 8 - ones
                value = int(bits[place : place + category] or "0", 2)
                place += category
                diff = value if not category or value >> (category - 1) else value - (1 << category) + 1
                guess = row[-1] if row else rows[-1][0] if rows else 128
                row.append((guess + diff) % 256)
            rows.append(row)
        out += bytes(v for row in rows for v in row)
    return bytes(out)


def test_media_query(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_media(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        payload = texts[r.doc_id] + b"\xff" * (-len(texts[r.doc_id]) % 576 if texts[r.doc_id] else 576)
        stored = media.write_avi(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(payload) < 6000:
            assert plain_avi(stored) == payload
            clips = plain_clips(payload)
            ends = ",".join(str(sum(clips[: k + 1])) for k in range(len(clips)))
            assert r.feature == f"{len(clips)}:{hashlib.sha1(ends.encode()).hexdigest()}"


def test_word_ids_equal_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [t or "" for t in ODD] + ["á ̈x İ Σας <|endoftext|> x\x1cy \x85 \xa0 l'été it's 'S", "日本 語 1234 ½"]
    for text, ids in zip(texts, packing.encode_texts(WORDS, texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_capacity(rule):
    rng = np.random.default_rng(4)
    counts = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, 101, size=60)}
    caps = (100, 7, 4000)
    counts = {k: v for k, v in counts.items() if k * k <= caps[2]}
    bins: dict = {}
    seen = dict.fromkeys(counts, 0)
    for length, first, each, n, base, offset in packing.plan(counts, caps, rule=rule).tolist():
        assert first == seen[length]
        seen[length] += each * n
        for b in range(n):
            bins.setdefault(base + b, []).extend((offset + j * length, length) for j in range(each))
    assert seen == counts and sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        held.sort()
        assert [s for s, _ in held] == [sum(x for _, x in held[:k]) for k in range(len(held))]
        assert sum(x for _, x in held) <= 100 and len(held) <= 7 and sum(x * x for _, x in held) <= 4000
    with pytest.raises(ValueError):
        packing.plan({101: 1}, caps)


def test_packing(spark, sf):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*ODD, "same", "same", "w " * 20000]
    ids = [*range(len(texts) - 2), len(texts) - 3, len(texts) - 1]
    rows = packing.pack_documents(documents(spark, texts, ids), WORDS).collect()
    spare: dict = {}
    for r in rows:
        spare.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in spare.values():
        held.sort()
        assert [s for s, _ in held] == [sum(x for _, x in held[:k]) for k in range(len(held))] and sum(x for _, x in held) <= 4096
    for k, text in zip(ids, texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k})
        assert mine == [(p, s, len(want[s : s + 4096]), zlib.crc32(struct.pack(f"<{len(want[s : s + 4096])}I", *want[s : s + 4096]))) for p, s in enumerate(range(0, len(want), 4096))]
    assert sum(r.doc_id == ids[-2] for r in rows) == 2
    assert packing.pack_documents(documents(spark, []), WORDS).count() == 0
    rows = queries.op10_packing(spark, sf).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) * 1.02 + 1


def brute_lines(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    docs: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x) and i is not None:
                docs.setdefault(key(x), set()).add(i)
    shared = {k for k, v in docs.items() if len(v) >= least}
    return [(i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in shared)) for i, t in rows]


def test_lines(spark, sf):
    rows = [(k, f"Foo É \nown {k}\n\n\tfoo É") for k in range(5)] + [(5, None), (6, ""), (7, "\n"), (8, "foo é"), (None, "foo É\nx"), (None, "x"), (0, "Foo É \nown 0\n\n\tfoo É"), (9, "x\nx"), (10, "X")]
    clash = ["kept_text", "lost", "Row", "_row", "_kept", "flags", "mark", "pos", "again"]
    frame = spark.createDataFrame([(i, t, *clash) for i, t in rows], f"doc_id long, text string, {', '.join(c + ' string' for c in clash)}")
    kept = lines.drop_shared_lines(frame, min_docs=3)
    assert set(frame.columns) < set(kept.columns) and {tuple(r) for r in kept.select(*clash[1:]).collect()} == {tuple(clash[1:])}
    for least in (2, 3, 5, 6):
        got = lines.drop_shared_lines(frame, min_docs=least).select("doc_id", "n_lines", "kept_text").collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute_lines(rows, least)))
    assert lines.drop_shared_lines(frame.limit(0)).count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in brute_lines(docs, 10))
    assert sorted((r.doc_id, r.n_lines, r.kept_sha256) for r in queries.op8_lines(spark, sf).collect()) == want


@pytest.mark.parametrize("max_tokens", [4096, 32_768, 131_072])
def test_places_are_gapless_at_long_sequences(spark, max_tokens):
    rng = np.random.default_rng(max_tokens)
    lengths = np.concatenate([rng.integers(1, 400, 20_000), rng.integers(1, max_tokens + 1, 3_000), [max_tokens] * 20])
    rows = spark.createDataFrame([(int(n), i, "mine", 7, 1.5) for i, n in enumerate(lengths)], "length long, id long, salt string, own int, `a.at` double")
    got = packing.pack(rows.repartition(5), ["id"], max_tokens).toPandas()
    assert list(got.columns) == ["length", "id", "salt", "own", "a.at", "sequence_id", "offset"]
    assert len(got) == len(lengths) and set(got["salt"]) == {"mine"} and set(got["own"]) == {7} and sorted(got["length"]) == sorted(lengths)
    got = got.sort_values(["sequence_id", "offset"])
    for _, one in got.groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *np.cumsum(one["length"])[:-1]] and one["length"].sum() <= max_tokens
