"""The library's operators on small fixtures, against plain loops and known outcomes."""

import collections
import glob
import hashlib
import json
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.functions import times
from cuelake.operators import batch, display, frames, language, pair, report, resume, split, tracks
from cuelake.plans import catalog, jobs
from cuelake.sources import files, sinks, subtitles
from cuelake.streaming import ingest

CUE = "title_id string, pos long, start double, end double, text string"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "name,value,want",
    [
        ("clean_subtitle_text", "{\\an8}<i>Hi</i>  <br>there<img src=x>　you", "Hi there you"),
        ("clean_subtitle_text", " - ", ""),
        ("clean_subtitle_text", None, ""),
        ("clean_rich_text", "a &amp;lt; <b>b</b>{\\x}\n \n c﻿", "a &lt; b\nc"),
        ("strip_ass_tags", "{x}a\\Nb\\hc", "a b c"),
        ("escape_ass", "a {b}\n c", "a (b) c"),
        ("clean_english_track", "hello 你", ""),
        ("normalize_language", " English (US) ", "en"),
        ("normalize_language", "existing Chinese sidecar subtitle", "zh"),
        ("normalize_language", "pt-BR", "pt"),
        ("normalize_language", "cached source", "cached source"),
        ("classify_text", "你好你好你", "zh"),
        ("classify_text", "one two three four five", "en"),
        ("classify_text", "a b c", ""),
        ("strip_model_noise", "<think>x\ny</think>```json\n[1]\n```", "[1]"),
        ("clean_name", "/m/The.Film.2001.1080p.x264-GRP.mkv", "The Film 2001"),
        ("name_before_year", "/m/The.Film.2001.1080p.mkv", "The Film"),
        ("safe_file_part", "a b/c?", "a_b_c"),
        ("safe_file_part", "??", "subtitle"),
    ],
)
def test_text(spark, name, value, want):
    assert one(spark, value, getattr(X, name)) == want


def test_more_text(spark):
    assert one(spark, "movie.zh-cn.srt", lambda c: X.classify_file_name(F.concat(F.lit("/a/"), c))) == "zh"
    assert one(spark, "(MUSIC PLAYING)", X.is_sound_cue) and not one(spark, "hello", X.is_sound_cue)
    assert one(spark, ["Hello", " ", "world", "!"], X.join_words, "array<string>") == "Hello world!"
    assert one(spark, "開車國", lambda c: X.simplify(c, {"開車": "开车", "國": "国"})) == "开车国"
    assert one(spark, "x", lambda c: X.resolve_asr_language(F.lit("source"), F.lit("auto"))) == "auto"
    assert one(spark, "a", lambda c: X.language_valid(c, F.lit("好"), F.lit("好"))) is False
    assert one(spark, "a", lambda c: X.language_valid(c, c, F.lit("abc"))) is False
    assert one(spark, "a", lambda c: X.preview_english(c, F.lit(""), F.lit("ja"))) == ""
    assert one(spark, "かな", lambda c: X.preview_english(c, F.lit(None).cast("string"), F.lit("ja"))) == "かな"
    assert one(spark, "かな", lambda c: X.preview_english(c, F.lit(None).cast("string"), F.lit("zh"))) == ""
    assert one(spark, "cht", X.ocr_language) == "chinese_cht"
    assert batch.routing("remote:host:a:b") == ("host", "a:b") and batch.routing("a") is None


def test_times(spark):
    assert one(spark, "01:02:03,004", times.srt_seconds) == 3723.004
    assert one(spark, "1:2:3,4", times.srt_seconds) is None
    assert one(spark, "1:2:3.4", lambda c: times.srt_seconds(c, lenient=True)) == 3723.4
    assert one(spark, "0:00:01.50", times.ass_seconds) == 1.5
    assert one(spark, "01:02.5", times.vtt_seconds) == 62.5
    assert one(spark, 0.125, times.ass_time, "double") == "0:00:00.12"
    assert one(spark, 360000.0, times.srt_time, "double") == "100:00:00,000"
    assert one(spark, -1.0, times.srt_time, "double") == "00:00:00,000"


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\n there\r\n\r\n00:00:03,000 --> 00:00:02,000\r\nbad\r\n\r\n3\r\n00:00:04,000 --> 00:00:05,000\r\n-\r\n\r\nnoise\r\n\r\n5\r\n00:00:06,000 --> 00:00:07,000\r\n<br>last"
ASS = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,{\\b}a, b\\Nc\nDialogue: 0,bad,0:00:02.00,D,,0,0,0,,x\nDialogue: 0,0:00:05.00,0:00:04.00,D,,0,0,0,,y\nDialogue: 0,1\n"
VTT = "WEBVTT\n\nNOTE x\n\nid\n00:01.5 --> 00:02.000 align:start\nHi\nthere\n\n1:00:00.000 --> 1:00:01.000\nlate\n"


def files_of(spark, **named):
    return spark.createDataFrame([("t", k, k.rpartition("_")[2], v) for k, v in named.items()], "title_id string, path string, extension string, content string")


def test_parsers(spark):
    rows = files_of(spark, a_srt=SRT, b_ass=ASS, c_vtt=VTT, d_vtt="WEBVTT\n\n00:01:99:1:2.0 --> 00:02.000\nx", e_txt="x")
    cues, rejected = subtitles.parse(rows)
    got = sorted((r.path, r.pos, r.start, r.end, r.text) for r in cues.collect())
    assert got == [("a_srt", 0, 1.0, 2.5, "Hello there"), ("a_srt", 1, 6.0, 7.0, "last"), ("b_ass", 0, 1.0, 2.0, "a, b c"), ("c_vtt", 0, 1.5, 2.0, "Hi there"), ("c_vtt", 1, 3600.0, 3601.0, "late")]
    assert sorted(r.path for r in rejected.collect()) == ["d_vtt", "e_txt"]
    lenient = subtitles.parse_srt(files_of(spark, a_srt="1\n0:0:1,5 --> 0:0:1,2\na\nb\n"), lenient=True).collect()
    assert [(r.start, r.end, r.text) for r in lenient] == [(1.005, 1.002, "a\nb")]
    assert subtitles.parse(files_of(spark, a_srt=""))[0].count() == 0


def test_bytes_and_stream(spark, tmp_path):
    folder = tmp_path / "in" / "t"
    folder.mkdir(parents=True)
    (folder / "a.srt").write_bytes(SRT.replace("Hello", "你好").encode("gb18030"))
    (folder / "b.SRT").write_bytes(SRT.encode())
    (folder / "c.srt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\ncaf\xe9 \xff")
    (folder / "d.xyz").write_bytes(b"x")
    cues, rejected = subtitles.parse(subtitles.scan(spark, str(tmp_path / "in")))
    texts = sorted((r.path.rpartition("/")[2], r.text) for r in cues.where("pos = 0").collect())
    assert texts == [("a.srt", "你好 there"), ("b.SRT", "Hello there"), ("c.srt", "café ÿ")]
    assert rejected.count() == 1
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "cues"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cues")).count() == cues.count()


def test_segments(spark):
    good = [{"start": 1, "end": 2, "text": "a", "source_language": "fre"}, {"start": 2, "end": 3, "text": "", "en": "b 你", "zh": "國"}, {"start": 3, "end": 4, "text": " "}]
    rows = files_of(spark, good=json.dumps(good), late=json.dumps([{"start": 2, "end": 2, "text": "a"}]), none="[]", obj="{}", broken="[", odd=json.dumps([1]), part=json.dumps([good[0], {"start": 1, "end": 2}]))
    got = sorted((r.path, r.pos, r.text, r.en, r.zh, r.source_language) for r in subtitles.parse_segments(rows, {"國": "国"}).collect())
    assert got == [("good", 0, "a", None, None, "fre"), ("good", 1, "b 你", "", "国", "fr")]


def test_detections_and_packets(spark):
    raw = {"a": {"rec_texts": ["x", " ", "y"], "rec_boxes": [[1, 2, 3, 4], [], []]}, "b": {"res": {"rec_texts": ["z"], "rec_polys": [[[5, 6], [7, 8]]]}}, "c": [[[[1, 50], [2, 60]], ["q", 0.9]], [[[0, 2]], ["p", 0.5]]]}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in raw.items()], "frame_id string, raw string")
    got = sorted((r.frame_id, r.seq, r.x, r.y, r.text) for r in subtitles.parse_detections(rows).collect())
    assert got == [("a", 0, 0.0, 0.0, "x"), ("a", 2, 0.0, 2.0, "y"), ("b", 0, 5.0, 6.0, "z"), ("c", 0, 1.0, 50.0, "q"), ("c", 1, 0.0, 2.0, "p")]
    assert {r.frame_id: r.text for r in frames.reading_order(subtitles.parse_detections(rows)).collect()}["c"] == "p q"
    packet = lambda pts, kind, body: b"PG" + pts.to_bytes(4, "big") + bytes(4) + bytes([kind]) + len(body).to_bytes(2, "big") + body
    comp = bytes([7, 128, 4, 56, 0, 0, 1, 0, 0, 3, 1, 0, 9, 0, 0, 1, 2, 0, 5])
    first, rest = bytes([0, 9, 1, 0x80, 0, 0, 9, 0, 4, 0, 2]) + b"AB", bytes([0, 9, 1, 0x40]) + b"CD"
    content = packet(90_000, 0x16, comp) + packet(90_000, 0x15, first) + packet(90_000, 0x15, rest)
    got = frames.packets(spark.createDataFrame([("f", content), ("cut", content[:-30])], "path string, content binary"))
    assert got.where("path = 'f'").count() == 3 and got.first().pts == 1.0
    row = frames.compositions(got.where("path = 'f'")).first()
    assert (row.width, row.height, row.palette_id, [tuple(o) for o in row.objects]) == (1920, 1080, 3, [(9, 258, 5)])
    assert bytes(frames.object_parts(got.where("path = 'f'")).first().data) == b"ABCD"
    with pytest.raises(Exception, match="no packet"):
        frames.packets(spark.createDataFrame([("f", b"XX")], "path string, content binary")).collect()


def loop_chunks(words, cap, max_chars):
    out, now = [], []
    for w in words:
        now.append(w)
        if re.search(r"[.!?]$", w) or len(now) >= cap or len(" ".join(now)) >= max_chars:
            out.append(" ".join(now))
            now = []
    return out + ([" ".join(now)] if now else [])


def test_split_by_text(spark):
    rng = random.Random(2)
    rows = [("t", k, float(k * 100), k * 100 + rng.choice([1.0, 7.0, 30.0]), " ".join("".join(rng.choices("abc", k=rng.randint(1, 9))) + rng.choice(["", "", "", ".", "?"]) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    got = [tuple(r) for r in split.split_cues(spark.createDataFrame(rows, CUE)).orderBy("pos").collect()]
    want = []
    for title, _, start, end, text in rows:
        words, long = text.split(), end - start
        if not words:
            continue
        text = " ".join(words)
        chunks = [text]
        if long > 6 or len(text) > 82 or len(words) > 14:
            least = max(1, math.ceil(long / 6), math.ceil(len(text) / 82))
            chunks = loop_chunks(words, max(3, min(14, math.ceil(len(words) / least))), 82)
        at, total = start, sum(max(1, len(c)) for c in chunks)
        for k, c in enumerate(chunks):
            stop = end if k == len(chunks) - 1 else at + long * max(1, len(c)) / total
            want.append((title, len(want), at, stop, c))
            at = stop
    assert got == want


def test_split_by_words_and_sanity(spark):
    rng = random.Random(3)
    words = [(float(k), k + 0.5, "w" * rng.randint(1, 30) + rng.choice(["", "", "!"])) for k in range(50)]
    rows = spark.createDataFrame([("t", 0, 0.0, 50.0, " ".join(w for _, _, w in words), words), ("t", 1, 60.0, 72.0, "one two", None)], CUE + ", words array<struct<start:double,end:double,word:string>>")
    want, now = [], []
    for s, e, w in words:
        now.append((s, e, w))
        if w.endswith("!") or len(now) >= 14 or len(" ".join(x for _, _, x in now)) >= 82 or e - now[0][0] >= 6:
            want.append((now[0][0], e, " ".join(x for _, _, x in now)))
            now = []
    if now:
        want.append((now[0][0], now[-1][1], " ".join(x for _, _, x in now)))
    got = split.sane_timing(split.split_cues(rows)).orderBy("pos").collect()
    assert [(r.start, r.end, r.text) for r in got[: len(want)]] == want
    assert [(r.start, r.end, r.text) for r in got[len(want) :]] == [(60.0, 66.0, "one"), (66.0, 72.0, "two")] or got[-1].text.endswith("two")


def loop_pairs(en, zh):
    used, first, out = set(), 0, []
    for i, (s, e, text) in enumerate(en):
        while first < len(zh) and zh[first][1] < s - 5:
            first += 1
        best = None
        if "MUSIC" not in text.upper():
            for k in range(first, min(len(zh), first + 12)):
                zs, ze = zh[k][:2]
                over, gap = max(0.0, min(e, ze) - max(s, zs)), abs((s + e) / 2 - (zs + ze) / 2)
                if k not in used and not (over <= 0 and gap > 3.5) and (best is None or over * 10 - gap > best[0]):
                    best = (over * 10 - gap, gap, k)
            if best and best[0] < -2.5 and best[1] > 2.5:
                best = None
        if best:
            used.add(best[2])
        out.append((i, best[2] if best else None))
    out += [(None, k) for k in range(len(zh)) if k not in used]
    return sorted(out, key=lambda p: min(side[k][0] for side, k in ((en, p[0]), (zh, p[1])) if k is not None))


def test_pairs(spark):
    rng = random.Random(5)
    en, zh, want = [], [], {}
    for t in range(12):
        def track(n, at=0.0):
            rows = []
            for _ in range(n):
                at += rng.choice([0.1, 1.0, 4.0, 12.0])
                rows.append((at, at + rng.choice([0.5, 2.0, 5.0]), rng.choice(["hello", "music", "word"])))
            return rows
        a, b = track(rng.randint(0, 40)), track(rng.randint(0, 40))
        if t == 0:
            a, b = [(0.0, 1.0, "x")], [(2.5, 3.5, "y")]
        if t == 1:
            a, b = [(0.0, 1.0, "x")], [(2.7, 3.5, "y")]
        en += [(str(t), k, *x) for k, x in enumerate(a)]
        zh += [(str(t), k, *x) for k, x in enumerate(b)]
        want[str(t)] = loop_pairs(a, b)
    rows = pair.greedy_pairs(spark.createDataFrame(en, CUE), spark.createDataFrame(zh, CUE)).orderBy("title_id", "pair_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r.title_id, []).append((r.en and r.en.pos, r.zh and r.zh.pos))
    assert got == {t: p for t, p in want.items() if p}
    assert got["0"] == [(0, 0)] and len(got["1"]) == 2
    best = pair.best_match(spark.createDataFrame(en, CUE), spark.createDataFrame(zh, CUE)).collect()
    single = {(r.title_id, r.en_pos) for r in best}
    assert {(t, e) for t, p in got.items() for e, z in p if e is not None and z is not None} <= single


def test_pairs_in_blocks(spark, tmp_path):
    """Titles whose cues overlap throughout, in blocks much shorter than they are, and one title of one cue."""
    rng, rounds = random.Random(9), []

    def keep(df, name):
        rounds.append(name)
        df.write.parquet(f"{tmp_path}/{len(rounds)}")
        return spark.read.parquet(f"{tmp_path}/{len(rounds)}")

    def track(n, step):
        return sorted((round(a, 2), round(a + rng.uniform(0.5, 6), 2), rng.choice(["hello", "music", "word"])) for a in (rng.uniform(0, n * step) for _ in range(n)))

    tracks = {"dense": (track(150, 0.7), track(120, 0.9)), "many en": (track(120, 0.05), track(20, 0.3)), "many zh": (track(20, 2.0), track(200, 0.2)), "one": ([(0.0, 1.0, "x")], [(0.5, 1.5, "y")]), "alone": ([(0.0, 1.0, "x")], [])}
    en, zh = (spark.createDataFrame([(t, k, *x) for t, sides in tracks.items() for k, x in enumerate(sides[n])], CUE) for n in (0, 1))
    for block in (1, 7, 1000):
        before = len(rounds)
        got = {}
        for r in pair.greedy_pairs(en, zh, keep, block).orderBy("title_id", "pair_no").collect():
            got.setdefault(r.title_id, []).append((r.en and r.en.pos, r.zh and r.zh.pos))
        assert got == {t: loop_pairs(*sides) for t, sides in tracks.items()}
        if block == 1000:
            assert rounds[before:] == ["pair-candidates", "pair-reach", "pair-chosen-0", "pair-held-1", "pair-changed-1"]
        elif block == 7:
            assert "pair-chosen-1" in rounds[before:]


def test_merge(spark):
    en = spark.createDataFrame([("a", 0, 1.0, 2.0, "Hi"), ("b", 0, 1.0, 2.0, "Alone")], CUE)
    zh = spark.createDataFrame([("a", 0, 1.1, 2.2, "國"), ("a", 1, 9.0, 9.5, "<i></i>")], CUE)
    rows = pair.merge_tracks(en, zh, "label", {"國": "国"}).collect()
    assert [(r.title_id, r.start, r.end, r.text, r.en, r.zh, r.display) for r in rows] == [("a", 1.0, 2.2, "Hi", "Hi", "国", True)]


SHOWN = CUE + ", display boolean, display_start double, display_end double"


def test_hidden_extension(spark):
    rng, rows, want = random.Random(7), [], {}
    rows += [("x", 0, 10.0, 11.0, "", True, None, None), ("x", 1, 11.0, 12.0, "", False, None, None), ("x", 2, 12.0, 13.0, "", False, None, None)]
    for t in range(30):
        cues = [(rng.uniform(0, 60), rng.choice([True, False, False, None])) for _ in range(20)]
        cues = sorted(cues) if t % 3 else cues
        rows += [(str(t), k, s, s + rng.uniform(0.1, 4), "", d, None, None) for k, (s, d) in enumerate(cues)]
    last = {}
    for title, pos, s, e, _, d, _, _ in rows:
        if d is False:
            if title in last:
                key = last[title]
                reach = want[key][1] if want[key][0] is None else want[key][0]
                if s - reach <= 2.0:
                    want[key] = (max(reach, e), want[key][1])
        else:
            last[title] = (title, pos)
        want[title, pos] = (None, e)
    got = {(r.title_id, r.pos): r.display_end for r in display.extend_over_hidden(spark.createDataFrame(rows, SHOWN)).collect()}
    assert got == {k: v[0] for k, v in want.items()} and got["x", 0] == 13.0


def test_display_directives(spark):
    cases = [
        ('{"display": "hide"}', False, None, None), ('{"display": 0}', False, None, None), ('{"display": null}', True, None, None), ('{"show": false}', False, None, None),
        ('{"display": true, "show": false}', True, None, None), ('{"keep": "no"}', False, None, None), ('{"display_start": 19, "display_end": 24}', True, 19.0, 24.0),
        ('{"start": "20.5"}', True, 20.5, None), ('{"display_end": 99}', True, None, 25.0), ('{"display_start": 21, "display_end": 20}', True, None, None), ('{"display_end": 21.01}', True, None, None),
        ("{}", True, None, None), ('{"display": []}', True, None, None),
    ]
    rows = spark.createDataFrame([(str(k), c[0]) for k, c in enumerate(cases)], "title_id string, j string").withColumn("item", F.expr("parse_json(j)"))
    rows = rows.select("*", F.lit(20.0).alias("start"), F.lit(21.0).alias("end"), F.lit(18.0).alias("context_start"), F.lit(25.0).alias("context_end"), *display.directive())
    got = {int(r.title_id): (r.display, r.display_start, r.display_end) for r in display.apply_timing(rows.drop("item")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]


def test_checkpoints(spark):
    cues = spark.createDataFrame([("t", k, float(k), k + 1.0, f"c{k}") for k in range(12)], CUE)
    done = cues.where("pos < 7").withColumn("display", F.lit(True)).withColumn("processing_mode", F.lit("translate"))
    assert resume.compatible(done, cues, "translate").first().fits
    for bad in (done.withColumn("display", F.lit(None).cast("boolean")), done.withColumn("processing_mode", F.lit("x")), done.withColumn("end", F.col("end") + 0.03), done.withColumn("text", F.lit("x")), done.withColumn("pos", F.col("pos") + 6)):
        assert not resume.compatible(bad, cues, "translate").first().fits
    assert resume.compatible(done.withColumn("end", F.col("end") + 0.02 - 1e-9), cues).first().fits
    assert resume.remaining(cues, done, 5, "translate").count() == 7
    assert resume.remaining(cues, done.withColumn("text", F.lit("x")), 5).count() == 12
    resume.assert_timing_kept(cues, cues)
    with pytest.raises(ValueError):
        resume.assert_timing_kept(cues, cues.where("pos <> 3"))


def store(df, name):
    return df.checkpoint()


def stub_model():
    """A model that keeps the text, tells its length, and hides lines that repeat the one before."""

    def model(prompts):
        out = []
        for prompt in prompts:
            lines, before, items = re.findall(r"^\[(\d+)\] \S+ ?(.*)$", prompt.split("TARGET\n", 1)[1].split("\n\nAFTER\n", 1)[0], re.M), None, []
            for index, text in lines:
                items.append({"index": int(index), "corrected_text": text, "chinese_translation": f"译{len(text)}", "corrected_chinese": f"译{len(text)}", "display": text != before})
                before = text
            out.append(json.dumps(items, ensure_ascii=False))
        return out

    return model


def fixed(reply):
    return lambda prompts: [reply] * len(prompts)


def test_translate_hides_duplicates(spark):
    cues = spark.createDataFrame([("t", 0, 210.0, 211.0, "We were"), ("t", 1, 211.0, 212.0, "We were there"), ("t", 2, 212.0, 213.0, "there")], CUE)
    reply = json.dumps([{"index": 0, "corrected_text": "We were there.", "chinese_translation": "我们在那里。", "display": True, "display_start": 210, "display_end": 213}, {"index": "1", "display": False, "chinese_translation": "好"}, {"index": 2, "display": "hide", "chinese_translation": "好"}, {"index": "x"}, 5])
    rows = jobs.process(cues, fixed("<think>hm</think>```json\n" + reply + "\n```"), store, pause=0.0).orderBy("pos").collect()
    assert [(r.en, r.zh, r.display, r.display_end) for r in rows] == [("We were there.", "我们在那里。", True, 213.0), ("We were there", "好", False, None), ("there", "好", False, None)]
    assert jobs.process(cues, fixed("{}"), store, pause=0.0).where("display and en = text and zh = text").count() == 3


def counted(path, replies):
    """A model that notes its prompts in a file; replies(prompt, number of times it was asked before)."""

    def model(prompts):
        out = []
        for prompt in prompts:
            key = hashlib.md5(prompt.encode()).hexdigest()
            with open(path, "a+") as notes:
                notes.seek(0)
                before = notes.read().count(key)
                notes.write(key + "\n")
            out.append(replies(prompt, before))
        return out

    return model


def test_model_is_asked_three_times_then_the_run_ends(spark, tmp_path):
    rows = spark.createDataFrame([("t", k, f"prompt {k}") for k in range(5)], "title_id string, batch_id long, prompt string").coalesce(1)
    model = counted(tmp_path / "a", lambda p, before: "no json" if p.endswith("3") and before < 2 else "[]")
    got = {r.batch_id: (r.attempt, r.raw, r.error is not None) for r in batch.run_model(rows, model, pause=0.0).collect()}
    assert got == {k: (3, "[]", True) if k == 3 else (1, "[]", False) for k in range(5)}
    assert len((tmp_path / "a").read_text().split()) == 7  # only the failed prompt goes again
    with pytest.raises(Exception, match="JSONDecodeError"):
        batch.run_model(rows, counted(tmp_path / "b", lambda p, before: "no json" if p.endswith("3") else "[]"), pause=0.0).collect()
    assert len((tmp_path / "b").read_text().split()) == 7
    one = batch.run_model(rows, lambda ps: ["x"] * len(ps), 1, 0.0, abort=False).first()
    assert one.raw is None and one.error.startswith("JSONDecodeError")
    for raw, want in (("<think>[1]</think> ```json\n[2]\n```", [2]), ("so: {\"a\": 1} done", {"a": 1}), ("[]", [])):
        assert batch.parse_reply(raw) == want


def test_single_cues_are_asked_until_valid(spark, tmp_path):
    cues = spark.createDataFrame([("t", k, float(k), k + 1.0, f"line {'abcdefg'[k]}") for k in range(7)], CUE)

    def reply(prompt, before):
        if "exactly 1 " not in prompt:
            n = int(re.search(r"exactly (\d+) ", prompt)[1])
            return json.dumps([{"index": k, "corrected_text": "wrong", "chinese_translation": "wrong", "display": False} for k in range(n)])
        assert "BEFORE\n[0]" in prompt or "AFTER\n[5]" in prompt  # the context of the batch
        if "line b" in prompt.split("TARGET\n")[1].split("AFTER\n")[0]:
            return json.dumps([{"corrected_text": "Line b", "chinese_translation": "乙"}]) if before >= 4 else "broken" if before == 2 else "[]"
        return json.dumps([{"corrected_text": "still wrong", "chinese_translation": "wrong"}])

    done = jobs.process(cues, counted(tmp_path / "a", reply), store, pause=0.0).orderBy("pos").collect()
    assert [(r.en, r.zh, r.display) for r in done] == [("Line b", "乙", False) if k == 1 else (f"line {'abcdefg'[k]}",) * 2 + (False,) for k in range(7)]
    asked = collections.Counter((tmp_path / "a").read_text().split())
    assert sorted(asked.values()) == [1, 1, 5, 10, 10, 10, 10, 10, 10]


def test_restart_leaves_other_titles(spark, tmp_path):
    path = str(tmp_path / "store")
    cues = spark.createDataFrame([(t, 0, 0.0, 1.0, "x") for t in ("a", "b", "c: d/e?", "é 100%")], CUE)
    sinks.write_titles(cues, path)
    sinks.write_titles(cues.where("title_id = 'a'").withColumn("text", F.lit("y")), path)
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["x", "x", "x", "y"]
    assert sinks.restart_titles(spark, ["a", "c: d/e?", "é 100%", "none"], [path, str(tmp_path / "not there")]) == 3
    assert [r.title_id for r in spark.read.parquet(path).collect()] == ["b"]


def test_language_check_retries_then_falls_back(spark, tmp_path):
    cues = spark.createDataFrame([("t", 0, 0.0, 1.0, "hello"), ("t", 1, 1.0, 2.0, "world")], CUE)
    bad = json.dumps([{"index": 0, "corrected_text": "你好", "chinese_translation": "你好"}, {"index": 1, "corrected_text": "world", "chinese_translation": "not translated"}])
    good = json.dumps([{"index": 0, "corrected_text": "Hello", "chinese_translation": "你好"}])
    rows = jobs.process(cues, lambda ps: [good if "exactly 1 " in p else bad for p in ps], store, pause=0.0).orderBy("pos").collect()
    assert [(r.en, r.zh) for r in rows] == [("Hello", "你好"), ("Hello", "你好")]
    rows = jobs.process(cues, lambda ps: ["[]" if "exactly 1 " in p else bad for p in ps], store, pause=0.0).orderBy("pos").collect()
    assert [(r.en, r.zh) for r in rows] == [("hello", "hello"), ("world", "world")]

    def failing(prompts):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="down"):
        batch.run_model(spark.createDataFrame([("t", 0, "p")], "title_id string, batch_id long, prompt string"), failing, 2, 0.0).collect()


def test_proofread(spark):
    rows = [("t", 0, 0.0, 1.0, "", "Helo", "你好"), ("t", 1, 1.0, 2.0, "", "Helo", "你好"), ("t", 2, 2.0, 3.0, "", "(MUSIC PLAYING)", ""), ("t", 3, 3.0, 4.0, "只有", "只有", "只有")]
    cues = spark.createDataFrame(rows, CUE + ", en string, zh string").withColumn("source_language", F.lit(None).cast("string"))
    reply = json.dumps([{"index": 0, "corrected_english": "Hello", "corrected_chinese": "你好", "display_end": 2.0}, {"index": 1, "corrected_english": "Hello", "display": False}, {"index": 2, "corrected_english": "(MUSIC PLAYING)", "corrected_chinese": "（音乐）"}, {"index": 3, "corrected_english": "只有", "corrected_chinese": "只有"}])
    got = jobs.process(cues, fixed(reply), store, proofread=True, pause=0.0).orderBy("pos").collect()
    assert [(r.en, r.zh, r.display, r.display_end) for r in got] == [("Hello", "你好", True, 2.0), ("Hello", "你好", False, None), ("(MUSIC PLAYING)", "（音乐）", True, None), ("", "只有", True, None)]


def test_resume_sends_only_what_is_left(spark):
    cues = spark.createDataFrame([("t", k, float(k), k + 1.0, f"c{k}") for k in range(12)], CUE)
    full = jobs.process(cues, stub_model(), store, pause=0.0)
    cached = full.where("pos < 7").withColumn("zh", F.lit("旧"))
    rows = jobs.process(cues, stub_model(), store, pause=0.0, cached=cached).orderBy("pos").collect()
    assert [r.zh == "旧" for r in rows] == [True] * 5 + [False] * 7


def test_subtitle_job(spark):
    plain = spark.createDataFrame([("a", 0, 0.0, 1.0, "hello there"), ("b", 0, 0.0, 1.0, "good day")], CUE)
    cached = spark.createDataFrame([("b", 0, 0.0, 1.0, "existing", "existing", "已有中文")], CUE + ", en string, zh string")
    out = jobs.subtitle_job({"cache": cached, "audio": plain}, stub_model(), store)
    modes = {r.title_id: r.processing_mode for r in out["processed"].collect()}
    assert modes == {"a": "translate", "b": "proofread_existing_chinese"}
    text = {r.title_id: r.content for r in out["ass_bilingual"].collect()}
    assert "{\\rEnglish}\\Nhello there" in text["a"] and out["report_done"].count() == 2


def test_layers(spark, tmp_path):
    rows = [("t", 0, 30.0, 31.0, "shown", "shown", "看", None, True, None, 33.0), ("t", 1, 31.0, 32.0, "gone", "gone", "没", None, False, None, None), ("t", 2, 40.0, 41.0, "中文", "中文", "中文", "zh", True, None, None)]
    cues = spark.createDataFrame(rows, CUE + ", en string, zh string, source_language string, display boolean, display_start double, display_end double")
    content = {m: sinks.render_ass(cues, m).first().content for m in ("en", "zh", "bilingual")}
    assert "0:00:30.00,0:00:33.00,English,,0,0,0,,shown\n" in content["en"] and "gone" not in content["bilingual"]
    assert "中文" not in content["en"] and "中文{\\rEnglish}\\N\n" in content["bilingual"]
    with pytest.raises(ValueError):
        sinks.layer_lines(cues, "x")
    sinks.write_files(sinks.render_ass(cues, "en"), str(tmp_path / "out"))
    assert (next((tmp_path / "out" / "title_id=t").glob("*.txt"))).read_text() == content["en"]
    sinks.write_titles(cues, str(tmp_path / "store"))
    sinks.write_titles(cues.withColumn("title_id", F.lit("u")), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 6


def test_languages(spark):
    rows = [("a", 0, "fre"), ("a", 1, "auto"), ("a", 2, "de"), ("a", 3, None), ("b", 0, ""), ("b", 1, "auto")]
    cues = spark.createDataFrame(rows, "title_id string, pos long, source_language string").withColumn("text", F.lit("x"))
    assert [tuple(r) for r in language.dominant(cues).collect()] == [("a", "fr")]
    got = {(r.title_id, r.pos): r.source_language for r in language.fill_missing(cues).collect()}
    assert got == {("a", 0): "fre", ("a", 1): "fr", ("a", 2): "de", ("a", 3): "fr", ("b", 0): "", ("b", 1): "auto"}
    assert dict(language.first_known(cues).collect()) == {"a": "fre", "b": "auto"}
    assert dict(language.first_known(cues, "ja").collect()) == {"a": "ja", "b": "ja"}
    assert language.matches_request(cues, "French", "").select("title_id").distinct().collect()[0][0] == "a"
    assert language.matches_request(cues, "auto", "source").count() == 6


def test_files_and_tracks(spark):
    paths = [("m", "/m/BDMV/STREAM/1.m2ts", 5), ("m", "/m/big.mkv", 90), ("n", "/n/a.mkv", 3), ("n", "/n/b.MP4", 4), ("n", "/n/b.en.srt", 1), ("n", "/n/b.srt", 1), ("n", "/n/c.zh.ass", 1)]
    listing = spark.createDataFrame(paths, "title_id string, path string, length long")
    video = files.main_videos(listing)
    assert {r.title_id: r.path for r in video.collect()} == {"m": "/m/BDMV/STREAM/1.m2ts", "n": "/n/b.MP4"}
    ranked = files.rank_sidecars(video, listing)
    assert [(r.path, r.score) for r in ranked.orderBy("rank").collect()] == [("/n/b.srt", 150), ("/n/b.en.srt", 60), ("/n/c.zh.ass", 0)]
    named = spark.createDataFrame([("n", "/n/c.zh.ass", 1), ("n", "/n/gone.srt", 2)], "title_id string, path string, priority int")
    assert [r.path for r in files.candidates(ranked, named, listing).orderBy("rank").collect()] == ["/n/c.zh.ass", "/n/b.srt", "/n/b.en.srt"]
    texts = spark.createDataFrame([("/n/b.srt", "你好你好你")], "path string, content string")
    row = files.resolve_languages(ranked, texts).first()
    assert (row.zh_path, row.en_path) == ("/n/b.srt", "/n/b.en.srt")
    log = ["Input", "  Stream #0:0: Video: h264, x", "  Stream #0:2(eng)[0x1]: Subtitle: subrip (default)", "    Metadata:", "      title           : English Full", "      NUMBER_OF_FRAMES: 1200", "  Stream #0:3(chi): Subtitle: hdmv_pgs_subtitle, y", "    Metadata:", "      title : Forced Simplified", "      BPS : 90000000"]
    probed = tracks.parse_probe_logs(spark.createDataFrame([("t", k, x) for k, x in enumerate(log)], "title_id string, line_no long, line string"))
    got = {r["index"]: (r.kind, r.codec, r.lang, r.title, r.score) for r in probed.withColumn("score", tracks.score()).collect()}
    assert got == {0: ("Video", "h264", "", "", 0), 2: ("Subtitle", "subrip (default)", "eng", "English Full", 3200), 3: ("Subtitle", "hdmv_pgs_subtitle", "chi", "Forced Simplified", -9000)}
    assert tracks.best_chinese(probed).first().zh_kind == "zh-Hans" and tracks.best_english(probed).first()["index"] == 2
    asked = spark.createDataFrame([("t", 9)], "title_id string, index int")
    assert tracks.preferred(probed, "chi").first()["index"] == 3 and tracks.preferred(probed, "chi", asked).count() == 0


def test_frames_and_reports(spark):
    rows = [("t", 0, 1.0, False, "a"), ("t", 1, 2.0, False, "a"), ("t", 2, 3.0, False, "b"), ("t", 3, 3.0, True, None), ("t", 4, 5.0, False, "c")]
    got = frames.merge_frames(spark.createDataFrame(rows, "track_id string, seq long, pts double, is_empty boolean, image_hash string"))
    assert [(r.start, r.end, r.image_hash) for r in got.orderBy("event_no").collect()] == [(1.0, 3.0, "a"), (5.0, 8.0, "c")]
    texts = spark.createDataFrame([("t/0", "hi"), ("t/1", "")], "frame_id string, text string")
    assert [tuple(r) for r in frames.ocr_cues(got, texts).collect()] == [("t", 0, 1.0, 3.0, "hi")]
    row = report.timing(spark.createDataFrame([("t", 0, 0.0, 9.0, "")], CUE)).first()
    assert (row.events, row.max_duration, row.over_6s, row.over_8s, row.gaps_over_5s, row.max_gap) == (1, 9.0, 1, 1, 0, 0.0)
    log = spark.createDataFrame([("r", 0, "Using sidecar"), ("r", 1, "x")], "run_id string, line_no long, line string")
    running = spark.createDataFrame([("r", True), ("s", True), ("q", False)], "run_id string, running boolean")
    assert {r.run_id: r.stage for r in report.stages(log, running).collect()} == {"r": 0, "s": 0, "q": -1}


def test_names_are_asked_once_a_path_time_and_model(spark, tmp_path):
    listing = spark.createDataFrame([("/l/A.Film.1080p.mkv", 1), ("/l/show.s01.mkv", 2), ("/l/odd.file.mkv", 3)], "path string, modificationTime long").withColumn("modificationTime", F.timestamp_seconds("modificationTime"))

    def reply(prompt, before):
        return "no" if "odd" in prompt else json.dumps({"series_name": "S", "movie_name": "A Film" if "Film" in prompt else "Pilot", "kind": "movie" if "Film" in prompt else "series"})

    first = jobs.name_titles(listing, counted(tmp_path / "a", reply), store, "m", pause=0.0).cache()
    want = {"/l/A.Film.1080p.mkv": ("A Film", "A Film", "model"), "/l/show.s01.mkv": ("Pilot", "S", "model"), "/l/odd.file.mkv": ("odd file", "odd file", "heuristic")}
    assert {r.path: (r.movie_name, r.series_name, r.name_source) for r in first.collect()} == want
    assert len((tmp_path / "a").read_text().split()) == 5
    later = listing.withColumn("modificationTime", F.when(F.col("path").contains("show"), F.timestamp_seconds(F.lit(9))).otherwise(F.col("modificationTime")))
    again = jobs.name_titles(later, counted(tmp_path / "b", reply), store, "m", cached=first, pause=0.0)
    assert {r.path: (r.movie_name, r.series_name, r.name_source) for r in again.collect()} == want
    assert len((tmp_path / "b").read_text().split()) == 1
    jobs.name_titles(later, counted(tmp_path / "c", reply), store, "other", cached=first, pause=0.0).collect()
    assert len((tmp_path / "c").read_text().split()) == 5


def test_stored_state_that_cannot_be_read_is_left_out(spark, tmp_path):
    schema = "title_id string, pos long, text string"
    assert resume.read_stored(spark, str(tmp_path / "none"), schema).count() == 0
    spark.createDataFrame([("t", 0, "x")], schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    (tmp_path / "s" / "part-broken.parquet").write_bytes(b"PAR1 no table")
    assert [tuple(r) for r in resume.read_stored(spark, str(tmp_path / "s"), schema + ", more int").collect()] == [("t", 0, "x", None)]


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    told = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    want = sorted(repr(sorted(zip(columns, r))) for r in told.fetchall())
    assert want and sorted(repr(sorted(r.asDict().items())) for r in catalog.QUERIES[name](spark, sf).collect()) == want


def plain_extension(rows, gap=2.0):
    """display_end of rows (pos, start, end, display, display_end) by one loop."""
    out, last = [r[4] for r in rows], None
    for k, (_, start, end, shown, _) in enumerate(rows):
        if shown is None or shown:
            last = k
        elif last is not None:
            reach = rows[last][2] if out[last] is None else out[last]
            if start - reach <= gap:
                out[last] = max(reach, end)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_extension_of_unsorted_titles(spark, seed):
    rng = random.Random(seed)
    titles = {}
    for t in "abcdef":
        rows, at = [], 0.0
        for k in range(40):
            at += rng.uniform(-3, 4) if t < "d" else rng.uniform(0, 4)
            rows.append((k, round(at, 3), round(at + rng.uniform(0.2, 3), 3), rng.choice([True, False, False, None]), rng.choice([None, None, round(at + 5, 3)])))
        titles[t] = rows
    cues = spark.createDataFrame([(t, *r, f"{t}{r[0]}") for t, rows in titles.items() for r in rows], "title_id string, pos long, start double, end double, display boolean, display_end double, text string")
    got = {(r.title_id, r.pos): (r.display_end, r.text) for r in display.extend_over_hidden(cues).collect()}
    assert got == {(t, k): (x, f"{t}{k}") for t, rows in titles.items() for k, x in enumerate(plain_extension(rows))}


def test_existing_pair_tracks(spark):
    track = "title_id string, index int, kind string, codec string, lang string, title string, metadata map<string,string>"
    rows = []
    for t in ("plain", "pick", "wrong", "english", "chinese", "odd", "same"):
        rows += [(t, 1, "Subtitle", "subrip", "eng", "", {}), (t, 2, "Subtitle", "hdmv_pgs_subtitle", "chi", "Traditional", {}), (t, 3, "Subtitle", "ass", "chi", "Cantonese", {}), (t, 4, "Subtitle", "ass", "eng", "Full", {}), (t, 5, "Subtitle", "ass", "fre", "", {}), (t, 6, "Audio", "aac", "eng", "", {})]
    rows += [("none", 1, "Subtitle", "ass", "eng", "", {})]
    probed = spark.createDataFrame(rows, track)
    asked = [("pick", None, 3, 1), ("wrong", 6, None, None), ("english", 1, None, None), ("chinese", 3, 2, None), ("odd", None, 5, 99), ("same", None, 4, None)]
    overrides = spark.createDataFrame(asked, "title_id string, track_index int, zh_index int, en_index int")
    got = {r.title_id: tuple(r)[1:] for r in jobs.existing_pair_tracks(probed, overrides).collect()}
    assert got == {
        "plain": (2, "zh-Hant", 4, "chinese_cht"),
        "pick": (3, "zh-yue", 1, "chinese_cht"),
        "english": (2, "zh-Hant", 1, "chinese_cht"),
        "chinese": (3, "zh-yue", 4, "chinese_cht"),
        "odd": (5, "zh", 4, "ch"),
        "same": (4, "zh", None, "ch"),
    }
    assert {r.ocr_language for r in jobs.existing_pair_tracks(probed, ocr_language="ch").collect()} == {"ch"}
    cues = spark.createDataFrame([("plain", 2, 0, 0.0, 1.0, "繁"), ("plain", 2, 1, 1.0, 2.0, " "), ("plain", 4, 0, 0.0, 1.5, "yes"), ("plain", 4, 1, 9.0, 9.5, "no"), ("pick", 2, 0, 0.0, 1.0, " ")], "title_id string, index int, pos long, start double, end double, text string")
    out = [(r.title_id, r.pos, r.start, r.end, r.en, r.zh) for r in jobs.existing_pair_job(probed, cues, {"繁": "简"}).orderBy("pos").collect()]
    assert out == [("plain", 0, 0.0, 1.5, "yes", "简"), ("plain", 1, 9.0, 9.5, "no", "")]


def test_track_pairs_translate_titles_without_chinese(spark):
    track = "title_id string, index int, kind string, codec string, lang string, title string, metadata map<string,string>"
    probed = spark.createDataFrame([("a", 1, "Subtitle", "ass", "eng", "", {}), ("b", 1, "Subtitle", "ass", "eng", "", {}), ("b", 2, "Subtitle", "pgs", "chi", "", {})], track)
    pictures = spark.createDataFrame([("b", 0, 0.0, 1.0, "好")], "title_id string, pos long, start double, end double, text string")
    owners = spark.createDataFrame([("b", "b", 2)], "track_id string, title_id string, index int")
    text = spark.createDataFrame([("a", 1, 0, 0.0, 1.0, "hi"), ("b", 1, 0, 0.0, 1.0, "well")], "title_id string, index int, pos long, start double, end double, text string")
    cues = text.unionByName(jobs.picture_cues(pictures, owners))
    out = jobs.track_pair_job(probed, cues, translate=lambda rows: rows.withColumn("zh", F.concat(F.lit("译"), "text")))
    assert {(r.title_id, r.en.text, r.zh.text) for r in out["pairs"].collect()} == {("a", "hi", "译hi"), ("b", "well", "好")}
    assert [r.title_id for r in out["untranslated"].collect()] == ["a"]
    assert {(r.title_id, r.en.text) for r in jobs.track_pair_job(probed, cues)["pairs"].collect()} == {("b", "well")}


def test_picture_cues_are_kept_if_as_many(spark):
    frames_ = [(t, k, float(k), False, f"h{k}") for t in "xy" for k in range(3)]
    pictures = spark.createDataFrame(frames_, "track_id string, seq long, pts double, is_empty boolean, image_hash string")
    lines = spark.createDataFrame([(f"{t}/{k}", 0, 0.0, 0.0, f"{t}{k}") for t in "xy" for k in range(3)], "frame_id string, seq long, x double, y double, text string")
    full = jobs.picture_job(pictures, lines)
    cached = full.withColumn("text", F.concat(F.lit("old "), "text")).where("title_id = 'x' or pos < 2")
    assert {(r.title_id, r.pos): r.text for r in jobs.picture_job(pictures, lines, cached=cached).collect()} == {**{("x", k): f"old x{k}" for k in range(3)}, **{("y", k): f"y{k}" for k in range(3)}}


def test_embedded_job_drops_blank_cues_and_unreadable_tracks(spark):
    track = "title_id string, index int, kind string, codec string, lang string, title string, metadata map<string,string>"
    probed = spark.createDataFrame([("a", 1, "Subtitle", "ass", "fre", "", {}), ("b", 1, "Subtitle", "eia_608", "fre", "", {}), ("c", 1, "Subtitle", "ass", "", "", {})], track)
    cues = spark.createDataFrame([("a", 1, 0, 0.0, 1.0, " "), ("a", 1, 1, 1.0, 2.0, "oui"), ("b", 1, 0, 0.0, 1.0, "non"), ("c", 1, 0, 0.0, 1.0, "\u3000")], "title_id string, index int, pos long, start double, end double, text string")
    assert [tuple(r) for r in jobs.embedded_job(probed, cues, "fre").select("title_id", "pos", "text", "source_language").collect()] == [("a", 0, "oui", "fre")]
    assert [(r.title_id, r.reason) for r in tracks.rejected(probed).collect()] == [("b", "unsupported codec eia_608")]


def test_every_order_is_parsed(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    orders = {}
    for r in rows:
        orders.setdefault(str(r.l_orderkey), []).append((r.l_linenumber, r.l_returnflag, r.l_quantity, r.l_extendedprice))
    want = {(k, n, t, round(x, 3), round(y, 3)) for k, lines in orders.items() for n, (_, t, x, y) in enumerate(sorted(lines))}
    got = [(r.frame_id, r.seq, r.text, r.x, r.y) for r in catalog.QUERIES["order_detections"](spark, sf).collect()]
    assert len(got) == len(rows) and set(got) == want
