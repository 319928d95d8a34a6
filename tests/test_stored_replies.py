"""Replies stored batch by batch, sources read in turn, display sets, file lines, mapping by longest match."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.operators import batch, frames, report
from cuelake.plans import catalog, jobs
from cuelake.sources import files
from cuelake.streaming import replies

CUE = "title_id string, pos long, start double, end double, text string"


def noted(path, broken=lambda prompt: False):
    """A model that notes what it is asked in a file, and says nothing useful to some prompts."""

    def model(prompts):
        out = []
        for prompt in prompts:
            target = prompt.split("TARGET\n", 1)[1].split("\n\nAFTER\n", 1)[0]
            with open(path, "a") as notes:
                notes.write(target.replace("\n", " / ") + "\n")
            items = [{"index": int(k), "corrected_text": f"{t} now", "corrected_english": f"{t} now", "chinese_translation": "好"} for k, t in re.findall(r"^\[(\d+)\] (?:\S+->\S+ )?(.*)$", target, re.M)]
            out.append("no answer" if broken(prompt) else json.dumps(items))
        return out

    return model


def asked(path):
    try:
        return path.read_text().splitlines()
    except FileNotFoundError:
        return []


def store(df, name):
    return df.checkpoint()


@pytest.fixture
def cues(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    return spark.createDataFrame([("t", k, k * 2.0, k * 2.0 + 1, f"line {k} here") for k in range(60)], CUE)  # twelve batches


def test_one_prompt_without_reply_leaves_the_others_stored(spark, cues, tmp_path):
    folder, first, second = str(tmp_path / "store"), tmp_path / "first", tmp_path / "second"
    dead = lambda prompt: "TARGET\n[0] 70.00" in prompt  # noqa: E731  the eighth batch
    seen = []
    with pytest.raises(RuntimeError, match="1 prompts have no reply"):
        jobs.process(cues, noted(first, dead), store, pause=0.0, replies_at=folder)
    assert len(asked(first)) == 11 + 3 and replies.stored(spark, folder).count() == 11
    so_far = jobs.processed_so_far(cues, folder).orderBy("pos").collect()
    assert [r.pos for r in so_far] == list(range(35)) and so_far[3].en == "line 3 here now"
    done = jobs.process(cues, noted(second), store, pause=0.0, replies_at=folder).orderBy("pos").collect()
    assert len(asked(second)) == 1 and "line 35" in asked(second)[0]
    assert [(r.pos, r.en, r.zh) for r in done] == [(k, f"line {k} here now", "好") for k in range(60)]
    batches = batch.requests(batch.context(cues))
    again = replies.ask(batches, noted(tmp_path / "third"), folder, after=lambda rows: seen.append(rows.count()))
    assert again.count() == 12 and asked(tmp_path / "third") == [] and seen == []
    assert not (tmp_path / "store" / "requests").exists() or not list((tmp_path / "store" / "requests").iterdir())


def test_a_changed_prompt_is_asked_again(spark, cues, tmp_path):
    folder, notes = str(tmp_path / "store"), tmp_path / "notes"
    replies.ask(batch.requests(batch.context(cues, lines=0)), noted(notes), folder, pause=0.0)
    changed = cues.withColumn("text", F.when(F.col("pos") == 7, "another").otherwise(F.col("text")))
    got = replies.ask(batch.requests(batch.context(changed, lines=0)), noted(notes), folder, pause=0.0)
    assert len(asked(notes)) == 13 and got.count() == 12 and "another now" in got.where("batch_id = 1").first().raw


def test_micro_batches_are_stored_one_by_one_until_the_model_is_gone(spark, cues, tmp_path):
    folder, notes, seen = str(tmp_path / "store"), tmp_path / "notes", []
    requests = batch.requests(batch.context(cues)).repartitionByRange(12, "batch_id")
    late = lambda prompt: len(notes.read_text().splitlines()) > 4  # noqa: E731  answers four prompts, then none
    with pytest.raises(Exception, match="answers no prompt any more"):
        replies.ask(requests, noted(notes, late), folder, 2, 0.0, prompts=1, files=1, after=lambda rows: seen.append(rows.count()))
    assert seen == [1, 1, 1, 1] and replies.stored(spark, folder).count() == 4 and len(asked(notes)) == 4 + 2
    assert replies.stored(spark, str(tmp_path / "none")).count() == 0


def test_texts_are_translated_without_times(cues, tmp_path):
    notes = tmp_path / "notes"
    rows = jobs.translate_texts(cues, noted(notes), str(tmp_path / "store"), pause=0.0).orderBy("pos").collect()
    assert [(r.pos, r.start, r.en, r.zh) for r in rows] == [(k, k * 2.0, f"line {k} here now", "好") for k in range(60)]
    assert "[0] line 0 here / [1] line 1 here" in "\n".join(asked(notes))
    prompt = batch.requests(batch.context(cues, timed=False), timed=False).where("batch_id = 1").first().prompt
    assert "->" not in prompt and "display" not in prompt and "[4] line 4 here" in prompt and "[10] line 10 here" in prompt
    gaps = lambda prompts: ['[{"index": 0, "chinese_translation": ""}, {"index": 1, "corrected_english": "B"}]'] * len(prompts)
    rows = jobs.translate_texts(cues.where("pos < 3"), gaps, str(tmp_path / "other"), pause=0.0).orderBy("pos").collect()
    assert [(r.en, r.zh) for r in rows] == [("line 0 here", "line 0 here"), ("B", "B"), ("line 2 here", "line 2 here")]


def test_lower_sources_are_not_read_for_titles_that_have_cues(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    touched = {name: spark.sparkContext.accumulator(0) for name in ("sidecar", "audio")}
    listed = spark.createDataFrame([(f"t{k}", f"/v/t{k}.srt") for k in range(9)], "title_id string, path string")

    def reader(name, good):
        def read(paths):
            def decode(parts):
                for part in parts:
                    touched[name].add(len(part))
                    part = part[part["title_id"].isin(good)]
                    yield part.assign(pos=0, start=0.0, end=1.0, text=name)[["title_id", "pos", "start", "end", "text"]]

            return paths.mapInPandas(decode, CUE)

        return read

    cached = spark.createDataFrame([(f"t{k}", 0, 0.0, 1.0, "cache") for k in range(4)], CUE)
    sources = {"audio": jobs.sidecar_source(listed, reader("audio", [f"t{k}" for k in range(9)])), "sidecar": jobs.sidecar_source(listed, reader("sidecar", ["t4", "t5"])), "cache": cached}
    got = {r.title_id: (r.source, r.text) for r in jobs.resolve_cues(sources, store=store).collect()}
    assert got == {f"t{k}": (s, s) for k in range(9) for s in ["cache" if k < 4 else "sidecar" if k < 6 else "audio"]}
    assert touched["sidecar"].value == 5 and touched["audio"].value == 3
    assert {r.source for r in jobs.resolve_cues(sources, "cache").collect()} == {"cache"}
    with pytest.raises(ValueError):
        jobs.resolve_cues({"cache": cached}, "audio")


def plain_sets(packets):
    """What each END shows, by one loop over (seq, pts, kind, payload)."""
    palettes, active, objects, pending, comp, out = {}, None, {}, {}, None, []
    whole = lambda raw: int.from_bytes(raw, "big")
    for seq, pts, kind, p in packets:
        if kind == 0x14 and len(p) >= 7:
            palettes[p[0]] = active = seq
        elif kind == 0x15 and len(p) >= 4:
            key = whole(p[:2]), p[2]
            if p[3] & 0x80:
                if len(p) < 11:
                    continue
                pending[key] = [whole(p[7:9]), whole(p[9:11]), p[11:]]
            else:
                if key not in pending:
                    same = [k for k in pending if k[0] == key[0]]
                    if not same:
                        continue
                    key = same[-1]
                pending[key][2] += p[4:]
            if p[3] & 0x40:
                objects[key[0]] = (seq, *pending.pop(key))
        elif kind == 0x16:
            comp = None
            if len(p) >= 11:
                at, held = 11, []
                for _ in range(p[10]):
                    if at + 8 > len(p):
                        break
                    held.append((whole(p[at : at + 2]), whole(p[at + 4 : at + 6]), whole(p[at + 6 : at + 8])))
                    at += 16 if p[at + 3] & 0x40 and at + 16 <= len(p) else 8
                comp = seq, pts, whole(p[:2]), whole(p[2:4]), p[9], held
        elif kind == 0x80 and comp:
            out.append((seq, comp[1], comp[2], comp[3], palettes.get(comp[4], active), [(i, x, y, objects.get(i)) for i, x, y in comp[5]]))
            comp = None
    return out


def test_display_sets_equal_a_plain_loop(spark):
    rng = random.Random(4)
    some = lambda n: bytes(rng.choices([0, 1, 2, 64, 128, 192, 255], k=n))
    rows, want = [], {}
    for name in "abcd":
        packets = []
        for seq in range(600):
            kind = rng.choice([0x14, 0x15, 0x15, 0x15, 0x16, 0x16, 0x80, 0x80, 0x17])
            payload = some(rng.randint(0, 40))
            if kind == 0x15 and rng.random() < 0.9:
                payload = bytes([0, rng.randint(0, 1), rng.randint(0, 2), rng.choice([0, 0x40, 0x80, 0xC0])]) + some(rng.randint(0, 12))
            if kind == 0x16 and rng.random() < 0.8:
                entries = b"".join(bytes([0, rng.randint(0, 2), 0, rng.choice([0, 0x40])]) + some(4) + some(rng.choice([0, 8])) for _ in range(rng.randint(0, 3)))
                payload = some(9) + bytes([rng.randint(0, 2), rng.randint(0, 4)]) + entries
            if kind == 0x14 and rng.random() < 0.8:
                payload = bytes([rng.randint(0, 2), 0]) + some(rng.randint(0, 14))
            packets.append((seq, seq / 8, kind, payload))
        want[name] = plain_sets(packets)
        rows += [(name, *p) for p in packets]
    table = spark.createDataFrame(rows, "path string, seq long, pts double, kind int, payload binary").repartition(5)
    held = {(r.path, r.object_id, r.seq): (r.seq, r.width, r.height, bytes(r.data)) for r in frames.object_parts(table).collect()}
    got = {name: [] for name in "abcd"}
    for r in frames.display_sets(table).orderBy("path", "seq").collect():
        got[r.path].append((r.seq, r.pts, r.width, r.height, r.palette_seq, [(o.object_id, o.x, o.y, held[r.path, o.object_id, o.seq] if o.seq is not None else None) for o in r.objects]))
    assert got == want and sum(o[3] is not None for s in want.values() for r in s for o in r[5]) > 50


def test_cropped_objects_open_objects_and_palettes(spark):
    crop = bytes([0, 1, 0, 0x40, 0, 5, 0, 6]) + bytes(8) + bytes([0, 2, 0, 0, 0, 30, 0, 40])
    rows = [("f", 0, 0.0, 0x16, bytes(10) + b"\x02" + crop), ("f", 1, 0.0, 0x15, bytes([0, 7, 0, 0x80]) + bytes(7) + b"half"), ("f", 2, 0.0, 0x14, bytes([3, 0, 1, 16, 128, 129, 255, 1, 17, 2, 3, 4]))]
    table = spark.createDataFrame(rows, "path string, seq long, pts double, kind int, payload binary")
    assert [tuple(o) for o in frames.compositions(table).first().objects] == [(1, 5, 6), (2, 30, 40)]
    assert frames.object_parts(table).count() == 0
    palette = frames.palettes(table).first()
    assert palette.palette_id == 3 and {k: tuple(v) for k, v in palette.entries.items()} == {1: (17, 2, 3, 4)}


def test_the_event_that_meets_the_limit_is_the_last(spark):
    rows = [("t", k, t, h is None, h) for k, (t, h) in enumerate([(1.0, "a"), (2.0, "b"), (4.0, "c"), (5.0, None), (6.0, "d")])]
    table = spark.createDataFrame(rows, "track_id string, seq long, pts double, is_empty boolean, image_hash string")
    ends = lambda n: [(r.start, r.end) for r in frames.merge_frames(table, n).orderBy("event_no").collect()]
    assert ends(2) == [(1.0, 2.0), (2.0, 5.0)] and ends(1) == [(1.0, 4.0)]
    assert ends(0) == ends(9) == [(1.0, 2.0), (2.0, 4.0), (4.0, 5.0), (6.0, 9.0)]


@pytest.mark.parametrize("split", ["64", "134217728"])
def test_lines_of_files(spark, tmp_path, split):
    rng = random.Random(8)
    raw = {"a.log": b"".join(rng.choice([b"", b"one", "é日".encode(), b"bad \xff\xfe", b"x" * 300]) + rng.choice([b"\n", b"\r\n"]) for _ in range(200)) + b"last", "b/c.log": b"only\n", "empty.log": b"", "d.log": b"\n\n"}
    for name, body in raw.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in own:
            spark.conf.set(k, split)
        got = files.lines(spark, str(tmp_path)).collect()
        tails = {r.run_id.rpartition("/")[2]: r.tail for r in report.log_text(files.last_lines(spark, str(tmp_path), 350).withColumnRenamed("path", "run_id"), 350).collect()}
        many = files.last_lines(spark, str(tmp_path / "a.log"), 350).count()
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    for name, body in raw.items():
        mine = sorted((r.line_no, r.line) for r in got if r.path.endswith(f"/{name}"))
        lines = body.decode(errors="replace").replace("\r\n", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert mine == list(enumerate(lines)), name
        assert tails.get(name.rpartition("/")[2], "") == "\n".join(lines)[-350:]
    assert (many < 30) == (split == "64")


@pytest.mark.parametrize("split", ["64", "134217728"])
def test_lines_of_files_that_hold_many_logs(spark, tmp_path, split):
    rng = random.Random(9)
    logs = {f"r{k}": [rng.choice(["", "one", "é日\tb", "x" * 90]) for _ in range(rng.choice([1, 3, 60]))] for k in range(20)}
    for n in range(2):
        (tmp_path / f"{n}.log").write_text("".join(f"{k}\t{line}\n" for k in sorted(logs)[n::2] for line in logs[k]))
    (tmp_path / "mixed.txt").write_text("a\tx\nb\ty\na\tz\n")
    parts = F.substring_index("line", "\t", 1), F.expr("substr(line, instr(line, '\t') + 1)")
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in own:
            spark.conf.set(k, split)
        found = [str(tmp_path / f"{n}.log") for n in range(2)]
        got = sorted((r.log, r.line_no, r.line) for r in files.lines(spark, found, parts).collect())
        tails = {r.run_id: r.tail for r in report.log_text(files.last_lines(spark, found, 200, parts).withColumnRenamed("log", "run_id"), 200).collect()}
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert got == sorted((k, n, line) for k, lines in logs.items() for n, line in enumerate(lines))
    assert tails == {k: "\n".join(lines)[-200:] for k, lines in logs.items()}
    with pytest.raises(Exception, match="do not stand together"):
        files.lines(spark, str(tmp_path / "mixed.txt"), parts).collect()


def test_files_of_run_logs_do_not_grow_with_the_runs(spark, sf):
    path = catalog._log_files(spark, sf)
    runs = catalog._log(spark, sf)[0].select("run_id").distinct().count()
    assert len(spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < runs


def test_mapping_takes_the_longest_match(spark):
    rng = random.Random(3)
    table = {"乾坤": "乾坤", "乾": "干", "開車": "开车", "車": "车", "車站": "车站", "國": "国家", "開": "開乾", "": "never"}
    texts = ["乾坤 乾", "no CJK 乾"[:6], "開車站開", "", None, *("".join(rng.choices("乾坤開車站國 a", k=12)) for _ in range(200))]

    def plain(text):
        at, out = 0, ""
        while at < len(text):
            key = max((k for k in table if k and text.startswith(k, at)), key=len, default=text[at])
            out, at = out + table.get(key, key), at + len(key)
        return out

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in rows.select(X.simplify("t", table).alias("t")).collect()]
    assert got[0] == "乾坤 干" and got == [plain(t or "") for t in texts]
    many = {chr(0x4E00 + k % 20_000) + chr(0x4E00 + k % 997) + str(k): str(k) for k in range(50_000)} | {"乾": "干"}
    began = time.time()
    plan = rows.select(X.simplify("t", many).alias("t"))
    plan._jdf.queryExecution().executedPlan()
    assert time.time() - began < 1.5 and plan.where("t = '干坤 干'").count() == 1
