import threading

import pytest
from pyspark.sql import functions as F

from cuelake.sources import snapshots

CUE = "title_id string, pos long, text string"


def cues(spark, titles, text, n=2):
    return spark.createDataFrame([(t, k, text) for t in titles for k in range(n)], CUE)


def held(df):
    return sorted((r.title_id or "", r.pos, r.text) for r in df.collect())


def test_replace_and_restart_over_tables(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.latest(spark, path) == 0 and snapshots.read(spark, path, "cues", CUE).count() == 0
    names = ["a", "b", "c: d/e?", "é 100%", None]
    assert snapshots.replace(spark, path, {"cues": cues(spark, names, "x"), "replies": cues(spark, ["a", "b"], "r", 1)}) == 1
    assert snapshots.replace(spark, path, {"cues": cues(spark, ["a", None], "y", 1)}) == 2
    assert held(snapshots.read(spark, path, "cues", CUE)) == [("", 0, "y"), ("a", 0, "y")] + [(t, k, "x") for t in names[1:4] for k in range(2)]
    assert held(snapshots.read(spark, path, "replies", CUE)) == [("a", 0, "r"), ("b", 0, "r")]
    assert snapshots.restart(spark, path, spark.createDataFrame([("a",), ("c: d/e?",), ("none",), (None,)], "title_id string")) == 3
    assert {t for t, _, _ in held(snapshots.read(spark, path, "cues", CUE))} == {"b", "é 100%"}
    assert held(snapshots.read(spark, path, "replies", CUE)) == [("b", 0, "r")]
    # earlier snapshots stay as they were, empty tables change nothing, columns may come later
    assert len(held(snapshots.read(spark, path, "cues", CUE, 1))) == 10
    assert snapshots.replace(spark, path, {"cues": cues(spark, [], "z")}) == 4
    snapshots.replace(spark, path, {"cues": cues(spark, ["n"], "x", 1).withColumn("commit_no", F.lit(1)).withColumn("extra", F.lit("e"))})
    got = {r.title_id: r.extra for r in snapshots.read(spark, path, "cues", CUE + ", extra string").collect()}
    assert got == {"b": None, "é 100%": None, "n": "e"}
    for name in ("_titles", "a/b"):
        with pytest.raises(ValueError):
            snapshots.replace(spark, path, {name: cues(spark, ["a"], "x")})


def test_rows_of_the_store_itself(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.replace(spark, path, {"cues": cues(spark, "abc", "x")})
    snapshots.replace(spark, path, {"cues": snapshots.read(spark, path, "cues", CUE).where("title_id <> 'a' and pos = 1").withColumn("text", F.lit("y"))})
    want = [("a", 0, "x"), ("a", 1, "x"), ("b", 1, "y"), ("c", 1, "y")]
    assert held(snapshots.read(spark, path, "cues", CUE)) == want
    snapshots.compact(spark, path, {"cues": CUE})
    assert held(snapshots.read(spark, path, "cues", CUE)) == want
    assert snapshots.vacuum(spark, path) == 0  # all of it is young
    assert snapshots.vacuum(spark, path, keep=2, grace=0.0) == 1 and held(snapshots.read(spark, path, "cues", CUE, 2)) == want
    assert snapshots.vacuum(spark, path, grace=0.0) == 3 and held(snapshots.read(spark, path, "cues", CUE)) == want
    assert snapshots.numbers(spark, path) == [3]


def test_a_write_that_fails_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.replace(spark, path, {"cues": cues(spark, "ab", "x"), "replies": cues(spark, "ab", "x")})
    bad = cues(spark, "ab", "y").withColumn("text", F.when(F.col("title_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        snapshots.replace(spark, path, {"replies": cues(spark, "ab", "y"), "cues": bad})
    for name in ("cues", "replies"):
        assert {text for _, _, text in held(snapshots.read(spark, path, name, CUE))} == {"x"}
    assert snapshots.vacuum(spark, path, grace=0.0) == 2


def test_a_reader_sees_old_or_new_only(spark, tmp_path):
    """While a writer replaces and restarts titles in two tables, each read finds both tables of one commit."""
    path, over, seen, wrong = str(tmp_path / "store"), threading.Event(), [], []
    snapshots.replace(spark, path, {"cues": cues(spark, "abcdef", "0"), "replies": cues(spark, "abcdef", "0")})

    def watch():
        while not over.is_set():
            number = snapshots.latest(spark, path)
            a, b = (held(snapshots.read(spark, path, name, CUE, number)) for name in ("cues", "replies"))
            seen.append(number)
            if a != b or len({text for _, _, text in a}) != 1 or len(a) not in (12, 6):
                wrong.append((number, a, b))

    reader = threading.Thread(target=watch)
    reader.start()
    for k in range(1, 4):
        snapshots.replace(spark, path, {n: cues(spark, "abcdef", str(k)) for n in ("cues", "replies")})
        snapshots.restart(spark, path, spark.createDataFrame([(t,) for t in "abc"], "title_id string"))
    over.set()
    reader.join()
    assert not wrong and len(set(seen)) > 1


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Two writers from one snapshot: neither loses the other's titles."""
    path = str(tmp_path / "store")
    snapshots.replace(spark, path, {"cues": cues(spark, "a", "0")})
    both = threading.Barrier(2)
    plain, waited = snapshots._rename, threading.local()

    def late(*args):
        if not getattr(waited, "done", False):
            waited.done = True
            both.wait(60)
        return plain(*args)

    monkeypatch.setattr(snapshots, "_rename", late)
    writers = [threading.Thread(target=lambda t=t: snapshots.replace(spark, path, {"cues": cues(spark, t, "1", 1)})) for t in ("b", "c")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert held(snapshots.read(spark, path, "cues", CUE)) == [("a", 0, "0"), ("a", 1, "0"), ("b", 0, "1"), ("c", 0, "1")]
    assert snapshots.latest(spark, path) == 3 and not [n for n, _ in snapshots._children(spark, f"{path}/_titles") if n.startswith("aside")]
