"""Scans by blocks against plain loops and against the windows that take a title whole."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import display, frames, report, scan
from cuelake.plans import catalog

CUE = "title_id string, pos long, start double, end double, display boolean, display_end double, text string"


def keep(df, name):
    return df.checkpoint()


@pytest.fixture(autouse=True)
def shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


@pytest.mark.parametrize("block", [1, 3, 1000])
@pytest.mark.parametrize("backwards", [False, True])
def test_before_equals_a_plain_loop(spark, block, backwards):
    rng = random.Random(block)
    data = {(t, p): rng.choice([None, rng.randrange(-9, 9)]) for t in ["a", "b", None] for p in rng.sample(range(-20, 40), 25)}
    data["c", 5] = 7
    rows = spark.createDataFrame([(t, p, v, f"{t}{p}") for (t, p), v in data.items()], "t string, p long, v long, other string")
    v = F.col("v")
    got = {(r.t, r.p): (r.prior, r.total, r.top, r.other) for r in scan.before(rows, ["t"], "p", {"prior": ("last", v), "total": ("sum", v), "top": ("max", v)}, block, backwards).collect()}
    want = {}
    for t, group in itertools.groupby(sorted(data, key=lambda k: (str(k[0]), -k[1] if backwards else k[1])), key=lambda k: k[0]):
        past = []
        for key in group:
            known = [x for x in past if x is not None]
            want[key] = (past[-1] if past else None, sum(known) if known else None, max(known, default=None), f"{t}{key[1]}")
            past.append(data[key])
    assert got == want


def test_number_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 7), ("a", -3), ("b", 2), ("a", 7_000_000)], "t string, p long")
    assert sorted((r.t, r.p, r.number) for r in scan.number(rows, ["t"], "p", 2).collect()) == [("a", -3, 0), ("a", 7, 1), ("a", 7_000_000, 2), ("b", 2, 0)]
    assert scan.number(rows.limit(0), ["t"], "p").count() == 0


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_gaps_by_blocks(spark, block):
    rows = spark.createDataFrame([(t, k, k * 2.0, k * 2.0 + k % 3, None, None, "") for t, n in (("a", 30), ("b", 1)) for k in range(n)], CUE)
    assert sorted(report.gaps(rows, block).collect(), key=str) == sorted(report.gaps(rows).collect(), key=str)


@pytest.mark.parametrize("block, limit", [(1, 0), (1, 3), (5, 1), (5, 4), (1000, 2), (7, 0)])
def test_frames_by_blocks(spark, block, limit):
    rng = random.Random(block + limit)
    data, at = [], 0.0
    for t, n in (("a", 60), ("b", 1), ("c", 9)):
        for k in range(n):
            at += rng.choice([0.0, 0.5, 1.0])
            data.append((t, k, at, rng.random() < 0.2, rng.choice(["x", "y", None])))
    rows = spark.createDataFrame(data, "track_id string, seq long, pts double, is_empty boolean, image_hash string")
    got = frames.merge_frames(rows, limit, keep, block)
    assert sorted(got.collect(), key=str) == sorted(frames.merge_frames(rows, limit).collect(), key=str)


@pytest.mark.parametrize("block", [1, 6, 1000])
@pytest.mark.parametrize("ordered", [True, False])
def test_extension_by_blocks(spark, block, ordered):
    rng, data = random.Random(block), []
    for t in "abcd":
        at = 0.0
        for k in range(50):
            at += rng.uniform(0, 4) if ordered or t == "a" else rng.uniform(-3, 4)
            shown = rng.choice([True, None, False, False, False, False]) if t < "d" else k == 1
            data.append((t, k, round(at, 3), round(at + rng.uniform(0.2, 3), 3), shown, rng.choice([None, round(at + 5, 3)]), f"{t}{k}"))
    rows = spark.createDataFrame(data, CUE)
    got = display.extend_over_hidden(rows, store=keep, block=block)
    assert got.columns == rows.columns
    assert sorted(got.collect(), key=str) == sorted(display.extend_over_hidden(rows).collect(), key=str)


def test_islands_of_several_files_are_folded_whole(spark, tmp_path):
    """Spark plans the join to the odd islands by a shuffle and then, as they are few, broadcasts them."""
    data = [("t", p, p / 2 - (20 if p % 97 == 96 else 0), p / 2 + 0.5 + p % 5, p % 7 == 0, None, "") for p in range(1500)]
    rows = spark.createDataFrame(data, CUE)

    def scattered(df, name):
        df.repartition(7).write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    limits = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        got = sorted((r.pos, r.display_end) for r in display.extend_over_hidden(rows, store=scattered, block=16).collect() if r.display_end)
    finally:
        for key in limits:
            spark.conf.unset(key)
    want = {}
    for _, p, start, end, shown, _, _ in data:
        if shown:
            at, reach = p, end
        elif start - reach <= display.MAX_GAP:
            reach = want[at] = max(reach, end)
    assert got == sorted(want.items())


def test_extension_of_no_cues(spark):
    assert display.extend_over_hidden(spark.createDataFrame([], CUE), store=keep).count() == 0
