"""Batch contexts against a plain loop."""

import pytest

from cuelake.operators import batch


@pytest.mark.parametrize("size, lines", [(5, 30), (4, 6), (3, 1), (5, 0)])
def test_context_equals_a_plain_loop(spark, size, lines):
    titles = {"a": 83, "b": 5, "c": 1, "d": 12}
    cues = spark.createDataFrame([(t, k, k * 1.5, k * 1.5 + 1, f"{t}{k}") for t, n in titles.items() for k in range(n)], "title_id string, pos long, start double, end double, text string")
    got = {(r.title_id, r.batch_id): r for r in batch.context(cues.repartition(4), size, lines, timed=False).collect()}
    assert len(got) == sum(-(-n // size) for n in titles.values())
    for (t, b), r in got.items():
        lo, hi, n = b * size, min(titles[t], (b + 1) * size), titles[t]
        ahead, behind = range(max(0, lo - lines), lo), range(hi, min(n, hi + lines))
        said = lambda ks, shift=0, t=t: "\n".join(f"[{k - shift}] {t}{k}" for k in ks)
        assert (r.n, r.target, r.before, r.after) == (hi - lo, said(range(lo, hi), lo), said(ahead), said(behind))
        assert r.context_start == min([*ahead, lo]) * 1.5 and r.context_end == max([*behind, hi - 1]) * 1.5 + 1
