"""What a query must not do again for each step."""

from cuelake.operators import batch
from cuelake.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_are_those_of_the_context(spark):
    data = [(t, p, p * 2.0, p * 2.0 + 1 + p % 3, "x") for t, n in (("a", 93), ("b", 1), ("c", 7)) for p in range(n)]
    cues = spark.createDataFrame(data, "title_id string, pos long, start double, end double, text string")
    for size, lines in ((5, 30), (5, 7), (4, 0), (3, 100)):
        want = batch.context(cues, size, lines).select("title_id", "batch_id", "context_start", "context_end")
        assert sorted(batch.bounds(cues, size, lines).collect()) == sorted(want.collect())


def test_pairing_looks_at_stored_cues(spark, sf):
    assert "l_partkey" not in plan(catalog.QUERIES["existing_pairs"](spark, sf))


def test_replies_need_no_context_lines(spark, sf):
    assert "own" not in plan(catalog.QUERIES["translated_titles"](spark, sf))
