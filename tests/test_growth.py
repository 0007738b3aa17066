"""Plans and work that have to stay small while tables grow."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docaudit.plans import planted  # noqa: F401
from docaudit.plans.catalogue import queries

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_decks_never_pass_through_the_driver(spark):
    """tables made of a narrow one are far larger than its file, so they aren't broadcast, and shared steps are planned once."""
    plan = plan_of(queries()["storyline_findings"](spark, DATA))
    assert plan.count("BroadcastExchange") <= 1 and plan.count("Scan parquet") < 60  # the twenty rows of capacities


def test_a_line_is_measured_once(spark):
    """gaps and heights are put in order once a line and candidate, not anew for each use."""
    from docaudit.functions import lines

    assert str(lines.height_split(F.col("t"), F.col("g"))).count("array_sort") <= 4


def test_vectors_go_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """a row is copied as often in a table of 500,000 as in one of 40,000; tiles of blocks give all pairs."""
    import numpy as np

    from docaudit.operators import stats

    assert stats.n_blocks(40_000) == stats.n_blocks(500_000) == stats.BLOCKS and stats.n_blocks(0) == 1
    monkeypatch.setattr(stats, "BLOCK_ROWS", 5)
    monkeypatch.setattr(stats, "BLOCKS", 2)
    v = np.random.default_rng(3).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    s = v @ v.T
    near = (s >= 1.5) & ~np.eye(60, dtype=bool)
    assert {r.id: r.n_close for r in stats.close_counts(rows, "id", "v", 1.5).collect()} == {i: int(n) for i, n in enumerate(near.sum(1)) if n}
    pairs = sorted(((s[a, b], a, b) for a in range(60) for b in range(a + 1, 60)), reverse=True)
    assert [(r.a, r.b) for r in stats.top_pairs(rows, "id", "v", 7).collect()] == [p[1:] for p in pairs[:7]]
    assert stats.similarity_report(rows, "id", "v", 1.5).first().n_pairs == len(pairs)


def test_pairs_are_made_of_distinct_rows(spark):
    """rows are made distinct before they meet, so that pairs aren't gathered to be so."""
    from docaudit.operators import graph

    rows = spark.createDataFrame([("n", "x", 1), ("n", "x", 1), ("n", "x", 2), ("n", "x", 3), ("n", "y", 4), ("n", None, 5), ("n", None, 6), ("m", "x", 7)], "g string, v string, k int")
    pairs = graph.pairwise_equal(rows, "k", ["g"], "v")
    assert sorted(tuple(r) for r in pairs.collect()) == [("n", "x", 1, 2), ("n", "x", 1, 3), ("n", "x", 2, 3)]
    top = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top


def test_lines_are_counted_where_they_are(spark, monkeypatch):
    """with an index that tasks can hold no candidate is shuffled; blocks of any size count the same."""
    import random

    from docaudit.operators import grams

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    lines = spark.createDataFrame([(i, text(rng.randint(0, 60))) for i in range(150)] + [(900, None)], "line_id long, line string")
    entries = spark.createDataFrame([(i, text(rng.randint(0, 80))) for i in range(20)] + [(90, None)], "entry_id long, entry string")
    key = lambda d: sorted(map(tuple, d.collect()))
    found = grams.sharing(lines, entries, 3, 0.45)
    assert "Exchange" not in plan_of(found)
    want = key(grams.sharing(lines, entries, 3, 0.45, sent=0))
    assert key(found) == want and want
    monkeypatch.setattr(grams, "LOOKED_AT", 7)
    assert key(grams.sharing(lines, entries, 3, 0.45)) == want
