"""The greedy assignment by keys equals the one in rounds."""
import random

from pyspark.sql import functions as F

from folioforge.operators import resolve as R


def test_greedy_within_equals_greedy_match(spark):
    rng = random.Random(8)
    rows = sorted({(k, k * 100 + rng.randrange(6), k * 100 + rng.randrange(6)) for k in range(4) for _ in range(12)})
    c = spark.createDataFrame(rows, "k int, t bigint, o bigint").coalesce(2)
    got = [(r.t, r.o) for r in R.greedy_within(c, "t", "o", "k").collect()]
    done, used = {}, set()
    for _, t, o in rows:
        if t not in done and o not in used:
            done[t] = o
            used.add(o)
    assert sorted(got) == sorted(done.items())
    assert sorted(got) == sorted((r.t, r.o) for r in R.greedy_match(c, "t", "o", [F.lit(0)]).collect())
