"""The set similarity join against all pairs, at both thresholds and for small and large sets."""
import random

import pytest

from folioforge.operators import matching as M


@pytest.mark.parametrize("num,den", [(4, 5), (3, 5), (1, 2), (2, 5), (1, 1)])
def test_jaccard_join_of_small_and_large_sets_against_all_pairs(spark, num, den):
    rng = random.Random(num)
    vocabulary = [f"w{k}" for k in range(60)]
    sets = [[]] + [rng.sample(vocabulary[:12], rng.randint(1, 5)) for _ in range(40)]
    for _ in range(25):  # sets about the border of small ones, with changed copies
        s = rng.sample(vocabulary, rng.randint(6, 30))
        sets += [s] + [[w for w in s if rng.random() > p] + rng.sample(vocabulary, rng.randint(0, 3)) for p in (0, 0.1, 0.3)]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, w array<string>")
    got = M.jaccard_join(df, df.withColumnRenamed("i", "j"), "i", "j", "w", "w", num, den).collect()
    want = {(i, j, len(set(a) & set(b)), len(set(a) | set(b))) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(set(a) & set(b)) * den >= len(set(a) | set(b)) * num}
    assert {(r.i, r.j, r.inter, r.uni) for r in got} == want and len(got) == len(want)


def test_titles_of_one_pattern_meet_by_more_than_one_word(spark):
    """300 titles over few words: pairs that meet must grow with the matches, not with the square of the titles."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(25)]
    sets = [sorted(rng.sample(words, 6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sets)), "i bigint, w array<string>")
    import numpy as np
    s = M._signatures(df, np.zeros(0, np.int64), 4, 5)
    met = s.alias("a").join(s.alias("b"), "h").count()
    assert met < 300 * 300 / 10
