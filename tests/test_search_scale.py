"""Lexical search on what grows with texts and queries alike: scores are made where the texts are."""
import math
import random

import pytest

from folioforge.operators import search as S
from folioforge.plans import registry
from tests.conftest import DATA


def brute(texts, queries):
    """{(query_id, key): score}, as the SQL states it: postings by key, length and term."""
    docs = [(k, t.split()) for k, t in texts if t is not None]
    n, avgdl = len(docs), sum(len(w) for _, w in docs) / len(docs)
    tf, out = {}, {}
    for k, w in docs:
        for t in w:
            tf[k, len(w), t] = tf.get((k, len(w), t), 0) + 1
    df = {t: sum(x[2] == t for x in tf) for _, _, t in tf}
    for q, text in queries:
        for t in set((text or "").split()):
            for (k, dl, u), f in tf.items():
                if u == t:
                    idf = max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6)
                    out[q, k] = out.get((q, k), 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))
    return out


@pytest.mark.parametrize("slices", [50_000, 2])
def test_bm25_against_brute_force_without_a_shuffle_of_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(S, "SLICE", slices)
    rng = random.Random(3)
    vocabulary = ["the", "of", "reef", "kelp", "größe", "x1", "sand"]
    texts = [(i, " ".join(rng.choices(vocabulary, (9, 6, 1, 1, 1, 1, 1), k=rng.randint(0, 9)))) for i in range(60)]
    texts += [(3, "the reef reef"), (3, "reef the the"), (4, "kelp"), (100, None), (None, "reef sand")]
    queries = [(1, "the reef"), (1, "reef kelp"), (2, "of of größe"), (3, "nothing"), (4, None), (5, "sand"), (6, "the")]
    want = brute(texts, queries)
    t, q = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(queries, "query_id int, query string")
    df = S.bm25(t, q, "k", "text")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert {(r.query_id, r.k): pytest.approx(r.score) for r in rows} == want and len(rows) == len(want)
    best = S.bm25(t, q, "k", "text", 2, 3)
    for by, k in (("score", 2), ("key", 3)):
        ranked = lambda p: sorted((v, (-round(s, 9) if by == "score" else 0, -math.inf if key is None else key)) for (v, key), s in p.items())
        heads = lambda p: {v: [x[1][1] for x in ranked(p) if x[0] == v][:k] for v in {v for v, _ in p}}
        assert heads({(r.query_id, r.k): r.score for r in best.collect()}) == heads(want)


def ranked_rows(spark, monkeypatch, name):
    """Rows that the query's lexical ranking orders, and the number of scored pairs."""
    seen, d, top_k = [], str(DATA / "sf0.01"), S.top_k
    monkeypatch.setattr(S, "top_k", lambda s, *a: seen.append(s.count()) or top_k(s, *a))
    table = "documents" if name == "t04_hybrid" else "chunks"
    registry.queries()[name](spark, d)
    texts = spark.read.parquet(f"{d}/{table}.parquet")
    from folioforge.plans.search import _queries
    return seen[0], S.bm25(texts, _queries(spark, d), texts.columns[0] if table == "documents" else "chunk_id", "text").count()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["t01_lexical_top", "j39_rank_fusion", "t04_hybrid"])
def test_ranking_orders_only_the_best_of_each_batch(spark, monkeypatch, name):
    ranked, scored = ranked_rows(spark, monkeypatch, name)
    assert ranked < scored / 2
