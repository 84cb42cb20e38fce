"""Stored vectors and index, progress, retries and the command line."""
import numpy as np
import pytest

from folioforge.__main__ import main
from folioforge.operators import store as S
from folioforge.streaming import progress as P
from folioforge.streaming import streams
from tests.conftest import DATA


def test_vector_store(spark, tmp_path):
    v = S.VectorStore(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        v.search(spark.createDataFrame([], "query_id int, q array<float>"), 1)
    e = S.HashEmbedder(64)
    assert np.allclose(np.linalg.norm(e.embed(["a b c", "x"]), axis=1), 1) and not e.embed([""]).any()
    docs = spark.createDataFrame([(1, "renal beams"), (2, "coastal reefs"), (3, None)], "vec_id bigint, text string")
    v.put(S.embedded(docs, "vec_id", "text", e))
    v.put(S.embedded(spark.createDataFrame([(2, "spinal mice"), (4, "coastal reefs")], "vec_id bigint, text string"), "vec_id", "text", e))
    v.put(S.embedded(spark.createDataFrame([(5, "moss")], "vec_id bigint, text string"), "vec_id", "text", e))
    q = S.embedded(spark.createDataFrame([(9, "coastal reefs")], "query_id bigint, text string"), "query_id", "text", e).withColumnRenamed("embedding", "q")
    top = v.search(q, 1).collect()
    assert [(r.vec_id, r.rank) for r in top] == [(4, 1)] and v.read().count() == 4 and len(v.versions()) == 2
    v.reset()
    assert v.read() is None


def test_index_works_on_changes_only(spark, tmp_path):
    ix = S.SearchIndex(spark, str(tmp_path / "i"))
    df = lambda rows: spark.createDataFrame(rows, "chunk_id bigint, doc_hash string, text string")
    rows = [(1, "a", "renal beams"), (2, "a", None), (3, "b", "coastal reefs"), (4, "c", "")]
    assert ix.refresh(df(rows))[1:] == (3, 0) and ix.refresh(df(rows))[1:] == (0, 0)
    rows = [(1, "a", "renal beams"), (2, "a", "kelp"), (3, "b", "coastal reefs"), (5, "d", "reefs")]
    index, worked, gone = ix.refresh(df(rows))
    assert (worked, gone) == (2, 1) and sorted((r.chunk_id, r.n_words) for r in index.collect()) == [(1, 2), (2, 1), (3, 2), (5, 1)]
    q = spark.createDataFrame([(1, "reefs")], "query_id int, query string")
    assert [r.chunk_id for r in ix.query(q, 2).orderBy("rank").collect()] == [5, 3]


def test_retry_deadline_and_progress(spark, tmp_path):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert P.with_retry(flaky, lambda e: isinstance(e, OSError), 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        P.with_retry(lambda: {}["x"], lambda e: isinstance(e, OSError))
    assert P.within(spark, 60, "g", lambda: spark.range(3).count()) == 3
    spark.range(5).write.parquet(str(tmp_path / "in" / "t.parquet"))
    events: list[str] = []
    listener = P.Progress(lambda kind, e: events.append(kind))
    spark.streams.addListener(listener)
    try:
        streams.run_once(streams.read_parquet_stream(spark, str(tmp_path / "in"), "t"), lambda b, i: b.count(), str(tmp_path / "cp"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert "started" in events


@pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")
def test_command_line(spark, tmp_path, capsys):
    t = str(DATA / "sf0.001")
    assert main(["readers"]) == 0 and main(["list"]) == 0 and main(["run", "nothing", t, "x"], spark) == 2
    assert main(["stats", t], spark) == 0 and main(["eval", t], spark) == 0 and main(["show", t, "3"], spark) == 0
    assert main(["run", "a02_index_stats", t, str(tmp_path / "o")], spark) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 1
    assert main(["index", t, str(tmp_path / "ix")], spark) == 0 and main(["query", str(tmp_path / "ix"), "coastal"], spark) == 0
    assert main(["bibliography", t, str(tmp_path / "b")], spark) == 0
    assert "documents indexed" in capsys.readouterr().out
