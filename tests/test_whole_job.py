"""Cases that an earlier form of a query lost."""
import re

import pytest

from folioforge.plans import registry


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_title_agreement_over_whole_entries(spark, tmp_path):
    rows = [(1, "Größe der Böden", "Zarubamel, Q. and Losobranoski, A. and Klokehaveski, A. and Modrevin, B. and Tarudi, S. Größe der Böden. J. 1"), (2, "renal beams", "renal beams"), (3, None, "x"), (4, "Ёлка", "ёлка!")]
    spark.createDataFrame(rows, "ref_id bigint, title string, raw string").write.parquet(str(tmp_path / "extracted_refs.parquet"))
    got = {r.ref_id: r.value for r in registry.queries()["x10_title_agreement"](spark, str(tmp_path)).collect()}
    for i, a, b in rows:
        a, b = (" ".join(re.findall(r"[^\W_]+", (x or "").lower())) for x in (a, b))
        assert got[i] == pytest.approx(1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0, abs=1e-6)


def test_similarity_of_stored_letters(spark, tmp_path):
    rows = [(1, "Größe, Ä.", "Größe"), (2, None, None), (3, "", "x"), (4, "Ёлка", "Ёлки"), (5, "💡b", "b"), (6, "same", "same")]
    spark.createDataFrame(rows, "ref_id bigint, author string, surname string").write.parquet(str(tmp_path / "extracted_refs.parquet"))
    got = {r.ref_id: r.value for r in registry.queries()["x09_similarity"](spark, str(tmp_path)).collect()}
    for i, a, b in rows:
        a, b = a or "", b or ""
        assert got[i] == pytest.approx(1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0, abs=1e-6)


def test_late_deliveries_in_many_files(spark, tmp_path):
    for i in range(10):  # the last files hold the oldest rows
        df = spark.createDataFrame([(i, f"20{20 - i:02d}-01-01 00:00:00"), (0, "2020-01-01 00:00:00")], "run_id bigint, landed_at string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "runs.parquet"))
    got = [r.run_id for r in registry.queries()["st08_deliveries_once"](spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(10))


def test_word_error_rate_against_word_by_word_distance(spark):
    import random

    from folioforge.operators.text_ops import word_error_rate
    rng = random.Random(2)
    words = ["reef", "kelp", "Größe", "土", "a", "💡"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 7))), " ".join(rng.choices(words, k=rng.randint(0, 7)))) for i in range(80)] + [(900, None, "x"), (901, "x", None), (902, "  ", "x"), (903, " a  a ", "a a")]
    rows.append((904, " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(1, 3000))))
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", word_error_rate("a", "b").alias("v")).collect()}
    assert got.pop(904) == pytest.approx(1 / 3000)
    for i, a, b in rows[:-1]:
        a, b = (a or "").split(), (b or "").split()
        assert got[i] == (pytest.approx(distance(a, b) / len(a)) if a else None)
