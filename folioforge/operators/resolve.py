"""Greedy one-to-one matching in full, and resolving entries against landed records."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.session import materialize, ship


def greedy_match(candidates: DataFrame, truth: str, other: str, order: list[Column]) -> DataFrame:
    """(truth, other) of the greedy assignment: each truth row in ascending order takes its best unused partner.

    ``order`` ranks a row's partners, ties by ascending ``other``. A pair is final if it is the best one left of its
    truth row and no smaller truth row still has that partner as a candidate; the least open row always is, so
    each round ends some, and the result is the one of going through the rows one by one.
    """
    rank = F.row_number().over(Window.partitionBy(truth).orderBy(*order, other))
    left = materialize(candidates.withColumn("__r", rank).select(truth, other, "__r"))
    done = None
    while not left.isEmpty():
        best = left.groupBy(truth).agg(F.min_by(other, "__r").alias(other))
        first = left.groupBy(other).agg(F.min(truth).alias(truth))
        final = materialize(best.join(first, [truth, other]))
        done = final if done is None else done.unionByName(final)
        left = materialize(left.join(final.select(truth), truth, "left_anti").join(final.select(other), other, "left_anti"))
    return done if done is not None else left.select(truth, other)


def greedy_within(candidates: DataFrame, truth: str, other: str, key: str) -> DataFrame:
    """(truth, other) of greedy_match with partners in ascending order, where no row has candidates under two keys.

    Each key is gone through row by row in one task, so the work doesn't grow in rounds with the rows of a key;
    a task holds one key's candidates at a time.
    """
    kinds = dict(candidates.dtypes)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        done: dict = {}
        used: set = set()
        for t, o in x.sort_values([truth, other])[[truth, other]].itertuples(index=False):
            if t not in done and o not in used:
                done[t] = o
                used.add(o)
        return pd.DataFrame({truth: list(done), other: list(done.values())}, columns=[truth, other])

    ship(candidates.sparkSession)
    return candidates.select(key, truth, other).groupBy(key).applyInPandas(run, f"`{truth}` {kinds[truth]}, `{other}` {kinds[other]}")


def verified_entries(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(ref_id, doi, outcome) of entries against registry records of the same normalised title.

    ``records`` is (key, doi, year, surname). accepted: the year differs by one at most and the surname, where
    both know it, agrees; ambiguous: accepted records with different DOIs; mismatch: none is accepted.
    """
    e = entries.select("ref_id", "year", T.normalize_title("surname").alias("s"), T.normalize_title("title").alias("key")).where("key != ''")
    r = records.select("key", "doi", F.col("year").alias("r_year"), F.col("surname").alias("r_s")).where("doi is not null").distinct()
    j = e.join(r, "key")
    ok = (F.col("year").isNull() | F.col("r_year").isNull() | (F.abs(F.col("year") - F.col("r_year")) <= 1)) & (F.col("s").isNull() | F.col("r_s").isNull() | (F.col("s") == F.col("r_s")))
    g = j.groupBy("ref_id").agg(F.count_distinct(F.when(ok, F.col("doi"))).alias("dois"), F.min(F.when(ok, F.col("doi"))).alias("doi"))
    outcome = F.when(F.col("dois") == 1, "accepted").when(F.col("dois") > 1, "ambiguous").otherwise("mismatch")
    return g.select("ref_id", F.when(F.col("dois") == 1, F.col("doi")).alias("doi"), outcome.alias("outcome"))


def rejections(attempts: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, rejected): some attempt is a mismatch and none ambiguous."""
    return attempts.groupBy(key).agg((F.bool_or(F.col("outcome") == "mismatch") & ~F.bool_or(F.col("outcome") == "ambiguous")).alias("rejected"))


def paper_records(papers: DataFrame, records: DataFrame, least: float = 0.85, margin: float = 0.05) -> DataFrame:
    """(paper, doi, score): the record whose title agrees best, unless another DOI comes within the margin.

    ``papers`` is (paper, title), ``records`` is (doi, title). Candidates are found by the exact prefix join of
    word sets at 3/5, which every title of that agreement reaches but for one of very few words; these are met by equality.
    """
    from folioforge.operators.matching import jaccard_join
    p = papers.where("title is not null").select("paper", T.normalize_title("title").alias("pt")).where("pt != ''")
    r = records.where("doi is not null and title is not null").select("doi", T.normalize_title("title").alias("rt")).where("rt != ''").distinct()
    tp, tr = p.select("pt").distinct(), r.select("rt").distinct()
    near = jaccard_join(tp.withColumn("w", F.split("pt", " ")), tr.withColumn("w", F.split("rt", " ")), "pt", "rt", "w", "w", 3, 5).select("pt", "rt")
    near = near.union(tp.join(tr, F.col("pt") == F.col("rt")).select("pt", "rt")).distinct()
    # over different titles, not over papers and records
    near = near.withColumn("score", T.similarity("pt", "rt")).where(F.col("score") >= least)
    j = p.join(near, "pt").join(r, "rt")
    best = j.groupBy("paper").agg(F.max_by(F.struct("doi", "score"), F.struct("score", "doi")).alias("b"))
    rival = j.join(best, "paper").where((F.col("doi") != F.col("b.doi")) & (F.col("b.score") - F.col("score") < margin)).select("paper").distinct()
    return best.join(rival, "paper", "left_anti").select("paper", "b.doi", "b.score")
