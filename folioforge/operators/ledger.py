"""Ledger operators: runs, documents, chunks and their latest versions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USABLE = ("complete", "partial")
#: Worst last, as the maximum over a document's chunks.
STATUS_RANK = {"complete": 0, "partial": 1, "deferred": 2, "failed": 3}


def status_rank(c: str = "status") -> Column:
    out = F.lit(None).cast("int")
    for k, v in STATUS_RANK.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def delivered_once(runs: DataFrame) -> DataFrame:
    """One row for each run_id: the delivery that landed last.

    max_by aggregates on the map side, so no run's deliveries are sorted in one task.
    """
    cols = [c for c in runs.columns if c != "run_id"]
    return runs.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.struct(*[c for c in ("landed_at", "finished_at", "started_at", "status") if c in cols])).alias("r")).select("run_id", "r.*")


def latest_run(runs: DataFrame, usable_only: bool = True) -> DataFrame:
    """The run of each doc_hash that finished last, ties to the larger run_id."""
    r = delivered_once(runs)
    if usable_only:
        r = r.where(F.col("status").isin(*USABLE))
    cols = [c for c in r.columns if c != "doc_hash"]
    return r.groupBy("doc_hash").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("finished_at", F.lit(-1).cast("bigint")), "run_id")).alias("r")).select("doc_hash", "r.*")


def chunk_groups(chunks: DataFrame, size: int = 20) -> DataFrame:
    """Groups of ``size`` pages of a run: page range, number of chunks, digest of the texts in order."""
    g = chunks.groupBy("doc_hash", "run_id", F.floor((F.col("page") - 1) / size).alias("grp"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return g.agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("chunks"), F.sha2(F.array_join(texts, "\n\f\n"), 256).alias("digest"))


def merge_runs(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent publish: rows of ``batch`` replace those of equal identity (K01, K03, K04); null keys are equal."""
    b = batch.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = c if cond is None else cond & c
    return target.join(b, cond, "left_anti").unionByName(batch)


#: Ranges into which the order of a ranking is cut.
RANK_RANGES = 256


def row_numbers(df: DataFrame, by: list[str], order: str, name: str = "rn", ties: list[str] = ()) -> DataFrame:
    """``df`` with the row number within ``by`` in ascending ``order`` (numeric), then ``ties``.

    The order is cut into RANK_RANGES ranges; a row's number is the count of its key's rows in lower ranges, from a
    small table, plus its number within its range. A key that holds a third of all rows is so sorted by many tasks.
    """
    ends = df.agg(F.min(order).cast("double").alias("lo"), F.max(order).cast("double").alias("hi")).first()
    lo, hi = ends.lo or 0.0, ends.hi or 0.0
    r = F.least(F.floor((F.col(order).cast("double") - F.lit(lo)) / F.lit(max(hi - lo, 1e-300)) * RANK_RANGES), F.lit(RANK_RANGES - 1)) if hi > lo else F.lit(0).cast("bigint")
    x = df.withColumn("__r", F.when(F.col(order).isNull(), F.lit(-1).cast("bigint")).otherwise(r.cast("bigint")))  # a null order comes first
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    n = x.groupBy(*by, "__r").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    n = n.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.col("__r").alias("__q"), "__before")
    same = F.col("__r") == F.col("__q")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
    own = F.row_number().over(Window.partitionBy(*by, "__r").orderBy(order, *ties))
    return x.withColumn("__own", own).join(n, same).select(*df.columns, (F.col("__before") + F.col("__own")).cast("int").alias(name))


def running_sum(df: DataFrame, by: list[str], rn: str, value: str, name: str = "upto", block: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of ``by`` in the order of its row number ``rn`` (from ``row_numbers``).

    Blocks of row numbers are summed first, so a key with very many rows is spread over its blocks.
    """
    x = df.withColumn("__b", F.floor((F.col(rn) - 1) / block))
    before = F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    t = x.groupBy(*by, "__b").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__s")).withColumn("__before", F.coalesce(before, F.lit(0)))
    t = t.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.col("__b").alias("__q"), "__before")
    same = F.col("__b") == F.col("__q")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
    own = F.sum(value).over(Window.partitionBy(*by, "__b").orderBy(rn).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("__own", F.coalesce(own, F.lit(0))).join(t, same).select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))


def shifted(df: DataFrame, by: list[str], rn: str, value: str, by_rows: int, name: str) -> DataFrame:
    """``df`` with the value of the row ``by_rows`` further on in ``by`` (negative: before), joined by row number."""
    o = df.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], (F.col(rn) - by_rows).alias("__rn"), F.col(value).alias(name))
    same = F.col(rn) == F.col("__rn")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
    return df.join(o, same, "left").select(*df.columns, name)
