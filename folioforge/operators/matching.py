"""One-to-one matching, similarity joins and record merging."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.graph import connected_components
from folioforge.operators.ledger import row_numbers
from folioforge.session import materialize


def rank_pairing(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str) -> DataFrame:
    """(lid, rid, key): the n-th left row of a key is paired with its n-th right row.

    The same as taking the first unused partner in order, without any state; ids are numbers.
    """
    a = row_numbers(left.where(F.col(key).isNotNull()).select(key, lid), [key], lid)
    b = row_numbers(right.where(F.col(key).isNotNull()).select(key, rid), [key], rid)
    return a.join(b, [key, "rn"]).select(lid, rid, key)


def cascade(left: DataFrame, right: DataFrame, keys: list[tuple[str, Column, Column]], lid: str, rid: str) -> DataFrame:
    """(lid, rid, method): passes over keys in order, each on the rows no pass before has used."""
    out = None
    for name, lk, rk in keys:
        a, b = left.select(lid, lk.alias("__k")), right.select(rid, rk.alias("__k"))
        if out is not None:
            a, b = a.join(out.select(lid), lid, "left_anti"), b.join(out.select(rid), rid, "left_anti")
        # written once: the passes behind read it, and their counts would repeat all passes before
        got = materialize(rank_pairing(a, b, "__k", lid, rid).select(lid, rid, F.lit(name).alias("method")))
        out = got if out is None else out.unionByName(got)
    return out


#: Most words whose frequencies order the words of a set; all others are rarer and come first, by their hash.
FREQUENT = 20_000
#: Sets of up to so many words meet by several shared words at once; pairs with a larger set by one.
SMALL_SET = 16


def _signatures(sets: DataFrame, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """(h, i, n, sketch): what a set meets its partners by.

    A pair at num/den shares at least c = ceil(n * num / den) words of either set, so the first n - c + m words of both hold
    m common ones. m is as many as a set must have to have a larger partner at all, three at most; smaller sets have only equal ones. The
    sketch has a bit flipped for each word: two sets differ in at least as many words as their sketches in bits.
    """
    most = max(m for m in (1, 2, 3) if (m - 1) * den < m * num)
    order = np.argsort(frequent, kind="stable")
    ranked = frequent[order]

    def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x ^ y) * np.uint64(0x9E3779B97F4A7C15)
        return z ^ (z >> np.uint64(29))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            h, row = b.column(1).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(h), np.int64)  # 0: rarer than all that are ranked
            if len(ranked):
                at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                rank = np.where(ranked[at] == h, len(ranked) - order[at], 0)
            u = h[np.lexsort((h, rank, row))].astype(np.uint64)
            start = np.cumsum(n) - n
            sketch = np.bitwise_xor.reduceat(np.uint64(1) << (u >> np.uint64(58)), start).astype(np.int64) if len(n) else np.zeros(0, np.int64)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for size in np.unique(n):
                of = np.flatnonzero(n == size)
                c = -(-int(size) * num // den)
                ways = ([min(most, int(size))] if size <= SMALL_SET else []) + ([0] if size >= -(-SMALL_SET * num // den) else [])
                for m in ways:  # 0: by one word, with or as a large set
                    for some in combinations(range(size - c + m if 0 < m <= c else size - c + 1), max(m, 1)):
                        k = np.full(len(of), m + 1, np.uint64)
                        for j in some:
                            k = mixed(k, u[start[of] + j])
                        out.append((k.astype(np.int64), of))
            if out:
                at = np.concatenate([o for _, o in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in out])), pa.array(ids[at]), pa.array(n[at], pa.int32()), pa.array(sketch[at])], ["h", "i", "n", "sketch"])

    return sets.select("i", F.transform("w", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(run, "h bigint, i bigint, n int, sketch bigint")


def jaccard_join(left: DataFrame, right: DataFrame, lid: str, rid: str, lw: str, rw: str, num: int = 4, den: int = 5) -> DataFrame:
    """(lid, rid, inter, uni) of all pairs whose word sets have a Jaccard coefficient of at least num/den.

    An exact prefix-filtered join: sets meet by the rarest words that a pair at the threshold must share,
    several at once in short sets, and sizes and sketches are compared inside the join, so that little but the pairs
    themselves leaves it. These are compared word by word.
    """
    def numbered(x: DataFrame, key: str, ws: str) -> DataFrame:
        return materialize(x.select(F.col(key).alias("id"), F.array_distinct(F.col(ws)).alias("w")).where("size(w) > 0").withColumn("i", F.monotonically_increasing_id()))

    a, b = numbered(left, lid, lw), numbered(right, rid, rw)
    words = a.select(F.explode("w").alias("w")).unionByName(b.select(F.explode("w").alias("w"))).groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("df"))
    # at most FREQUENT rows reach the driver, the most frequent first
    frequent = np.array([r.h for r in words.where("df > 1").orderBy(F.desc("df"), "h").limit(FREQUENT).collect()], np.int64)
    x, y = _signatures(a, frequent, num, den).alias("x"), _signatures(b, frequent, num, den).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    near = (n * den >= m * num) & (m * den >= n * num) & (F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) * (num + den) <= (n + m) * (den - num))
    cand = x.join(y, (F.col("x.h") == F.col("y.h")) & near).select(F.col("x.i").alias("ia"), F.col("y.i").alias("ib")).distinct()
    full = cand.join(a.select(F.col("i").alias("ia"), F.col("id").alias(lid), F.col("w").alias("wa")), "ia").join(b.select(F.col("i").alias("ib"), F.col("id").alias(rid), F.col("w").alias("wb")), "ib")
    full = full.select(lid, rid, F.size(F.array_intersect("wa", "wb")).alias("inter"), F.size(F.array_union("wa", "wb")).alias("uni"))
    return full.where(F.col("inter") * den >= F.col("uni") * num)


def merge_groups(rows: DataFrame, key: str, link_keys: list[Column]) -> DataFrame:
    """(key, grp): rows linked by any equal non-null key, transitively; grp is the least key.

    Rows of one key value are linked to the least row of that value, so a value with many rows gives
    as many links, not their square.
    """
    links = None
    for k in link_keys:
        v = rows.select(F.col(key).alias("a"), k.alias("v")).where("v is not null")
        hub = v.groupBy("v").agg(F.min("a").alias("b"))
        e = v.join(hub, "v").select("a", "b")
        links = e if links is None else links.unionByName(e)
    cc = connected_components(links)
    return rows.select(key).join(cc, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("grp"))


def first_known(rows: DataFrame, grp: str, rank: Column, fields: list[str]) -> DataFrame:
    """The first non-null value of each field by rank within a group."""
    return rows.groupBy(grp).agg(*[F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it.

    Union and a running last value: one shuffle on the key, no range join. Ties on the right go to
    the greatest value.
    """
    marked = left.withColumn("__side", F.lit(1)).unionByName(right.select(*by, at, *value).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__side", *value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked
    for v in value:
        out = out.withColumn(f"asof_{v}", F.last(F.when(F.col("__side") == 0, F.col(v)), ignorenulls=True).over(w))
    return out.where("__side = 1").drop("__side", *value)
