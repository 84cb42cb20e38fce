"""Lexical, vector and fused search as DataFrame plans."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import words
from folioforge.session import materialize

K1, B, RRF_K = 1.2, 0.75, 60


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of every text; one row a different term."""
    return df.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Queries whose terms a task holds at once; more are searched in slices, each one pass over the texts.
SLICE = 50_000
#: Scored pairs in one batch of results.
FLUSH = 500_000


def bm25(df: DataFrame, queries: DataFrame, key: str, text: str, best: int | None = None, first: int = 0) -> DataFrame:
    """(query_id, key, score) of all texts that hold a query's term.

    ``queries`` is (query_id, query). Texts are read and cut into words once; what is shuffled and written is one row a
    text with the codes of the query terms it holds. A batch of texts then meets all queries of a slice, so
    every score is summed up where its text is and no pair is shuffled. With ``best``, a batch gives only the ``best``
    highest scores of each query and the ``first`` texts it finds in the order of their keys: those of the whole are among them.
    """
    q = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("t")).where("size(t) > 0")
    q = materialize(q.groupBy("query_id").agg(F.flatten(F.collect_list("t")).alias("t")))
    slices = max(1, -(-q.count() // SLICE))
    out = None
    for k in range(slices):
        got = _scores(df, q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k) if slices > 1 else q, key, text, best, first)
        out = got if out is None else out.unionByName(got)
    return out


def _scores(df: DataFrame, queries: DataFrame, key: str, text: str, best: int | None, first: int) -> DataFrame:
    """bm25 of at most about SLICE queries, (query_id, t); a term that stands twice in t counts twice."""
    spark, kind, q_kind = df.sparkSession, dict(df.dtypes)[key], dict(queries.dtypes)["query_id"]
    asked = queries.toArrow().combine_chunks()
    q_ids, lists = (pa.concat_arrays(asked.column(c).chunks) if asked.num_rows else pa.array([], asked.schema.field(c).type) for c in ("query_id", "t"))
    terms = pc.unique(lists.flatten())
    of = np.split(pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1]) if len(lists) else []

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten()
            code = pc.fill_null(pc.index_in(flat, value_set=terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
            held = np.bincount(np.repeat(np.arange(len(n)), n)[code >= 0], minlength=len(n))
            ends = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(code[code >= 0], pa.int32()))], ["key", "dl", "t"])

    def postings(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, length, term and frequency of each posting of a batch; texts of one key and length are one, as in the SQL."""
        p = b.column(1)
        texts = p.flatten()
        row = np.repeat(np.arange(len(p)), pc.list_value_length(p).to_numpy(zero_copy_only=False))
        dl, t = pc.struct_field(texts, "dl").to_numpy(zero_copy_only=False).astype(np.int64), pc.struct_field(texts, "t")
        both, at = np.unique(row << 32 | dl, return_inverse=True)
        posts, tf = np.unique(np.repeat(at, pc.list_value_length(t).to_numpy(zero_copy_only=False)) * max(1, len(terms)) + t.flatten().to_numpy(zero_copy_only=False), return_counts=True)
        g, code = np.divmod(posts, max(1, len(terms)))
        return both[g] >> 32, both[g] & 0xFFFFFFFF, code, tf

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            total += np.bincount(postings(b)[2], minlength=len(terms))
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(total[t], pa.int64())], ["t", "df"])

    base = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), words(F.col(text)).alias("w"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = materialize(base.mapInArrow(coded, f"key {kind}, dl int, t array<int>").repartition(parts, "key").groupBy("key").agg(F.collect_list(F.struct("dl", "t")).alias("p")))
    n, avgdl = docs.select(F.explode("p").alias("p")).agg(F.count("*"), F.avg("p.dl")).first()
    df_of = np.zeros(len(terms))
    for r in docs.mapInArrow(frequencies, "t int, df bigint").groupBy("t").agg(F.sum("df").alias("df")).toArrow().to_batches():  # one row a query term
        df_of[r.column(0).to_numpy()] = r.column(1).to_numpy()
    idf = np.maximum(np.log((n - df_of + 0.5) / (df_of + 0.5), where=n - df_of + 0.5 > 0, out=np.zeros(len(terms))), 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = b.column(0), b.num_rows
            row, dl, code, tf = postings(b)
            s = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)) if len(code) else np.zeros(0)
            order = np.argsort(code, kind="stable")
            row, code, s = row[order], code[order], s[order]
            if len(code):  # texts of one key but different lengths: one posting
                new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
                row, code, s = row[new], code[new], np.add.reduceat(s, new)
            start = np.searchsorted(code, np.arange(len(terms) + 1))
            rank = np.empty(rows, np.int64)
            rank[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(rows)
            dense: dict[int, np.ndarray] = {}
            at: list[np.ndarray] = []
            found: list[np.ndarray] = []
            score: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                got = [q_ids.take(pa.array(np.concatenate(at))), keys.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(score), pa.float64())]
                at.clear(), found.clear(), score.clear()
                return pa.RecordBatch.from_arrays(got, ["query_id", key, "score"])

            held = 0
            for j, ts in enumerate(of):
                acc = np.zeros(rows)
                for t in ts:
                    x, y = start[t], start[t + 1]
                    if (y - x) * 8 > rows:
                        if t not in dense:
                            dense[t] = np.bincount(row[x:y], s[x:y], rows)
                        acc += dense[t]
                    elif y > x:
                        acc[row[x:y]] += s[x:y]
                hit = np.flatnonzero(acc)
                if best is not None and len(hit) > best:
                    r = np.floor(acc[hit] * 1e9 + 0.5)  # the 9 digits by which top_k ranks
                    most = hit[r >= np.partition(r, len(hit) - best)[len(hit) - best]]
                    if len(most) > best:
                        most = most[np.lexsort((rank[most], -np.floor(acc[most] * 1e9 + 0.5)))[:best]]
                    hit = np.union1d(most, hit[np.argsort(rank[hit])[:first]]) if first else most
                if len(hit):
                    at.append(np.full(len(hit), j)), found.append(hit), score.append(acc[hit])
                    held += len(hit)
                    if held >= FLUSH:
                        yield flush()
                        held = 0
            if held:
                yield flush()

    return docs.mapInArrow(run, f"query_id {q_kind}, `{key}` {kind}, score double")


def top_k(scores: DataFrame, k: int, key: str, by: str = "query_id") -> DataFrame:
    """The k best of each query, ties by ascending key, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where the lengths differ or a norm is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


#: Vectors in one block of either side.
BLOCK = 2048


def _blocks(df: DataFrame, key: str, vec: str, block: int, name: str) -> DataFrame:
    """(name_ids, name_v): about ``block`` rows of a side in one row, by the hash of their key."""
    many = max(1, -(-df.count() // block))
    g = df.groupBy(F.pmod(F.xxhash64(key), F.lit(many)).alias("b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v"))).alias("r"))
    return g.select(F.col("r.k").alias(f"{name}_ids"), F.col("r.v").alias(f"{name}_v"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): exact cosine top k of each query vector, ties by ascending key.

    ``queries`` is (query_id, q), a stated query set. Both sides are cut into blocks of bounded size and every
    block of queries meets every block of vectors, one matrix product each, in one job; a pair of blocks gives
    the k best of each query, so what is shuffled is k rows a query and block. Vectors of another length than
    the query score 0, as do zero ones; null vectors aren't found.
    """
    base = vectors.select(F.col(key), F.col(vec).alias("v")).where("v is not null")
    qs = materialize(queries.where("q is not null").select("query_id", "q"))
    kinds = dict(base.dtypes)[key], dict(qs.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vs, q_ids, qv = (batch.column(c)[row].as_py() for c in range(4))
                out: list[tuple] = []
                for dim in sorted({len(x) for x in qv}):
                    at = [j for j, x in enumerate(qv) if len(x) == dim]
                    m = np.array([qv[j] for j in at], np.float64).reshape(len(at), dim)
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                    x = np.array([v if len(v) == dim else [0.0] * dim for v in vs], np.float64).reshape(len(vs), dim)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    s = np.round(m @ x.T, 9) + 0.0
                    for r, j in enumerate(at):
                        least = np.partition(s[r], len(ids) - k)[len(ids) - k] if len(ids) > k else -2.0
                        near = sorted((-float(s[r][t]), ids[t]) for t in np.flatnonzero(s[r] >= least))[:k]  # ties at the end are ranked by key
                        out += [(q_ids[j], kk, -v) for v, kk in near]
                yield pa.RecordBatch.from_pydict({"query_id": [o[0] for o in out], key: [o[1] for o in out], "score": [o[2] for o in out]}, schema=schema)

    kind = lambda t: pa.string() if t == "string" else pa.int64() if t == "bigint" else pa.int32()
    schema = pa.schema([("query_id", kind(kinds[1])), (key, kind(kinds[0])), ("score", pa.float64())])
    pairs = _blocks(base, key, "v", block, "v").crossJoin(_blocks(qs, "query_id", "q", block, "q"))
    return top_k(pairs.mapInArrow(run, f"query_id {kinds[1]}, `{key}` {kinds[0]}, score double"), k, key)


def reciprocal_rank_fusion(lists: DataFrame, key: str, by: str = "query_id") -> DataFrame:
    """Sum of weight / (60 + rank) over ranked lists (by, list_id, weight, key, rank)."""
    first = lists.groupBy(by, "list_id", "weight", key).agg(F.min("rank").alias("rank"))
    return first.groupBy(by, key).agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, key: str, alpha: float = 0.5, by: str = "query_id") -> DataFrame:
    """Fused top k of both searches at depth max(4k, 50); alpha weighs the vectors."""
    alpha = 0.5 if alpha != alpha else min(1.0, max(0.0, alpha))
    depth = max(4 * k, 50)
    both = lexical.where(F.col("rank") <= depth).select(by, key, "rank", F.lit("lexical").alias("list_id"), F.lit(1 - alpha).alias("weight")).unionByName(
        vector.where(F.col("rank") <= depth).select(by, key, "rank", F.lit("vector").alias("list_id"), F.lit(alpha).alias("weight")))
    return top_k(reciprocal_rank_fusion(both, key, by), k, key, by)


def keyset_page(df: DataFrame, created: str, key: str, cursor: tuple | None, limit: int) -> DataFrame:
    """One page in (created, key) descending order after a cursor, with one row more to know of a next page."""
    if cursor is not None:
        at, last = (F.lit(cursor[0]), F.lit(cursor[1]))
        df = df.where((F.col(created) < at) | (F.col(created) == at) & (F.col(key) < last))
    return df.orderBy(F.desc(created), F.desc(key)).limit(limit + 1)
