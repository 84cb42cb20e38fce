"""Search queries: lexical, vector, fused, feature hashing."""
from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import search as S
from folioforge.plans.registry import query
from folioforge.session import materialize, table

TOK = r"list_filter(string_split(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
BM25 = f"""WITH q AS (SELECT query_id, unnest(list_distinct({TOK.format(c='query')})) AS term FROM (SELECT truth_id AS query_id, title AS query FROM latex_refs WHERE truth_id % 50 = 0 AND title IS NOT NULL)),
toks AS (SELECT chunk_id, {TOK.format(c='text')} AS w FROM chunks WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT q.query_id, p.chunk_id, sum(greatest(ln((st.n - dfs.df + 0.5) / (dfs.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.avgdl))) AS score FROM p JOIN dfs USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL)"""


def _queries(spark, d):
    """The query set: the title of every cited work whose id is divisible by 50, against all texts."""
    return table(spark, d, "latex_refs").where("truth_id % 50 = 0 and title is not null").select(F.col("truth_id").alias("query_id"), F.col("title").alias("query"))


@query("t01_lexical_top", BM25 + " SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 10")
def t01(spark, d):
    return S.top_k(S.bm25(table(spark, d, "chunks"), _queries(spark, d), "chunk_id", "text", 10), 10, "chunk_id").select("query_id", "chunk_id", "rank")


@query("x60_bm25_scores", BM25 + " SELECT query_id, chunk_id, round(score, 6) AS score FROM sc")
def x60(spark, d):
    return S.bm25(table(spark, d, "chunks"), _queries(spark, d), "chunk_id", "text").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


COS = "SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS score FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


@query("t02_vector_top", f"SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({COS})) WHERE rank <= 10")
def t02(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.vector_search(e, q, 10).select("query_id", "vec_id", "rank")


@query("t04_hybrid", None)
def t04(spark, d):
    """Lexical and vector lists over documents' embeddings by id, fused by reciprocal rank."""
    lex = S.top_k(S.bm25(table(spark, d, "documents"), _queries(spark, d), "doc_id", "text", 50), 50, "doc_id").select("query_id", F.col("doc_id").alias("key"), "rank")
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    vec = S.vector_search(e, q, 50).select("query_id", F.col("vec_id").alias("key"), "rank")
    return S.hybrid(lex, vec, 10, "key").select("query_id", "key", "rank", F.round("score", 9).alias("score"))


@query("j39_rank_fusion", BM25 + """, lst AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, 1 AS list_id, 0.7 AS weight FROM sc UNION ALL
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank, 2 AS list_id, 0.3 AS weight FROM sc)
SELECT query_id, chunk_id, round(sum(weight / (60 + rank)), 9) AS score FROM lst WHERE rank <= 50 GROUP BY ALL""")
def j39(spark, d):
    # both lists are ranked on what the batches hold for either; written once, as both read it
    s = materialize(S.bm25(table(spark, d, "chunks"), _queries(spark, d), "chunk_id", "text", 50, 50))
    a = S.top_k(s, 50, "chunk_id").select("query_id", "chunk_id", "rank", F.lit(1).alias("list_id"), F.lit(0.7).alias("weight"))
    b = S.top_k(s.withColumn("score", F.lit(0.0)), 50, "chunk_id").select("query_id", "chunk_id", "rank", F.lit(2).alias("list_id"), F.lit(0.3).alias("weight"))
    return S.reciprocal_rank_fusion(a.unionByName(b), "chunk_id").select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("x64_cosine", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1")
def x64(spark, d):
    """Cosine of each vector with the one before it."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("q"))
    return e.join(before, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("x65_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS l1 FROM embeddings")
def x65(spark, d):
    v = S.l2_normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query("a26_label_means", "SELECT label, pos, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL")
def a26(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count("*").alias("n"))


@query("x62_feature_hashing", None)
def x62(spark, d):
    """Signed FNV-1a feature hashing of words and word pairs into 64 buckets, unit length."""
    from folioforge.functions.ids import fnv1a
    from folioforge.functions.text import words
    w = words(F.col("title"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(w, i), F.try_element_at(w, i + 1)))
    f = table(spark, d, "latex_refs").where("title is not null").select("truth_id", F.explode(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("f"))
    f = f.select("truth_id", fnv1a("f").alias("h")).select("truth_id", F.pmod("h", F.lit(64)).alias("bucket"), F.when(F.col("h") < 0, -1.0).otherwise(1.0).alias("s"))
    g = f.groupBy("truth_id", "bucket").agg(F.sum("s").alias("v"))
    n = g.groupBy("truth_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return g.join(n, "truth_id").select("truth_id", "bucket", F.round(F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0), 9).alias("v"))
