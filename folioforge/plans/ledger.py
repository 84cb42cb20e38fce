"""Queries over the ledger: runs, chunks, manifest, references."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import ledger as L
from folioforge.plans.registry import query
from folioforge.session import table

ONE_RUN = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY landed_at DESC, finished_at DESC, started_at DESC, status DESC) rn FROM runs) WHERE rn = 1)"
LATEST = f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY coalesce(finished_at, -1) DESC, run_id DESC) rn FROM {ONE_RUN} WHERE status IN ('complete', 'partial')) WHERE rn = 1)"
LATEST_ANY = LATEST.replace(" WHERE status IN ('complete', 'partial')", "")


@query("j01_latest_run", f"SELECT r.doc_hash, r.run_id, r.status, r.finished_at, count(c.chunk_id) AS chunks FROM {LATEST} r LEFT JOIN chunks c ON c.run_id = r.run_id AND c.doc_hash = r.doc_hash GROUP BY ALL")
def j01(spark, d):
    r = L.latest_run(table(spark, d, "runs")).select("doc_hash", "run_id", "status", "finished_at")
    n = table(spark, d, "chunks").groupBy("doc_hash", "run_id").agg(F.count("chunk_id").alias("chunks"))
    return r.join(n, ["doc_hash", "run_id"], "left").select("doc_hash", "run_id", "status", "finished_at", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("j02_corpus", f"SELECT m.doc_hash, m.title, m.pub_year, r.run_id, r.status FROM (SELECT doc_hash, max(title) AS title, max(pub_year) AS pub_year FROM manifest_item GROUP BY doc_hash) m LEFT JOIN {LATEST_ANY} r ON r.doc_hash = m.doc_hash")
def j02(spark, d):
    m = table(spark, d, "manifest_item").groupBy("doc_hash").agg(F.max("title").alias("title"), F.max("pub_year").alias("pub_year"))
    r = L.latest_run(table(spark, d, "runs"), usable_only=False).select("doc_hash", "run_id", "status")
    return m.join(r, "doc_hash", "left").select("doc_hash", "title", "pub_year", "run_id", "status").orderBy(F.col("title").isNull(), F.lower(F.coalesce("title", "doc_hash")), "doc_hash")


@query("s16_load_run", f"SELECT r.run_id, r.doc_hash, count(x.ref_id) AS refs, count(x.doi) AS with_doi, min(x.idx) AS first_idx, max(x.idx) AS last_idx FROM {LATEST} r LEFT JOIN extracted_refs x ON x.run_id = r.run_id AND x.doc_hash = r.doc_hash GROUP BY ALL")
def s16(spark, d):
    r = L.latest_run(table(spark, d, "runs")).select("run_id", "doc_hash")
    x = table(spark, d, "extracted_refs").groupBy("run_id", "doc_hash").agg(F.count("ref_id").alias("refs"), F.count("doi").alias("with_doi"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return r.join(x, ["run_id", "doc_hash"], "left").select("run_id", "doc_hash", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("with_doi", F.lit(0)).alias("with_doi"), "first_idx", "last_idx")


@query("s24_run_pages", f"SELECT c.doc_hash, c.page, string_agg(coalesce(c.text, ''), chr(10) ORDER BY c.idx) AS text FROM chunks c JOIN {LATEST} r ON r.run_id = c.run_id AND r.doc_hash = c.doc_hash GROUP BY c.doc_hash, c.page")
def s24(spark, d):
    r = L.latest_run(table(spark, d, "runs")).select("run_id", "doc_hash")
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return table(spark, d, "chunks").join(r, ["run_id", "doc_hash"]).groupBy("doc_hash", "page").agg(t.alias("text"))


@query("a01_stats", """SELECT (SELECT count(DISTINCT run_id) FROM runs) AS runs, (SELECT count(DISTINCT run_id) FROM runs WHERE status = 'complete') AS complete,
(SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks WHERE text = '') AS empty_chunks, (SELECT count(*) FROM extracted_refs) AS refs, (SELECT count(*) FROM extracted_refs WHERE doi IS NOT NULL) AS refs_with_doi,
(SELECT count(*) FROM latex_refs) AS truth, (SELECT count(DISTINCT doc_hash) FROM manifest_item) AS papers, (SELECT count(*) FROM documents) AS documents""")
def a01(spark, d):
    one = lambda t, **c: table(spark, d, t).agg(*[e.alias(k) for k, e in c.items()])
    out = one("runs", runs=F.count_distinct("run_id"), complete=F.count_distinct(F.when(F.col("status") == "complete", F.col("run_id"))))
    for x in (one("chunks", chunks=F.count("*"), empty_chunks=F.count_if(F.col("text") == "")), one("extracted_refs", refs=F.count("*"), refs_with_doi=F.count("doi")),
              one("latex_refs", truth=F.count("*")), one("manifest_item", papers=F.count_distinct("doc_hash")), one("documents", documents=F.count("*"))):
        out = out.crossJoin(x)  # one row each
    return out


@query("a02_index_stats", "SELECT count(DISTINCT doc_hash) AS docs, count(*) AS chunks FROM chunks")
def a02(spark, d):
    return table(spark, d, "chunks").agg(F.count_distinct("doc_hash").alias("docs"), F.count("*").alias("chunks"))


@query("a03_chunk_groups", "SELECT doc_hash, run_id, ((page - 1) // 20) AS grp, min(page) AS first_page, max(page) AS last_page, count(*) AS chunks, sha256(string_agg(coalesce(text, ''), chr(10) || chr(12) || chr(10) ORDER BY idx)) AS digest FROM chunks GROUP BY doc_hash, run_id, grp")
def a03(spark, d):
    return L.chunk_groups(table(spark, d, "chunks"))


@query("a04_page_counts", r"SELECT doc_hash, count(*) AS n, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 20) AS sparse, count(*) FILTER (coalesce(text, '') = '') AS empty FROM chunks GROUP BY doc_hash")
def a04(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "chunks").groupBy("doc_hash").agg(F.count("*").alias("n"), F.count_if(F.length(F.regexp_replace(t, r"\s", "")) < 20).alias("sparse"), F.count_if(t == "").alias("empty"))


@query("a05_route", r"""SELECT doc_hash, pages, unmapped, scanned, CASE WHEN unmapped > 0 THEN 'mapping' WHEN scanned > 0 THEN 'ocr' ELSE 'default' END AS route FROM (
SELECT doc_hash, count(*) AS pages, count(*) FILTER (regexp_matches(coalesce(text, ''), '[\x{FFFD}\x{E000}-\x{F8FF}]')) AS unmapped, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 20) AS scanned FROM chunks GROUP BY doc_hash)""")
def a05(spark, d):
    """Counts of pages with unmapped characters and with (almost) no text; unmapped ones decide before scanned ones."""
    t = F.coalesce("text", F.lit(""))
    x = table(spark, d, "chunks").groupBy("doc_hash").agg(F.count("*").alias("pages"), F.count_if(t.rlike("[\\uFFFD\\uE000-\\uF8FF]")).alias("unmapped"), F.count_if(F.length(F.regexp_replace(t, r"\s", "")) < 20).alias("scanned"))
    return x.select("*", F.when(F.col("unmapped") > 0, "mapping").when(F.col("scanned") > 0, "ocr").otherwise("default").alias("route"))


@query("k01_publish", f"SELECT run_id, doc_hash, status, landed_at FROM {ONE_RUN}")
def k01(spark, d):
    return L.delivered_once(table(spark, d, "runs")).select("run_id", "doc_hash", "status", "landed_at")


@query("w02_run_for_prefix", f"SELECT substring(doc_hash, 1, 2) AS prefix, max(finished_at) AS finished_at, count(*) AS runs FROM {ONE_RUN} GROUP BY 1")
def w02(spark, d):
    return L.delivered_once(table(spark, d, "runs")).groupBy(F.substring("doc_hash", 1, 2).alias("prefix")).agg(F.max("finished_at").alias("finished_at"), F.count("*").alias("runs"))


@query("j37_coverage", """SELECT coalesce(m.doc_hash, r.doc_hash) AS doc_hash, CASE WHEN r.doc_hash IS NULL THEN 'missing' WHEN m.doc_hash IS NULL THEN 'unexpected' WHEN m.n > 1 THEN 'several_versions' ELSE 'ok' END AS coverage
FROM (SELECT doc_hash, count(*) n FROM manifest_item GROUP BY 1) m FULL JOIN (SELECT DISTINCT doc_hash FROM runs WHERE status = 'complete') r ON m.doc_hash = r.doc_hash""")
def j37(spark, d):
    m = table(spark, d, "manifest_item").groupBy("doc_hash").agg(F.count("*").alias("n"))
    r = table(spark, d, "runs").where("status = 'complete'").select("doc_hash").distinct().withColumn("has_run", F.lit(True))
    return m.join(r, "doc_hash", "full_outer").select("doc_hash", F.when(F.col("has_run").isNull(), "missing").when(F.col("n").isNull(), "unexpected").when(F.col("n") > 1, "several_versions").otherwise("ok").alias("coverage"))


@query("j03_citation_targets", r"""WITH mk AS (SELECT DISTINCT c.doc_hash, c.run_id, unnest(regexp_extract_all(c.text, '\[([0-9]+)\]', 1))::INT AS number FROM chunks c)
SELECT mk.doc_hash, mk.run_id, mk.number, x.ref_id FROM mk JOIN extracted_refs x ON x.doc_hash = mk.doc_hash AND x.run_id = mk.run_id AND x.idx = mk.number - 1""")
def j03(spark, d):
    mk = table(spark, d, "chunks").select("doc_hash", "run_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("n")).select("doc_hash", "run_id", F.col("n").try_cast("int").alias("number")).distinct()
    x = table(spark, d, "extracted_refs").select("doc_hash", "run_id", (F.col("idx") + 1).alias("number"), "ref_id")
    return mk.join(x, ["doc_hash", "run_id", "number"]).select("doc_hash", "run_id", "number", "ref_id")


@query("w03_chunk_index", "SELECT chunk_id, row_number() OVER (PARTITION BY doc_hash, run_id ORDER BY page, idx, chunk_id) - 1 AS pos FROM chunks")
def w03(spark, d):
    c = table(spark, d, "chunks").select("doc_hash", "run_id", "page", "idx", "chunk_id")
    return L.row_numbers(c, ["doc_hash", "run_id"], "page", "n", ["idx", "chunk_id"]).select("chunk_id", (F.col("n") - 1).alias("pos"))


@query("w08_namespace", """SELECT ref_id, sum(CASE WHEN number <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_hash, run_id ORDER BY idx)::BIGINT AS namespace FROM (
SELECT ref_id, doc_hash, run_id, idx, number, lag(number) OVER (PARTITION BY doc_hash, run_id ORDER BY idx) AS prev FROM (SELECT *, nullif(regexp_extract(coalesce(label, ''), '([0-9]{1,6})', 1), '')::INT AS number FROM extracted_refs))""")
def w08(spark, d):
    by = ["doc_hash", "run_id"]
    x = table(spark, d, "extracted_refs").select("ref_id", *by, "idx", F.nullif(F.regexp_extract(F.coalesce("label", F.lit("")), "([0-9]{1,6})", 1), F.lit("")).cast("int").alias("number"))
    x = L.shifted(L.row_numbers(x, by, "idx"), by, "rn", "number", -1, "prev")
    x = x.withColumn("again", F.when(F.col("number") <= F.col("prev"), 1).otherwise(0).cast("bigint"))
    return L.running_sum(x, by, "rn", "again", "namespace").select("ref_id", "namespace")


@query("w09_numbered_run", "SELECT ref_id FROM (SELECT ref_id, label, lead(label, 1) OVER w AS b, lead(label, 2) OVER w AS c FROM extracted_refs WINDOW w AS (PARTITION BY doc_hash, run_id ORDER BY idx)) WHERE label = '[1]' AND b = '[2]' AND c = '[3]'")
def w09(spark, d):
    by = ["doc_hash", "run_id"]
    x = L.row_numbers(table(spark, d, "extracted_refs").select("ref_id", *by, "idx", "label"), by, "idx")
    return L.shifted(L.shifted(x, by, "rn", "label", 1, "b"), by, "rn", "label", 2, "c").where("label = '[1]' and b = '[2]' and c = '[3]'").select("ref_id")


@query("w18_tie_rank", "SELECT ref_id, row_number() OVER (PARTITION BY doi ORDER BY year IS NULL, surname IS NULL, ref_id) AS rank FROM extracted_refs WHERE doi IS NOT NULL")
def w18(spark, d):
    w = Window.partitionBy("doi").orderBy(F.col("year").isNull(), F.col("surname").isNull(), "ref_id")
    return table(spark, d, "extracted_refs").where("doi is not null").select("ref_id", F.row_number().over(w).alias("rank"))


@query("a24_breakdown", """SELECT coalesce(publisher, '(none)') AS publisher, is_manuscript, count(*) AS papers, count(doi) AS with_doi, sum(ref_count)::BIGINT AS refs, grouping(publisher, is_manuscript)::INT AS level
FROM manifest_item GROUP BY GROUPING SETS ((publisher), (is_manuscript), (publisher, is_manuscript))""")
def a24(spark, d):
    table(spark, d, "manifest_item").createOrReplaceTempView("folioforge_manifest")
    return spark.sql("""SELECT coalesce(publisher, '(none)') AS publisher, is_manuscript, count(*) AS papers, count(doi) AS with_doi, sum(ref_count) AS refs, cast(grouping_id(publisher, is_manuscript) as int) AS level
        FROM folioforge_manifest GROUP BY GROUPING SETS ((publisher), (is_manuscript), (publisher, is_manuscript))""")


@query("a27_timing", f"SELECT backend_name, count(*) AS n, round(avg(finished_at - started_at), 6) AS mean_s, quantile_disc(finished_at - started_at, 0.5) AS p50, quantile_disc(finished_at - started_at, 0.95) AS p95 FROM {ONE_RUN} GROUP BY 1")
def a27(spark, d):
    from folioforge.operators.text_ops import nearest_rank, order_statistic
    r = L.delivered_once(table(spark, d, "runs")).select("backend_name", F.expr("finished_at - started_at").alias("s"))
    p = lambda q, name: order_statistic(r, "backend_name", "s", nearest_rank(q)).withColumnRenamed("s", name)
    out = r.groupBy("backend_name").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_s"))
    return out.join(p(0.5, "p50"), "backend_name", "left").join(p(0.95, "p95"), "backend_name", "left")


@query("a21_outcomes", f"SELECT backend_name, status, count(*) AS n, count(*) FILTER (warnings_json IS NOT NULL AND warnings_json <> '[]') AS warned FROM {ONE_RUN} GROUP BY ALL")
def a21(spark, d):
    return L.delivered_once(table(spark, d, "runs")).groupBy("backend_name", "status").agg(F.count("*").alias("n"), F.count_if((F.col("warnings_json").isNotNull()) & (F.col("warnings_json") != "[]")).alias("warned"))


@query("j36_compare_runs", f"""SELECT a.doc_hash, a.run_id AS run_a, b.run_id AS run_b, a.status AS status_a, b.status AS status_b, (b.finished_at - b.started_at) - (a.finished_at - a.started_at) AS delta_s
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY coalesce(finished_at, -1) DESC, run_id DESC) rn FROM {ONE_RUN}) WHERE rn = 2) a JOIN {LATEST_ANY} b ON a.doc_hash = b.doc_hash""")
def j36(spark, d):
    r = L.delivered_once(table(spark, d, "runs"))
    w = Window.partitionBy("doc_hash").orderBy(F.desc(F.coalesce("finished_at", F.lit(-1))), F.desc("run_id"))
    r = r.withColumn("rn", F.row_number().over(w)).where("rn <= 2").withColumn("s", F.expr("finished_at - started_at"))
    a, b = r.where("rn = 2"), r.where("rn = 1")
    return a.alias("a").join(b.alias("b"), "doc_hash").select("doc_hash", F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"), F.col("a.status").alias("status_a"), F.col("b.status").alias("status_b"), (F.col("b.s") - F.col("a.s")).alias("delta_s"))


@query("u07_added_removed", "SELECT DISTINCT doc_hash, 'added' AS change FROM chunks WHERE doc_hash NOT IN (SELECT doc_hash FROM extracted_refs) UNION ALL SELECT DISTINCT doc_hash, 'removed' FROM extracted_refs WHERE doc_hash NOT IN (SELECT doc_hash FROM chunks)")
def u07(spark, d):
    a, b = table(spark, d, "chunks").select("doc_hash").distinct(), table(spark, d, "extracted_refs").select("doc_hash").distinct()
    return a.join(b, "doc_hash", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "doc_hash", "left_anti").withColumn("change", F.lit("removed")))


@query("u02_dedupe_keys", "SELECT paper_id, lower(cite_key) AS k, min(truth_id) AS truth_id FROM latex_refs WHERE cite_key IS NOT NULL GROUP BY ALL")
def u02(spark, d):
    return table(spark, d, "latex_refs").where("cite_key is not null").groupBy("paper_id", F.lower("cite_key").alias("k")).agg(F.min("truth_id").alias("truth_id"))


@query("u04_capped_distinct", "SELECT doc_hash, count(DISTINCT doi)::INT AS dois FROM extracted_refs GROUP BY doc_hash")
def u04(spark, d):
    return table(spark, d, "extracted_refs").groupBy("doc_hash").agg(F.count_distinct("doi").cast("int").alias("dois"))


@query("j16_missing_keys", "SELECT truth_id FROM latex_refs a WHERE source = 'bib' AND lower(cite_key) NOT IN (SELECT lower(cite_key) FROM latex_refs WHERE source = 'bbl' AND cite_key IS NOT NULL)")
def j16(spark, d):
    t = table(spark, d, "latex_refs").withColumn("k", F.lower("cite_key"))
    return t.where("source = 'bib' and k is not null").join(t.where("source = 'bbl' and k is not null").select("k").distinct(), "k", "left_anti").select("truth_id")


@query("j17_coverage_test", "SELECT paper_id, count(*) AS wanted, count(*) FILTER (source = 'bbl') AS covered, count(*) FILTER (source = 'bbl') * 2 < count(*) AS is_partial FROM latex_refs GROUP BY paper_id")
def j17(spark, d):
    c = F.count_if(F.col("source") == "bbl")
    return table(spark, d, "latex_refs").groupBy("paper_id").agg(F.count("*").alias("wanted"), c.alias("covered"), (c * 2 < F.count("*")).alias("is_partial"))


@query("k07_ordered_authors", "SELECT truth_id, unnest(range(len(authors)))::INT AS pos, unnest(authors) AS author FROM latex_refs WHERE authors IS NOT NULL")
def k07(spark, d):
    return table(spark, d, "latex_refs").select("truth_id", F.posexplode("authors").alias("pos", "author"))


@query("s61_text_window", "SELECT chunk_id, substring(text, 101, 200) AS part, length(text) AS total FROM chunks")
def s61(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.substring("text", 101, 200).alias("part"), F.length("text").alias("total"))


@query("f42_like_search", "SELECT chunk_id FROM chunks WHERE title ILIKE '%archive%' OR text ILIKE '%estuary%'")
def f42(spark, d):
    return table(spark, d, "chunks").where(F.col("title").ilike("%archive%") | F.col("text").ilike("%estuary%")).select("chunk_id")


@query("t12_sample", None)
def t12(spark, d):
    """A seeded sample with a cap for each publisher; the cap is the feature."""
    w = Window.partitionBy("publisher").orderBy(F.xxhash64("pmcid", "doc_version", F.lit(42)))
    return table(spark, d, "manifest_item").withColumn("r", F.row_number().over(w)).where("r <= 5").select("pmcid", "doc_version", "publisher")


@query("t06_keyset_page", "SELECT doc_id, created_at FROM documents ORDER BY created_at DESC, doc_id DESC LIMIT 51")
def t06(spark, d):
    from folioforge.operators.search import keyset_page
    return keyset_page(table(spark, d, "documents").select("doc_id", "created_at"), "created_at", "doc_id", None, 50)


@query("t07_best_with_margin", """SELECT doi, ref_id FROM (SELECT doi, ref_id, s, row_number() OVER (PARTITION BY doi ORDER BY s DESC, ref_id) rn FROM (SELECT doi, ref_id, (CASE WHEN year IS NULL THEN 0 ELSE 1 END) + (CASE WHEN title IS NULL THEN 0 ELSE 1 END) + (CASE WHEN surname IS NULL THEN 0 ELSE 1 END) AS s FROM extracted_refs WHERE doi IS NOT NULL)) WHERE rn = 1""")
def t07(spark, d):
    s = sum((F.col(c).isNotNull().cast("int") for c in ("year", "title", "surname")), F.lit(0))
    x = table(spark, d, "extracted_refs").where("doi is not null").select("doi", "ref_id", s.alias("s"))
    return x.groupBy("doi").agg(F.max_by("ref_id", F.struct("s", -F.col("ref_id"))).alias("ref_id"))
