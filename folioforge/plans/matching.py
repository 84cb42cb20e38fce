"""Matching, merging and evaluation queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import ids, text as T
from folioforge.operators import matching as M
from folioforge.plans.registry import query
from folioforge.session import table

NT = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
W = "list_distinct(list_filter(string_split(" + NT + ", ' '), lambda x: x <> ''))"


@query("j11_exact_pass", f"""SELECT ref_id, truth_id, k AS title_key FROM (SELECT ref_id, {NT.format(c='title')} AS k, row_number() OVER (PARTITION BY {NT.format(c='title')} ORDER BY ref_id) rn FROM extracted_refs WHERE title IS NOT NULL) a
JOIN (SELECT truth_id, {NT.format(c='title')} AS k, row_number() OVER (PARTITION BY {NT.format(c='title')} ORDER BY truth_id) rn FROM latex_refs WHERE title IS NOT NULL) b USING (k, rn)""")
def j11(spark, d):
    a = table(spark, d, "extracted_refs").select("ref_id", T.normalize_title("title").alias("title_key"))
    b = table(spark, d, "latex_refs").select("truth_id", T.normalize_title("title").alias("title_key"))
    return M.rank_pairing(a, b, "title_key", "ref_id", "truth_id")


def _pass(n: int, ka: str, kb: str, prior: list[str]) -> str:
    anti = lambda c: "".join(f" AND {c} NOT IN (SELECT {c} FROM p{i})" for i in prior)
    return f"""p{n} AS (SELECT ref_id, truth_id FROM (SELECT ref_id, {ka} AS k, row_number() OVER (PARTITION BY {ka} ORDER BY ref_id) rn FROM extracted_refs WHERE {ka} IS NOT NULL{anti('ref_id')}) a
JOIN (SELECT truth_id, {kb} AS k, row_number() OVER (PARTITION BY {kb} ORDER BY truth_id) rn FROM latex_refs WHERE {kb} IS NOT NULL{anti('truth_id')}) b USING (k, rn))"""


_TY = f"CASE WHEN title IS NOT NULL AND year IS NOT NULL THEN {NT.format(c='title')} || '|' || year::VARCHAR END"
_TT = f"{NT.format(c='title')}"


_LOOSE = r"nullif(regexp_replace(regexp_replace(lower(trim(doi)), '^.*?(10\.[0-9]{4,9}/)', '\1'), '[.,;:)\]}'']+$', ''), '')"


@query("j10_cascade", f"WITH {_pass(1, _LOOSE, _LOOSE, [])}, {_pass(2, _TY, _TY, [1])}, {_pass(3, _TT, _TT, [1, 2])} SELECT *, 'doi' AS method FROM p1 UNION ALL SELECT *, 'title_year' FROM p2 UNION ALL SELECT *, 'title' FROM p3")
def j10(spark, d):
    """Cascade doi, then title and year, then title: each side is used once."""
    t = T.normalize_title("title")
    ty = F.when(F.col("year").isNotNull(), F.concat(t, F.lit("|"), F.col("year").cast("string")))
    return M.cascade(table(spark, d, "extracted_refs"), table(spark, d, "latex_refs"), [("doi", F.nullif(ids.loose_doi("doi"), F.lit("")), F.nullif(ids.loose_doi("doi"), F.lit(""))), ("title_year", ty, ty), ("title", t, t)], "ref_id", "truth_id")


@query("j13_fuzzy_title", f"""WITH a AS (SELECT {NT.format(c='title')} AS ta, count(*) AS na FROM extracted_refs WHERE title IS NOT NULL GROUP BY 1), b AS (SELECT {NT.format(c='title')} AS tb, count(*) AS nb FROM latex_refs WHERE title IS NOT NULL GROUP BY 1),
wa AS (SELECT ta, na, list_distinct(string_split(ta, ' ')) AS w FROM a), wb AS (SELECT tb, nb, list_distinct(string_split(tb, ' ')) AS w FROM b)
SELECT ta, tb, na, nb, inter::INT AS inter, (la + lb - inter)::INT AS uni FROM (SELECT ta, tb, na, nb, len(list_intersect(wa.w, wb.w)) AS inter, len(wa.w) AS la, len(wb.w) AS lb FROM wa, wb WHERE len(wa.w) * 5 >= len(wb.w) * 4 AND len(wb.w) * 5 >= len(wa.w) * 4) WHERE inter * 5 >= (la + lb - inter) * 4""")
def j13(spark, d):
    """All title classes of both tables with a word Jaccard of at least 4/5, with the number of rows of each."""
    a = table(spark, d, "extracted_refs").where("title is not null").groupBy(T.normalize_title("title").alias("ta")).agg(F.count("*").alias("na"))
    b = table(spark, d, "latex_refs").where("title is not null").groupBy(T.normalize_title("title").alias("tb")).agg(F.count("*").alias("nb"))
    p = M.jaccard_join(a.withColumn("w", F.split("ta", " ")), b.withColumn("w", F.split("tb", " ")), "ta", "tb", "w", "w")
    return p.join(a, "ta").join(b, "tb").select("ta", "tb", "na", "nb", "inter", "uni")


@query("j15_author_venue", f"SELECT DISTINCT ref_id, truth_id FROM (SELECT ref_id, year, {NT.format(c='surname')} AS s FROM extracted_refs) a JOIN (SELECT truth_id, year, {NT.format(c='authors[1]')} AS s FROM latex_refs) b ON a.year = b.year AND a.s = b.s WHERE a.s <> ''")
def j15(spark, d):
    a = table(spark, d, "extracted_refs").select("ref_id", "year", T.normalize_title("surname").alias("s")).where("s != ''")
    b = table(spark, d, "latex_refs").select("truth_id", "year", T.normalize_title(F.get("authors", F.lit(0))).alias("s"))
    return a.join(b, ["year", "s"]).select("ref_id", "truth_id").distinct()


@query("j21_author_year", f"""SELECT c.chunk_id, count(DISTINCT x.ref_id) AS refs FROM (SELECT DISTINCT chunk_id, doc_hash, run_id, lower(m[1]) AS s, m[2]::INT AS y FROM (SELECT chunk_id, doc_hash, run_id, regexp_extract_all(text, '(\\p{{Lu}}[\\p{{L}}’-]+)(?: et al\\.)?, (?:19|20)[0-9]{{2}}', 0) AS ms FROM chunks), unnest(list_transform(ms, lambda z: [regexp_extract(z, '(\\p{{Lu}}[\\p{{L}}’-]+)', 1), regexp_extract(z, '((?:19|20)[0-9]{{2}})', 1)])) t(m)) c
JOIN extracted_refs x ON x.doc_hash = c.doc_hash AND x.run_id = c.run_id AND x.year = c.y AND lower(x.surname) = c.s GROUP BY c.chunk_id""")
def j21(spark, d):
    p = r"(\p{Lu}[\p{L}’-]+)(?: et al\.)?, (?:19|20)[0-9]{2}"
    c = table(spark, d, "chunks").select("chunk_id", "doc_hash", "run_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"))
    c = c.select("chunk_id", "doc_hash", "run_id", F.lower(F.regexp_extract("m", r"(\p{Lu}[\p{L}’-]+)", 1)).alias("s"), F.regexp_extract("m", "((?:19|20)[0-9]{2})", 1).cast("int").alias("year")).distinct()
    x = table(spark, d, "extracted_refs").select("doc_hash", "run_id", F.lower("surname").alias("s"), "year", "ref_id")
    return c.join(x, ["doc_hash", "run_id", "s", "year"]).groupBy("chunk_id").agg(F.count_distinct("ref_id").alias("refs"))


@query("j34_merge_records", None)
def j34(spark, d):
    """References linked by DOI or by title and year, transitively: group id and size."""
    t = T.normalize_title("title")
    x = table(spark, d, "extracted_refs")
    g = M.merge_groups(x, "ref_id", [ids.normalize_doi("doi"), F.when(F.col("year").isNotNull() & (F.length(t) > 0), F.concat(t, F.lit("|"), F.col("year").cast("string")))])
    n = g.groupBy("grp").agg(F.count("*").alias("links"))
    return g.join(n, "grp").select("ref_id", "grp", "links")


@query("a20_merge_group", """SELECT k AS title_key, first(doi ORDER BY ref_id) FILTER (doi IS NOT NULL) AS doi, first(year ORDER BY ref_id) FILTER (year IS NOT NULL) AS year, first(surname ORDER BY ref_id) FILTER (surname IS NOT NULL) AS surname
FROM (SELECT *, """ + NT.format(c="title") + " AS k FROM extracted_refs WHERE title IS NOT NULL) GROUP BY k")
def a20(spark, d):
    x = table(spark, d, "extracted_refs").where("title is not null").withColumn("title_key", T.normalize_title("title"))
    return M.first_known(x, "title_key", F.col("ref_id"), ["doi", "year", "surname"])


@query("a18_duplicate_groups", f"SELECT k AS title_key, count(*) AS n, count(DISTINCT year) AS years FROM (SELECT {NT.format(c='title')} AS k, year, doi FROM latex_refs WHERE title IS NOT NULL) GROUP BY k HAVING count(*) >= 2 AND count(DISTINCT doi) <= 1")
def a18(spark, d):
    x = table(spark, d, "latex_refs").where("title is not null").groupBy(T.normalize_title("title").alias("title_key"))
    return x.agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"), F.count_distinct("doi").alias("dois")).where("n >= 2 and dois <= 1").drop("dois")


@query("j20_marker_targets", """WITH x AS (SELECT ref_id, doc_hash, run_id, idx, nullif(regexp_extract(coalesce(label, ''), '([0-9]{1,6})', 1), '')::INT AS number FROM extracted_refs)
SELECT doc_hash, run_id, number, min(ref_id) AS ref_id FROM x WHERE number IS NOT NULL GROUP BY ALL""")
def j20(spark, d):
    x = table(spark, d, "extracted_refs").select("ref_id", "doc_hash", "run_id", F.nullif(F.regexp_extract(F.coalesce("label", F.lit("")), "([0-9]{1,6})", 1), F.lit("")).cast("int").alias("number"))
    return x.where("number is not null").groupBy("doc_hash", "run_id", "number").agg(F.min("ref_id").alias("ref_id"))


@query("j24_asof", """SELECT e.event_id, (SELECT max(p.value) FROM (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p WHERE p.user_id = e.user_id AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.event_type = 'purchase' AND q.user_id = e.user_id AND q.ts <= e.ts)) AS asof_value
FROM events e WHERE e.event_type = 'click'""")
def j24(spark, d):
    """Nearest preceding event of another kind: each click with the last purchase of its user at or before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return M.asof_join(left, e.where("event_type = 'purchase'").select("user_id", "ts", "value"), ["user_id"], "ts", ["value"]).select("event_id", "asof_value")


@query("f46_family_in_entry", None)
def f46(spark, d):
    """The folding has no SQL form; tested by brute force."""
    return table(spark, d, "extracted_refs").where("surname is not null and raw is not null").select("ref_id", T.family_in_entry("surname", "raw").alias("found"))


@query("f47_year_in_entry", f"SELECT ref_id, list_has_any({W.format(c='raw')}, [(year - 1)::VARCHAR, year::VARCHAR, (year + 1)::VARCHAR]) AS found FROM extracted_refs WHERE year IS NOT NULL AND raw IS NOT NULL")
def f47(spark, d):
    y = F.col("year")
    return table(spark, d, "extracted_refs").where("year is not null and raw is not null").select("ref_id", F.arrays_overlap(T.words("raw"), F.array((y - 1).cast("string"), y.cast("string"), (y + 1).cast("string"))).alias("found"))


_LABEL, _YEAR = r"^\s*\[?([0-9]{1,3})[.)\]]", r"\b(?:19|20)[0-9][0-9]\b"


@query("f49_list_plausible", rf"""SELECT doc_hash, run_id, entries, max_label, years, max_label <= entries + 1 AND years <= entries + entries // 2 + 3 AS plausible FROM (
SELECT doc_hash, run_id, count(*) AS entries, coalesce(max(list_max(list_transform(string_split(raw, chr(10)), lambda x: coalesce(nullif(regexp_extract(x, '{_LABEL}', 1), '')::INT, 0)))), 0) AS max_label,
coalesce(sum(len(regexp_extract_all(raw, '{_YEAR}'))), 0)::BIGINT AS years FROM extracted_refs GROUP BY ALL)""")
def f49(spark, d):
    """A list is implausible if a printed label is beyond its entries, or far more years are printed than entries found."""
    labels = F.transform(F.split("raw", "\n"), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, _LABEL, 1), F.lit("")).cast("int"), F.lit(0)))
    x = table(spark, d, "extracted_refs").groupBy("doc_hash", "run_id").agg(F.count("*").alias("entries"), F.coalesce(F.max(F.array_max(labels)), F.lit(0)).alias("max_label"), F.coalesce(F.sum(F.size(F.regexp_extract_all("raw", F.lit(_YEAR), F.lit(0)))), F.lit(0)).alias("years"))
    return x.withColumn("plausible", (F.col("max_label") <= F.col("entries") + 1) & (F.col("years") <= F.col("entries") + F.floor(F.col("entries") / 2) + 3))


@query("x22_title_equal", None)
def x22(spark, d):
    """Equality of the titles of hand-labelled pairs without TeX, case, accents and punctuation."""
    x, t = table(spark, d, "extracted_refs").select("ref_id", F.col("title").alias("xt")), table(spark, d, "latex_refs").select("truth_id", F.col("title").alias("tt"))
    return table(spark, d, "match_labels").join(x, "ref_id").join(t, "truth_id").select("ref_id", "truth_id", T.title_equal("xt", "tt").alias("same"), T.paper_title_matches("xt", "tt").alias("matches"))


@query("j38_label_quality", f"""SELECT is_match, count(*) AS n, count(*) FILTER (x.year = t.year) AS same_year, count(*) FILTER ({NT.format(c='x.title')} = {NT.format(c='t.title')}) AS same_title
FROM match_labels l JOIN extracted_refs x USING (ref_id) JOIN latex_refs t USING (truth_id) GROUP BY is_match""")
def j38(spark, d):
    x = table(spark, d, "extracted_refs").select("ref_id", F.col("year").alias("xy"), T.normalize_title("title").alias("xt"))
    t = table(spark, d, "latex_refs").select("truth_id", F.col("year").alias("ty"), T.normalize_title("title").alias("tt"))
    return table(spark, d, "match_labels").join(x, "ref_id").join(t, "truth_id").groupBy("is_match").agg(F.count("*").alias("n"), F.count_if(F.col("xy") == F.col("ty")).alias("same_year"), F.count_if(F.col("xt") == F.col("tt")).alias("same_title"))


@query("a06_evaluation", f"""SELECT count(*) AS truth, count(*) FILTER (hit) AS found, round(coalesce(count(*) FILTER (hit)::DOUBLE / nullif(count(*), 0), 0), 6) AS recall FROM (
SELECT truth_id, {NT.format(c='title')} IN (SELECT {NT.format(c='title')} FROM extracted_refs WHERE title IS NOT NULL) AS hit FROM latex_refs WHERE title IS NOT NULL)""")
def a06(spark, d):
    t = table(spark, d, "latex_refs").where("title is not null").select("truth_id", T.normalize_title("title").alias("k"))
    x = table(spark, d, "extracted_refs").where("title is not null").select(T.normalize_title("title").alias("k")).distinct().withColumn("hit", F.lit(1))
    c = F.count("hit")
    return t.join(x, "k", "left").agg(F.count("*").alias("truth"), c.alias("found"), F.round(F.coalesce(F.try_divide(c, F.count("*")), F.lit(0.0)), 6).alias("recall"))


@query("a25_count_difference", """SELECT CASE WHEN m.ref_count IS NULL THEN 'unknown' WHEN n = ref_count THEN 'exact' WHEN abs(n - ref_count) <= 2 THEN 'near' WHEN n < ref_count THEN 'fewer' ELSE 'more' END AS bucket, count(*) AS papers
FROM (SELECT doc_hash, max(ref_count) AS ref_count FROM manifest_item GROUP BY 1) m JOIN (SELECT doc_hash, max(c) AS n FROM (SELECT doc_hash, run_id, count(*) AS c FROM extracted_refs GROUP BY ALL) GROUP BY 1) x USING (doc_hash) GROUP BY 1""")
def a25(spark, d):
    m = table(spark, d, "manifest_item").groupBy("doc_hash").agg(F.max("ref_count").alias("rc"))
    x = table(spark, d, "extracted_refs").groupBy("doc_hash", "run_id").count().groupBy("doc_hash").agg(F.max("count").alias("n"))
    b = F.when(F.col("rc").isNull(), "unknown").when(F.col("n") == F.col("rc"), "exact").when(F.abs(F.col("n") - F.col("rc")) <= 2, "near").when(F.col("n") < F.col("rc"), "fewer").otherwise("more")
    return m.join(x, "doc_hash").groupBy(b.alias("bucket")).agg(F.count("*").alias("papers"))


@query("a30_evidence_multiset", "SELECT coalesce(source, '') || '|' || coalesce(year::VARCHAR, '') AS evidence, count(*) AS n FROM latex_refs GROUP BY 1")
def a30(spark, d):
    return table(spark, d, "latex_refs").groupBy(F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("evidence")).agg(F.count("*").alias("n"))


@query("d48_ambiguous_doi", r"SELECT ref_id, len(list_distinct(regexp_extract_all(lower(concat_ws(' ', raw, doi)), '10\.[0-9]{4,9}/[a-z0-9./-]*[a-z0-9]'))) > 1 AS ambiguous FROM extracted_refs")
def d48(spark, d):
    n = F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "raw", "doi")), F.lit(r"(10\.[0-9]{4,9}/[a-z0-9./-]*[a-z0-9])"), F.lit(1))))
    return table(spark, d, "extracted_refs").select("ref_id", (n > 1).alias("ambiguous"))
