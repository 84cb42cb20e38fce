"""Queries of per-document operators over whole tables; rules that SQL can't state have tests instead."""
from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import urls as U
from folioforge.operators import documents as D
from folioforge.plans.registry import query
from folioforge.session import table


@query("x95_parse_entry", None)
def x95(spark, d):
    return table(spark, d, "extracted_refs").select("ref_id", D.entry_fields("raw").alias("e")).select("ref_id", "e.*")


@query("d29_segment_entries", None)
def d29(spark, d):
    """Entries of the bibliographies among the documents, from their lines."""
    x = table(spark, d, "documents").where("kind = 'bibliography' and text is not null").select("doc_id", F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n").alias("lines"))
    return D.segment_entries(x, ["doc_id"])


@query("d33_evidence_guard", None)
def d33(spark, d):
    return D.evidence_guard(table(spark, d, "extracted_refs").select("doc_hash", "run_id", "idx", "raw"), ["doc_hash", "run_id"], "idx", "raw")


_P = r"(\p{Lu}[\p{L}’''-]+(?:\s+(?:et al\.?|and|&)\s*(?:\p{Lu}[\p{L}’''-]+)?)?,?\s+\(?(?:18|19|20)[0-9]{2}[a-z]?)"


@query("d39_author_year_markers", rf"""SELECT chunk_id, regexp_extract(m, '^(\p{{Lu}}[\p{{L}}’''-]+)', 1) AS surname, regexp_extract(m, '((?:18|19|20)[0-9]{{2}})[a-z]?$', 1)::INT AS year, nullif(regexp_extract(m, '[0-9]([a-z])$', 1), '') AS suffix
FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{_P}', 1)) AS m FROM chunks)""")
def d39(spark, d):
    return D.author_year_markers(table(spark, d, "chunks"), "chunk_id", "text")


@query("d27_reference_headings", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(trim(line, chr(13)), '^\s*(?:[0-9IVX]{1,4}\.?\s+)?(?i:references?(?:\s+cited)?|bibliography|literature(?:\s+cited)?|works\s+cited|literatur(?:verzeichnis)?|références|bibliographie|referencias|bibliografía)\s*:?\s*$') GROUP BY doc_id")
def d27(spark, d):
    ln = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line", F.lit("\r")))
    return D.reference_headings(ln).groupBy("doc_id").agg(F.count("*").alias("n"))


#: Paths of the papers' pages: dot segments, default ports, tracking parameters and fragments by the row.
_HOST = "CASE doc_version % 2 WHEN 0 THEN 'www.' ELSE '' END || CASE WHEN is_manuscript THEN 'press' ELSE 'journals' END || '.example.' || CASE WHEN pub_year % 3 = 0 THEN 'net' ELSE 'org' END"


def _url():
    host = F.concat(F.when(F.col("doc_version") % 2 == 0, "WWW.").otherwise(""), F.when(F.col("is_manuscript"), "Press").otherwise("journals"), F.lit(".Example."), F.when(F.col("pub_year") % 3 == 0, "net").otherwise("ORG"))
    tail = F.when(F.col("pub_year") % 2 == 0, F.concat(F.lit("?utm_source=x&v="), F.col("doc_version").cast("string"))).otherwise("#top")
    return F.concat(F.lit("HTTPS://"), host, F.lit(":443/a/../"), F.lower("pmcid"), F.when(F.col("pub_year") % 5 == 0, "/./pdf").otherwise("/b/../view"), tail)


_NORMAL = f"'https://' || {_HOST} || '/' || lower(pmcid) || CASE WHEN pub_year % 5 = 0 THEN '/pdf' ELSE '/view' END || CASE WHEN pub_year % 2 = 0 THEN '?v=' || doc_version::VARCHAR ELSE '' END"


@query("x38_normalize_url", f"SELECT pmcid, doc_version, {_NORMAL} AS url FROM manifest_item")
def x38(spark, d):
    return table(spark, d, "manifest_item").select("pmcid", "doc_version", U.normalize_url(_url()).alias("url"))


@query("f34_host_policy", f"SELECT pmcid, doc_version, CASE WHEN pub_year % 3 <> 0 AND is_manuscript IS NOT true THEN 'allow' ELSE 'block' END AS action, CASE WHEN pub_year % 5 = 0 THEN 'possible' ELSE 'no' END AS pdf FROM manifest_item")
def f34(spark, d):
    """The longest matching domain rule of each page; without one it is blocked."""
    rules = spark.createDataFrame([("example.org", "block"), ("journals.example.org", "allow"), ("org", "block")], "domain string, action string")
    u = table(spark, d, "manifest_item").select("pmcid", "doc_version", U.normalize_url(_url()).alias("url"))
    return U.host_policy(u, "url", rules).select("pmcid", "doc_version", "action", U.classify_pdf_url("url").alias("pdf"))


@query("x42_percent_encode", None)
def x42(spark, d):
    return table(spark, d, "latex_refs").select("truth_id", U.percent_encode("title").alias("enc"), (U.percent_decode(U.percent_encode("title")) == F.col("title")).alias("back"))


@query("x36_latex_to_text", None)
def x36(spark, d):
    f = F.pandas_udf(lambda s: s.map(D.latex_to_text), "string")
    return table(spark, d, "latex_refs").select("truth_id", f("title").alias("title"))
