"""Queries of line tests, citations, resolving, rebuilt runs, catalogues and readers over the test tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import ids, lines as N, text as T, urls as U
from folioforge.operators import catalog as C, citations as X, documents as D, ledger as L, resolve as R, text_ops as O
from folioforge.plans.ledger import LATEST, ONE_RUN
from folioforge.plans.registry import query
from folioforge.plans.scalars import nt, scalar
from folioforge.session import materialize, table

Q = lambda s: s.replace("'", "''")
IN = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
LINES = "(SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM chunks WHERE text IS NOT NULL)"


def _lines(spark, d):
    return O.lines(table(spark, d, "chunks").where("text is not null"), "chunk_id")


# ---- tests of lines and entries ------------------------------------------------------------------
def _line_test(name: str, test, sql: str) -> None:
    @query(name, f"SELECT chunk_id, line_no FROM {LINES} WHERE {sql}")
    def f(spark, d, test=test):
        return _lines(spark, d).where(test("line")).select("chunk_id", "line_no")


_line_test("f10_stamp_lines", N.is_stamp, rf"regexp_matches(trim(line), '{Q(N.STAMP)}')")
_line_test("f11_affiliation_lines", N.has_affiliation_signal, f"regexp_matches(line, '{N.AFFILIATION}')")
_line_test("f13_lettered_affiliations", N.is_lettered_affiliation, rf"regexp_matches(trim(line), '^[ᵃᵇᶜᵈᵉᶠᵍʰ]\s*\p{{Lu}}.*(?:,|{N.AFFILIATION})') OR (regexp_matches(trim(line), '^[a-h] (?:\S+\s+){{0,2}}{N.INSTITUTION}(?:\s|$)') AND length(trim(line)) - length(replace(trim(line), ',', '')) >= 2)")
_line_test("f19_algorithm_lines", N.is_algorithm_line, " OR ".join(f"contains(lower(trim(line)), '{m}')" for m in N.ALGORITHM_MARKERS) + rf" OR regexp_matches(lower(trim(line)), '^[0-9]+:(?:\s|$)') OR regexp_extract(lower(trim(line)), '^(\S+)', 1) IN {IN(N.ALGORITHM_STARTS)}")
_line_test("f31_math_heavy_lines", N.is_math_heavy, r"length(regexp_replace(regexp_replace(line, '\s', '', 'g'), '\p{L}', '', 'g')) > 0 AND 2 * length(regexp_replace(regexp_replace(line, '\s', '', 'g'), '\p{L}', '', 'g')) >= length(regexp_replace(line, '\s', '', 'g'))")
_line_test("f08_contents_lines", T.is_toc, r"regexp_matches(line, '(?:\.\s?){4,}\s*[0-9]*\s*$')")
_line_test("f09_caption_lines", T.is_caption, r"regexp_matches(line, '^\s*(?:Figure|Fig\.|Table|Scheme|Plate)\s+[0-9IVX]+[.:]')")
_BODY = rf"trim(regexp_replace(trim(raw), '^\s*(?:\[[0-9]{{1,4}}\]|\([0-9]{{1,4}}\)|[0-9]{{1,4}}[.)]?)\s+', ''))"
_HEAD = f"regexp_replace({_BODY}, '{Q(N.TITLELESS_TAIL)}', '')"
scalar("f32_titleless_entry", "extracted_refs", "ref_id", lambda: N.titleless_raw("raw"),
       rf"NOT regexp_matches({_BODY}, '{N.QUOTES}') AND regexp_matches({_BODY}, '{Q(N.TITLELESS_TAIL)}') AND regexp_matches({_HEAD}, '{Q(N.INITIALS_FIRST)}') AND regexp_matches(trim(regexp_extract({_HEAD}, '([^,]*)$', 1)), '^\p{{Lu}}') AND length(trim(regexp_extract({_HEAD}, '([^,]*)$', 1))) <= 80 AND NOT regexp_matches(trim(regexp_extract({_HEAD}, '([^,]*)$', 1)), '(?:^|\s)\p{{Ll}}\S{{3,}}')")
scalar("f05_body_role", "documents", "doc_id", lambda: N.is_body_role("kind"), f"kind IN {IN(N.BODY_ROLES)}")
scalar("f03_in_split", "latex_refs", "truth_id", lambda: N.in_split("source", "bib") & N.in_split("source", "all"), "source = 'bib'")
scalar("f07_edge_band", "extracted_refs", "ref_id", lambda: N.in_edge_band(F.col("idx") * 10.0, F.col("idx") * 10.0 + 8, F.lit(800.0), F.lit(0), 0.1), "(idx * 10.0 + 4) >= 720 OR (idx * 10.0 + 4) <= 80")
scalar("f18_code_lines", "extracted_refs", "ref_id", lambda: N.is_code_line(F.array(F.struct(F.col("label").alias("text"), F.lit("Body").alias("font")), F.struct(F.col("surname").alias("text"), F.lit("CMTT10").alias("font")))), None)
scalar("f24_mark_incomplete", "runs", "run_id", lambda: F.array_join(N.mark_incomplete(F.from_json("warnings_json", "array<string>"), F.col("status") == "failed", F.col("status") == "partial"), "|"), None)
scalar("f35_scholarly_host", "manifest_item", "doc_hash", lambda: N.is_scholarly_host(F.concat(F.lit("www."), F.when(F.col("pmcid").endswith("1"), "nature.com").when(F.col("pmcid").endswith("2"), "notnature.com").otherwise("PLOS.org"))), "NOT pmcid LIKE '%2'")
scalar("f41_public_suffix", "manifest_item", "doc_hash", lambda: N.is_public_suffix(F.lit("Org"), F.when(F.col("is_manuscript"), "org").otherwise("com")), "is_manuscript IS NOT DISTINCT FROM true")
scalar("f48_venue_in_entry", "extracted_refs", "ref_id", lambda: N.venue_in_entry(N.venue_of("raw"), "raw", "title"), None)
scalar("x70_find_doi", "extracted_refs", "ref_id", lambda: N.find_doi("raw"), r"""nullif(lower(regexp_replace(regexp_replace(regexp_extract(raw, '(10\.\s?[0-9]{4,9}\s?/[^\s"<>]+)', 1), '\s', '', 'g'), '[.,;:)\]}'']+$', '')), '')""")
_NAME = r"trim(regexp_replace(author, '(?i),?\s*\bet al\.?\s*$', ''))"
_TOK = rf"list_filter(regexp_split_to_array({_NAME}, '\s+'), lambda t: t <> '' AND lower(rtrim(t, '.')) NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'phd', 'md'))"
scalar("x105_author_surname", "extracted_refs", "ref_id", lambda: N.author_surname("author"),
       rf"CASE WHEN contains({_NAME}, ',') THEN lower(trim(split_part({_NAME}, ',', 1))) WHEN len({_TOK}) > 0 THEN lower(trim(CASE WHEN regexp_matches({_TOK}[-1], '^[\p{{Lu}}.]{{1,3}}$') THEN {_TOK}[1] ELSE {_TOK}[-1] END, '.')) WHEN author IS NOT NULL THEN '' END")
scalar("x93_json_year", "manifest_item", "doc_hash", lambda: N.year_of_json(F.concat(F.lit('"'), F.col("pub_year").cast("string"), F.lit('-01"'))), "CASE WHEN pub_year BETWEEN 1000 AND 2999 THEN pub_year END")
scalar("x126_json_array", "runs", "run_id", lambda: F.size(N.json_array(F.concat(F.lit('{"w": '), F.coalesce("warnings_json", F.lit("null")), F.lit("}")), "$.w")), "coalesce(len(from_json(warnings_json, '[\"VARCHAR\"]')), 0)::INT")
scalar("x127_reference_extra", "extracted_refs", "ref_id", lambda: N.reference_extra("label", "page"), None)
scalar("x129_requires_session", "manifest_item", "doc_hash", lambda: N.requires_session(F.when(F.col("pmid").isNull(), "www.arxiv.org").otherwise("www.x.org"), F.col("license_code").isNotNull()), "license_code IS NULL AND pmid IS NOT NULL")
scalar("x132_search_url", "manifest_item", "doc_hash", lambda: N.search_url("https://api.example.org/works", "pmcid", 5000), "'https://api.example.org/works?query=' || pmcid || '&rows=1000'")
_VK = r"(?:Annals|Journal|Letters|Proceedings|Acta|Archives|Reviews|Transactions|Bulletin|Ann|J|Lett|Proc|Arch|Rev|Trans|Bull)\b"
scalar("x98_venue", "extracted_refs", "ref_id", lambda: N.venue_of("raw"), "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(raw, '{p}', 1), ' .,'), '')" for p in (r"\bIn:\s+([^,;:0-9]+)", r"[”\"],?\s+([^,;:0-9”\"]+),", rf"[.,]\s+({_VK}[^,;:0-9]*)")) + ")")
_Y92 = r"nullif(regexp_extract(x, '\b((?:19|20)[0-9]{2})\b', 1), '')::INT"
scalar("x92_page1_year", "chunks", "chunk_id", lambda: N.page1_year(F.split("text", "\n")),
       rf"coalesce(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\b(?:received|accepted|published|copyright|available online)\b|©')), lambda x: {_Y92}), lambda y: y IS NOT NULL)[1], list_filter(list_transform(string_split(text, chr(10)), lambda x: {_Y92}), lambda y: y IS NOT NULL)[1])")
scalar("x113_encode_component", "manifest_item", "doc_hash", lambda: U.percent_encode(F.concat("pmcid", F.lit(" &/"), F.col("pub_year").cast("string"))), "pmcid || '%20%26%2F' || pub_year::VARCHAR")
scalar("x41_percent_decode", "manifest_item", "doc_hash", lambda: U.percent_decode(F.concat("pmcid", F.lit("%20%C3%A9+%2"))), "pmcid || '%20%C3%A9+%2'")
scalar("x40_extension", "manifest_item", "doc_hash", lambda: U.extension(F.concat(F.lit("https://x.org/a.b/"), "pmcid", F.lit(".PDF?x=1"))), "CASE WHEN pmcid IS NOT NULL THEN 'pdf' END")
scalar("x43_tracking_param", "events", "event_id", lambda: U.is_tracking_param(F.concat(F.lit("utm_"), "event_type")), "event_type IS NOT NULL")
scalar("x39_resolve_url", "manifest_item", "doc_hash", lambda: U.resolve(F.lit("https://ex.org/a/b?x=1"), F.concat(F.lit("../"), "pmcid")), "'https://ex.org/' || pmcid")
scalar("x46_proxied_url", "manifest_item", "doc_hash", lambda: U.proxied_url(F.lit("https://p/login?url="), F.concat(F.lit("http://x.org/"), "pmcid")), "'https://p/login?url=http%3A%2F%2Fx.org%2F' || pmcid")
scalar("x45_unproxy_host", "manifest_item", "doc_hash", lambda: U.unproxy_host(F.concat(F.lit("www-"), F.lower("pmcid"), F.lit("-org.proxy.edu")), "proxy.edu"), "'www.' || lower(pmcid) || '.org'")
scalar("x73_doi_in_url", "extracted_refs", "ref_id", lambda: U.doi_from_url(F.concat(F.lit("https://x.org/doi/"), F.regexp_extract("doi", r"^(10\.[0-9]{4,9}/[a-z0-9.-]*[a-z0-9])$", 1), F.lit("/pdf"))), None)
scalar("x112_extra_map", "manifest_item", "doc_hash", lambda: F.element_at(U.extra_map(F.concat(F.lit("PMCID: "), "pmcid", F.lit("\npmcid: x\nbad"))), "pmcid"), "pmcid")
scalar("x114_link_header", "manifest_item", "doc_hash", lambda: F.element_at(U.link_header(F.concat(F.lit("<http://a/"), "pmcid", F.lit(">; rel=\"next\", <http://b>; rel=last"))), "next"), "'http://a/' || pmcid")
scalar("x119_http_date", "orders", "o_orderkey", lambda: U.http_date(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), "epoch(o_orderdate)::BIGINT")
scalar("x131_openurl", "manifest_item", "doc_hash", lambda: U.openurl("http://r", F.col("doi"), F.col("pmcid"), F.col("pub_year")), None)
scalar("x44_host_suffixes", "manifest_item", "doc_hash", lambda: F.array_join(U.host_suffixes(F.concat(F.lower("pmcid"), F.lit(".co.uk"))), " "), "lower(pmcid) || '.co.uk co.uk uk'")
scalar("f43_public_ip", "customer", "c_custkey", lambda: U.public_ip(F.concat(F.lit("10."), (F.col("c_custkey") % 256).cast("string"), F.lit(".0.1"))), "false")
scalar("f44_safe_url", "manifest_item", "doc_hash", lambda: U.safe_url(F.concat(F.when(F.col("is_manuscript"), "ftp").otherwise("https"), F.lit("://x.org/"), "pmcid")), "CASE WHEN is_manuscript IS NOT true THEN 'https://x.org/' || pmcid END")
scalar("x32_spacing_accents", "extracted_refs", "ref_id", lambda: T.spacing_to_combining(F.concat("surname", F.lit("´"))),
       "translate(surname || '´', '´`ˆ˜¨˚¸ˇ˘˙˝', '" + "\u0301\u0300\u0302\u0303\u0308\u030a\u0327\u030c\u0306\u0307\u030b" + "')")
_FAM = r"CASE WHEN contains(trim(author), ',') THEN trim(split_part(trim(author), ',', 1)) ELSE regexp_extract(trim(author), '((?:(?:van|von|de|di|da|du|der|den|del|la|le)\s+)*\S+)$', 1) END"
scalar("x16_person_key", "extracted_refs", "ref_id", lambda: ids.person_key("author"),
       rf"concat_ws('|', lower({_FAM}), lower(substring(CASE WHEN contains(trim(author), ',') THEN trim(regexp_replace(trim(author), '^[^,]*,\s*', '')) ELSE trim(author) END, 1, 1)))")
scalar("x20_text_tokens", "latex_refs", "truth_id", lambda: F.array_join(F.array_sort(F.array_distinct(T.words(F.regexp_replace(T.join_break_hyphens(O.nfkc("text")), r"^\s*\[[^\]]{1,12}\]\s*", "")))), " "), None)
scalar("w06_separator", "extracted_refs", "ref_id", lambda: N.separator(F.lit(0), F.col("idx") % 2, F.lit(1.0), F.lit(10.0)), "CASE WHEN idx % 2 = 1 THEN chr(10) || chr(10) ELSE chr(10) END")


scalar("x02_normalize_title_first", "extracted_refs", "ref_id", lambda: T.normalize_title_first("title"), nt("replace(title, 'İ', 'i')"))


@query("x29_hyphen_lines", None)
def x29(spark, d):
    """Every pair of successive lines of the chunks with what becomes of a hyphen between them; tested by cases."""
    ln = _lines(spark, d)
    pairs = ln.select("chunk_id", "line_no", F.col("line").alias("first"), F.lead("line").over(Window.partitionBy("chunk_id").orderBy("line_no")).alias("second")).where(F.col("first").rlike(r"\p{L}[-¬‐]\s*$"))
    return O.hyphen_lines(pairs, O.vocabulary(table(spark, d, "chunks"), "text"))


# ---- citations -----------------------------------------------------------------------------------
_NUM = r"regexp_replace(regexp_replace(marker, '[\[\]\s]', '', 'g'), '–', '-', 'g')"


@query("d35_numeric_citations", rf"""WITH m AS (SELECT chunk_id, doc_hash, run_id, unnest(regexp_extract_all(text, '{X.NUMERIC}', 1)) AS marker, generate_subscripts(regexp_extract_all(text, '{X.NUMERIC}', 1), 1) - 1 AS pos FROM chunks),
p AS (SELECT chunk_id, doc_hash, run_id, marker, pos, unnest(string_split({_NUM}, ',')) AS part FROM m),
n AS (SELECT chunk_id, doc_hash, run_id, pos, marker, unnest(CASE WHEN contains(part, '-') THEN CASE WHEN split_part(part, '-', 1)::INT > 0 AND split_part(part, '-', 2)::INT BETWEEN split_part(part, '-', 1)::INT AND split_part(part, '-', 1)::INT + 99 THEN range(split_part(part, '-', 1)::INT, split_part(part, '-', 2)::INT + 1) ELSE [] END WHEN part::INT > 0 THEN [part::INT] ELSE [] END) AS number FROM p)
SELECT n.chunk_id, n.pos::INT AS pos, n.marker, n.number::INT AS number, x.ref_id FROM n JOIN extracted_refs x ON x.doc_hash = n.doc_hash AND x.run_id = n.run_id AND x.idx + 1 = n.number""")
def d35(spark, d):
    """Bracketed markers of each chunk with the entries they cite."""
    c = table(spark, d, "chunks").select("chunk_id", "doc_hash", "run_id", "text")
    m = X.numeric_markers(c, ["chunk_id", "doc_hash", "run_id"], "text").where("kind = 'bracket'")
    r = table(spark, d, "extracted_refs").select("doc_hash", "run_id", (F.col("idx") + 1).alias("number"), "ref_id")
    return X.resolve_numbers(m, r, ["doc_hash", "run_id"]).select("chunk_id", "pos", "marker", "number", "ref_id")


@query("d37_superscripts", r"SELECT chunk_id, unnest(regexp_extract_all(text, '" + Q(X.SUPERSCRIPT) + r"', 1)) AS marker FROM chunks")
def d37(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(X.SUPERSCRIPT), F.lit(1))).alias("marker"))


@query("d38_detached_superscripts", r"SELECT chunk_id, unnest(regexp_extract_all(text, '" + Q(X.DETACHED) + r"', 1)) AS marker FROM chunks")
def d38(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(X.DETACHED), F.lit(1))).alias("marker"))


@query("d40_name_citations", None)
def d40(spark, d):
    """Author-year markers with their entries, by surname, whole name, co-authors and letter; tested by cases."""
    m = X.name_markers(table(spark, d, "chunks").select("chunk_id", "doc_hash", "run_id", "text"), ["chunk_id", "doc_hash", "run_id"], "text")
    by = ["doc_hash", "run_id"]
    return X.resolve_names(m, X.reference_index(table(spark, d, "extracted_refs"), by), by, ["chunk_id", "pos"])


@query("d51_body_only", rf"SELECT chunk_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{Q(X.NOT_BODY)}')), chr(10)), '\s?\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]', '', 'g') AS body FROM chunks WHERE text IS NOT NULL")
def d51(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", X.body_only(F.col("text")).alias("body"))


@query("d52_reference_extents", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS no FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, max(no) AS e FROM l GROUP BY 1), h AS (SELECT doc_id, no, lead(no) OVER (PARTITION BY doc_id ORDER BY no) AS nxt FROM l WHERE regexp_matches(trim(line, chr(13)), '{Q(D.HEADINGS)}'))
SELECT doc_id, no + 1 AS first, coalesce(nxt - 1, e) AS last FROM h JOIN e USING (doc_id) WHERE no + 1 <= coalesce(nxt - 1, e)""")
def d52(spark, d):
    ln = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("doc_id", (F.col("no") + 1).alias("no"), F.trim("line", F.lit("\r")).alias("line"))
    return X.reference_extents(ln, "doc_id", "no", "line")


@query("w15_last_list_page", r"SELECT doc_hash, run_id, max(page) AS page FROM chunks WHERE regexp_matches(text, '\[[0-9]+\]') GROUP BY ALL")
def w15(spark, d):
    """The last page that shows a citation label: what a scan from the end would stop at."""
    return table(spark, d, "chunks").where(F.col("text").rlike(r"\[[0-9]+\]")).groupBy("doc_hash", "run_id").agg(F.max("page").alias("page"))


# ---- resolving and evaluation --------------------------------------------------------------------
_REC = f"(SELECT DISTINCT {nt('title')} AS key, lower(doi) AS doi, pub_year AS year FROM manifest_item WHERE doi IS NOT NULL AND title IS NOT NULL)"


@query("d47_resolve_entries", f"""SELECT ref_id, CASE WHEN n = 1 THEN doi END AS doi, CASE WHEN n = 1 THEN 'accepted' WHEN n > 1 THEN 'ambiguous' ELSE 'mismatch' END AS outcome FROM (
SELECT ref_id, count(DISTINCT r.doi) FILTER (e.year IS NULL OR r.year IS NULL OR abs(e.year - r.year) <= 1) AS n, min(r.doi) FILTER (e.year IS NULL OR r.year IS NULL OR abs(e.year - r.year) <= 1) AS doi
FROM extracted_refs e JOIN {_REC} r ON {nt('e.title')} = r.key WHERE {nt('e.title')} <> '' GROUP BY ref_id)""")
def d47(spark, d):
    """References that cite a paper of the manifest, by title and year."""
    m = table(spark, d, "manifest_item").where("title is not null").select(T.normalize_title("title").alias("key"), F.lower("doi").alias("doi"), F.col("pub_year").alias("year"), F.lit(None).cast("string").alias("surname"))
    return R.verified_entries(table(spark, d, "extracted_refs"), m)


@query("a22_rejections", """SELECT backend_name, bool_or(status = 'failed') AND NOT bool_or(status = 'deferred') AS rejected FROM runs GROUP BY 1""")
def a22(spark, d):
    o = F.when(F.col("status") == "failed", "mismatch").when(F.col("status") == "deferred", "ambiguous").otherwise("accepted")
    return R.rejections(table(spark, d, "runs").select("backend_name", o.alias("outcome")), "backend_name")


@query("d49_resolve_papers", None)
def d49(spark, d):
    """The manifest record of each paper by the title printed on its chunks; tested by brute force."""
    c = table(spark, d, "chunks").where("title is not null").select(F.col("doc_hash").alias("paper"), "title").distinct()
    return R.paper_records(c, table(spark, d, "manifest_item").select("doi", "title"))


@query("d50_evaluate_papers", f"""WITH x AS (SELECT DISTINCT {nt('title')} AS k, year FROM extracted_refs WHERE title IS NOT NULL)
SELECT paper_id, count(*) AS truth, count(DISTINCT truth_id) FILTER (k IN (SELECT k FROM x)) AS found, count(DISTINCT truth_id) FILTER ((k, year) IN (SELECT (k, year) FROM x WHERE year IS NOT NULL)) AS with_year,
round(count(DISTINCT truth_id) FILTER (k IN (SELECT k FROM x))::DOUBLE / count(*), 6) AS recall FROM (SELECT paper_id, truth_id, {nt('title')} AS k, year FROM latex_refs) GROUP BY paper_id""")
def d50(spark, d):
    """Entries of each author's source found among the extracted ones, and with the same year."""
    x = table(spark, d, "extracted_refs").where("title is not null").select(T.normalize_title("title").alias("k"), "year").distinct()
    t = table(spark, d, "latex_refs").select("paper_id", "truth_id", T.normalize_title("title").alias("k"), "year")
    j = t.join(x.select("k").distinct().withColumn("hit", F.lit(1)), "k", "left").join(x.where("year is not null").withColumn("hit_year", F.lit(1)), ["k", "year"], "left")
    f = F.count("hit")
    return j.groupBy("paper_id").agg(F.count("*").alias("truth"), f.alias("found"), F.count("hit_year").alias("with_year"), F.round(f / F.count("*"), 6).alias("recall"))


@query("j10_full_cascade", None)
def j10_full(spark, d):
    """All passes of the assignment: DOI, title and year, title, fuzzy title, author and year, whole text; each row is used once.

    The passes with a key of their own pair the n-th rows of a key, agreeing surnames first; the others are greedy in
    truth order. Tested against going through the rows one by one.
    """
    from folioforge.operators import matching as M
    x, t = table(spark, d, "extracted_refs"), table(spark, d, "latex_refs")
    key = T.normalize_title("title")
    sx, st = T.normalize_title(N.author_surname("author")), T.normalize_title(N.author_surname(F.get("authors", F.lit(0))))
    yx = F.col("year").cast("string")
    k = lambda *c: F.when(F.length(key) > 0, F.concat_ws("|", key, *c))
    with_ = lambda s: F.when(yx.isNotNull() & (F.length(s) > 0), k(yx, s))
    done = M.cascade(x, t, [("doi", F.nullif(ids.loose_doi("doi"), F.lit("")), F.nullif(ids.loose_doi("doi"), F.lit(""))), ("title", with_(sx), with_(st)), ("title", F.when(yx.isNotNull(), k(yx)), F.when(yx.isNotNull(), k(yx))),
                            ("title", F.when(F.length(sx) > 0, k(sx)), F.when(F.length(st) > 0, k(st))), ("title", k(), k())], "ref_id", "truth_id")
    done = materialize(done)
    open_ = lambda df, c: df.join(done.select(c), c, "left_anti")
    # fuzzy titles, over the different titles
    a, b = open_(x, "ref_id").select("ref_id", key.alias("kx"), "year", sx.alias("s")).where("kx != ''"), open_(t, "truth_id").select("truth_id", key.alias("kt"), F.col("year").alias("ty"), st.alias("ts")).where("kt != ''")
    near = M.jaccard_join(b.select("kt").distinct().withColumn("w", F.split("kt", " ")), a.select("kx").distinct().withColumn("w", F.split("kx", " ")), "kt", "kx", "w", "w", 4, 5)
    cand = near.join(b, "kt").join(a, "kx").where(~T.digits_conflict(T.digit_bag("kt"), T.digit_bag("kx")))
    same = lambda p, q: F.coalesce(F.col(p) == F.col(q), F.lit(False))
    fuzzy = R.greedy_match(cand, "truth_id", "ref_id", [F.desc(F.col("inter") / F.col("uni")), F.desc(same("year", "ty")), F.desc(same("s", "ts"))])
    done = materialize(done.unionByName(fuzzy.select("ref_id", "truth_id", F.lit("fuzzy_title").alias("method"))))
    a, b = open_(x, "ref_id").select("ref_id", key.alias("kx"), ids.author_year_key(sx, "year").alias("k")).where("k is not null"), open_(t, "truth_id").select("truth_id", key.alias("kt"), ids.author_year_key(st, "year").alias("k")).where("k is not null")
    c = lambda p: F.coalesce(p, F.lit(""))
    clash = F.col("kx").isNotNull() & F.col("kt").isNotNull() & T.digits_conflict(T.digit_bag(c("kt")), T.digit_bag(c("kx")))
    ay = R.greedy_within(b.join(a, "k").where(~F.coalesce(clash, F.lit(False))), "truth_id", "ref_id", "k")
    done = materialize(done.unionByName(ay.select("ref_id", "truth_id", F.lit("author_year").alias("method"))))
    body = lambda col: F.regexp_replace(T.join_break_hyphens(col), r"^\s*\[[^\]]{1,12}\]\s*", "")
    a, b = open_(x, "ref_id").select("ref_id", T.words(body("raw")).alias("w")), open_(t, "truth_id").select("truth_id", T.words(body("text")).alias("w"))
    near = M.jaccard_join(b, a, "truth_id", "ref_id", "w", "w", 3, 5)
    text = R.greedy_match(near, "truth_id", "ref_id", [F.desc(F.col("inter") / F.col("uni"))])
    return done.unionByName(text.select("ref_id", "truth_id", F.lit("text").alias("method")))


# ---- rebuilt runs --------------------------------------------------------------------------------
@query("s17_load_pages", f"SELECT c.run_id, c.page, c.idx, c.text FROM chunks c JOIN {LATEST} r ON r.run_id = c.run_id AND r.doc_hash = c.doc_hash")
def s17(spark, d):
    """Pages of the latest runs, one row a piece in order of (page, idx)."""
    r = L.latest_run(table(spark, d, "runs")).select("run_id", "doc_hash")
    return table(spark, d, "chunks").join(r, ["run_id", "doc_hash"]).select("run_id", "page", "idx", "text")


@query("s19_load_metadata", f"""SELECT r.run_id, m.title, lower(m.doi) AS doi, m.pub_year, m.journal FROM {LATEST} r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY doc_version DESC, pmcid DESC) rn FROM manifest_item) WHERE rn = 1) m ON m.doc_hash = r.doc_hash""")
def s19(spark, d):
    r = L.latest_run(table(spark, d, "runs")).select("run_id", "doc_hash")
    m = table(spark, d, "manifest_item").groupBy("doc_hash").agg(F.max_by(F.struct("title", "doi", "pub_year", "journal"), F.struct("doc_version", "pmcid")).alias("m"))
    return r.join(m, "doc_hash").select("run_id", "m.title", F.lower("m.doi").alias("doi"), "m.pub_year", "m.journal")


@query("s20_load_references", f"SELECT x.run_id, x.idx, x.label, x.raw, x.author, x.title, x.year, x.doi FROM extracted_refs x JOIN {LATEST} r ON r.run_id = x.run_id AND r.doc_hash = x.doc_hash")
def s20(spark, d):
    r = L.latest_run(table(spark, d, "runs")).select("run_id", "doc_hash")
    return table(spark, d, "extracted_refs").join(r, ["run_id", "doc_hash"]).select("run_id", "idx", "label", "raw", "author", "title", "year", "doi")


@query("s21_load_citations", f"""SELECT c.run_id, c.page, count(*) AS markers FROM (SELECT run_id, doc_hash, page, unnest(regexp_extract_all(text, '{X.NUMERIC}', 1)) FROM chunks) c JOIN {LATEST} r ON r.run_id = c.run_id AND r.doc_hash = c.doc_hash GROUP BY ALL""")
def s21(spark, d):
    r = L.latest_run(table(spark, d, "runs")).select("run_id", "doc_hash")
    c = table(spark, d, "chunks").join(r, ["run_id", "doc_hash"]).select("run_id", "page", F.size(F.regexp_extract_all("text", F.lit(X.NUMERIC), F.lit(1))).alias("n"))
    return c.groupBy("run_id", "page").agg(F.sum("n").alias("markers")).where("markers > 0")


@query("s22_load_document", "SELECT doc_hash, count(*) AS versions, string_agg(pmcid || 'v' || doc_version::VARCHAR, ' ' ORDER BY pmcid, doc_version) AS sources FROM manifest_item GROUP BY doc_hash")
def s22(spark, d):
    s = F.transform(F.array_sort(F.collect_list(F.struct("pmcid", "doc_version"))), lambda x: F.concat(x["pmcid"], F.lit("v"), x["doc_version"].cast("string")))
    return table(spark, d, "manifest_item").groupBy("doc_hash").agg(F.count("*").alias("versions"), F.array_join(s, " ").alias("sources"))


@query("s26_document_detail", f"""SELECT r.run_id, r.status, coalesce(p.pieces, 0) AS pieces, coalesce(x.refs, 0) AS refs FROM {ONE_RUN} r LEFT JOIN (SELECT run_id, count(*) AS pieces FROM chunks GROUP BY 1) p USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS refs FROM extracted_refs GROUP BY 1) x USING (run_id)""")
def s26(spark, d):
    """Detail of every run: status and sizes."""
    p = table(spark, d, "chunks").groupBy("run_id").agg(F.count("*").alias("pieces"))
    x = table(spark, d, "extracted_refs").groupBy("run_id").agg(F.count("*").alias("refs"))
    r = L.delivered_once(table(spark, d, "runs")).select("run_id", "status")
    return r.join(p, "run_id", "left").join(x, "run_id", "left").select("run_id", "status", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("refs", F.lit(0)).alias("refs"))


@query("d53_refreshed_index", "SELECT doc_hash, count(*) AS chunks FROM chunks GROUP BY doc_hash")
def d53(spark, d):
    """An index built over half of the documents and then refreshed: only new or changed ones are worked on again (D53, ST01)."""
    from folioforge.streaming import streams as S
    h = F.conv(F.substring(F.sha2(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    now = materialize(table(spark, d, "chunks").groupBy("doc_hash").agg(F.count("*").alias("chunks"), F.sum(h).cast("string").alias("fingerprint")))
    stored = materialize(now.where(F.pmod(F.xxhash64("doc_hash"), F.lit(2)) == 0))
    changed = S.changed_only(now, stored, "doc_hash", "fingerprint")
    return L.merge_runs(stored, changed, ["doc_hash"]).select("doc_hash", "chunks")


@query("d54_page_facts", "SELECT pmcid, doc_version, lower(doi) AS doi, 'https://x.org/' || pmcid || '.pdf' AS pdf FROM manifest_item")
def d54(spark, d):
    """Facts of captured pages: declared DOI and PDF link."""
    page = F.concat(F.lit('<html><head><meta name="citation_doi" content="'), F.coalesce("doi", F.lit("")), F.lit('"><meta name="citation_pdf_url" content="https://x.org/'), "pmcid", F.lit('.pdf"></head><body>text</body></html>'))
    h = table(spark, d, "manifest_item").select("pmcid", "doc_version", U.html_fields(page).alias("h"))
    return h.select("pmcid", "doc_version", N.find_doi(F.element_at("h.meta", "citation_doi")).alias("doi"), F.element_at("h.meta", "citation_pdf_url").alias("pdf"))


# ---- catalogues, windows and other operators of tables --------------------------------------------
def _eav(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("itemID"), "p_name", "p_brand")
    rows = p.select("itemID", F.explode(F.array(F.struct(F.lit(1).alias("fieldID"), F.col("p_name").alias("value")), F.struct(F.lit(2).alias("fieldID"), F.col("p_brand").alias("value")))).alias("v")).select("itemID", "v.*")
    rows = rows.withColumn("valueID", F.col("itemID") * 10 + F.col("fieldID"))
    names = spark.createDataFrame([(1, "title"), (2, "publicationTitle")], "fieldID int, fieldName string")
    return rows.select("itemID", "fieldID", "valueID"), names, rows.select("valueID", "value")


@query("j05_item_fields", 'SELECT p_partkey AS "itemID", p_name AS title, p_brand AS venue FROM part')
def j05(spark, d):
    f = C.item_fields(*_eav(spark, d))
    r = C.record_of(F.col("fields"))
    return f.select("itemID", r["title"].alias("title"), r["venue"].alias("venue"))


@query("j06_item_creators", "SELECT truth_id AS \"itemID\", array_to_string(authors, '|') AS names FROM latex_refs WHERE len(authors) > 0")
def j06(spark, d):
    a = table(spark, d, "latex_refs").select(F.col("truth_id").alias("itemID"), F.posexplode("authors").alias("orderIndex", "lastName")).withColumn("creatorID", F.col("itemID") * 1000 + F.col("orderIndex"))
    types = spark.createDataFrame([(1, "author")], "creatorTypeID int, creatorType string")
    c = C.item_creators(a.select("itemID", "creatorID", "orderIndex", F.lit(1).alias("creatorTypeID")), a.select("creatorID", "lastName", F.lit("").alias("firstName")), types)
    return c.select("itemID", F.array_join(F.transform("creators", lambda x: x["last"]), "|").alias("names"))


@query("j07_live_items", "SELECT doc_id AS \"itemID\" FROM documents WHERE kind <> 'note' AND lang IS NOT NULL")
def j07(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("itemID"), F.col("kind").alias("itemTypeID"), "lang")
    return C.live_items(x.select("itemID", "itemTypeID"), x.where("lang is null").select("itemID"), x.select("itemTypeID", F.col("itemTypeID").alias("typeName")).where("itemTypeID is not null").distinct()).select("itemID")


@query("j08_live_attachments", "SELECT a.chunk_id AS \"itemID\" FROM chunks a JOIN chunks p ON p.chunk_id = a.chunk_id - 1 WHERE coalesce(a.text, '') <> '' AND coalesce(p.text, '') <> ''")
def j08(spark, d):
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("itemID"), F.coalesce("text", F.lit("")).alias("text"))
    parent = c.select((F.col("itemID") + 1).alias("itemID"), F.col("itemID").alias("parentItemID"))
    return C.live_attachments(c.select("itemID"), parent, c.where("text = ''").select("itemID")).select("itemID")


@query("j09_memberships", "SELECT doc_id AS \"itemID\", source AS names FROM documents WHERE source IS NOT NULL")
def j09(spark, d):
    x = table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("itemID"), F.col("source").alias("collectionID"))
    return C.memberships(x, x.select("collectionID", F.col("collectionID").alias("collectionName")).distinct()).select("itemID", F.array_join("collections", "|").alias("names"))


@query("j33_unique_links", "SELECT doc_hash, page, doi AS uri, (idx % 3)::DOUBLE AS x0, min(ref_id) AS ref_id FROM extracted_refs GROUP BY doc_hash, page, doi, idx % 3")
def j33(spark, d):
    x = table(spark, d, "extracted_refs").select("doc_hash", "page", F.col("doi").alias("uri"), (F.col("idx") % 3).cast("double").alias("x0"), *[F.lit(0.0).alias(c) for c in ("y0", "x1", "y1")], "ref_id", F.col("ref_id").alias("seq"))
    return C.unique_links(x, ["doc_hash", "page"]).select("doc_hash", "page", "uri", "x0", "ref_id")


@query("j40_carried_heads", r"""SELECT doc_hash, page, open || ' ' || rest AS "group" FROM (SELECT doc_hash, page, regexp_extract(t, '([\[(][^\])]*)$', 1) AS open, lead(regexp_extract(t, '^([^\[(]*?[\])])', 1)) OVER (PARTITION BY doc_hash ORDER BY page) AS rest FROM (SELECT doc_hash, page, min(text) AS t FROM chunks GROUP BY ALL)) WHERE open <> '' AND rest <> ''""")
def j40(spark, d):
    p = table(spark, d, "chunks").groupBy("doc_hash", "page").agg(F.min("text").alias("t"))
    return C.carried_heads(p, "doc_hash", "page", "t")


@query("w07_line_joins", rf"""SELECT chunk_id, line_no, l AS "left", r AS "right" FROM (SELECT chunk_id, line_no, regexp_extract(line, '(\p{{L}}+)[-¬‐]\s*$', 1) AS l, lead(regexp_extract(line, '^\s*(\p{{L}}+)', 1)) OVER (PARTITION BY chunk_id ORDER BY line_no) AS r FROM {LINES}) WHERE l <> '' AND r <> ''""")
def w07(spark, d):
    return C.line_joins(_lines(spark, d), "chunk_id", "line_no", "line")


@query("w10_bare_runs", rf"""SELECT chunk_id, min(n) AS first, count(*) AS n, min(line_no) AS line_no FROM (SELECT chunk_id, line_no, n, row_number() OVER (PARTITION BY chunk_id ORDER BY line_no) - n AS island FROM (SELECT chunk_id, line_no, nullif(regexp_extract(line, '^\s*([0-9]{{1,4}})[.)]?\s*$', 1), '')::INT AS n FROM {LINES}) WHERE n IS NOT NULL) GROUP BY chunk_id, island HAVING min(n) = 1 AND count(*) >= 3""")
def w10(spark, d):
    return C.bare_runs(_lines(spark, d), "chunk_id", "line_no", "line")


@query("w14_sections", rf"""SELECT chunk_id, line_no, number, heading, lead(heading) OVER (PARTITION BY chunk_id ORDER BY line_no) AS next FROM (SELECT chunk_id, line_no, regexp_extract(line, '^\s*([0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{0,3}})\.?\s+\p{{Lu}}', 1) AS number, trim(regexp_extract(line, '^\s*[0-9.]+\s+(\p{{Lu}}.{{2,80}})$', 1)) AS heading FROM {LINES}) WHERE number <> '' AND heading <> ''""")
def w14(spark, d):
    return C.sections(_lines(spark, d), "chunk_id", "line_no", "line")


@query("w16_carried_state", "SELECT doc_hash, page, last_value(doi IGNORE NULLS) OVER (PARTITION BY doc_hash ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM (SELECT doc_hash, page, min(doi) AS doi FROM chunks GROUP BY ALL)")
def w16(spark, d):
    p = table(spark, d, "chunks").groupBy("doc_hash", "page").agg(F.min("doi").alias("doi"))
    return C.carried_state(p, "doc_hash", "page", "doi").select("doc_hash", "page", "carried")


@query("w12_numbered_lists", None)
def w12(spark, d):
    """Entries of numbered lists of the bibliographies (W12); tested by cases."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n").alias("lines"))
    return D.segment_entries(x, ["doc_id"]).where("label is not null")


@query("d23_metadata_by_priority", """SELECT doc_hash, 'title' AS field, coalesce(m.title, c.title) AS value, CASE WHEN m.title IS NOT NULL THEN 'manifest' ELSE 'chunk' END AS source FROM (SELECT doc_hash, min(nullif(trim(title), '')) AS title FROM manifest_item GROUP BY 1) m FULL JOIN (SELECT doc_hash, min(nullif(trim(title), '')) AS title FROM chunks GROUP BY 1) c USING (doc_hash) WHERE coalesce(m.title, c.title) IS NOT NULL""")
def d23(spark, d):
    one = lambda t, s, k: table(spark, d, t).groupBy("doc_hash").agg(F.min(F.nullif(F.trim("title"), F.lit(""))).alias("value")).select("doc_hash", F.lit("title").alias("field"), "value", F.lit(s).alias("source"), F.lit(k).alias("priority"), F.lit(0).alias("pos"))
    return C.prioritised(one("manifest_item", "manifest", 0).unionByName(one("chunks", "chunk", 1)), "doc_hash")


@query("d42_better_result", f"""SELECT doc_hash, max(finished_at) AS finished_at FROM (SELECT * FROM {ONE_RUN}) WHERE run_id % 2 IN (0, 1) AND finished_at IS NOT NULL GROUP BY doc_hash""")
def d42(spark, d):
    """Of two sets of runs the one with the better quality tuple for each document."""
    r = L.delivered_once(table(spark, d, "runs")).where("finished_at is not null")
    part = lambda k: r.where(F.col("run_id") % 2 == k).groupBy("doc_hash").agg(F.max("finished_at").alias("finished_at"))
    return C.better_result(part(0), part(1), "doc_hash", ["finished_at"])


@query("u01_append_documents", "SELECT doc_hash, bool_or(doi IS NOT NULL) AS flag FROM (SELECT doc_hash, doi FROM chunks UNION ALL SELECT doc_hash, doi FROM extracted_refs) GROUP BY 1")
def u01(spark, d):
    part = lambda t: table(spark, d, t).groupBy("doc_hash").agg(F.bool_or(F.col("doi").isNotNull()).alias("flag")).withColumn("methods", F.array(F.lit(t)))
    return C.append_documents([part("chunks"), part("extracted_refs")], "doc_hash", "flag", "methods").select("doc_hash", "flag")


@query("x61_snippets", None)
def x61(spark, d):
    """Sixteen words around the first hit of each chunk, the hit in brackets."""
    w = F.split(T.collapse("text"), " ")
    at = F.array_position(F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"\W", ""))), "coastal")
    start = F.greatest(at - 8, F.lit(1)).cast("int")
    part = F.slice(F.transform(w, lambda x: F.when(F.lower(F.regexp_replace(x, r"\W", "")) == "coastal", F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)), start, F.lit(16))
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", F.when(at > 0, F.array_join(part, " ")).alias("snippet")).where("snippet is not null")


@query("a38_summary_lines", f"""SELECT r.run_id, r.status || chr(9) || substring(r.doc_hash, 1, 12) || chr(9) || coalesce(p.pages, 0)::VARCHAR || 'p' || chr(9) || coalesce(x.refs, 0)::VARCHAR || ' refs' AS line FROM {ONE_RUN} r LEFT JOIN (SELECT run_id, count(DISTINCT page) AS pages FROM chunks GROUP BY 1) p USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS refs FROM extracted_refs GROUP BY 1) x USING (run_id)""")
def a38(spark, d):
    p = table(spark, d, "chunks").groupBy("run_id").agg(F.count_distinct("page").alias("pages"))
    x = table(spark, d, "extracted_refs").groupBy("run_id").agg(F.count("*").alias("refs"))
    r = L.delivered_once(table(spark, d, "runs")).join(p, "run_id", "left").join(x, "run_id", "left")
    n = lambda c, s: F.concat(F.coalesce(c, F.lit(0)).cast("string"), F.lit(s))
    return r.select("run_id", F.concat_ws("\t", "status", F.substring("doc_hash", 1, 12), n("pages", "p"), n("refs", " refs")).alias("line"))


@query("a37_throughput", f"SELECT backend_name, count(*) AS runs, round(sum(pieces)::DOUBLE / nullif(sum(finished_at - started_at), 0), 6) AS pieces_a_second FROM {ONE_RUN} r JOIN (SELECT run_id, count(*) AS pieces FROM chunks GROUP BY 1) p USING (run_id) GROUP BY 1")
def a37(spark, d):
    p = table(spark, d, "chunks").groupBy("run_id").agg(F.count("*").alias("pieces"))
    r = L.delivered_once(table(spark, d, "runs")).join(p, "run_id")
    return r.groupBy("backend_name").agg(F.count("*").alias("runs"), F.round(F.try_divide(F.sum("pieces").cast("double"), F.sum(F.expr("finished_at - started_at"))), 6).alias("pieces_a_second"))


@query("j35_positional_alignment", "SELECT x.ref_id, x.doc_hash, x.idx FROM extracted_refs x JOIN (SELECT doc_hash, run_id, count(*) AS n FROM extracted_refs GROUP BY ALL) c USING (doc_hash, run_id) JOIN (SELECT doc_hash, max(ref_count) AS m FROM manifest_item GROUP BY 1) m ON m.doc_hash = x.doc_hash WHERE c.n = m.m")
def j35(spark, d):
    """Entries of lists as long as the paper says: these are aligned by position."""
    x = table(spark, d, "extracted_refs")
    n = x.groupBy("doc_hash", "run_id").agg(F.count("*").alias("n"))
    m = table(spark, d, "manifest_item").groupBy("doc_hash").agg(F.max("ref_count").alias("m"))
    return x.join(n, ["doc_hash", "run_id"]).join(m, "doc_hash").where("n = m").select("ref_id", "doc_hash", "idx")


@query("x123_box_overlap", "SELECT ref_id, greatest(least((idx % 7) + 5, 8) - greatest(idx % 7, 3), 0)::DOUBLE * 2 AS area FROM extracted_refs")
def x123(spark, d):
    box = lambda x0, x1: F.struct(x0.cast("double").alias("x0"), F.lit(0.0).alias("y0"), x1.cast("double").alias("x1"), F.lit(2.0).alias("y1"))
    return table(spark, d, "extracted_refs").select("ref_id", D.overlap_area(box(F.col("idx") % 7, F.col("idx") % 7 + 5), box(F.lit(3), F.lit(8))).alias("area"))


@query("x110_paper_truth", "SELECT truth_id, 'T' || truth_id::VARCHAR AS title, 'Ann Berg|Bo Dahl' AS authors FROM latex_refs")
def x110(spark, d):
    r"""Title and authors of a LaTeX title page, \title and \author with their groups (X110, X37)."""
    src = F.concat(F.lit("\\documentclass{a}\\title{T"), F.col("truth_id").cast("string"), F.lit("}\\author{Ann Berg \\and Bo Dahl}\\begin{document}x\\end{document}"))
    t = F.regexp_extract(src, r"\\title\{([^{}]*)\}", 1)
    a = F.transform(F.split(F.regexp_extract(src, r"\\author\{([^{}]*)\}", 1), r"\\and"), lambda x: F.trim(x))
    return table(spark, d, "latex_refs").select("truth_id", t.alias("title"), F.array_join(a, "|").alias("authors"))
