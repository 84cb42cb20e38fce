"""Operators without SQL: brute force, fixed cases and round trips on small fixtures."""
import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import ids, text, urls
from folioforge.operators import documents as D
from folioforge.operators import matching as M
from folioforge.operators import search as S
from folioforge.operators import text_ops as O
from folioforge.operators.graph import connected_components
from folioforge.operators.ledger import latest_run
from folioforge.sources import readers, sinks


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_connected_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, None), (5000, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if b is not None for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jaccard_join_against_all_pairs(spark):
    rng = random.Random(1)
    sets = [rng.sample("abcdefghij", rng.randint(1, 6)) for _ in range(60)] + [[]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, w array<string>")
    got = {(r.i, r.j) for r in M.jaccard_join(df, df.withColumnRenamed("i", "j"), "i", "j", "w", "w").collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(set(a) & set(b)) * 5 >= len(set(a) | set(b)) * 4}
    assert got == want


def test_rank_pairing_equals_first_unused(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "l int, k string")
    b = spark.createDataFrame([(10, "x"), (11, "y"), (12, "y"), (13, "x")], "r int, k string")
    assert sorted((x.l, x.r) for x in M.rank_pairing(a, b, "k", "l", "r").collect()) == [(1, 10), (2, 13), (3, 11)]


def test_merge_groups_and_first_known(spark):
    df = spark.createDataFrame([(1, "d", None, None), (2, "d", "t", 5), (3, None, "t", 6), (4, None, None, 7)], "i bigint, doi string, t string, y int")
    g = {r.i: r.grp for r in M.merge_groups(df, "i", [F.col("doi"), F.col("t")]).collect()}
    assert g == {1: 1, 2: 1, 3: 1, 4: 4}
    m = M.first_known(df.join(M.merge_groups(df, "i", [F.col("doi"), F.col("t")]), "i"), "grp", F.col("i"), ["t", "y"]).where("grp = 1").first()
    assert (m.t, m.y) == ("t", 5)


def test_latest_run_ties_nulls_and_deliveries(spark):
    rows = [(1, "h", "complete", 5, "2020-01-01"), (1, "h", "failed", 5, "2020-02-01"), (2, "h", "complete", 7, "2020-01-01"), (3, "h", "partial", 7, "2020-01-01"), (4, "g", "failed", 9, "2020-01-01"), (5, "k", "complete", None, "2020-01-01")]
    df = spark.createDataFrame(rows, "run_id bigint, doc_hash string, status string, finished_at bigint, landed_at string")
    assert {r.doc_hash: r.run_id for r in latest_run(df).collect()} == {"h": 3, "k": 5}
    assert {r.doc_hash: r.run_id for r in latest_run(df, usable_only=False).collect()} == {"h": 3, "g": 4, "k": 5}


def test_word_windows():
    w = [f"w{i}" for i in range(500)]
    assert O.word_windows(w) == [(0, 200), (160, 360), (320, 500)]
    w[149], w[150] = "end.", "Start"
    assert O.word_windows(w)[0] == (0, 150) and O.word_windows([]) == []


def test_lcs_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(100):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert O.lcs_length(a, b) == t[-1][-1]


def test_identifiers(spark):
    n = lambda f, x: one(spark, f(F.lit(x)))
    assert n(ids.normalize_doi, "https://doi.org/10.1234/AbC(1).") == "10.1234/abc(1)" and n(ids.normalize_doi, "10.1/x") is None and n(ids.normalize_doi, "doi: 10.1234/abc)") == "10.1234/abc"
    assert n(ids.normalize_arxiv, "arXiv:2101.00001v2") == "2101.00001" and n(ids.normalize_arxiv, "hep-th/9901001") == "hep-th/9901001" and n(ids.normalize_arxiv, "x") is None
    assert n(ids.normalize_pmcid, "pmc123") == "PMC123" and n(ids.normalize_pmid, "PMID: 0042") == "42" and n(ids.arxiv_from_doi, "10.48550/arXiv.2101.1") == "2101.1"
    assert n(ids.find_year, "1999–2001 (2005a)") == 2005 and n(ids.year_from_arxiv, "9901001") == 1999 and n(ids.year_from_date, "D:20210304") == 2021
    assert n(ids.printed_family, "Anna van der Berg") == "van der Berg" and n(ids.family_of, "Anna van der Berg") == "der Berg" and n(ids.person_key, "Berg, Anna") == "berg|a"
    h = one(spark, ids.fnv1a(F.lit("foobar")))
    assert h % (1 << 64) == 0x85944171F73967E8 and one(spark, ids.fnv1a(F.lit(""))) % (1 << 64) == 0xCBF29CE484222325


def test_text_functions(spark):
    n = lambda f, x: one(spark, f(F.lit(x)))
    assert n(text.cited_numbers, "[3, 7-9]") == [3, 7, 8, 9] and n(text.cited_numbers, "[9-7]") == [] and n(text.cited_numbers, "[0]") == []
    assert n(text.normalize_title, "  The “Ünïted” X-1! ") == "the ünïted x 1" and n(text.expand_ligatures, "ﬁeld") == "field" and n(text.join_break_hyphens, "recon- struction") == "reconstruction"
    assert n(text.safe_file_stem, "../a b?.pdf") == "a_b_.pdf" and n(text.is_page_number, " – 12 – ") and not n(text.is_page_number, "12 monkeys")
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 1.0


def test_urls(spark):
    n = lambda f, x: one(spark, f(F.lit(x)))
    assert n(urls.normalize_url, "HTTPS://Ex.org:443/a/./b/../c?utm_source=1&x=2#f") == "https://ex.org/a/c?x=2" and n(urls.normalize_url, "ex.org") == "https://ex.org/" and n(urls.normalize_url, "ftp://x.y/") is None
    assert n(urls.percent_encode, "a b~*/ü") == "a%20b~%2A%2F%C3%BC" and n(urls.percent_decode, "a%20b+c") == "a b+c" and n(urls.percent_decode, "%zz") == "%zz"
    assert n(urls.safe_url, "http://u:p@x/") is None and n(urls.extension, "http://x/a.PDF?q=1") == "pdf" and n(urls.classify_pdf_url, "http://x/pdf/1") == "possible"
    assert [n(urls.public_ip, x) for x in ("8.8.8.8", "10.1.1.1", "172.20.0.1", "300.1.1.1", "192.168.0.1", "1.2.3")] == [True, False, False, False, False, False]
    assert one(spark, urls.looks_like_pdf(F.lit(b"\n%PDF-1.7"))) and not one(spark, urls.looks_like_pdf(F.lit(b"x")))


def test_html(spark):
    page = '<html><head><title>T &amp; U</title><meta name="citation_doi" content="10.1/x"><script>var a="</p>";</script></head><body><nav>skip</nav><p>One<br>two &#233;</p><a href="/a.pdf">x</a><b>bold</body>'
    t, txt, meta, links, _ = urls.read_html(page)
    assert t == "T & U" and txt == "One\ntwo é\nxbold" and meta == {"citation_doi": "10.1/x"} and links == ["/a.pdf"] and urls.read_html(None) is None
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(urls.html_fields("html").alias("f"))
    assert [r.f.title for r in df.collect()] == ["T & U", None, None]
    assert one(spark, urls.strip_simple_tags(F.lit("<b>a</b> &lt; <i>c</i>"))) == "a < c"


def test_vector_search_against_brute_force(spark):
    rng = random.Random(2)
    vs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(80)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id int, embedding array<double>")
    q = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r.vec_id) for r in S.vector_search(df, q, 5).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    assert got == {(i, j) for i in range(3) for j in sorted(range(80), key=lambda j: (-cos(vs[i], vs[j]), j))[:5]}


def test_reading_order_two_columns(spark):
    rows = [("h", 1, t, x, y, x + 200.0, y + 10.0, 10.0) for t, x, y in [("L1", 50.0, 700.0), ("R1", 300.0, 700.0), ("L2", 50.0, 680.0), ("R2", 300.0, 680.0)]] + [("h", 1, "Head", 50.0, 760.0, 500.0, 775.0, 14.0), ("h", 1, " ", 0.0, 0.0, 1.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "hash string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [r.text for r in D.order_pages(df).orderBy("idx").collect()] == ["Head", "L1", "L2", "R1", "R2"]


def test_lists_and_entries(spark):
    assert D.segment_numbered(["[1] A. B. 2001.", "goes on", "[2] C.", "[5] no entry", "[3] D."]) == [("[1]", "A. B. 2001. goes on"), ("[2]", "C. [5] no entry"), ("[3]", "D.")]
    assert [x for x, _ in D.segment_numbered(["1. a", "2. b", "3. c"])] == ["1.", "2.", "3."] and D.segment_numbered(["x"]) == []
    f = D.parse_entry("[3] Edward Tasi, Berg, Anna “On the reefs,” J. Rural Medicine, vol. 77, pp. 605–612, 2024. doi:10.1234/ab.")
    assert f[0] == ["Edward Tasi", "Berg, Anna"] and f[1] == "On the reefs" and f[2] == 2024 and f[3] == "J. Rural Medicine" and f[4] == "77" and f[6] == "605–612" and f[7] == "10.1234/ab"
    f = D.parse_entry("Noor V. Puz et al. Hepatic soils of the coast. Annals of Rural Medicine. 1999;12:1–9.")
    assert f[0] == ["Noor V. Puz"] and f[1] == "Hepatic soils of the coast" and f[2] == 1999 and D.parse_entry(None) is None and D.parse_entry("")[1] is None
    e = spark.createDataFrame([("d", 0, "no evidence"), ("d", 1, "A (2001)"), ("d", 2, "goes on"), ("d", 3, "B (2002)"), ("d", 4, "tail"), ("e", 0, "x"), ("e", 1, "y")], "d string, idx int, raw string")
    got = sorted((r.d, r.idx, r.raw) for r in D.evidence_guard(e, ["d"], "idx", "raw").collect())
    assert got == [("d", 0, "no evidence A (2001) goes on"), ("d", 3, "B (2002)"), ("e", 0, "x"), ("e", 1, "y")]


def test_latex():
    bib = '@article{a1, title = {The {N}ested {T}itle}, author = "M\\"uller, A.", year = 2001}\n@comment{x, y}\n@book{b2, title={X}}'
    assert [(t, k, f.get("title"), f.get("year")) for t, k, f in D.parse_bib(bib)] == [("article", "a1", "The {N}ested {T}itle", "2001"), ("book", "b2", "X", None)]
    assert D.parse_bbl(r"\begin{thebibliography}{9}\bibitem[A1]{k1} A. \emph{Bee}. \bibitem{k2} C\'er\'e\end{thebibliography}") == [("A1", "k1", "A. Bee."), (None, "k2", "Céré")]
    assert D.cite_keys(r"a \cite{x,y} % \cite{no}" + "\n" + r"\citep[p. 1]{z}") == ["x", "y", "z"] and D.latex_to_text(None) is None
    assert D.latex_to_text(r"Erd\H{o}s and \O{}re {\bf no} --- 5\%") == "Erdős and Øre no — 5%"


def test_interval_and_box_functions(spark):
    r = lambda *p: F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in p])
    assert [tuple(x) for x in one(spark, D.subtract_ranges(r((0, 10), (20, 30)), r((2, 4), (25, 40))))] == [(0, 2), (4, 10), (20, 25)]
    m = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("n")))
    assert one(spark, D.mask_ranges(F.lit("abcd"), m)) == "a  d"
    b = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v)])
    assert one(spark, D.overlap_area(b(0, 0, 2, 2), b(1, 1, 3, 3))) == 1.0 and one(spark, D.mostly_inside(b(0, 0, 1, 1), b(0, 0, 9, 9))) and not one(spark, D.mostly_inside(b(0, 0, 4, 4), b(0, 0, 1, 1)))
    links = spark.createDataFrame([("h", 1, 0, 50.0, 1), ("h", 1, 0, 90.0, 2)], "h string, page int, column int, y double, link int")
    anchors = spark.createDataFrame([("h", 1, 0, 60.0, 7), ("h", 1, 0, 80.0, 8)], "h string, page int, column int, y double, entry int")
    assert {x.link: x.entry for x in D.nearest_above(links, anchors, ["h", "page"], "link", "entry").collect()} == {1: 7, 2: None}


def test_api_answers(spark):
    df = lambda o: spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),), (None,), ("{bad",)], "body string")
    c = readers.crossref(df({"message": {"items": [{"DOI": "10.1/A", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"name": "Org"}], "issued": {"date-parts": [[2001, 2]]}, "abstract": "<p>x</p>"}]}})).collect()
    assert len(c) == 1 and c[0].doi == "10.1/a" and c[0].authors == ["A B", "Org"] and c[0].year == 2001 and c[0].abstract == "x"
    o = readers.openalex(df({"results": [{"id": "W1", "doi": "https://doi.org/10.1/b", "title": "T", "publication_year": 2002, "authorships": [{"author": {"display_name": "N"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}]})).first()
    assert o.abstract == "a b a" and o.doi == "10.1/b" and o.authors == ["N"]
    assert readers.semantic_scholar(df({"data": [{"paperId": "p", "title": "T", "externalIds": {"DOI": "10.1/C"}}]})).first().doi == "10.1/c"
    assert readers.europepmc(df({"resultList": {"result": [{"id": "1", "title": "T", "authorString": "A B, C D.", "pubYear": "1999"}]}})).first().authors == ["A B", "C D"]
    assert [r.id for r in readers.esearch_ids(df({"esearchresult": {"idlist": ["5", "3"]}})).orderBy("pos").collect()] == ["5", "3"]
    s = readers.esummary(df({"result": {"uids": ["7"], "7": {"title": "T", "pubdate": "2003 Jan", "authors": [{"name": "N"}], "articleids": [{"idtype": "doi", "value": "10.1/D"}]}}})).first()
    assert (s.source_id, s.year, s.doi) == ("7", 2003, "10.1/d")
    assert readers.unpaywall(df({"doi": "10.1/E", "oa_locations": [{"url": "u", "url_for_pdf": "p"}, {"url": "u", "url_for_pdf": "p"}]})).count() == 1
    x = spark.createDataFrame([("P1", "<article><back><ref-list><ref id='r1'><label>1</label><mixed-citation>One</mixed-citation></ref><ref id='r2'><mixed-citation>Two</mixed-citation></ref></ref-list></back></article>")], "pmcid string, xml string")
    assert [(r.idx, r.ref, r.raw) for r in readers.jats_references(x).orderBy("idx").collect()] == [(0, "r1", "One"), (1, "r2", "Two")]
    assert readers.feed(spark.createDataFrame([("<rss><channel><item><title>a</title><link>l</link></item><item><title>b</title></item></channel></rss>",)], "body string")).count() == 2


def test_archives_and_snapshots(spark, tmp_path):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.tex", "x"), f.writestr("../evil", "y")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("b.tex")
        i.size = 1
        f.addfile(i, io.BytesIO(b"z"))
    df = spark.createDataFrame([("z", z.getvalue()), ("t", t.getvalue()), ("g", gzip.compress(b"plain")), ("bad", b"\x1f\x8bxx")], "path string, content binary")
    rows = {(r.path, r.member): (bytes(r.content) if r.content is not None else None, r.error is not None) for r in readers.unpack(df).collect()}
    assert rows["z", "a.tex"] == (b"x", False) and rows["z", "../evil"] == (None, True) and rows["t", "b.tex"] == (b"z", False) and rows["g", None] == (b"plain", False) and rows["bad", None] == (None, True)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-"), (tmp_path / "b.pdf").write_bytes(b"x" * 99), (tmp_path / "c.txt").write_bytes(b"n")
    assert readers.snapshot(spark, str(tmp_path), max_bytes=50).count() == 1


def test_sinks(spark, tmp_path):
    keys = ["h", "b"]
    mk = lambda rows: spark.createDataFrame(rows, "h string, b string, v int")
    p = str(tmp_path / "t")
    sinks.publish(spark, mk([("1", "x", 1), ("2", None, 2)]), p, keys)
    sinks.publish(spark, mk([("2", None, 3), ("3", "x", 4)]), p, keys)
    assert {(r.h, r.b, r.v) for r in spark.read.parquet(p).collect()} == {("1", "x", 1), ("2", None, 3), ("3", "x", 4)}
    q = str(tmp_path / "q")
    sinks.publish(spark, mk([("1", "x", 1), ("2", "y", 2)]), q, ["b"], partition="h")
    sinks.publish(spark, mk([("2", "y", 9)]), q, ["b"], partition="h")
    assert {(str(r.h), r.v) for r in spark.read.parquet(q).collect()} == {("1", 1), ("2", 9)}
    r = sinks.compare_and_set(mk([("1", "x", 1), ("2", "x", 2)]), spark.createDataFrame([("1", 5, 1), ("2", 6, 99)], "h string, v int, base int"), "h", "v", "base")
    assert {(x.h, x.v, x.applied) for x in r.collect()} == {("1", 5, True), ("2", 2, False)}
    sinks.references_csv(spark.createDataFrame([(1, 'a "q", b', ["x", "y"], None, 2001, None)], "id int, title string, authors array<string>, doi string, year int, raw string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().title == 'a "q", b'
    assert "| a |" in sinks.markdown(spark.createDataFrame([("v",)], "a string"), "T")


def test_cookies(spark):
    jar = spark.createDataFrame([(".ex.org", "TRUE", "/", "FALSE", 0, "a", "1"), ("ex.org", "FALSE", "/p", "TRUE", 0, "b", "2"), ("ex.org", "FALSE", "/", "FALSE", 5, "old", "3")], "domain string, include_subdomains string, path string, secure string, expires bigint, name string, value string")
    u = spark.createDataFrame([("https://ex.org/p/x",), ("http://sub.ex.org/",)], "url string")
    got = {(r.url, r.name, r.pos) for r in readers.cookies_for(u, jar, 100).collect()}
    assert got == {("https://ex.org/p/x", "b", 1), ("https://ex.org/p/x", "a", 2), ("http://sub.ex.org/", "a", 1)}


def test_streams(spark, tmp_path):
    from folioforge.streaming import streams
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-09 00:00:00")], "user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "e.parquet")
    e.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(e.schema).parquet(src)
    out = []
    streams.run_once(streams.sessions(s), lambda b, i: out.extend(b.collect()), str(tmp_path / "ck"))
    got = sorted((r.user_id, r.n) for r in out)
    assert (1, 2) in got
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, f string")
    assert [r.k for r in streams.changed_only(now, spark.createDataFrame([("a", "1"), ("b", "0")], "k string, f string"), "k", "f").collect()] == ["b"]
