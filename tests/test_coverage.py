"""Citations, greedy assignment, resolving, office and library readers against brute force and built inputs."""
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import lines as N, text as T
from folioforge.operators import citations as X, resolve as R
from folioforge.sources import library as B, office as O


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


# ---- lines ---------------------------------------------------------------------------------------
def test_line_tests(spark):
    n = lambda f, x: one(spark, f(F.lit(x)))
    assert n(N.is_stamp, "arXiv:2101.00001v2 [cs.CL] 3 Jan 2021") and not n(N.is_stamp, "arXiv:2101.00001")
    assert n(N.is_algorithm_line, "3: x") and n(N.is_algorithm_line, "for all y") and n(N.is_algorithm_line, "x ← 3") and not n(N.is_algorithm_line, "A sentence about reefs")
    assert n(N.is_lettered_affiliation, "a Department of Reefs, University of X, City") and not n(N.is_lettered_affiliation, "a river, a lake, a sea")
    assert n(N.is_math_heavy, "x = 1 + 2") and not n(N.is_math_heavy, "plain words") and not n(N.is_math_heavy, "")
    assert n(N.titleless_raw, "A. B. Smith, C. Jones, J. Chem. Phys., 2013, 42, 3127–3171.") and not n(N.titleless_raw, "Smith A. A title. J. 2013;4:1-2") and not n(N.titleless_raw, "A. Smith, “T,” J. Chem., 2013, 42, 31.")
    assert [n(N.author_surname, x) for x in ("Smith, J.", "J. A. Smith", "Smith AB", "John Smith Jr.", "Smith et al.", "")] == ["smith", "smith", "smith", "smith", "smith", ""]
    assert n(N.find_doi, "see 10. 1234/ab.c).") == "10.1234/ab.c" and n(N.find_doi, "none") is None and n(N.year_of_json, '"2001-05"') == 2001 and n(N.year_of_json, "20015") is None
    assert one(spark, N.page1_year(F.array(F.lit("in 1999"), F.lit("Received 3 May 2004")))) == 2004 and one(spark, N.page1_year(F.array(F.lit("x")))) is None
    w = one(spark, N.mark_incomplete(F.array(F.lit("extraction_incomplete: x")), F.lit(True), F.lit(True)))
    assert w == ["extraction_incomplete: x", "unicode_mapping: unmapped"] and one(spark, N.mark_incomplete(F.lit(None).cast("array<string>"), F.lit(None).cast("boolean"), F.lit(False))) == []
    spans = lambda *s: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(f).cast("string").alias("font")) for t, f in s])
    assert one(spark, N.is_code_line(spans(("abcdefgh", "CMTT10"), ("ab", None)))) and not one(spark, N.is_code_line(spans(("abc", "Times"), ("ab", "Courier"))))
    assert n(N.is_scholarly_host, "www.NATURE.com") and not n(N.is_scholarly_host, "notnature.com")
    assert one(spark, N.venue_in_entry(F.lit("Journal of Reefs"), F.lit("Smith. On kelp. Reefs 3"), F.lit("On kelp"))) and not one(spark, N.venue_in_entry(F.lit("Kelp"), F.lit("Smith. On kelp. 3"), F.lit("On kelp")))


# ---- citations -----------------------------------------------------------------------------------
def test_numbers_and_markers(spark):
    n = lambda x: one(spark, X.numbers_of(F.lit(x)))
    assert n("[3, 7–9]") == [3, 7, 8, 9] and n("[9-7]") == [] and n("[0]") == [] and n("²,⁴–⁶") == [2, 4, 5, 6]
    df = spark.createDataFrame([(1, "As shown [1, 2] and by others³ here.\n⁴,⁵\nend"), (2, None), (3, "")], "id int, text string")
    got = {(r.id, r.kind, r.number) for r in X.numeric_markers(df, ["id"], "text").collect()}
    assert got == {(1, "bracket", 1), (1, "bracket", 2), (1, "superscript", 3), (1, "detached", 4), (1, "detached", 5)}


def test_names_resolve_by_surname_tail_coauthors_and_letter(spark):
    refs = spark.createDataFrame([
        (1, 0, "Smith, J.", "Smith, J. A title. 2020.", 2020), (2, 1, "Smith, K.", "Smith, K., Jones, L. Another title. 2020.", 2020), (3, 2, "Smith, M.", "Smith, M., Dahl, B., Berg, C. Third. 2020.", 2020),
        (4, 3, "Omar El Malki", "Omar El Malki. T. 2019.", 2019), (5, 4, "Berg, A.", "Berg, A. One. 2018.", 2018), (6, 5, "Berg, A.", "Berg, A. Two. 2018.", 2018), (7, 6, None, "No one. 2018.", 2018), (8, 7, "Van Dyk Team", "Van Dyk Team. T. 2017", 2017)],
        "ref_id int, idx int, author string, raw string, year int").withColumn("doc", F.lit("d"))
    texts = ["(Smith, 2020)", "(Smith and Jones, 2020)", "(Smith et al., 2020)", "(Malki, 2019)", "(Berg, 2018b)", "(Berg, 2018)", "(Nobody, 2018)", "Team (2017"]
    m = X.name_markers(spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("doc", F.lit("d")), ["id", "doc"], "text")
    out = {}
    for r in X.resolve_names(m, X.reference_index(refs, ["doc"]), ["doc"], ["id", "pos"]).collect():
        out.setdefault(r.id, set()).add(r.ref_id)
    assert out == {0: {1}, 1: {2}, 2: {3}, 3: {4}, 4: {6}, 5: {5, 6}, 7: {8}}


def test_extents_and_body(spark):
    ln = spark.createDataFrame([(1, i, x) for i, x in enumerate(["text", "References", "a", "b", "Bibliography", "c"], 1)] + [(2, 1, "no list"), (3, 1, "References")], "id int, no int, line string")
    assert sorted((r.id, r.first, r.last) for r in X.reference_extents(ln, "id", "no", "line").collect()) == [(1, 3, 4), (1, 6, 6)]
    assert one(spark, X.body_only(F.lit("One [1, 2] two.\nFigure 1. A box\n12\nThree"))) == "One two.\nThree"


# ---- assignment and resolving --------------------------------------------------------------------
def test_greedy_match_equals_going_through_the_rows(spark):
    rng = random.Random(5)
    for size in (1, 8, 40):
        rows = sorted({(rng.randrange(size), rng.randrange(size), rng.randrange(3)) for _ in range(size * 4)}, key=lambda x: x[:2])
        rows = list({(t, o): (t, o, s) for t, o, s in rows}.values())
        used, want = set(), set()
        for t in sorted({r[0] for r in rows}):
            left = sorted((-s, o) for a, o, s in rows if a == t and o not in used)
            if left:
                used.add(left[0][1]), want.add((t, left[0][1]))
        got = R.greedy_match(spark.createDataFrame(rows, "t int, o int, s int"), "t", "o", [F.desc("s")])
        assert {(r.t, r.o) for r in got.collect()} == want
    assert R.greedy_match(spark.createDataFrame([], "t int, o int, s int"), "t", "o", [F.desc("s")]).count() == 0


def test_entries_and_papers_resolve(spark):
    e = spark.createDataFrame([(1, 2000, "Berg", "A title"), (2, 1990, "Berg", "A title"), (3, None, None, "Two dois"), (4, 2000, "X", None), (5, 2000, "Dahl", "A title"), (6, 2000, "Y", "Unknown")], "ref_id int, year int, surname string, title string")
    r = spark.createDataFrame([("a title", "10.1/a", 2001, "berg"), ("two dois", "10.1/b", None, None), ("two dois", "10.1/c", None, None), ("x", None, 1, None)], "key string, doi string, year int, surname string")
    got = {x.ref_id: (x.doi, x.outcome) for x in R.verified_entries(e, r).collect()}
    assert got == {1: ("10.1/a", "accepted"), 2: (None, "mismatch"), 3: (None, "ambiguous"), 5: (None, "mismatch")}
    papers = spark.createDataFrame([("p", "Effects of renal beams on coastal ballots"), ("q", "Twin studies of kelp and moss"), ("r", None), ("s", "Reefs")], "paper string, title string")
    recs = spark.createDataFrame([("10.1/a", "Effects of renal beams on coastal ballot"), ("10.1/b", "Twin studies of kelp and moss"), ("10.1/c", "Twin studies of kelp and moss."), ("10.1/d", "Reefs"), (None, "Reefs")], "doi string, title string")
    brute = {}
    for p in papers.collect():
        if p.title:
            score = sorted(((one(spark, T.title_agreement(F.lit(p.title), F.lit(x.title))), x.doi) for x in recs.collect() if x.doi), reverse=True)
            if score[0][0] >= 0.85 and not any(d != score[0][1] and score[0][0] - s < 0.05 for s, d in score):
                brute[p.paper] = score[0][1]
    assert {x.paper: x.doi for x in R.paper_records(papers, recs).collect()} == brute and set(brute) == {"p", "s"}


# ---- containers ----------------------------------------------------------------------------------
def _zip(**parts: str) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return b.getvalue()


def test_office_containers(spark):
    w = 'xmlns:w="http://w"'
    word = _zip(word__document_xml=f'<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    sheet = _zip(xl__workbook_xml='<workbook><sheets><sheet name="Data"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>hello</t></si></sst>",
                 xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1"/></row></sheetData></worksheet>')
    slides = _zip(ppt__presentation_xml="<p/>", ppt__slides__slide2_xml="<s><p><r><t>second</t></r></p></s>", ppt__slides__slide1_xml="<s><p><r><t>first</t></r></p></s>")
    bomb = _zip(word__document_xml='<!DOCTYPE x [<!ENTITY a "b">]><w/>')
    files = spark.createDataFrame([("w", word), ("s", sheet), ("p", slides), ("x", b"no zip"), ("n", None), ("z", _zip(other_xml="<a/>")), ("b", bomb)], "path string, content binary")
    rows = {}
    for r in O.office_rows(files).collect():
        rows.setdefault(r.path, []).append((r.kind, r.part, r.address, r.text, r.formula, r.error is not None))
    assert rows["w"] == [("word", "body", None, "One\ttwo", None, False), ("word", "table", "R1", "a\tb", None, False)]
    assert rows["s"] == [("spreadsheet", "Data", "A1", "hello", None, False), ("spreadsheet", "Data", "B1", "2", "1+1", False)]
    assert [r[3] for r in rows["p"]] == ["first", "second"] and all(rows[k][0][5] for k in "xnzb") and O.office_rows(files.limit(0)).count() == 0


def test_library_and_tei(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    t = {"items": df([(1, 1), (2, 1), (3, 9)], "itemID int, itemTypeID int"), "itemTypes": df([(1, "book"), (9, "note")], "itemTypeID int, typeName string"), "deletedItems": df([(2,)], "itemID int"),
         "itemData": df([(1, 1, 1), (1, 2, 2)], "itemID int, fieldID int, valueID int"), "fields": df([(1, "title"), (2, "date")], "fieldID int, fieldName string"), "itemDataValues": df([(1, "T"), (2, "May 2001")], "valueID int, value string"),
         "itemCreators": df([(1, 1, 0, 1)], "itemID int, creatorID int, orderIndex int, creatorTypeID int"), "creators": df([(1, "Berg", "Ann")], "creatorID int, lastName string, firstName string"), "creatorTypes": df([(1, "author")], "creatorTypeID int, creatorType string"),
         "collections": df([(1, "Top", None), (2, "Sub", 1)], "collectionID int, collectionName string, parentCollectionID int"), "collectionItems": df([(2, 1)], "collectionID int, itemID int")}
    r = B.library_items(t).collect()
    assert len(r) == 1 and (r[0].record.title, r[0].record.year, r[0].creators[0].last, r[0].collections) == ("T", 2001, "Berg", ["Sub"])
    assert {(c.collectionName, c.parent) for c in B.library_collections(t["collections"]).collect()} == {("Top", None), ("Sub", "Top")}
    page = df([(1, '[{"key":"A","version":3,"data":{"itemType":"book","title":"T","DOI":"10.1/X"}}]', "7", '<http://n>; rel="next"'), (2, "bad", None, None)], "page int, body string, total string, link string")
    got = {x.page: x for x in B.items_page(page).collect()}
    assert (got[1].key, got[1].total, got[1].next, got[1].doi) == ("A", 7, "http://n", "10.1/x") and got[2].key is None
    c = B.collections_page(df([('[{"key":"A","data":{"name":"N","parentCollection":false}},{"key":"B","data":{"name":"M","parentCollection":"A"}}]',)], "body string")).collect()
    assert [(x.key, x.parent) for x in c] == [("A", None), ("B", "A")]
    wr = B.write_result(df([(1, '{"success":{"0":"K"},"unchanged":{},"failed":{"1":{"code":412}}}'), (2, "x")], "page int, body string")).collect()
    assert {(x.page, x.idx, x.outcome) for x in wr} == {(1, 0, "success"), (1, 1, "failed")}
    tei = '<TEI xmlns="http://t"><teiHeader><fileDesc><title level="a">Own</title></fileDesc></teiHeader><text><listBibl><biblStruct><analytic><title level="a">Cited</title><author><persName><forename>Ann</forename> <surname>Berg</surname></persName></author><idno type="DOI">10.1/X</idno></analytic><monogr><date when="2001-02"/></monogr></biblStruct></listBibl></text></TEI>'
    rows = sorted(B.tei(df([(1, tei), (2, None), (3, "<bad"), (4, "<!DOCTYPE x><TEI/>")], "id int, xml string"), "id").collect(), key=lambda x: (x.id, x.idx))
    assert [(x.id, x.idx, x.title, x.year, x.doi, x.authors) for x in rows] == [(1, 0, "Own", None, None, []), (1, 1, "Cited", 2001, "10.1/x", ["Ann Berg"])]


def test_latex_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("a/main.tex", "x"), ("refs.bib", "@a{}"), ("note.txt", "y")):
        (tmp_path / name).write_text(text)
    assert sorted((r.kind, r.text) for r in B.latex_files(spark, str(tmp_path)).collect()) == [("bib", "@a{}"), ("tex", "x")]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "  ", "", -1)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, author string, year int").withColumn("pos", F.lit(7)).withColumn("marker", F.lit("clash"))
    assert X.numeric_markers(df, ["id"], "text").count() == 0 and X.name_markers(df, ["id"], "text").count() == 0
    assert df.select(N.author_surname("author"), N.is_algorithm_line("text"), N.venue_of("text"), N.find_doi("text"), N.titleless_raw("text")).count() == len(rows)
