"""Roles, cleaned pages and page-one metadata on built pages."""
from pyspark.sql import functions as F

from folioforge.operators import layout as Y

LINE = "hash string, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double, size double, height double, width double, rotation int, mono boolean, role string"


def page(texts, number=1, size=10.0, **over):
    out = []
    for i, t in enumerate(texts):
        text, s = t if isinstance(t, tuple) else (t, size)
        y = 780.0 - 12 * i
        out.append(dict(hash="h", page=number, idx=i, text=text, x0=50.0, y0=y, x1=50 + 5.0 * len(text), y1=y + 10, size=s, height=800.0, width=600.0, rotation=0, mono=False, role="body") | over)
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in LINE.split(", ")) for r in rows], LINE)


PROSE = "the remaining records were annotated later in the northern basin by all of us"


def test_page_one_metadata(spark):
    rows = page([("A Study of Northern", 18.0), ("Reefs and Records", 18.0), "Ann Berg¹, Bo van Dahl²", "University of Reefs", "Abstract—We sampled", "many reefs.", "Keywords: reefs", "1 Introduction", PROSE])
    df = frame(spark, rows + [dict(r, hash="g", size=10.0) for r in page(["plain", PROSE])])
    t = Y.title_block(df).collect()
    assert [(r.hash, r.title, r.last) for r in t] == [("h", "A Study of Northern Reefs and Records", 1)]
    assert [(r.hash, r.authors) for r in Y.page1_authors(df).collect()] == [("h", ["Ann Berg", "Bo van Dahl"])]
    assert [(r.hash, r.abstract) for r in Y.page1_abstract(df).collect()] == [("h", "We sampled many reefs.")]
    assert Y.title_block(df.limit(0)).count() == Y.page1_abstract(df.limit(0)).count() == 0


def test_roles():
    tag = lambda texts, **o: Y.tag_page(page(texts, 2, **o))
    assert tag([PROSE, "Table 1. Counts of reefs.", "1.0  2.0", "3.0  4.0", PROSE]) == ["body", "caption", "table", "table", "body"]
    assert tag([PROSE, "axis", "label", "Figure 2. A box.", PROSE]) == ["body", "figure", "figure", "caption", "body"]
    assert tag([PROSE, "a  b  c", "1  2  3", "4  5  6", PROSE])[1:4] == ["table"] * 3
    assert tag([PROSE, "x = y + 2 ≤ 3", PROSE])[1] == "math"
    mono = page([PROSE, "int f", "return x", "done now", PROSE], 2)
    for r in mono[1:4]:
        r["mono"] = True
    assert Y.tag_page(mono)[1:4] == ["code"] * 3
    notes = page([PROSE] * 3 + [("1 A note.", 7.0), ("goes on", 7.0)], 2)
    for k, r in enumerate(notes[3:]):
        r["y0"], r["y1"] = 60.0 - 10 * k, 68.0 - 10 * k
    assert Y.tag_page(notes) == ["body"] * 3 + ["footnote"] * 2
    assert Y.tag_page(page(["Table 3 (continued)", "1", "2"], 2, rotation=90)) == ["caption", "table", "table"]
    assert Y.tag_page(page(["Keywords: reefs", "and moss.", "Introduction", PROSE]))[:2] == ["front", "front"] and Y.tag_page([]) == []
    ruled = page([PROSE, "a", "b", PROSE], 2)
    assert Y.tag_page(ruled, [(50.0, 779.0, 400.0, 779.5), (50.0, 755.0, 400.0, 755.5)])[1:3] == ["table", "table"]


def test_tag_pages_and_biographies(spark):
    df = frame(spark, page(["References", "[1] A", "Ann Berg received the degree", "in reefs."], 3) + page([PROSE, "Table 1. Counts.", "1.0  2.0"], 2) + [dict(r, hash=None, text=None) for r in page(["x"], 1)])
    assert {(r.page, r.idx): r.role for r in Y.tag_pages(df).where("hash = 'h'").collect()}[(2, 2)] == "table" and Y.tag_pages(df).count() == df.count()
    rules = spark.createDataFrame([("h", 2, 50.0, 779.0, 400.0, 779.5)], "hash string, page int, x0 double, y0 double, x1 double, y1 double")
    assert Y.tag_pages(df, rules).count() == df.count()
    got = {r.idx: r.role for r in Y.tag_biographies(df.where("hash = 'h' and page = 3")).collect()}
    assert got == {0: "body", 1: "body", 2: "biography", 3: "biography"}


def test_cleaning(spark):
    rows = [r for p in (1, 2, 3) for r in page([f"Journal of Reefs {p}", "words of nor-", "thern basins", str(p)], p)]
    for r in rows:
        if r["idx"] == 3:
            r["y0"], r["y1"] = 10.0, 20.0
        elif r["idx"] in (1, 2):
            r["y0"], r["y1"] = 400.0 - 12 * r["idx"], 410.0 - 12 * r["idx"]
    out = {r.page: r.text for r in Y.clean_pages(frame(spark, rows)).collect()}
    assert out == {p: "words of northern basins" for p in (1, 2, 3)}
    fused = frame(spark, [dict(page(["left words        right words"])[0], x0=50.0, x1=550.0), page(["one column"])[0]])
    assert sorted((r.text, r.x0) for r in Y.split_fused(fused).collect()) == [("left words", 50.0), ("one column", 50.0), ("right words", 300.0)]
    scripts = spark.createDataFrame([("h", 1, 1, "12", 90.0, 784.0)], "hash string, page int, script_id int, text string, x0 double, y0 double")
    assert [r.text for r in Y.merge_scripts(frame(spark, page(["some words", "next"])), scripts).orderBy("idx").collect()] == ["some words¹²", "next"]


def test_list_bodies(spark):
    df = frame(spark, page([PROSE, "[1] A", "[2] B", "[3] C", "Appendix A", "x"], 4))
    s = Y.headingless_section(df)
    assert [(r.page, r.idx) for r in s.collect()] == [(4, 1)]
    assert [r.text for r in Y.list_body(df, s).orderBy("idx").collect()] == ["[2] B", "[3] C"]
    far = df.withColumn("x0", F.when(F.col("idx") == 5, 400.0).otherwise(F.col("x0")))
    assert Y.drop_foreign_columns(far, ["hash"]).count() == 5
    links = spark.createDataFrame([("h", 1, "u"), ("h", 2, "v")], "hash string, page int, uri string")
    frames = spark.createDataFrame([("h", 1, True), ("h", 2, False)], "hash string, page int, same boolean")
    assert Y.union_links(links.limit(1), links, frames).count() == 1


def test_layout_starts(spark):
    xs = [50, 62, 62, 50.5, 62, 50, 62.4, 62]
    rows = [dict(r, x0=float(x)) for r, x in zip(page([f"line {i}" for i in range(8)], 1), xs)] + [dict(r, hash="flat") for r in page(["a", "b", "c"], 1)]
    got: dict = {}
    for r in Y.layout_starts(frame(spark, rows), ["hash"]).collect():
        got.setdefault(r.hash, {})[r.idx] = r.starts
    assert got == {"h": {i: x < 55 for i, x in enumerate(xs)}, "flat": {0: None, 1: None, 2: None}}
    assert Y.layout_starts(frame(spark, rows).limit(0), ["hash"]).count() == 0


def test_hyphens_between_lines(spark):
    from folioforge.operators import text_ops as O
    vocab = spark.createDataFrame([("northern", 5), ("self-reported", 3), ("reported", 9), ("self-aware", 2)], "w string, n bigint")
    cases = [("in the nor-", "thern basin", "join"), ("the self-", "reported count", "keep"), ("no hyphen", "here", "none"), ("Nor-", "Thern", "none"), ("NOR-", "THERN X", "join"), ("10-", "fold", "none"), (None, "x", "none"), ("a-", None, "none")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, first string, second string")
    got = {r.i: r for r in O.hyphen_lines(df, vocab).collect()}
    assert [got[i].decision for i in range(len(cases))] == [c[2] for c in cases]
    assert (got[0].new_first, got[0].new_second) == ("in the northern", "basin") and (got[1].new_first, got[1].new_second) == ("the self-", "reported count")


def test_body_of_a_source_and_manifest(spark, tmp_path):
    from folioforge.operators.documents import body_text
    from folioforge.sources.sinks import save_manifest
    tex = "\\documentclass{a}\\begin{document}\\title{T}\\maketitle\\begin{abstract}x\\end{abstract}\\section{Intro}We saw~\\cite{a} \\emph{reefs} % no\n at $x=1$ once.\n\nNext.\\begin{figure}f\\end{figure}\\end{document}after"
    assert body_text(tex) == "Intro\n\nWe saw reefs at once.\n\nNext." and body_text(None) is None and body_text("") == ""
    save_manifest(spark.createDataFrame([(1, "t")], "id int, title string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
