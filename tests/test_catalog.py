"""Catalogue and page-evidence operators on fixed cases."""
from pyspark.sql import functions as F

from folioforge.operators import catalog as C


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_catalogue(spark):
    mk = spark.createDataFrame
    f = C.item_fields(mk([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "itemID int, fieldID int, valueID int"), mk([(1, "title"), (2, "date")], "fieldID int, fieldName string"), mk([(10, "T"), (11, "May 2001"), (12, "U")], "valueID int, value string"))
    r = {x.itemID: x.r for x in f.select("itemID", C.record_of(F.col("fields")).alias("r")).collect()}
    assert r[1].title == "T" and r[1].year == 2001 and r[2].year is None
    c = C.item_creators(mk([(1, 5, 1, 1), (1, 6, 9, 0)], "itemID int, creatorID int, creatorTypeID int, orderIndex int"), mk([(5, "B", "b"), (6, "A", None)], "creatorID int, lastName string, firstName string"), mk([(1, "author")], "creatorTypeID int, creatorType string")).first()
    assert [x.last for x in c.creators] == ["A", "B"] and c.creators[0].kind is None
    items, types, gone = mk([(1, 1), (2, 2), (3, 1)], "itemID int, itemTypeID int"), mk([(1, "book"), (2, "note")], "itemTypeID int, typeName string"), mk([(3,)], "itemID int")
    assert [x.itemID for x in C.live_items(items, gone, types).collect()] == [1]
    assert [x.itemID for x in C.live_attachments(items, mk([(1, 2), (2, 3), (3, 1)], "itemID int, parentItemID int"), gone).collect()] == [1]
    assert C.memberships(mk([(1, 1), (1, 2)], "itemID int, collectionID int"), mk([(1, "b"), (2, "a")], "collectionID int, collectionName string")).first().collections == ["a", "b"]


def test_page_evidence(spark):
    mk = spark.createDataFrame
    ln = mk([("h", 1, "u", 0.0, 0.0, 1.0, 1.0, 2), ("h", 1, "u", -0.0, 0.0, 1.0, 1.0, 1)], "h string, page int, uri string, x0 double, y0 double, x1 double, y1 double, seq int")
    assert [x.seq for x in C.unique_links(ln, ["h", "page"]).collect()] == [1]
    b = mk([("h", 1, 1, 0.0, 100.0, 50.0, 200.0), ("h", 1, 2, 90.0, 100.0, 99.0, 200.0)], "h string, page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    cap = mk([("h", 1, 1, "table", 10.0, 60.0, 40.0, 70.0), ("h", 1, 2, "figure", 10.0, 80.0, 40.0, 95.0)], "h string, page int, caption_id int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert rows(C.nearest_caption(b, cap, ["h", "page"], 50.0)) == [("h", 1, 1, "figure")]
    s = mk([("h", 1, 7, 20.0, 104.0)], "h string, page int, script_id int, x0 double, y0 double")
    lines = mk([("h", 1, 1, 0.0, 50.0, 100.0, 10.0), ("h", 1, 2, 0.0, 50.0, 90.0, 10.0)], "h string, page int, line_id int, x0 double, x1 double, y0 double, size double")
    assert rows(C.script_targets(s, lines, ["h", "page"])) == [("h", 1, 7, 1)]
    lab = mk([("h", 1, 1, 0.0, 50.0), ("h", 1, 2, 0.0, 40.0)], "h string, page int, label_id int, x0 double, y0 double")
    t = mk([("h", 1, 5, 20.0, 50.5), ("h", 1, 6, 20.0, 39.0)], "h string, page int, line_id int, x0 double, y0 double")
    assert rows(C.pair_labels(lab, t, ["h", "page"])) == [("h", 1, 1, 5), ("h", 1, 2, 6)]


def test_ordered_lines(spark):
    ln = spark.createDataFrame([("d", i, x) for i, x in enumerate(["1 Intro", "recon-", "struction of", "1", "2.", "3", "2 Methods used", "9"])], "d string, i int, t string")
    assert rows(C.line_joins(ln, "d", "i", "t")) == [("d", 1, "recon", "struction")]
    assert [(x.first, x.n) for x in C.bare_runs(ln, "d", "i", "t").collect()] == [(1, 3)]
    assert [(x.heading, x.next) for x in C.sections(ln, "d", "i", "t").orderBy("i").collect()] == [("Intro", "Methods used"), ("Methods used", None)]
    p = spark.createDataFrame([("d", 1, "see (Smith and", None), ("d", 2, "Jones 2001) which", "x"), ("d", 3, "end", None)], "d string, page int, t string, s string")
    assert C.carried_heads(p, "d", "page", "t").first().group == "(Smith and Jones 2001)"
    assert [x.carried for x in C.carried_state(p, "d", "page", "s").orderBy("page").collect()] == [None, None, "x"]


def test_choices(spark):
    c = spark.createDataFrame([(1, "title", "A", "info", 2, 0), (1, "title", "B", "page", 1, 0), (1, "title", " ", "xmp", 0, 0), (1, "year", None, "info", 1, 0)], "k int, field string, value string, source string, priority int, pos int")
    assert rows(C.prioritised(c, "k")) == [(1, "title", "B", "page")]
    a = spark.createDataFrame([(1, 5, "a"), (2, 1, "a")], "k int, q int, v string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 2, "b"), (3, 0, "b")], "k int, q int, v string")
    assert rows(C.better_result(a, b, "k", ["q"])) == [(1, 5, "a"), (2, 2, "b"), (3, 0, "b")]
    u = spark.createDataFrame([(1, False, ["x"])], "k int, f boolean, m array<string>")
    assert rows(C.append_documents([u, u.withColumn("f", F.lit(True))], "k", "f", "m")) == [(1, True, ["x"])]


def test_row_numbers_of_a_hot_key(spark):
    from folioforge.operators.ledger import row_numbers
    rows = [("hot", i * 7 % 1000, i) for i in range(1000)] + [("hot", None, 5), (None, 3, 1), (None, 2, 2), ("one", 5, 1), ("tie", 1, 2), ("tie", 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = {(r.k, r.o, r.id): r.rn for r in row_numbers(df, ["k"], "o", ties=["id"]).collect()}
    want: dict = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2])), 1):
            want[r] = n
    assert got == want and row_numbers(df.limit(0), ["k"], "o").count() == 0
