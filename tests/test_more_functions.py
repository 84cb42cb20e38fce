"""Fixed cases of the functions that few tables exercise."""
from pyspark.sql import functions as F

from folioforge.functions import text, urls


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_text(spark):
    n = lambda f, *x: one(spark, f(*map(F.lit, x)))
    assert n(text.fold_ascii, "Łódź – Straße Ñandú") == "lodz  strasse nandu" and n(text.title_equal, r"The {\em Große} X", "the Grosse x!") and not n(text.title_equal, "a", "b")
    assert n(text.paper_title_matches, "a b c d e f g h i j", "J i h g f e d c b a") and n(text.spacing_to_combining, "e\u00b4c\u00b8") == "e\u0301c\u0327"
    assert n(text.quoted_title, "X, “On reefs,” J.") == "On reefs" and n(text.find_url, "see (https://x.y/z).") == "https://x.y/z" and n(text.glued_marker, "foo[1]bar") and not n(text.glued_marker, "foo [1] bar")
    v = n(text.bibliographic_numbers, "J. X, vol. 7, no. 2, pp. 5 – 9")
    assert (v.volume, v.issue, v.pages) == ("7", "2", "5–9")
    r = one(spark, text.page_range(F.lit("0-99"), 10))
    assert (r.lo, r.hi) == (1, 10) and one(spark, text.page_range(F.lit("9-2"), 10)) is None and one(spark, text.page_range(F.lit("x"), 10)) is None
    assert one(spark, text.byte_prefix(F.lit("aéé"), 4)) == "aé" and one(spark, text.byte_prefix(F.lit("ab"), 4)) == "ab"
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.multiset_overlap(a("x", "x", "y"), a("x", "x", "x"))) == 2 and one(spark, text.same_columns(a(1.0, 9.0), a(1.5, 9.2), 1.0)) and not one(spark, text.same_columns(a(1.0), a(1.0), 1.0))
    assert one(spark, text.page_route(F.lit("\ufffd\ufffdab"))).reason == "damaged" and one(spark, text.page_route(F.lit("ok"), F.array(F.lit("failed: x")))).reason == "failed" and one(spark, text.page_route(F.lit(None).cast("string"))).reason == "empty"
    ok = one(spark, text.verify_record(F.lit("Effects of renal beams"), F.lit("Zaru"), F.lit(2001), F.lit("Zaru Q. Effects of renal beams. J. 2002.")))
    assert ok.reason is None and ok.score == 1.0
    assert one(spark, text.verify_record(F.lit("Effects of renal beams"), F.lit("Zaru"), F.lit(1990), F.lit("Zaru Q. Effects of renal beams. J. 2002."))).reason == "year"


def test_urls(spark):
    n = lambda f, *x: one(spark, f(*map(F.lit, x)))
    b = "https://ex.org/a/b?x=1"
    assert [n(urls.resolve, b, h) for h in ("c", "/c", "//q.org/c", "?y=2", "../c", "http://z.org", "mailto:x")] == ["https://ex.org/a/c", "https://ex.org/c", "https://q.org/c", "https://ex.org/a/b?y=2", "https://ex.org/c", "http://z.org/", None]
    assert one(spark, urls.unproxy_host(F.lit("www-ex--a-org.proxy.edu"), "proxy.edu")) == "www.ex-a.org" and n(urls.proxied_url, "https://p/login?url=", "http://a b") == "https://p/login?url=http%3A%2F%2Fa%20b"
    d = n(urls.content_disposition, "attachment; filename=\"x/y.pdf\"; filename*=UTF-8''%C3%A9.pdf")
    assert (d.kind, d.filename) == ("attachment", "é.pdf") and n(urls.classify_pdf_response, "http://x/a", "application/pdf; q=1", None) == "likely"
    assert n(urls.link_header, '<http://a>; rel="next", <http://b>; rel=last') == {"next": "http://a", "last": "http://b"}
    assert n(urls.http_date, "Sun, 06 Nov 1994 08:49:37 GMT") == 784111777 and n(urls.http_date, "x") is None
    c = n(urls.set_cookie, "sid=1; Domain=.Ex.org; Secure; Max-Age=5")
    assert (c.name, c.value, c.domain, c.path, c.secure, c.max_age) == ("sid", "1", "ex.org", "/", True, 5)
    assert n(urls.extra_map, "DOI: 10.1/x\ndoi: y\n\nbad\nPMID: 3") == {"doi": "10.1/x", "pmid": "3"}
    assert n(urls.doi_from_url, "https://x.org/doi/10.1234%2Fab.c/pdf") == "10.1234/ab.c" and n(urls.arxiv_from_url, "http://arxiv.org/abs/2101.00001v3") == "2101.00001"
    assert one(spark, urls.openurl("http://r", F.lit("10.1/x"), F.lit("a b"), F.lit(2001))) == "http://r?url_ver=Z39.88-2004&rft_id=10.1%2Fx&rft.atitle=a%20b&rft.date=2001"
