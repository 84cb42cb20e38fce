"""Cases that the rules must decide as given, and brute-force forms of rules without SQL."""
import pytest
from pyspark.sql import functions as F

from folioforge.functions import ids, text


def decide(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f("v").alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize("f, true, false", [
    (ids.is_placeholder_doi, ["10.1145/nnnnnnn.nnnnnnn", "https://doi.org/10.1145/XXXXXXX.XXXXXXX", "10.1145/1122445.1122456", "10.475/123_4"], ["10.1145/3292500.3330701", "10.1038/nature14539", "10.1000/182"]),
    (text.is_page_number, ["12", "– 12 –", "p. 12", "Page 3 of 10", "3 / 12", "iv", "xxxix", "xi", "PAGE 7"], ["IIII", "12 monkeys", "12345", "", "ivi", "p 12 x", "IV"]),
    (ids.looks_like_person, ["Anna Berg", "Ludwig van Beethoven", "J. K. Rowling", "Martin Luther King Jr.", "Jean-Luc O’Neil"], ["Anna", "anna berg", "Dept 4 Berg", "A B C D E F G", "de la", None and "" or "x"]),
    (ids.author_is_generic, ["", " ", "Admin", "guest", "1234", "--"], ["Anna Berg", "user1"]),
    (ids.title_is_generic, ["", "Untitled", "Microsoft Word - a b.docx", "paper.pdf", "main_v2", "123 456", "report.final"], ["A study of reefs", "Graphs", "Version 2.0 of a plan"]),
])
def test_predicates(spark, f, true, false):
    assert decide(spark, f, true) == [True] * len(true)
    assert decide(spark, f, false) == [False] * len(false)
    assert decide(spark, f, [None]) == [None]


def test_years(spark):
    cases = {"Smith J (2020b). X. 1999": 2020, "pp. 1990–2005": None, "vol. 3, 1999, pp. 4": 1999, "1988–a Title": 1988, "12-1999-3": None, "1999–2001 (2005a)": 2005, "in 2011a.": 2011, "no year": None, None: None}
    assert decide(spark, ids.find_year, list(cases)) == list(cases.values())
    assert decide(spark, ids.first_year, ["pp. 1990–2005", "x1990 1850"]) == [1990, 1850]


def test_families(spark):
    cases = {"Anna Berg": "Berg", "Jan van Dyk": "van Dyk", "Ana dela Cruz": "dela Cruz", "Ana della Cruz": "Cruz", "Berg": "Berg", "  Anna   Berg ": "Berg", None: None}
    assert decide(spark, ids.family_of, list(cases)) == list(cases.values())


def brute_family(family, entry):
    fold = lambda x: " ".join("".join(c for c in __import__("unicodedata").normalize("NFKD", x.lower()) if c.isalnum() or c.isspace()).split())
    fam, raw = fold(family), fold(entry)
    if not fam:
        return False

    def sim(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return 1 - prev[-1] / max(len(a), len(b), 1)

    ws, sq, mine = raw.split(), raw.replace(" ", ""), fam.replace(" ", "")
    if fam in ws or sq.startswith(mine) or len(mine) >= 4 and mine in sq:
        return True
    op = ws[:8]
    return any(len(w) >= 4 and sim(w, mine) >= 0.8 or k + 1 < len(op) and len(w + op[k + 1]) >= 4 and sim(w + op[k + 1], mine) >= 0.8 for k, w in enumerate(op))


def test_family_in_entry(spark):
    cases = [("Rühland", "Ru hland K. A title of 1999"), ("Smith", "J. Smith, A title"), ("Row", "RowJR. A title"), ("Smithe", "J. Smith A title"), ("Berg", "A. Bergmann"), ("Berg", "Other names altogether here"),
             ("de la Cruz", "Cruz de la"), ("Ng", "Anger"), ("Kowalski", "one two three four five six seven eight nine kowalsky"), ("Kowalski", "one kowalsky"), ("", "x"), ("Araújo", "Arau jo, M.")]
    df = spark.createDataFrame(cases, "f string, e string").select("f", "e", text.family_in_entry("f", "e").alias("r"))
    for r in df.collect():
        assert r.r == brute_family(r.f, r.e), (r.f, r.e)
    assert df.limit(0).count() == 0 and spark.range(1).select(text.family_in_entry(F.lit(None).cast("string"), F.lit("x")).alias("r")).first().r is None
