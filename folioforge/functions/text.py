"""String normalisation, tokens and similarity as Column expressions (JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_title(c) -> Column:
    """Lower-case letters and digits; every other run becomes one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "))


def normalize_title_first(c) -> Column:
    """The same where a capital whose small form has two characters gives the first one only (X02): U+0130 is the only such letter."""
    return normalize_title(F.translate(col(c), "\u0130", "i"))


def words(c) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(normalize_title(c), " "), lambda w: w != "")


def alignment_words(c) -> Column:
    """Words without those of digits only."""
    return F.filter(words(c), lambda w: ~w.rlike("^[0-9]+$"))


def digit_key(c) -> Column:
    """ASCII digit runs as #, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "[0-9]+", "#"), r"\s+", " "))


def short_digit_key(c) -> Column:
    """Only digit runs of at most three become #; white space is kept."""
    return F.regexp_replace(col(c), "(?<![0-9])[0-9]{1,3}(?![0-9])", "#")


def similarity(a, b) -> Column:
    """1 - edit distance over the longer length; 1 if both are empty."""
    a, b = col(a), col(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def title_agreement(a, b) -> Column:
    """Similarity of normalised titles; 0 if either is empty."""
    x, y = normalize_title(a), normalize_title(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(similarity(x, y))


def long_words(c, least: int = 4) -> Column:
    """Distinct words of a least length in order."""
    return F.array_distinct(F.filter(words(c), lambda w: F.length(w) >= least))


def title_overlap(title, entry) -> Column:
    """Share of the title's distinct long words found in an entry; null below two words (X11)."""
    t = long_words(title)
    return F.when(F.size(t) >= 2, F.size(F.array_intersect(t, words(entry))) / F.size(t))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two word sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def join_break_hyphens(c) -> Column:
    """A hyphen between letters followed by white space is dropped with it."""
    return F.regexp_replace(col(c), r"(\p{L})-\s+(\p{L})", "$1$2")


def collapse(c) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def leading_words(c, n: int) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.split(collapse(c), " "), 1, n), " ")


def fts_terms(c) -> Column:
    """Quoted terms joined by OR for a full-text query; null without any."""
    w = words(c)
    return F.when(F.size(w) > 0, F.array_join(F.transform(w, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR "))


def expand_ligatures(c) -> Column:
    """Ligatures as their letters."""
    c = col(c)
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def script_form(c, sub: bool = False) -> Column:
    """Digits and signs in their superscript or subscript form."""
    return F.translate(col(c), "0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎" if sub else "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾")


def safe_file_stem(c, most: int = 80) -> Column:
    """A file name of letters, digits, dot, dash and underscore only (X33, X133)."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(s == "", "file").otherwise(F.substring(s, 1, most))


def strip_label(c) -> Column:
    """A reference without its printed label."""
    return F.regexp_replace(col(c), r"^\s*(?:\[[^\]]{1,12}\]|[0-9]{1,4}[.)])\s*", "")


def reference_label(c) -> Column:
    """Style of the printed label: bracket, dot, paren or none."""
    c = col(c)
    return F.when(c.rlike(r"^\s*\[[0-9]+\]"), "bracket").when(c.rlike(r"^\s*[0-9]{1,4}\."), "dot").when(c.rlike(r"^\s*[0-9]{1,4}\)"), "paren").otherwise("none")


PAGE_NUMBER = r"^(?:(?i:page|p\.)\s*[0-9]{1,4}(?:\s*(?:(?i:of)|/)\s*[0-9]{1,4})?|[-–—]?\s*[0-9]{1,4}\s*[-–—]?|[0-9]{1,4}\s*/\s*[0-9]{1,4})$"
ROMAN = r"^(?:x{1,3}(?:ix|iv|v?i{0,3})|ix|iv|vi{0,3}|i{1,3})$"


def is_page_number(c) -> Column:
    """A bare page number, "p. 12", "3 / 12", "Page n of m" or a roman numeral up to xxxix."""
    t = F.trim(col(c))
    return t.rlike(PAGE_NUMBER) | t.rlike(ROMAN)


def is_toc(c) -> Column:
    """A line with dot leaders."""
    return col(c).rlike(r"(?:\.\s?){4,}\s*[0-9]*\s*$")


def is_caption(c) -> Column:
    """The start of a figure or table caption."""
    return col(c).rlike(r"^\s*(?:Figure|Fig\.|Table|Scheme|Plate)\s+[0-9IVX]+[.:]")


def is_numeric_token(c) -> Column:
    """A number with optional sign, group and decimal marks or per cent (F16)."""
    return F.trim(col(c)).rlike(r"^[-+−]?[0-9][0-9.,]*%?$")


def is_prose(c) -> Column:
    """A line of at least six words, mostly lower-case ones."""
    w = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda x: x != "")
    low = F.filter(w, lambda x: x.rlike(r"^[a-z]{2,}[,;]?$"))
    return (F.size(w) >= 6) & (F.size(low) * 2 >= F.size(w))


def math_share(c) -> Column:
    """Share of mathematical signs among the non-space characters."""
    s = F.regexp_replace(col(c), r"\s", "")
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, r"[^=+<>≤≥±×÷∑∫√∂∞≈∝∈∀∃→←−*/^|]", "")) / F.length(s)).otherwise(0.0)


def replacement_share(c) -> Column:
    """Share of replacement and private-use characters."""
    n = F.length(col(c))
    return F.when(n > 0, (n - F.length(F.regexp_replace(col(c), "[\\uFFFD\\uE000-\\uF8FF]", ""))) / n).otherwise(0.0)


def has_reference_evidence(c) -> Column:
    """A year, DOI, URL or page range in a candidate entry."""
    return col(c).rlike(r"\b(?:1[89]|20)[0-9]{2}\b|10\.[0-9]{4,9}/|https?://|\b[0-9]+[–-][0-9]+\b")


def is_author_year_start(c) -> Column:
    """The start of an unlabelled entry: a surname and an initial or a comma."""
    return col(c).rlike(r"^\s*\p{Lu}[\p{L}’'-]+(?:,\s*\p{Lu}|\s+\p{Lu}{1,3}\b)")


def cited_numbers(c, most: int = 100) -> Column:
    """Numbers of a marker such as "3, 7-9"; empty where it is reversed, zero or spans ``most`` numbers, which is no marker (X104)."""
    parts = F.split(F.regexp_replace(F.regexp_replace(col(c), r"[\[\]\s]", ""), "–", "-"), ",")
    lo = lambda p: F.try_element_at(F.split(p, "-"), F.lit(1)).try_cast("int")
    hi = lambda p: F.coalesce(F.try_element_at(F.split(p, "-"), F.lit(2)), F.try_element_at(F.split(p, "-"), F.lit(1))).try_cast("int")
    good = F.forall(parts, lambda p: F.coalesce((lo(p) > 0) & (hi(p) >= lo(p)) & (hi(p) - lo(p) < most), F.lit(False)))
    return F.when(good, F.flatten(F.transform(parts, lambda p: F.sequence(lo(p), hi(p))))).otherwise(F.array().cast("array<int>"))


def markers(c) -> Column:
    """Numeric citation markers of a text in order."""
    return F.regexp_extract_all(col(c), F.lit(r"(\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\])"), F.lit(1))


def split_keywords(c) -> Column:
    """Keywords separated by comma, semicolon or middle dot (X128)."""
    return F.filter(F.transform(F.split(col(c), r"[,;·]"), lambda x: F.trim(x)), lambda x: x != "")


def digit_bag(c) -> Column:
    """Digit runs without years, sorted."""
    return F.array_sort(F.filter(F.regexp_extract_all(col(c), F.lit("([0-9]+)"), F.lit(1)), lambda x: ~x.rlike("^(1[89]|20)[0-9]{2}$")))


def digits_conflict(a: Column, b: Column) -> Column:
    """Each side has a digit run the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i"}


def fold_ascii(c) -> Column:
    """Lower-case letters and digits without accents, special letters spelt out (X07, X08); Latin letters by rule.

    The accented letters of the Latin blocks are taken from the Unicode data, so it stays in the JVM.
    """
    import unicodedata
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        if base != chr(cp) and base.isascii():
            src.append(chr(cp)), dst.append(base)
    s = F.translate(F.lower(col(c)), "".join(src), "".join(dst))
    for k, v in SPECIAL.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    return F.regexp_replace(F.regexp_replace(s, r"\p{M}", ""), r"[^\p{L}\p{N} ]", "")


def title_equal(a, b) -> Column:
    """Titles equal without TeX, case, accents and punctuation."""
    def k(c):
        return collapse(normalize_title(fold_ascii(F.regexp_replace(F.regexp_replace(col(c), r"\\[A-Za-z]+\s*", ""), r"[{}$\\]", ""))))
    return k(a) == k(b)


def paper_title_matches(a, b) -> Column:
    """Equal titles, or a word Jaccard coefficient of at least 0.9."""
    return title_equal(a, b) | (jaccard(F.array_distinct(words(a)), F.array_distinct(words(b))) >= 0.9)


def spacing_to_combining(c) -> Column:
    """Spacing accents as combining marks."""
    return F.translate(col(c), "\u00b4\u0060\u02c6\u02dc\u00a8\u02da\u00b8\u02c7\u02d8\u02d9\u02dd", "\u0301\u0300\u0302\u0303\u0308\u030a\u0327\u030c\u0306\u0307\u030b")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))


def same_columns(a: Column, b: Column, tol: float) -> Column:
    """At least two starts of b within tolerance of one of a, and at least half of the larger set."""
    hit = F.size(F.filter(b, lambda x: F.exists(a, lambda y: F.abs(x - y) <= tol)))
    return (hit >= 2) & (hit * 2 >= F.greatest(F.size(a), F.size(b)))


def verify_record(title, surname, year, entry) -> Column:
    """struct(score, reason) of a registry record against a printed entry.

    The year may differ by one; the surname must stand in the entry; the title's long words must be
    found to 0.6, or to 0.7 without a surname.
    """
    ws = words(entry)
    y = F.col(year) if isinstance(year, str) else year
    year_ok = y.isNull() | F.arrays_overlap(ws, F.array((y - 1).cast("string"), y.cast("string"), (y + 1).cast("string")))
    has = col(surname).isNotNull()
    name_ok = ~has | normalize_title(entry).contains(normalize_title(surname))
    share = title_overlap(title, entry)
    need = F.when(has, 0.6).otherwise(0.7)
    reason = F.when(~year_ok, "year").when(~name_ok, "author").when(share.isNull(), "no title").when(share < need, "title")
    return F.struct(F.when(reason.isNull(), share).alias("score"), reason.alias("reason"))


def byte_prefix(c, most: int) -> Column:
    """Longest prefix of at most ``most`` UTF-8 bytes that ends at a character."""
    chars = F.split(col(c), "")
    cut = F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.when(
        a["go"] & (a["n"] + F.octet_length(x) <= most), F.struct(F.concat(a["s"], x).alias("s"), (a["n"] + F.octet_length(x)).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(False).alias("go"))), lambda a: a["s"])
    return F.when(F.octet_length(col(c)) <= most, col(c)).otherwise(cut)


def page_range(c, count) -> Column:
    """"A-B" or "A" as struct(lo, hi) clamped to the pages there are; null where A is beyond B or the end."""
    lo = F.regexp_extract(col(c), r"^\s*([0-9]{1,9})", 1).try_cast("int")
    hi = F.coalesce(F.regexp_extract(col(c), r"-\s*([0-9]{1,9})\s*$", 1).try_cast("int"), lo)
    n = col(count) if isinstance(count, str) else F.lit(count)
    a, b = F.greatest(lo, F.lit(1)), F.least(hi, n)
    return F.when(col(c).rlike(r"^\s*[0-9]{1,9}(?:\s*-\s*[0-9]{1,9})?\s*$") & (a <= b), F.struct(a.alias("lo"), b.alias("hi")))


def page_route(text, warnings: Column | None = None) -> Column:
    """struct(backend, reason) of a page: failed, unmapped, empty, damaged or ok."""
    t = F.coalesce(col(text), F.lit(""))
    w = warnings if warnings is not None else F.array().cast("array<string>")
    has = lambda p: F.exists(F.coalesce(w, F.array().cast("array<string>")), lambda x: x.startswith(p))
    reason = F.when(has("failed:"), "failed").when(has("unicode_mapping:"), "unmapped").when(F.length(F.regexp_replace(t, r"\s", "")) == 0, "empty").when(replacement_share(t) >= 0.01, "damaged").otherwise("ok")
    return F.struct(F.when(reason == "ok", "default").otherwise("fallback").alias("backend"), reason.alias("reason"))


def glued_marker(c) -> Column:
    """Whether a [n] is glued to a word, as in an index."""
    return col(c).rlike(r"\p{L}\[[0-9]+\]\p{L}")


def bibliographic_numbers(c) -> Column:
    """struct(volume, issue, pages) of an entry by the first of three forms."""
    forms = (r"vol\.\s*([0-9]+)(?:,\s*no\.\s*([0-9]+))?,\s*pp\.\s*([0-9]+\s*[–-]\s*[0-9]+)", r"([0-9]+)\s*(?:\(([0-9]+)\))?\s*[,:]\s*([0-9]+\s*[–-]\s*[0-9]+)")
    get = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(col(c), p, i), F.lit("")) for p in forms])
    return F.struct(get(1).alias("volume"), get(2).alias("issue"), F.regexp_replace(get(3), r"\s", "").alias("pages"))


def quoted_title(c) -> Column:
    """A title between double quotes (X102)."""
    return F.nullif(F.regexp_extract(col(c), r'[“"]([^“”"]{4,}?),?[”"]', 1), F.lit(""))


def find_url(c) -> Column:
    """First URL of an entry without closing marks (X103)."""
    return F.nullif(F.regexp_replace(F.regexp_extract(col(c), r"(https?://[^\s<>\"]+)", 1), r"[.,;)\]]+$", ""), F.lit(""))


def family_in_entry(family, entry) -> Column:
    """Whether a record's family name stands in a printed entry: as a word, without spaces, or close to one of its first words."""
    raw = collapse(fold_ascii(entry))
    fam = collapse(fold_ascii(family))
    ws = F.filter(F.split(raw, " "), lambda w: w != "")
    squashed, mine = F.replace(raw, F.lit(" "), F.lit("")), F.replace(fam, F.lit(" "), F.lit(""))
    opening = F.slice(ws, 1, 8)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(opening), F.lit(1))), lambda i: F.concat(F.coalesce(F.try_element_at(opening, i), F.lit("")), F.coalesce(F.try_element_at(opening, i + 1), F.try_element_at(ws, i + 1), F.lit(""))))
    close = lambda w: (F.length(w) >= 4) & (similarity(w, mine) >= 0.8)
    found = F.array_contains(ws, fam) | squashed.startswith(mine) | (F.length(mine) >= 4) & squashed.contains(mine) | F.exists(opening, close) | F.exists(pairs, close)
    return F.when(mine == "", False).otherwise(found)
