"""Identifiers, years, names and hashes as Column expressions (JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import col, normalize_title

PARTICLES = "van|von|de|di|da|du|der|den|del|la|le"
#: Particles and suffixes of names, what stands for an author or a title, endings of files.
NAME_PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "do", "dos", "das", "la", "le", "du", "bin", "ibn", "al", "el", "ten", "ter", "y", "e")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")
GENERIC_AUTHORS = ("", "unknown", "user", "admin", "administrator", "author", "owner", "guest")
GENERIC_TITLES = ("", "untitled", "title", "untitled document")
FILE_ENDINGS = "docx|doc|tex|dvi|pdf|ps|odt|rtf|txt|indd|qxd"
TEMPLATE_DOIS = ("10.1145/1122445.1122456", "10.475/123_4")


def _balanced(c: Column) -> Column:
    """Trailing marks off, and a closing bracket without its opening one."""
    c = F.regexp_replace(c, r"[.,;:\s]+$", "")
    extra = c.endswith(")") & (F.length(c) - F.length(F.replace(c, F.lit(")"), F.lit(""))) > F.length(c) - F.length(F.replace(c, F.lit("("), F.lit(""))))
    return F.when(extra, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def normalize_doi(c) -> Column:
    """Lower-case DOI without resolver prefixes; null if it hasn't a DOI's shape."""
    s = F.regexp_replace(F.lower(F.trim(col(c))), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")
    s = _balanced(s)
    return F.when(s.rlike(r"^10\.[0-9]{4,9}/\S+$"), s)


def loose_doi(c) -> Column:
    """Everything from 10.NNNN/ on, trailing marks off, no shape check."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"^.*?(10\.[0-9]{4,9}/)", "$1"), r"[.,;:)\]}']+$", "")


def scan_dois(c) -> Column:
    """All DOIs of a text, in order, once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(col(c)), F.lit(r"(10\.[0-9]{4,9}/[^\s\"<>]+)"), F.lit(1)), _balanced))


def is_placeholder_doi(c) -> Column:
    """DOIs that templates ship: two known ones, or a suffix of the letters n and x and marks only."""
    d = loose_doi(c)
    return d.isin(*TEMPLATE_DOIS) | d.rlike(r"^[^/]*/[nx._#-]+$")


def normalize_arxiv(c) -> Column:
    """arXiv id without prefix and version, old or new style; null otherwise."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"^(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/|^arxiv:\s*", ""), r"v[0-9]+$|\.pdf$", "")
    return F.when(s.rlike(r"^(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})$"), s)


def find_arxiv(c) -> Column:
    """First arXiv id printed in a text."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"arxiv[:\s]+\s*([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})", 1), F.lit(""))


def arxiv_from_doi(c) -> Column:
    """arXiv id of a DataCite arXiv DOI."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"^10\.48550/arxiv\.(.+)$", 1), F.lit(""))


def normalize_pmid(c) -> Column:
    """PMID digits without leading zeros."""
    s = F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), r"^pmid:?\s*", "")
    return F.when(s.rlike("^[0-9]{1,10}$"), F.regexp_replace(s, "^0+([0-9])", "$1"))


def normalize_pmcid(c) -> Column:
    """PMC id in upper case."""
    s = F.upper(F.trim(col(c)))
    s = F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), s)).otherwise(s)
    return F.when(s.rlike("^PMC[0-9]{1,10}$"), s)


def all_years(c) -> Column:
    """All years from 1800 to 2099 printed as numbers of their own."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(?<![0-9A-Za-z_])((?:18|19|20)[0-9]{2})(?![0-9A-Za-z_])"), F.lit(1)), lambda x: x.cast("int"))


def find_year(c) -> Column:
    """Year in parentheses first, then the first bare one that isn't part of a page range; a dashed letter may follow."""
    inside = F.nullif(F.regexp_extract(col(c), r"\(((?:19|20)[0-9]{2})[a-z]?\)", 1), F.lit(""))
    bare = F.regexp_extract(col(c), r"(?:^|[^0-9–\-—])((?:19|20)[0-9]{2})(?:[–\-][a-z](?:[^\p{L}0-9]|$)|[a-z]?(?:[^0-9–\-—]|$))", 1)
    return F.coalesce(inside, F.nullif(bare, F.lit(""))).cast("int")


def first_year(c) -> Column:
    """The first year from 1800 to 2099 that is a number of its own."""
    return F.nullif(F.regexp_extract(col(c), r"(?<![0-9A-Za-z_])((?:18|19|20)[0-9]{2})(?![0-9A-Za-z_])", 1), F.lit("")).cast("int")


def year_from_arxiv(c) -> Column:
    """Year of an arXiv id's first two digits; 91 to 99 are of the old century."""
    yy = F.nullif(F.regexp_extract(col(c), r"^(?:[a-z.-]+/)?([0-9]{2})", 1), F.lit("")).cast("int")
    return F.when(yy >= 90, yy + 1900).otherwise(yy + 2000)


def year_from_doi(c) -> Column:
    """A year that stands as a part of a DOI, arXiv DOIs left out."""
    c = F.lower(col(c))
    return F.when(~c.contains("arxiv"), F.nullif(F.regexp_extract(c, r"[./](19[0-9]{2}|20[0-9]{2})(?:[./]|$)", 1), F.lit("")).cast("int"))


def year_from_date(c) -> Column:
    """Year of a free or PDF date."""
    return F.nullif(F.regexp_extract(col(c), r"(?:^D:|\b)((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def family_of(c) -> Column:
    """Last word of a record's author (given, family), with a short lower-case particle before it."""
    w = F.split(F.trim(F.regexp_replace(col(c), r"\s+", " ")), " ")
    last, before = F.element_at(w, -1), F.try_element_at(w, F.lit(-2))
    particle = before.rlike(r"^\p{Ll}") & (F.octet_length(before) <= 4)
    return F.when(F.coalesce(particle, F.lit(False)), F.concat(before, F.lit(" "), last)).otherwise(last)


def printed_family(c) -> Column:
    """What stands before the comma of a printed name, else its last word with its particles."""
    c = F.trim(col(c))
    last = F.regexp_extract(c, rf"((?:(?:{PARTICLES})\s+)*\S+)$", 1)
    return F.when(c.contains(","), F.trim(F.substring_index(c, ",", 1))).otherwise(last)


def person_key(c) -> Column:
    """Surname and first initial, folded to lower case."""
    c = F.trim(col(c))
    first = F.when(c.contains(","), F.trim(F.regexp_replace(c, r"^[^,]*,\s*", ""))).otherwise(c)
    return F.concat_ws("|", F.lower(printed_family(c)), F.lower(F.substring(first, 1, 1)))


def author_year_key(surname, year) -> Column:
    """surname|year, null if either is."""
    s = normalize_title(surname)
    return F.when(col(year).isNotNull() & (s != ""), F.concat(s, F.lit("|"), col(year).cast("string")))


def looks_like_person(c) -> Column:
    """Two to six words of at most 25 characters that begin with capitals, particles and suffixes aside."""
    words = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[,()]+|[,()]+$", ""))
    aside = lambda w: w.isin(*NAME_PARTICLES) | F.lower(F.regexp_replace(w, r"\.+$", "")).isin(*NAME_SUFFIXES)
    good = F.forall(words, lambda w: F.length(w).between(1, 25) & (aside(w) | w.rlike(r"^\p{Lu}[\p{L}'’.-]*$")))
    return F.size(words).between(2, 6) & good & (F.size(F.filter(words, lambda w: ~aside(w))) >= 2)


def author_is_generic(c) -> Column:
    """Placeholders in place of an author, or no letter at all."""
    t = F.lower(F.trim(col(c)))
    return t.isin(*GENERIC_AUTHORS) | ~t.rlike(r"\p{L}")


def title_is_generic(c) -> Column:
    """Placeholders, file names and texts without a letter in place of a title."""
    t = F.lower(F.trim(col(c)))
    return t.isin(*GENERIC_TITLES) | t.rlike(rf"^microsoft (?:word|powerpoint)|\.(?:{FILE_ENDINGS})$") | ~t.rlike(r"\p{L}") | ~t.contains(" ") & t.rlike(r"[._]")


def config_digest(m: Column) -> Column:
    """SHA-256 of the sorted key=value lines of a map (X116)."""
    lines = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def fnv1a(c) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed bigint.

    The product is taken modulo 2^64 in 32-bit halves, so it stays in exact decimals on the JVM.
    """
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(col(c))), lambda i: F.conv(F.substring(F.hex(F.encode(col(c), "UTF-8")), (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    codes = F.when(F.length(col(c)) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        lo = s["lo"].bitwiseXOR(b)
        # times 0x100000001B3 = 2^40 + 0x1B3
        low = lo * 0x1B3
        hi = (s["hi"] * 0x1B3 + F.shiftright(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(0xFFFFFFFF)
        return F.struct(hi.alias("hi"), low.bitwiseAND(0xFFFFFFFF).alias("lo"))

    return F.aggregate(codes, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))
