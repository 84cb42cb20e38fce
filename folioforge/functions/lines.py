"""Tests of printed lines and raw entries as Column expressions (JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import col, fold_ascii

#: What affiliations, algorithms and stamps hold.
AFFILIATION_SIGNALS = ("@", "University", "Institute", "Department", "Laboratory", "Corresponding")
AFFILIATION = "|".join(AFFILIATION_SIGNALS)
INSTITUTION = r"(?:Department|School|Faculty|University|Institute|College|Laboratory|Center|Centre|Division|Hospital|Academy),*"
STAMP = r"^arXiv:[0-9]{4}\.[0-9]{4,5}v[0-9]+\s+\[[A-Za-z.\-]+\]\s+[0-9]{1,2}\s+[A-Z][a-z]{2}\s+[0-9]{4}$"
ALGORITHM_MARKERS = ("input:", "output:", "require:", "ensure:", "return", "←", ":=", "end for", "end while", "end if", "end function", "end procedure", "until ")
ALGORITHM_STARTS = ("for", "while", "if", "else", "repeat", "foreach", "procedure", "function", "do")
MONOSPACE = r"(?i)mono|courier|consol|menlo|typewriter|cmtt|sftt|txtt"
BODY_ROLES = ("", "body", "heading")
TITLELESS_TAIL = r",\s*(?:19|20)[0-9]{2}[a-z]?,\s*[0-9]{1,5}(?:\s*\([0-9]{1,4}\))?,\s*(?:e[a-z]{0,4}[0-9]{1,9}|\p{Lu}?[0-9]{1,6}(?:\s*[–—-]\s*\p{Lu}?[0-9]{1,6})?)\.?$"
INITIALS_FIRST = r"^\s*(?:\p{Lu}\p{Ll}?\.\s*(?:-\s*\p{Lu}\p{Ll}?\.\s*)?)+(?:\p{Ll}+\s+)*\p{Lu}[\p{L}'’-]*,"
QUOTES = "[\"“”„‘]"
#: Domains of indexes, archives, publishers and library services; open archives.
SCHOLARLY = tuple("""doi.org hdl.handle.net orcid.org crossref.org openalex.org semanticscholar.org unpaywall.org scholar.google.com scholar.archive.org lens.org dimensions.ai
scopus.com webofscience.com base-search.net core.ac.uk dblp.org inspirehep.net adsabs.harvard.edu ui.adsabs.harvard.edu philpapers.org econpapers.repec.org ideas.repec.org
worldcat.org ncbi.nlm.nih.gov nih.gov europepmc.org ebi.ac.uk cochranelibrary.com who.int arxiv.org biorxiv.org medrxiv.org chemrxiv.org psyarxiv.com osf.io ssrn.com zenodo.org
hal.science researchsquare.com preprints.org figshare.com dryad.org datadryad.org openreview.net aclanthology.org proceedings.mlr.press neurips.cc papers.nips.cc
openaccess.thecvf.com ijcai.org aaai.org jmlr.org eprint.iacr.org escholarship.org dspace.mit.edu eric.ed.gov springer.com springernature.com nature.com biomedcentral.com
sciencedirect.com elsevier.com cell.com thelancet.com wiley.com tandfonline.com sagepub.com ieee.org acm.org jstor.org oup.com cambridge.org pnas.org science.org plos.org
frontiersin.org mdpi.com bmj.com nejm.org jamanetwork.com karger.com degruyter.com emerald.com iop.org aps.org acs.org rsc.org aip.org worldscientific.com muse.jhu.edu
hindawi.com peerj.com elifesciences.org royalsocietypublishing.org annualreviews.org psycnet.apa.org apa.org liebertpub.com thieme-connect.com ahajournals.org asm.org
aacrjournals.org ashpublications.org journals.physiology.org informs.org siam.org ams.org projecteuclid.org mit.edu uchicago.edu brill.com ingentaconnect.com scielo.br
scielo.org doaj.org ebscohost.com proquest.com exlibrisgroup.com ovid.com gale.com openathens.net zotero.org""".split())
OPEN_HOSTS = ("arxiv.org", "europepmc.org", "ncbi.nlm.nih.gov")


def is_body_role(c) -> Column:
    """Roles of running text."""
    return col(c).isin(*BODY_ROLES)


def in_split(c, split: str) -> Column:
    """Whether an item belongs to a manifest split; "all" takes every item."""
    return F.lit(True) if split == "all" else col(c) == split


def in_edge_band(y0, y1, height, rotation, band: float) -> Column:
    """Whether a line's middle lies in the top or bottom band of an upright page."""
    mid, h = (col(y0) + col(y1)) / 2, col(height)
    return (col(rotation) == 0) & (h > 0) & ((mid >= h * (1 - band)) | (mid <= h * band))


def is_stamp(c) -> Column:
    """The margin stamp of a preprint."""
    return F.trim(col(c)).rlike(STAMP)


def has_affiliation_signal(c) -> Column:
    """An address sign or a word of institutions."""
    return col(c).rlike(AFFILIATION)


def is_lettered_affiliation(c) -> Column:
    """A line such as "a Department of X, University Y, City" (F13)."""
    t = F.trim(col(c))
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    return t.rlike(rf"^[ᵃᵇᶜᵈᵉᶠᵍʰ]\s*\p{{Lu}}.*(?:,|{AFFILIATION})") | t.rlike(rf"^[a-h] (?:\S+\s+){{0,2}}{INSTITUTION}(?:\s|$)") & (commas >= 2)


def is_algorithm_line(c) -> Column:
    """A line with a mark of pseudo-code, a numbered step or a leading keyword."""
    t = F.lower(F.trim(col(c)))
    marked = F.lit(False)
    for m in ALGORITHM_MARKERS:
        marked = marked | t.contains(m)
    first = F.regexp_extract(t, r"^(\S+)", 1)
    return marked | first.rlike("^[0-9]+:$") | first.isin(*ALGORITHM_STARTS)


def is_code_line(spans: Column) -> Column:
    """Whether four fifths of a line's characters are set in a monospace font (F18); spans are structs of text and font."""
    n = lambda s: F.length(F.regexp_replace(s["text"], r"\s", ""))
    total = F.aggregate(spans, F.lit(0), lambda a, s: a + n(s))
    mono = F.aggregate(F.filter(spans, lambda s: F.coalesce(s["font"].rlike(MONOSPACE), F.lit(False))), F.lit(0), lambda a, s: a + n(s))
    return (total > 0) & (mono * 10 >= total * 8)


def is_math_heavy(c) -> Column:
    """Whether at least as many of a line's characters are signs as letters."""
    s = F.regexp_replace(col(c), r"\s", "")
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (F.length(s) - letters > 0) & (F.length(s) - letters >= letters)


def mark_incomplete(warnings: Column, scanned: Column, unmapped: Column) -> Column:
    """Warnings with those of a scanned or unmapped page, each once."""
    w = F.coalesce(warnings, F.array().cast("array<string>"))
    for test, text in ((scanned, "extraction_incomplete: scanned"), (unmapped, "unicode_mapping: unmapped")):
        kind = text.split(":")[0] + ":"
        known = F.exists(w, lambda x: x.startswith(kind))  # noqa: B023
        w = F.when(F.coalesce(test, F.lit(False)) & ~known, F.array_append(w, F.lit(text))).otherwise(w)
    return w


def titleless_raw(c) -> Column:
    """Whether an entry prints no title: initials and names, a journal, year, volume and page (F32)."""
    body = F.trim(F.regexp_replace(F.trim(col(c)), r"^\s*(?:\[[0-9]{1,4}\]|\([0-9]{1,4}\)|[0-9]{1,4}[.)]?)\s+", ""))
    head = F.regexp_replace(body, TITLELESS_TAIL, "")
    journal = F.trim(F.regexp_extract(head, r"([^,]*)$", 1))
    return ~body.rlike(QUOTES) & body.rlike(TITLELESS_TAIL) & head.rlike(INITIALS_FIRST) & journal.rlike(r"^\p{Lu}") & (F.length(journal) <= 80) & ~journal.rlike(r"(?:^|\s)\p{Ll}\S{3,}")


def host_in(host, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or lies in one."""
    h = F.lower(col(host))
    out = h.isin(*domains)
    for d in domains:
        out = out | h.endswith("." + d)
    return out


def is_scholarly_host(host) -> Column:
    """Hosts of publishers and archives."""
    return host_in(host, SCHOLARLY)


def is_public_suffix(host, suffix) -> Column:
    """A domain that is its own public suffix."""
    return F.lower(col(host)) == F.lower(col(suffix))


def requires_session(host, open_license) -> Column:
    """Whether a link may need a login: no open licence and no open archive (X129)."""
    return ~F.coalesce(col(open_license), F.lit(False)) & ~host_in(host, OPEN_HOSTS)


def venue_in_entry(venue, entry, title) -> Column:
    """Whether a word of three letters of the venue, no filler and not in the title, stands in the entry."""
    ws = lambda c: F.filter(F.split(fold_ascii(F.coalesce(col(c), F.lit(""))), r"\s+"), lambda w: w != "")
    needles = F.filter(ws(venue), lambda w: (F.length(w) >= 3) & ~w.isin("and", "the", "for", "with", "from", "into", "via"))
    return F.size(F.array_intersect(F.array_except(needles, ws(title)), ws(entry))) > 0


def separator(prev_column, column, gap, line_height, share: float = 0.5) -> Column:
    """What stands between two lines: a blank line where the column changes or the gap is wide."""
    wide = (col(prev_column) != col(column)) | F.coalesce(col(gap) > share * col(line_height), F.lit(False))
    return F.when(wide, "\n\n").otherwise("\n")


def author_surname(c) -> Column:
    """Key of an entry's author: what stands before the comma, else the last word, or the first where the last is initials (X105)."""
    name = F.trim(F.regexp_replace(col(c), r"(?i),?\s*\bet al\.?\s*$", ""))
    tokens = F.filter(F.split(name, r"\s+"), lambda t: (t != "") & ~F.lower(F.regexp_replace(t, r"\.+$", "")).isin("jr", "sr", "ii", "iii", "iv", "phd", "md"))
    last = F.element_at(tokens, -1)
    pick = F.when(last.rlike(r"^[\p{Lu}.]{1,3}$"), F.get(tokens, F.lit(0))).otherwise(last)
    return F.when(name.contains(","), F.lower(F.trim(F.substring_index(name, ",", 1)))).when(F.size(tokens) > 0, F.lower(F.regexp_replace(pick, r"^\.+|\.+$", ""))).when(name.isNotNull(), "")


def find_doi(c) -> Column:
    """First DOI of a text, with the blank a line wrap leaves after "10." or before the slash."""
    raw = F.regexp_extract(col(c), r"(10\.\s?[0-9]{4,9}\s?/[^\s\"<>]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(raw, r"\s", ""), r"[.,;:)\]}']+$", "")), F.lit(""))


def year_of_json(c) -> Column:
    """Year from 1000 to 2999 of a JSON number or string."""
    y = F.regexp_extract(F.trim(col(c), F.lit('" ')), r"^([0-9]{4})(?:[^0-9]|$)", 1).try_cast("int")
    return F.when(y.between(1000, 2999), y)


def json_array(c, path: str) -> Column:
    """A JSON array as texts, empty where there is none (X126)."""
    return F.coalesce(F.from_json(F.get_json_object(col(c), path), "array<string>"), F.array().cast("array<string>"))


def reference_extra(*fields: str) -> Column:
    """JSON of the optional fields of an entry, null if all are missing (X127)."""
    return F.when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull(), F.to_json(F.struct(*fields)))


def search_url(base: str, query, rows: int, mailto: str | None = None) -> Column:
    """Query URL of a registry; at most 1,000 rows an answer (X132)."""
    from folioforge.functions.urls import percent_encode
    tail = f"&rows={min(max(rows, 1), 1000)}" + (f"&mailto={mailto}" if mailto else "")
    return F.concat(F.lit(f"{base}?query="), percent_encode(query), F.lit(tail))


def venue_of(c) -> Column:
    """Venue of an entry: after "In:", after the closing quote, or a phrase that begins like one."""
    kind = r"(?:Annals|Journal|Letters|Proceedings|Acta|Archives|Reviews|Transactions|Bulletin|Ann|J|Lett|Proc|Arch|Rev|Trans|Bull)\b"
    forms = (r"\bIn:\s+([^,;:0-9]+)", r"[”\"],?\s+([^,;:0-9”\"]+),", rf"[.,]\s+({kind}[^,;:0-9]*)")
    got = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(col(c), p, 1), F.lit(" .,")), F.lit("")) for p in forms])
    return got


def page1_year(lines: Column) -> Column:
    """Year of the first dated line (received, accepted, published, copyright), else the first year at all."""
    y = lambda x: F.nullif(F.regexp_extract(x, r"(?<![0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])", 1), F.lit("")).cast("int")
    dated = F.filter(lines, lambda x: x.rlike(r"(?i)\b(?:received|accepted|published|copyright|available online)\b|©") & y(x).isNotNull())
    any_ = F.filter(lines, lambda x: y(x).isNotNull())
    return F.coalesce(y(F.get(dated, F.lit(0))), y(F.get(any_, F.lit(0))))
