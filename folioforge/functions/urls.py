"""URLs, hosts, HTML text and entities."""
from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from folioforge.functions.text import col

TRACKING = r"^(?:utm_.*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src|spm|_ga)$"
DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21"}


def percent_encode(c) -> Column:
    """RFC 3986 encoding of a component (X42, X113)."""
    return F.replace(F.replace(F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(c) -> Column:
    """%XX decoded, + kept; text with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B"))), col(c))


def is_tracking_param(c) -> Column:
    """Parameters that only track."""
    return F.lower(col(c)).rlike(TRACKING)


def _dots(path: Column) -> Column:
    """Dot segments resolved by a fold over the segments."""
    segs = F.split(path, "/")
    folded = F.aggregate(segs, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    return F.array_join(folded, "/")


def normalize_url(c) -> Column:
    """Scheme defaulted and lowered, host lowered, default port, fragment and tracking parameters dropped, dot segments resolved (X38); null if it is no http(s) URL."""
    s = F.trim(col(c))
    s = F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    auth = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(auth, r"(?:[^@]*@)?([^:]*)", 1))
    port = F.regexp_extract(auth, r":([0-9]+)$", 1)
    path = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(_dots(path))
    params = F.filter(F.split(F.regexp_extract(s, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~is_tracking_param(F.substring_index(p, "=", 1)))
    keep = (port != "") & (port != F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PORT.items() for x in kv]), scheme), F.lit("")))
    out = F.concat(scheme, F.lit("://"), host, F.when(keep, F.concat(F.lit(":"), port)).otherwise(""), path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & host.rlike(r"^[a-z0-9.-]+$"), out)


def safe_url(c) -> Column:
    """http(s) URLs without credentials, else null."""
    return F.when(col(c).rlike(r"^https?://[^/@\s]+(?:[/?#]\S*)?$"), col(c))


def extension(c) -> Column:
    """Lower-case extension of the last path segment."""
    return F.nullif(F.lower(F.regexp_extract(F.regexp_extract(col(c), r"^[^?#]*?([^/?#]*)(?:[?#].*)?$", 1), r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit(""))


def host_of(c) -> Column:
    return F.lower(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_policy(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Each URL with the action of the longest matching domain rule, "block" without one.

    ``rules`` is (domain, action); URLs are joined by their host suffixes, so the rules need no broadcast.
    """
    u = urls.withColumn("__host", host_of(url))
    hits = u.select(url, F.explode(host_suffixes(F.col("__host"))).alias("domain")).distinct().join(rules, "domain").groupBy(url).agg(F.max_by("action", F.length("domain")).alias("action"))
    return urls.join(hits, url, "left").withColumn("action", F.coalesce("action", F.lit("block")))


def classify_pdf_url(c) -> Column:
    """likely, possible or no, from the URL alone."""
    u = F.lower(col(c))
    return F.when(extension(u) == "pdf", "likely").when(u.rlike(r"/pdf(?:/|$|\?)|[?&](?:type|format)=pdf|/download"), "possible").otherwise("no")


def looks_like_pdf(content: Column) -> Column:
    """%PDF- within the first kilobyte."""
    at = F.instr(F.hex(F.substring(content, 1, 1024)), "255044462D")
    return (at > 0) & (at % 2 == 1)


def public_ip(c) -> Column:
    """Whether a dotted address lies outside the private and reserved ranges."""
    p = F.transform(F.split(col(c), r"\."), lambda x: x.try_cast("int"))
    a, b = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))
    ok = (F.size(p) == 4) & F.forall(p, lambda x: F.coalesce((x >= 0) & (x <= 255), F.lit(False)))
    bad = a.isin(0, 10, 127) | (a >= 224) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168) | (a == 169) & (b == 254) | (a == 100) & b.between(64, 127)
    return ok & ~bad


def strip_simple_tags(c) -> Column:
    """Tags out, the common entities decoded, white space collapsed."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "header", "footer", "main"}
_DROP = {"script", "style", "noscript", "template", "nav", "svg"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.meta, self.links, self.title, self.in_title, self.ld, self.in_ld = [], 0, {}, [], "", False, [], False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _DROP:
            self.skip += 1
            self.in_ld = tag == "script" and a.get("type") == "application/ld+json"
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or a.get("property")):
            self.meta.setdefault((a.get("name") or a["property"]).lower(), a.get("content", ""))
        elif tag in ("a", "link") and a.get("href"):
            self.links.append(a["href"])
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _DROP and self.skip:
            self.skip -= 1
            self.in_ld = False
        elif tag == "title":
            self.in_title = False
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_ld:
            self.ld.append(data)
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(data)


HTML_FIELDS = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("meta", MapType(StringType(), StringType())), StructField("links", ArrayType(StringType())), StructField("json_ld", StringType())])


def read_html(source: str | None) -> tuple | None:
    """(title, text, meta, links, JSON-LD) of a page (S49, X47 to X50, X56 to X58); null for null."""
    if source is None:
        return None
    r = _Reader()
    r.feed(source)
    r.close()
    text = "\n".join(x for x in (re.sub(r"\s+", " ", ln).strip() for ln in "".join(r.out).split("\n")) if x)
    return (r.title.strip() or None, text, r.meta, list(dict.fromkeys(r.links)), "".join(r.ld).strip() or None)


@F.pandas_udf(HTML_FIELDS)
def html_fields(s: pd.Series) -> pd.DataFrame:
    """Fields of a page as a struct, in Arrow batches."""
    rows = [read_html(x) or (None,) * 5 for x in s]
    return pd.DataFrame(rows, columns=[f.name for f in HTML_FIELDS.fields])


@F.pandas_udf(StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Named and numeric entities decoded, unknown ones kept."""
    return s.map(lambda x: None if x is None else _html.unescape(x))


def resolve(base, href) -> Column:
    """A reference against a base URL, normalised."""
    b, h = col(base), F.trim(col(href))
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    full = F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z]+:)", 1), h)).when(h.startswith("/"), F.concat(root, h)).when(
        h.startswith("?"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h)).when(h.startswith("#") | (h == ""), b).otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), h))
    return F.when(full.rlike(r"^(?i)https?://"), normalize_url(full))


def proxied_url(login, target) -> Column:
    """A login URL with its encoded target."""
    return F.concat(col(login), percent_encode(target))


def unproxy_host(host, suffix: str) -> Column:
    """journals-example-org.proxy.edu as journals.example.org."""
    h = F.lower(col(host))
    name = F.regexp_replace(h, r"\." + suffix.replace(".", r"\.") + "$", "")
    plain = F.replace(F.replace(F.replace(name, F.lit("--"), F.lit("\x01")), F.lit("-"), F.lit(".")), F.lit("\x01"), F.lit("-"))
    return F.when(h.endswith("." + suffix), F.when(name.contains("."), name).otherwise(plain)).otherwise(h)


def content_disposition(c) -> Column:
    """struct(kind, filename); filename* wins, path parts are dropped."""
    ext = F.try_url_decode(F.nullif(F.regexp_extract(col(c), r"(?i)filename\*\s*=\s*[A-Za-z0-9-]*'[^']*'([^;\s]+)", 1), F.lit("")))
    plain = F.nullif(F.regexp_replace(F.regexp_extract(col(c), r"(?i)filename\s*=\s*(\"[^\"]*\"|[^;\s]+)", 1), '"', ""), F.lit(""))
    return F.struct(F.lower(F.trim(F.split_part(col(c), F.lit(";"), F.lit(1)))).alias("kind"), F.regexp_replace(F.coalesce(ext, plain), r"^.*[/\\]", "").alias("filename"))


def classify_pdf_response(url, mime, disposition) -> Column:
    """Verdict from URL, media type and disposition."""
    m = F.lower(F.trim(F.split_part(F.coalesce(col(mime), F.lit("")), F.lit(";"), F.lit(1))))
    d = content_disposition(F.coalesce(col(disposition), F.lit("")))["filename"]
    return F.when(m.isin("application/pdf", "application/x-pdf"), "likely").when(F.lower(F.coalesce(d, F.lit(""))).endswith(".pdf"), "likely").when(m.startswith("text/html"), "no").otherwise(classify_pdf_url(url))


def link_header(c) -> Column:
    """map rel -> URL of a Link header (X114)."""
    parts = F.regexp_extract_all(col(c), F.lit(r'(<[^>]*>[^,<]*rel="?[A-Za-z]+"?)'), F.lit(1))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, r'rel="?([A-Za-z]+)', 1)), F.regexp_extract(p, r"<([^>]*)>", 1))))


def http_date(c) -> Column:
    """Unix seconds of an HTTP date in one of its three shapes (X119)."""
    s = F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]+,?\s+", "")
    t = F.coalesce(F.try_to_timestamp(s, F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(s, F.lit("dd-MMM-yy HH:mm:ss z")), F.try_to_timestamp(F.regexp_replace(s, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy")))
    return F.unix_timestamp(t)


def set_cookie(c) -> Column:
    """struct(name, value, domain, path, secure, max_age) of a Set-Cookie header."""
    attr = lambda n: F.nullif(F.trim(F.regexp_extract(col(c), rf"(?i);\s*{n}\s*=\s*([^;]*)", 1)), F.lit(""))
    return F.struct(F.trim(F.regexp_extract(col(c), r"^\s*([^=;]+)=", 1)).alias("name"), F.regexp_extract(col(c), r"^\s*[^=;]+=\"?([^;\"]*)", 1).alias("value"), F.lower(F.regexp_replace(attr("domain"), r"^\.", "")).alias("domain"),
                    F.coalesce(attr("path"), F.lit("/")).alias("path"), col(c).rlike(r"(?i);\s*secure(?:;|\s*$)").alias("secure"), attr("max-age").try_cast("bigint").alias("max_age"))


def extra_map(c) -> Column:
    """"Key: value" lines as a map, keys lower-cased, the first of each wins (X112)."""
    kv = F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:?", "")).alias("v"))), lambda e: (e["k"] != "") & (e["v"] != ""))
    return F.aggregate(kv, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))


def openurl(resolver: str, doi, title, year) -> Column:
    """An OpenURL link (X131)."""
    kv = [F.when(col(v).isNotNull(), F.concat(F.lit(k + "="), percent_encode(col(v).cast("string")))) for k, v in (("rft_id", doi), ("rft.atitle", title), ("rft.date", year))]
    return F.concat(F.lit(resolver + "?url_ver=Z39.88-2004&"), F.concat_ws("&", *kv))


def doi_from_url(c) -> Column:
    """DOI in a URL's decoded path or query, publisher tails cut."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(percent_decode(c)), r"(10\.[0-9]{4,9}/[^\s?#&]+)", 1), r"/(?:pdf|full|abstract|epdf|html)$|\.pdf$", ""), F.lit(""))


def arxiv_from_url(c) -> Column:
    """arXiv id of an arxiv.org URL."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"arxiv\.org/(?:abs|pdf|html)/([a-z-]*/?[0-9.]+[0-9])(?:v[0-9]+)?", 1), F.lit(""))
