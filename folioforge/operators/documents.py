"""Per-page and per-document operators whose rules depend on order: reading order, lists, entries, markers."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# ---- reading order (D01 to D06, T09) --------------------------------------------------------------


def xy_cut(boxes: list[tuple[float, float, float, float]], gap: float = 8.0) -> list[int]:
    """Reading order of boxes (x0, y0, x1, y1; y grows upwards): recursive cuts at the widest empty band.

    A vertical band (column gutter) is taken if it is at least ``gap`` wide, else a horizontal one;
    boxes that can't be cut apart go from top to bottom, then left to right.
    """
    def widest(ids: list[int], a: int, b: int) -> tuple[float, float]:
        spans = sorted((boxes[i][a], boxes[i][b]) for i in ids)
        reach, best, at = spans[0][1], 0.0, 0.0
        for s, e in spans[1:]:
            if s - reach > best:
                best, at = s - reach, (s + reach) / 2
            reach = max(reach, e)
        return best, at

    out: list[int] = []
    stack = [list(range(len(boxes)))]
    while stack:
        ids = stack.pop()
        if len(ids) > 1:
            wx, x = widest(ids, 0, 2)
            wy, y = widest(ids, 1, 3)
            if wx >= gap and wx >= wy:
                stack += [[i for i in ids if boxes[i][0] >= x], [i for i in ids if boxes[i][0] < x]]
                continue
            if wy > 0:
                stack += [[i for i in ids if boxes[i][1] < y], [i for i in ids if boxes[i][1] >= y]]
                continue
        out += sorted(ids, key=lambda i: (-boxes[i][3], boxes[i][0]))
    return out


def page_lines(spans: pd.DataFrame, tolerance: float = 0.4) -> list[dict]:
    """Spans of a page grouped to lines by baseline, in reading order."""
    rows = spans.sort_values(["y0", "x0"], ascending=[False, True]).to_dict("records")
    lines: list[dict] = []
    for r in rows:
        if not (r["text"] or "").strip():
            continue
        size = r["size"] or 10.0
        for ln in reversed(lines):
            if abs(ln["y0"] - r["y0"]) <= tolerance * size and -0.5 * size <= r["x0"] - ln["x1"] <= 2.5 * size:
                ln["text"] += ("" if r["x0"] - ln["x1"] < 0.15 * size else " ") + r["text"]
                ln["x1"], ln["y1"] = max(ln["x1"], r["x1"]), max(ln["y1"], r["y1"])
                break
        else:
            lines.append({k: r[k] for k in ("x0", "y0", "x1", "y1", "text", "size")})
    order = xy_cut([(ln["x0"], ln["y0"], ln["x1"], ln["y1"]) for ln in lines])
    return [lines[i] for i in order]


def order_pages(spans: DataFrame) -> DataFrame:
    """(hash, page, idx, text, x0, y0, x1, y1, size) of each line in reading order; one small group a page."""
    def page(p: pd.DataFrame) -> pd.DataFrame:
        rows = page_lines(p)
        return pd.DataFrame([(p["hash"].iloc[0], p["page"].iloc[0], i, r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["size"]) for i, r in enumerate(rows)],
                            columns=["hash", "page", "idx", "text", "x0", "y0", "x1", "y1", "size"])

    return spans.select("hash", "page", "text", "x0", "y0", "x1", "y1", "size").groupBy("hash", "page").applyInPandas(
        page, "hash string, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double, size double")


# ---- reference lists (D27 to D34, W08 to W13) -----------------------------------------------------

HEADINGS = r"^\s*(?:[0-9IVX]{1,4}\.?\s+)?(?i:references?(?:\s+cited)?|bibliography|literature(?:\s+cited)?|works\s+cited|literatur(?:verzeichnis)?|références|bibliographie|referencias|bibliografía)\s*:?\s*$"


def reference_headings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are a heading of a reference list."""
    return lines.where(F.col(line).rlike(HEADINGS))


def segment_numbered(lines: list[str]) -> list[tuple[str, str]]:
    """(label, raw) of each entry: a line opens one if its number is the expected next one, else it goes on."""
    out: list[list[str]] = []
    expected = None
    for line in lines:
        m = re.match(r"^\s*(\[(\d{1,4})\]|(\d{1,4})[.)])\s*(.*)$", line)
        n = int(m.group(2) or m.group(3)) if m else None
        if m and (expected is None and n == 1 or expected is not None and n in (expected, expected + 1)):
            out.append([m.group(1), m.group(4)])
            expected = n + 1
        elif m and expected is not None and n == 1 and expected > 4:
            break  # another list
        elif out:
            out[-1][1] = join_line(out[-1][1], line)
    return [(a, b.strip()) for a, b in out]


def segment_author_year(lines: list[str]) -> list[tuple[str, str]]:
    """Entries without labels: a line with an author-year start opens one after a finished entry."""
    out: list[list[str]] = []
    start = re.compile(r"^\s*[A-ZÀ-Þ][\w’'-]+(?:,\s*[A-ZÀ-Þ]|\s+[A-ZÀ-Þ]{1,3}\b)")
    for line in lines:
        if start.match(line) and (not out or re.search(r"[.)\d]\s*$", out[-1][1])):
            out.append(["", line])
        elif out:
            out[-1][1] = join_line(out[-1][1], line)
    return [(a, b.strip()) for a, b in out]


def join_line(a: str, b: str) -> str:
    """A wrapped line joined to the text before; a hyphen between lower-case letters is dropped."""
    b = b.strip()
    return a[:-1] + b if re.search(r"[a-zß-ÿ]-$", a) and b[:1].islower() else f"{a} {b}"


def segment_entries(lists: DataFrame, keys: list[str], lines: str = "lines") -> DataFrame:
    """(keys, idx, label, raw) of lists given as arrays of lines, numbered first, else author-year."""
    types = dict(lists.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                ls = list(row[-1]) if row[-1] is not None else []
                found = segment_numbered(ls) or segment_author_year(ls)
                rows += [(*row[:-1], i, label or None, raw) for i, (label, raw) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*keys, "idx", "label", "raw"])

    return lists.select(*keys, lines).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", idx int, label string, raw string")


def evidence_guard(entries: DataFrame, by: list[str], idx: str, raw: str) -> DataFrame:
    """Entries without evidence folded into the one before; a trailing run without any dropped.

    Gaps and islands: the running count of entries with evidence is the number of the entry to keep.
    A list in which no entry has evidence is left alone.
    """
    from folioforge.functions.text import has_reference_evidence
    from folioforge.operators.ledger import row_numbers, running_sum
    e = row_numbers(entries.withColumn("__e", F.coalesce(has_reference_evidence(raw), F.lit(False)).cast("bigint")), by, idx, "__rn")
    total = e.groupBy(*[F.col(c).alias(f"__t{k}") for k, c in enumerate(by)]).agg(F.sum("__e").alias("__all"))
    same = None
    for k, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"__t{k}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"__t{k}"))
    e = running_sum(e, by, "__rn", "__e", "__upto").join(total, same)
    e = e.where((F.col("__all") == 0) | (F.col("__upto") < F.col("__all")) | (F.col("__e") == 1))
    e = e.withColumn("__grp", F.greatest(F.when(F.col("__all") == 0, F.col("__rn").cast("bigint")).otherwise(F.col("__upto")), F.lit(1).cast("bigint")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(idx, raw))), lambda x: x[raw])
    return e.groupBy(*by, "__grp").agg(F.min(idx).alias(idx), F.array_join(texts, " ").alias(raw)).drop("__grp")


# ---- entries (X95 to X103) ------------------------------------------------------------------------

ENTRY = StructType([StructField("authors", ArrayType(StringType())), StructField("title", StringType()), StructField("year", IntegerType()), StructField("venue", StringType()), StructField("volume", StringType()),
                    StructField("issue", StringType()), StructField("pages", StringType()), StructField("doi", StringType()), StructField("url", StringType())])
_YEAR = re.compile(r"\((?P<a>(?:18|19|20)\d\d)[a-z]?\)|(?<![\d–-])(?P<b>(?:18|19|20)\d\d)(?![\d–-])")
_NUM = (re.compile(r"vol\.\s*(?P<v>\d+)(?:,\s*no\.\s*(?P<i>\d+))?,\s*pp\.\s*(?P<p>\d+\s*[–-]\s*\d+)"), re.compile(r"(?P<v>\d+)\s*(?:\((?P<i>\d+)\))?\s*[,:]\s*(?P<p>\d+\s*[–-]\s*\d+)"), re.compile(r"\b(?P<v>\d+)\s*\((?P<i>\d+)\)(?P<p>)"))
_VENUE = r"(?:(?:Annals|Journal|Letters|Proceedings|Acta|Archives|Reviews|Transactions|Bulletin|Ann|J|Lett|Proc|Arch|Rev|Trans|Bull)\b[^,;:\d]*)"


def split_authors(s: str) -> list[str]:
    """Names of an author list; a single word with initials or a given name after it is one name."""
    s = re.sub(r"\bet al\.?", "", s).strip(" ,.;:")
    parts = [p.strip() for p in re.split(r";\s*|,\s*(?:and|&)\s+|\s+(?:and|&)\s+|,\s*", s) if p.strip()]
    out: list[str] = []
    for p in parts:
        lone = out and " " not in out[-1] and "," not in out[-1]
        if lone and (re.fullmatch(r"(?:[A-ZÀ-Þ]\.?-?\s?){1,4}", p) or re.fullmatch(r"[A-ZÀ-Þ][\w’'-]+(?:\s[A-ZÀ-Þ]\.?)*", p)):
            out[-1] += ", " + p
        else:
            out.append(p)
    return out


def parse_entry(raw: str | None) -> tuple | None:
    """Fields of one entry: quoted titles, "authors (year) title", "authors: title. In: venue" and "authors. title. venue" (X95)."""
    if raw is None:
        return None
    s = re.sub(r"^\s*(?:\[[^\]]{1,12}\]|\d{1,4}[.)])\s*", "", " ".join(raw.split()))
    doi = re.search(r"10\.\d{4,9}/[^\s\"<>]+", s)
    url = re.search(r"https?://\S+", s)
    year = _YEAR.search(s)
    nums = next((m for p in _NUM if (m := p.search(s))), None)
    venue = re.search(rf"(?:^|[.,”\"]\s+|In:\s+)({_VENUE})", s)
    authors = title = None
    q = re.search(r"[“\"](.+?),?[”\"]", s)
    if q:
        authors, title = s[:q.start()], q.group(1)
    elif m := re.match(r"(.+?)\s\((?:18|19|20)\d\d[a-z]?\)[.:]?\s+(.+?)\.\s", s):
        authors, title = m.groups()
    elif m := re.match(r"([^:]{3,200}?):\s+(.+?)\.\s+In:\s", s):
        authors, title = m.groups()
    elif venue and venue.start() > 0:
        parts = re.split(r"(?<=[^\W\d_]{2})\.+\s+", s[:venue.start(1)].rstrip(" ."))
        if len(parts) > 1:
            authors, title = ". ".join(parts[:-1]), parts[-1]
    g = nums.groupdict() if nums else {}
    return (split_authors(authors) if authors else None, title.strip(" .,") if title else None, int(year.group("a") or year.group("b")) if year else None, venue.group(1).strip(" .,") if venue else None,
            g.get("v"), g.get("i"), (g.get("p") or "").replace(" ", "") or None, doi.group().rstrip(".,;)").lower() if doi else None, url.group().rstrip(".,;)") if url else None)


@F.pandas_udf(ENTRY)
def entry_fields(s: pd.Series) -> pd.DataFrame:
    """Parsed fields of raw entries in Arrow batches."""
    return pd.DataFrame([parse_entry(x) or (None,) * 9 for x in s], columns=[f.name for f in ENTRY.fields]).astype({"year": "Int32"})


# ---- LaTeX sources (X107 to X109, X36, S44, S45) --------------------------------------------------

def parse_bib(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; braces may nest, strings may be quoted (X108)."""
    out, i = [], 0
    while (m := re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,").search(text, i)):
        i, depth, start = m.end(), 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        if m.group(1).lower() in ("comment", "string", "preamble"):
            continue
        fields, body, k = {}, text[start:i - 1], 0
        while (f := re.compile(r"(\w+)\s*=\s*").search(body, k)):
            k = f.end()
            if k < len(body) and body[k] in "{\"":
                close, d, s = body[k], 0, k + 1
                k += 1
                while k < len(body) and not (d == 0 and body[k] == ("}" if close == "{" else '"')):
                    d += {"{": 1, "}": -1}.get(body[k], 0)
                    k += 1
                value = body[s:k]
            else:
                value = re.match(r"[^,\s]*", body[k:]).group()
            fields[f.group(1).lower()] = " ".join(value.split())
            k += max(1, len(value) if body[f.end():f.end() + 1] not in "{\"" else 1)
        out.append((m.group(1).lower(), m.group(2), fields))
    return out


def parse_bbl(text: str) -> list[tuple[str | None, str, str]]:
    """(label, key, text) of each bibitem (X107)."""
    parts = re.split(r"\\bibitem", text)[1:]
    out = []
    for p in parts:
        m = re.match(r"\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}(.*)", p.split("\\end{thebibliography}")[0], re.S)
        if m:
            out.append((m.group(1), m.group(2), latex_to_text(m.group(3))))
    return out


def cite_keys(text: str) -> list[str]:
    """Keys of all cite commands, in order, comments left out (X109)."""
    text = re.sub(r"(?<!\\)%.*", "", text)
    return [k.strip() for m in re.finditer(r"\\(?:no)?cite\w*\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^}]*)\}", text) for k in m.group(1).split(",") if k.strip()]


_ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "c": "̧", "v": "̌", "H": "̋", "=": "̄", ".": "̇", "u": "̆", "r": "̊", "k": "̨"}
_SYMBOLS = {"ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "l": "ł", "aa": "å", "AE": "Æ", "OE": "Œ", "O": "Ø", "L": "Ł", "AA": "Å", "i": "ı", "&": "&", "%": "%", "_": "_", "#": "#", "$": "$"}


def latex_to_text(s: str | None) -> str | None:
    """Accents, symbols and common commands of TeX as plain text."""
    import unicodedata
    if s is None:
        return None
    s = re.sub(r"\\([`'^\"~=.])\s*\{?\\?([A-Za-z])\}?|\\([cvHurk])\s*\{\\?([A-Za-z])\}", lambda m: (m.group(2) or m.group(4)) + _ACCENTS[m.group(1) or m.group(3)], s)
    s = re.sub(r"\\(ss|ae|oe|o|l|aa|AE|OE|O|L|AA|i)(?![A-Za-z])\s?(?:\{\})?", lambda m: _SYMBOLS[m.group(1)], s)
    s = re.sub(r"\\([&%_#$])", r"\1", s)
    s = re.sub(r"\\(?:emph|textit|textbf|textrm|textsc|texttt|mbox|url|newblock|em|bf|it)\b\s*", "", s)
    s = re.sub(r"\\[A-Za-z]+\*?\s*", "", s).replace("{", "").replace("}", "").replace("---", "—").replace("--", "–").replace("~", " ").replace("``", "“").replace("''", "”")
    return " ".join(unicodedata.normalize("NFC", s).split())


DROPPED = "figure|table|equation|align|gather|multline|eqnarray|thebibliography|verbatim|lstlisting|tikzpicture|algorithm|abstract"


def body_text(tex: str | None) -> str | None:
    """Running text of a LaTeX source: its body without comments, front matter, floats, math and cites, a blank line between paragraphs."""
    if tex is None:
        return None
    s = re.sub(r"(?<!\\)%.*", "", tex)
    m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", s, re.S)
    s = m.group(1) if m else s
    s = re.sub(rf"\\begin\{{({DROPPED})\*?\}}.*?\\end\{{\1\*?\}}", "\n\n", s, flags=re.S)
    s = re.sub(r"\\(?:title|author|date|thanks|label|bibliography|bibliographystyle|includegraphics|vspace|hspace|footnote)\*?(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}|\\maketitle\b", "", s)
    s = re.sub(r"~?\\(?:cite\w*|ref|eqref|autoref|cref)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", s)
    s = re.sub(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|(?<!\\)\$[^$]*(?<!\\)\$", " ", s, flags=re.S)
    s = re.sub(r"\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{((?:[^{}]|\{[^{}]*\})*)\}", r"\n\n\1\n\n", s)
    s = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\item\b(?:\[[^\]]*\])?", "", s)
    paras = (latex_to_text(p) for p in re.split(r"\n[ \t]*\n|\\par\b", s))
    return "\n\n".join(p for p in paras if p)


# ---- markers and boxes ----------------------------------------------------------------------------

def author_year_markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, surname, year, suffix) of markers such as (Smith et al., 2020a)."""
    p = r"(\p{Lu}[\p{L}’'-]+(?:\s+(?:et al\.?|and|&)\s*(?:\p{Lu}[\p{L}’'-]+)?)?,?\s+\(?(?:18|19|20)[0-9]{2}[a-z]?)"
    m = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))).alias("m"))
    return m.select(key, F.regexp_extract("m", r"^(\p{Lu}[\p{L}’'-]+)", 1).alias("surname"), F.regexp_extract("m", "((?:18|19|20)[0-9]{2})[a-z]?$", 1).cast("int").alias("year"), F.nullif(F.regexp_extract("m", "[0-9]([a-z])$", 1), F.lit("")).alias("suffix"))


def box_union(a: Column, b: Column) -> Column:
    """Least box around two (X121)."""
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def overlap_area(a: Column, b: Column) -> Column:
    """Area shared by two boxes (X122)."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    return w * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def mostly_inside(a: Column, b: Column, share: float = 0.5) -> Column:
    """Whether at least a share of box a lies in b (X123)."""
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, overlap_area(a, b) >= share * area).otherwise(False)


def tag_inside(lines: DataFrame, figures: DataFrame, page_keys: list[str]) -> DataFrame:
    """Lines with the figure box they mostly lie in (J30); joined on the page, so boxes meet their page's lines only."""
    f = figures.select(*page_keys, "figure_id", F.col("bbox").alias("__box"))
    return lines.join(f, page_keys).where(mostly_inside(F.col("bbox"), F.col("__box"))).select(*page_keys, "idx", "figure_id")


def nearest_above(links: DataFrame, anchors: DataFrame, page_keys: list[str], link_id: str, anchor_id: str) -> DataFrame:
    """Each link with the lowest anchor that starts at or above it in its column (J24): a union and a running last value."""
    both = links.select(*page_keys, "column", "y", F.col(link_id).alias("__l"), F.lit(None).cast("bigint").alias("__a")).unionByName(
        anchors.select(*page_keys, "column", "y", F.lit(None).cast("bigint").alias("__l"), F.col(anchor_id).cast("bigint").alias("__a")))
    w = Window.partitionBy(*page_keys, "column").orderBy(F.desc("y"), F.col("__l").isNotNull(), "__a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(anchor_id, F.last("__a", ignorenulls=True).over(w)).where("__l is not null").select(F.col("__l").alias(link_id), anchor_id)


def subtract_ranges(a: Column, b: Column) -> Column:
    """Parts of the ranges a (array of struct lo, hi; hi exclusive) outside the sorted ranges b."""
    def cut(rs: Column, x: Column) -> Column:
        return F.flatten(F.transform(rs, lambda r: F.filter(F.array(
            F.struct(r["lo"].alias("lo"), F.least(r["hi"], x["lo"]).alias("hi")), F.struct(F.greatest(r["lo"], x["hi"]).alias("lo"), r["hi"].alias("hi"))), lambda p: p["lo"] < p["hi"])))
    return F.aggregate(b, a, cut)


def mask_ranges(text: Column, ranges: Column) -> Column:
    """Characters of the ranges (start from 0, length) as blanks."""
    return F.aggregate(ranges, text, lambda s, r: F.overlay(s, F.repeat(F.lit(" "), r["n"]), r["start"] + 1, r["n"]))
