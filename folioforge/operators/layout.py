"""Roles of printed lines and cleaned pages (D03, D07 to D22), page-one metadata (D24 to D26), list bodies.

Lines are rows (hash, page, idx, text, x0, y0, x1, y1, size, role) with y growing upwards and idx in reading order;
page facts (width, height, rotation) are columns of the lines. What depends on the order inside a page runs over one page a
group, which no corpus makes larger; everything else is windows and joins.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import ids, lines as N, text as T

#: Lines shorter than this many are no code listing; lines a footnote run, an abstract or a front block has at most.
CODE_MIN, FOOTNOTE_MOST, ABSTRACT_MOST, BLOCK_MOST, AUTHOR_MOST = 3, 12, 60, 12, 20
#: A footnote's size and zone, a title's zone and margin over the median size, a region's widest gap, in body sizes or page heights.
SMALL, ZONE, TITLE_ZONE, LARGER, GAP = 0.92, 0.35, 0.4, 0.5, 2.5
ABSTRACT = r"^(?i:abstract|summary)\s*(?:[—–:.-]+\s*|$)(.*)$"
SECTION = r"^(?:(?:[0-9IVX]{1,4}\.?\s+)?(?i:introduction|background|methods?|related work|references|acknowledg\w+|conclusions?|results)\s*$|[0-9]{1,2}(?:\.[0-9]{1,2}){0,3}\.?\s+\p{Lu}.{2,80}$)"
KEYWORDS = r"^(?i:key\s?words?|index terms|ccs concepts)\b"
FRONT = r"^(?i:key\s?words?|index terms|ccs concepts|acm reference format|corresponding author|contact|received|©|copyright|this work is licensed|permission to make)\b"
CAPTION = r"^\s*(Figure|Fig\.|Table|Scheme|Plate|Algorithm)\s+[0-9IVX]+\s*(?:[.:]|\(continued\)|$)"
BIOGRAPHY = r"^(?:\p{Lu}[\p{L}.’'-]+\s+){1,4}(?:\([^)]*\)\s+)?(?:received|is\s+(?:a|an|the|with|currently)|was\s+born|obtained|joined)\b"
FOOTNOTE_START = r"^\s*(?:[0-9]{1,2}|[*†‡§¶∗]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+)\s*\S"


# ---- page-one metadata -----------------------------------------------------------------------------
def title_block(lines: DataFrame, doc: str = "hash") -> DataFrame:
    """(doc, title, last): the first run of lines set in the largest size in the upper part of page 1.

    No title if the largest size isn't larger than the median one.
    """
    p = lines.where("page = 1 and trim(text) != ''")
    usable = (F.length(F.trim("text")) >= 3) & F.col("text").rlike(r"\p{L}") & (F.col("y1") >= F.col("height") * TITLE_ZONE) & F.col("size").isNotNull()
    w = Window.partitionBy(doc)
    p = p.withColumn("top", F.max(F.when(usable, F.col("size"))).over(w)).withColumn("mid", F.percentile("size", 0.5).over(w)).where(F.col("top") >= F.col("mid") + LARGER)
    p = p.withColumn("big", (F.col("size") >= F.col("top") - LARGER) & F.col("text").rlike(r"\p{L}"))
    o = w.orderBy("idx")
    p = p.withColumn("first", F.min(F.when(usable & F.col("big"), F.col("idx"))).over(w)).where(F.col("idx") >= F.col("first"))
    p = p.withColumn("breaks", F.sum((~F.coalesce("big", F.lit(False))).cast("int")).over(o)).where("breaks = 0")
    t = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.trim(x["text"]))
    return p.groupBy(doc).agg(T.collapse(F.array_join(t, " ")).alias("title"), F.max("idx").alias("last"))


def page1_authors(lines: DataFrame, doc: str = "hash") -> DataFrame:
    """(doc, authors): names of the lines between the title and the abstract that hold person names only."""
    p = lines.where("page = 1").join(title_block(lines, doc).select(doc, "last"), doc).where(F.col("idx") > F.col("last"))
    stop = F.min(F.when(F.col("text").rlike(ABSTRACT) | F.col("text").rlike(SECTION) | F.col("text").rlike(KEYWORDS), F.col("idx"))).over(Window.partitionBy(doc))
    p = p.withColumn("stop", stop).where((F.col("stop").isNull() | (F.col("idx") < F.col("stop"))) & (F.col("idx") <= F.col("last") + AUTHOR_MOST))
    clean = F.regexp_replace(F.col("text"), r"[⁰¹²³⁴⁵⁶⁷⁸⁹*†‡§¶∗]|(?<=\p{L})[0-9]+(?:,[0-9]+)*", "")
    names = F.filter(F.transform(F.split(clean, r"\s*(?:,\s*(?:and\s+)?|;|·|&|\band\b)\s*"), lambda x: T.collapse(x)), lambda x: x != "")
    p = p.where(~N.has_affiliation_signal("text") & (F.length("text") <= 300)).withColumn("names", names)
    p = p.where((F.size("names") > 0) & F.forall("names", lambda x: ids.looks_like_person(x)))
    return p.groupBy(doc).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "names"))), lambda x: x["names"])).alias("authors"))


def page1_abstract(lines: DataFrame, doc: str = "hash") -> DataFrame:
    """(doc, abstract): what follows the abstract's heading up to the next heading or the keywords."""
    p = lines.where("page = 1")
    w = Window.partitionBy(doc)
    p = p.withColumn("start", F.min(F.when(F.trim("text").rlike(ABSTRACT), F.col("idx"))).over(w)).where("idx >= start")
    ends = (F.col("idx") > F.col("start")) & (F.trim("text").rlike(SECTION) | F.trim("text").rlike(KEYWORDS))
    p = p.withColumn("stop", F.min(F.when(ends, F.col("idx"))).over(w)).where((F.col("stop").isNull() | (F.col("idx") < F.col("stop"))) & (F.col("idx") <= F.col("start") + ABSTRACT_MOST))
    part = F.when(F.col("idx") == F.col("start"), F.regexp_extract(F.trim("text"), ABSTRACT, 1)).otherwise(F.trim("text"))
    t = F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("t")))), lambda x: x["t"])
    return p.groupBy(doc).agg(F.nullif(T.collapse(F.array_join(t, " ")), F.lit("")).alias("abstract")).where("abstract is not null")


# ---- roles of a page -------------------------------------------------------------------------------
def _kind(text: str) -> str | None:
    m = re.match(CAPTION.replace(r"\p{L}", "[^\\W\\d_]"), text or "")
    return None if not m else "table" if m.group(1) == "Table" else "algorithm" if m.group(1) == "Algorithm" else "figure"


def _prose(text: str) -> bool:
    words = text.split()
    return len(words) >= 6 and sum(bool(re.fullmatch(r"[a-z]{2,}[,;]?", w)) for w in words) * 2 >= len(words)


def _mathy(text: str) -> bool:
    s = re.sub(r"\s", "", text)
    return bool(s) and sum(not c.isalpha() for c in s) * 2 > len(s) and any(c in "=+<>≤≥±×÷∑∫√∂∞≈∝∈∀∃→←−^|" for c in s)


def region_of(rows: list[dict], pos: int, kind: str, body: float) -> list[int]:
    """Lines that belong to a caption: the unbroken run of lines that aren't prose, below a table's caption, above a figure's."""
    step = 1 if kind in ("table", "algorithm") else -1
    out, at, last = [], pos + step, rows[pos]
    while 0 <= at < len(rows):
        r = rows[at]
        gap = last["y0"] - r["y1"] if step > 0 else r["y0"] - last["y1"]
        if r["role"] != "body" or _prose(r["text"]) or gap > GAP * body or r["x1"] < rows[pos]["x0"] or r["x0"] > rows[pos]["x1"]:
            break
        out.append(at)
        last, at = r, at + step
    return out


def column_rows(rows: list[dict], body: float) -> list[int]:
    """Lines of a table without a caption: three or more successive lines whose cells start at the same places."""
    starts = [tuple(m.start() for m in re.finditer(r"(?:(?<=\s\s)|(?<=\t)|^)\S", r["text"])) for r in rows]
    out, run = [], []
    for k in range(len(rows)):
        cells = starts[k]
        same = run and sum(any(abs(a - b) <= 1 for b in starts[run[-1]]) for a in cells) * 2 >= max(len(cells), len(starts[run[-1]]))
        if rows[k]["role"] == "body" and len(cells) >= 2 and (not run or same):
            run.append(k)
            continue
        out += run if len(run) >= 3 else []
        run = [k] if rows[k]["role"] == "body" and len(cells) >= 2 else []
    return out + (run if len(run) >= 3 else [])


def tag_page(rows: list[dict], rules: list[tuple[float, float, float, float]] = ()) -> list[str]:
    """Roles of a page's lines in reading order (D09 to D22); a line keeps the first role that is found for it.

    ``rules`` are the boxes of drawn horizontal lines.
    """
    rows = [dict(r, role=r.get("role") or "body", text=r["text"] or "") for r in rows]
    if not rows:
        return []
    height, page = rows[0].get("height") or 0.0, rows[0].get("page") or 0
    sizes = sorted(r["size"] for r in rows if r.get("size"))
    body = sizes[len(sizes) // 2] if sizes else 10.0

    def tag(at: list[int], role: str) -> None:
        for k in at:
            if rows[k]["role"] == "body":
                rows[k]["role"] = role

    if page == 1:  # front matter: blocks with their opening line, lettered affiliations (D09, D10)
        intro = next((k for k, r in enumerate(rows) if re.match(r"(?i)^(?:[0-9I]\.?\s+)?(?:introduction|abstract)\b", r["text"].strip())), None)
        block = 0
        for k, r in enumerate(rows):
            text = r["text"].strip()
            if re.match(FRONT.replace(r"\b", r"(?:\b|(?<=©))"), text):
                tag([k], "front")
                block = 0 if text.endswith(".") else BLOCK_MOST
            elif re.match(r"^[a-h] \S+.*,.*,", text) and any(s in text for s in N.AFFILIATION_SIGNALS) or intro is not None and k < intro and any(s in text for s in N.AFFILIATION_SIGNALS):
                tag([k], "front")
                block = 0
            elif block and text and not re.match(r"(?i)^(?:[0-9I]\.?\s+)?(?:introduction|abstract)\b", text) and not re.match(r"^[0-9]+\.?\s+[A-Z]", text):
                tag([k], "front")
                block = 0 if text.endswith(".") else block - 1
            else:
                block = 0
    if rows[0].get("rotation"):  # a page on its side is a table if it carries a table's label (D15)
        if any(_kind(r["text"]) == "table" for r in rows):
            tag([k for k, r in enumerate(rows) if _kind(r["text"]) is None], "table")
        tag([k for k, r in enumerate(rows) if _kind(r["text"])], "caption")
        return [r["role"] for r in rows]
    # footnotes: the lowest run of small lines under the body, from its first mark on (D20), and what stands under a short rule
    low = []
    for k in reversed(range(len(rows))):
        r = rows[k]
        if r["role"] == "furniture":
            continue
        if r.get("size") and r["size"] <= SMALL * body and height and (r["y0"] + r["y1"]) / 2 <= ZONE * height and r["role"] == "body":
            low.append(k)
            continue
        break
    low.reverse()
    first = next((i for i, k in enumerate(low) if re.match(FOOTNOTE_START, rows[k]["text"])), None)
    if first is not None and len(low) <= FOOTNOTE_MOST and len(low) < len(rows):
        tag(low[first:], "footnote")
    for x0, y0, x1, y1 in rules:
        under = [k for k, r in enumerate(rows) if r["y1"] <= y0 and r["x0"] < x1 + 5 * (x1 - x0) and r["x1"] > x0]
        if height and y1 <= ZONE * height and under and re.match(FOOTNOTE_START, rows[under[0]]["text"]) and len(under) <= FOOTNOTE_MOST:
            tag(under, "footnote")
    # captions, their continuations, and the regions beside them
    for k, r in enumerate(rows):
        kind = _kind(r["text"]) if r["role"] == "body" else None
        if kind is None:
            continue
        rows[k]["role"] = "caption"
        end = k
        if not r["text"].rstrip().endswith((".", ")")):
            while end + 1 < len(rows) and rows[end + 1]["role"] == "body" and rows[end]["y0"] - rows[end + 1]["y1"] < 0.6 * body and abs(rows[end + 1]["size"] - r["size"]) < 0.1 and not rows[end]["text"].rstrip().endswith("."):
                end += 1
                rows[end]["role"] = "caption"
        tag(region_of(rows, end if kind in ("table", "algorithm") else k, kind, body), kind)
    # tables between two wide rules (D17), column-aligned ones
    wide = sorted(((x0, y0, x1, y1) for x0, y0, x1, y1 in rules if x1 - x0 > 8 * body), key=lambda b: -b[1])
    for a, b in zip(wide, wide[1:]):
        inside = [k for k, r in enumerate(rows) if b[3] <= r["y0"] and r["y1"] <= a[1] and r["x0"] >= a[0] - body and r["x1"] <= a[2] + body]
        if inside and not any(_prose(rows[k]["text"]) for k in inside):
            tag(inside, "table")
    tag(column_rows(rows, body), "table")
    # code listings: runs of lines set in a monospace font (D22); display maths
    run: list[int] = []
    for k, r in enumerate([*rows, {"mono": False, "role": "body"}]):
        if k < len(rows) and r["role"] == "furniture":
            continue
        if r.get("mono") and r["role"] == "body":
            run.append(k)
            continue
        if len(run) >= CODE_MIN:
            tag(run, "code")
        run = []
    tag([k for k, r in enumerate(rows) if _mathy(r["text"])], "math")
    # labels of figures: short lone lines beside one another, near a figure's region
    near = {k + d for k, r in enumerate(rows) if r["role"] == "figure" for d in (-1, 1)}
    tag([k for k in near if 0 <= k < len(rows) and len(rows[k]["text"].split()) <= 3 and not rows[k]["text"].rstrip().endswith(".")], "figure")
    return [r["role"] for r in rows]


def tag_pages(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``lines`` with their role (D13). ``mono`` tells a line set in a monospace font; ``rules`` is (hash, page, x0, y0, x1, y1)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in lines.dtypes)

    def page(p: pd.DataFrame, r: pd.DataFrame | None = None) -> pd.DataFrame:
        p = p.sort_values("idx", kind="mergesort").reset_index(drop=True)
        boxes = [] if r is None else list(r[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        p["role"] = tag_page(p.to_dict("records"), boxes)
        return p

    if rules is None:
        return lines.groupBy("hash", "page").applyInPandas(lambda p: page(p), schema)
    return lines.groupBy("hash", "page").cogroup(rules.groupBy("hash", "page")).applyInPandas(lambda a, b: page(a, b) if len(a) else a, schema)


def tag_biographies(lines: DataFrame) -> DataFrame:
    """Lines of authors' biographies behind the reference list: from one that begins like a biography on."""
    from folioforge.operators.documents import HEADINGS
    w = Window.partitionBy("hash").orderBy("page", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = lines.withColumn("__refs", F.max(F.trim("text").rlike(HEADINGS).cast("int")).over(w))
    x = x.withColumn("__bio", F.max(((F.col("__refs") == 1) & F.col("text").rlike(BIOGRAPHY)).cast("int")).over(w))
    return x.withColumn("role", F.when((F.col("__bio") == 1) & (F.col("role") == "body"), "biography").otherwise(F.col("role"))).drop("__refs", "__bio")


# ---- cleaning --------------------------------------------------------------------------------------
def split_fused(lines: DataFrame, gap: str = r"\s{6,}") -> DataFrame:
    """Lines fused across the gutter as two: where a wide blank stands at the middle of the page."""
    parts = F.split(F.trim("text"), gap)
    share = (F.col("width") / 2 - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6))
    first, all_ = F.length(F.get(parts, F.lit(0))), F.length(F.trim("text"))
    at = (first + all_ - F.coalesce(F.length(F.get(parts, F.lit(1))), F.lit(0))) / 2 / F.greatest(all_, F.lit(1))
    fused = (F.size(parts) == 2) & (F.col("x0") < F.col("width") / 2) & (F.col("x1") > F.col("width") / 2) & (F.abs(share - at) < 0.15)
    x = lines.select("*", F.posexplode(F.when(fused, parts).otherwise(F.array("text"))).alias("__half", "__part")).withColumn("__fused", fused)
    mid = F.col("width") / 2
    return x.withColumn("text", F.col("__part")).withColumn("x1", F.when(F.col("__fused") & (F.col("__half") == 0), mid).otherwise(F.col("x1"))).withColumn(
        "x0", F.when(F.col("__fused") & (F.col("__half") == 1), mid).otherwise(F.col("x0"))).withColumn("column", F.col("__half")).drop("__half", "__part", "__fused")


def merge_scripts(lines: DataFrame, scripts: DataFrame) -> DataFrame:
    """Lines with their raised fragments put in as superscript characters at the end of the word before.

    ``scripts`` is (hash, page, script_id, text, x0, y0); each goes to the line of its baseline.
    """
    from folioforge.operators.catalog import script_targets
    keys = ["hash", "page"]
    t = script_targets(scripts, lines.withColumn("line_id", F.col("idx")), keys)
    s = t.join(scripts.select(*keys, "script_id", F.col("text").alias("s_text"), F.col("x0").alias("s_x")), [*keys, "script_id"])
    add = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_x", T.script_form("s_text").alias("t")))), lambda x: x["t"]), "")
    s = s.groupBy(*keys, F.col("line_id").alias("idx")).agg(add.alias("__add"))
    return lines.join(s, [*keys, "idx"], "left").withColumn("text", F.concat("text", F.coalesce("__add", F.lit("")))).drop("__add")


def clean_pages(lines: DataFrame, least_pages: int = 3) -> DataFrame:
    """(hash, page, text): pages without stamps, furniture and broken words, in reading order.

    Furniture is a line in the edge band whose wording without digits stands on ``least_pages`` pages, or a page number.
    """
    edge = N.in_edge_band("y0", "y1", "height", "rotation", 0.1)
    x = lines.withColumn("__k", F.when(edge, T.digit_key("text"))).withColumn("__stamp", N.is_stamp("text"))
    seen = x.where("__k is not null").groupBy("hash", "__k").agg(F.count_distinct("page").alias("__n"))
    x = x.join(seen, ["hash", "__k"], "left").where(~F.col("__stamp") & ~(F.coalesce("__n", F.lit(0)) >= least_pages) & ~(edge & T.is_page_number("text")))
    t = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: r["text"])
    return x.groupBy("hash", "page").agg(F.regexp_replace(F.array_join(t, "\n"), r"(\p{Ll})[-¬‐]\n(\p{Ll})", "$1$2").alias("text"))


# ---- reference lists -------------------------------------------------------------------------------
def headingless_section(lines: DataFrame, by: str = "hash") -> DataFrame:
    """(by, page, idx): where a list [1] [2] [3] begins without a heading."""
    n = lines.withColumn("n", F.regexp_extract("text", r"^\s*\[([0-9]{1,3})\]", 1).try_cast("int")).where("n is not null")
    w = Window.partitionBy(by).orderBy("page", "idx")
    n = n.withColumn("b", F.lead("n", 1).over(w)).withColumn("c", F.lead("n", 2).over(w)).where("n = 1 and b = 2 and c = 3")
    return n.groupBy(by).agg(F.max(F.struct("page", "idx")).alias("at")).select(by, "at.page", "at.idx")


def list_body(lines: DataFrame, sections: DataFrame, by: str = "hash") -> DataFrame:
    """Lines of each list: behind its start up to the next section heading, furniture left out (D30). ``sections`` is (by, page, idx)."""
    from folioforge.operators.documents import HEADINGS
    s = sections.select(by, F.col("page").alias("__p"), F.col("idx").alias("__i"))
    after = (F.col("page") > F.col("__p")) | (F.col("page") == F.col("__p")) & (F.col("idx") > F.col("__i"))
    x = lines.join(s, by).where(after & (F.coalesce("role", F.lit("body")) != "furniture"))
    ends = (F.trim("text").rlike(SECTION) | F.trim("text").rlike(r"^(?i:appendix|supplementary)\b")) & ~F.trim("text").rlike(HEADINGS)
    w = Window.partitionBy(by, "__p", "__i").orderBy("page", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("__end", F.max(ends.cast("int")).over(w)).where("__end = 0").drop("__p", "__i", "__end")


def layout_starts(lines: DataFrame, by: list[str], tolerance: float = 4.0, hanging: float = 60.0, least_share: float = 0.25) -> DataFrame:
    """(by, page, idx, starts): whether a list's line begins an entry by its indent; null where the list has no hanging indents.

    Left edges within the tolerance of their neighbour are one level. A populated level begins entries unless another
    populated one stands to its left within a hanging indent; enough lines must be indented against such a level.
    """
    w = Window.partitionBy(*by).orderBy("x0")
    x = lines.where("x0 is not null").select(*by, "page", "idx", "x0", (F.col("x0") - F.lag("x0").over(w)).alias("d"))
    x = x.withColumn("level", F.sum(F.when(F.col("d") > tolerance, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = x.groupBy(*by).agg(F.count("*").alias("n"))
    lv = x.groupBy(*by, "level").agg(F.min("x0").alias("x"), F.count("*").alias("c")).join(n, by).withColumn("full", F.col("c") >= F.greatest(F.floor(F.col("n") / 20), F.lit(2)))
    o = lv.where("full").select(*[F.col(c).alias(f"o_{c}") for c in by], F.col("x").alias("ox"))
    same = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"o_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    left = lv.where("full").join(o, same & (F.col("x") > F.col("ox")) & (F.col("x") - F.col("ox") <= hanging)).select(*by, "level").distinct().withColumn("hangs", F.lit(True))
    lv = lv.join(left, [*by, "level"], "left").withColumn("hangs", F.coalesce("hangs", F.lit(False)))
    ok = lv.groupBy(*by).agg((F.sum(F.when(F.col("hangs"), F.col("c")).otherwise(0)) >= least_share * F.max("n")).alias("ok"))
    r = x.join(lv.select(*by, "level", "full", "hangs"), [*by, "level"]).join(ok, by)
    return r.select(*by, "page", "idx", F.when(F.col("ok"), F.col("full") & ~F.col("hangs")).alias("starts"))


def drop_foreign_columns(lines: DataFrame, by: list[str], reach: Column | float = 60.0) -> DataFrame:
    """Lines of a list without those that start far from where its lines start on that page."""
    at = lines.groupBy(*by, "page").agg(F.percentile("x0", 0.5).alias("__x"), F.min("x0").alias("__lo"))
    return lines.join(at, [*by, "page"]).where((F.col("x0") - F.col("__x") <= reach) & (F.col("__x") - F.col("x0") <= reach)).drop("__x", "__lo")


def union_links(a: DataFrame, b: DataFrame, frames: DataFrame) -> DataFrame:
    """Links of two readings of pages whose frames agree, each once (J32). ``frames`` is (hash, page, same)."""
    ok = frames.where("same").select("hash", "page")
    return a.unionByName(b.join(ok, ["hash", "page"], "left_semi")).distinct()
