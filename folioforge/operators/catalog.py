"""Library catalogues in entity-attribute-value form, evidence on pages, metadata by priority."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_fields(item_data: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """(itemID, fields map) from itemData, fields and itemDataValues (J05); the first value of a repeated field by its id."""
    j = item_data.join(fields.select("fieldID", "fieldName"), "fieldID").join(values.select("valueID", "value"), "valueID")
    one = j.groupBy("itemID", "fieldName").agg(F.min_by("value", "valueID").alias("value"))
    return one.groupBy("itemID").agg(F.map_from_entries(F.collect_list(F.struct("fieldName", "value"))).alias("fields"))


def item_creators(item_creators_: DataFrame, creators: DataFrame, types: DataFrame) -> DataFrame:
    """(itemID, creators in order) with their type, if known."""
    j = item_creators_.join(creators, "creatorID").join(types, "creatorTypeID", "left")
    s = F.array_sort(F.collect_list(F.struct("orderIndex", "lastName", "firstName", "creatorType")))
    return j.groupBy("itemID").agg(F.transform(s, lambda x: F.struct(x["lastName"].alias("last"), x["firstName"].alias("first"), x["creatorType"].alias("kind"))).alias("creators"))


def live_items(items: DataFrame, deleted: DataFrame, types: DataFrame, leave_out: tuple[str, ...] = ("attachment", "note", "annotation")) -> DataFrame:
    """Items not in the trash and not of the left-out types."""
    return items.join(types, "itemTypeID").where(~F.col("typeName").isin(*leave_out)).join(deleted.select("itemID"), "itemID", "left_anti")


def live_attachments(items: DataFrame, attachments: DataFrame, deleted: DataFrame) -> DataFrame:
    """Attachments with a parent, neither in the trash."""
    gone = deleted.select("itemID")
    a = attachments.where("parentItemID is not null").join(items.select("itemID"), "itemID").join(gone, "itemID", "left_anti")
    return a.join(gone.withColumnRenamed("itemID", "parentItemID"), "parentItemID", "left_anti")


def memberships(bridge: DataFrame, collections: DataFrame) -> DataFrame:
    """(itemID, names of its collections, sorted)."""
    return bridge.join(collections, "collectionID").groupBy("itemID").agg(F.array_sort(F.collect_set("collectionName")).alias("collections"))


def record_of(fields: Column) -> Column:
    """struct(title, venue, doi, year, url) from a map of fields (X111)."""
    f = lambda *names: F.coalesce(*[F.element_at(fields, n) for n in names])
    return F.struct(f("title", "caseName", "subject").alias("title"), f("publicationTitle", "proceedingsTitle", "bookTitle", "repository").alias("venue"), F.lower(f("DOI")).alias("doi"),
                    F.nullif(F.regexp_extract(f("date"), "((?:18|19|20)[0-9]{2})", 1), F.lit("")).cast("int").alias("year"), f("url").alias("url"))


def unique_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """The first link of each page, URI and rectangle; -0 and +0 are equal."""
    box = [(F.col(c) + F.lit(0.0)).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")]
    x = links.select("*", *box)
    cols = [c for c in links.columns if c not in (*keys, "uri")]
    return x.groupBy(*keys, "uri", "__x0", "__y0", "__x1", "__y1").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select(*keys, "uri", "r.*")


def nearest_caption(boxes: DataFrame, captions: DataFrame, page_keys: list[str], reach: float) -> DataFrame:
    """Each figure box with the kind of the nearest caption that overlaps it sideways within reach."""
    j = boxes.alias("b").join(captions.alias("c"), page_keys).where("b.x0 < c.x1 and c.x0 < b.x1")
    d = F.greatest(F.col("b.y0") - F.col("c.y1"), F.col("c.y0") - F.col("b.y1"), F.lit(0.0))
    return j.withColumn("__d", d).where(F.col("__d") <= reach).groupBy(*page_keys, "box_id").agg(F.min_by("kind", F.struct("__d", "caption_id")).alias("kind"))


def script_targets(scripts: DataFrame, lines: DataFrame, page_keys: list[str], up: float = 0.8, down: float = 0.5) -> DataFrame:
    """Each small fragment with the line whose baseline lies in its window, the nearest (J25, J26); joined by page and height band."""
    band = lambda y: F.floor(y / 20).cast("bigint")
    s = scripts.select(*page_keys, "script_id", F.col("x0").alias("sx"), F.col("y0").alias("sy")).withColumn("__b", F.explode(F.array(band(F.col("sy")) - 1, band(F.col("sy")), band(F.col("sy")) + 1)))
    ln = lines.select(*page_keys, "line_id", "x0", "x1", "y0", "size").withColumn("__b", band(F.col("y0")))
    j = s.join(ln, [*page_keys, "__b"]).where((F.col("sy") - F.col("y0")).between(-F.col("size") * down, F.col("size") * up) & (F.col("sx") >= F.col("x0")) & (F.col("sx") <= F.col("x1") + F.col("size")))
    return j.groupBy(*page_keys, "script_id").agg(F.min_by("line_id", F.struct(F.abs(F.col("sy") - F.col("y0")), "line_id")).alias("line_id"))


def pair_labels(labels: DataFrame, lines: DataFrame, page_keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """Detached labels and entry lines on one baseline, each used once: mutual first by distance."""
    j = labels.alias("l").join(lines.alias("t"), page_keys).where(F.abs(F.col("l.y0") - F.col("t.y0")) <= tolerance).where("t.x0 > l.x0").select(*page_keys, "label_id", "line_id", F.abs(F.col("l.y0") - F.col("t.y0")).alias("d"))
    a = Window.partitionBy("label_id").orderBy("d", "line_id")
    b = Window.partitionBy("line_id").orderBy("d", "label_id")
    return j.withColumn("ra", F.row_number().over(a)).withColumn("rb", F.row_number().over(b)).where("ra = 1 and rb = 1").select(*page_keys, "label_id", "line_id")


def carried_heads(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Pages that end in an open [ or ( group, with its completion at the next page's start."""
    w = Window.partitionBy(doc).orderBy(page)
    x = pages.select(doc, page, F.regexp_extract(text, r"([\[(][^\])]*)$", 1).alias("open"), F.lead(F.regexp_extract(text, r"^([^\[(]*?[\])])", 1)).over(w).alias("rest"))
    return x.where("open != '' and rest != ''").select(doc, page, F.concat_ws(" ", "open", "rest").alias("group"))


def line_joins(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Pairs of consecutive lines of which the first ends in a hyphen (W07): (doc, order, left, right)."""
    w = Window.partitionBy(doc).orderBy(order)
    x = lines.select(doc, order, F.regexp_extract(text, r"(\p{L}+)[-¬‐]\s*$", 1).alias("left"), F.lead(F.regexp_extract(text, r"^\s*(\p{L}+)", 1)).over(w).alias("right"))
    return x.where("left != '' and right != ''")


def bare_runs(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Runs of lines that are consecutive bare numbers from 1 on (W10): (doc, first, n)."""
    n = F.regexp_extract(text, r"^\s*([0-9]{1,4})[.)]?\s*$", 1).try_cast("int")
    x = lines.select(doc, order, n.alias("n")).where("n is not null")
    w = Window.partitionBy(doc).orderBy(order)
    x = x.withColumn("island", F.row_number().over(w) - F.col("n"))
    return x.groupBy(doc, "island").agg(F.min("n").alias("first"), F.count("*").alias("n"), F.min(order).alias(order)).where("first = 1 and n >= 3").drop("island")


def sections(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Numbered headings with the one that follows (W14): (doc, order, number, heading, next)."""
    w = Window.partitionBy(doc).orderBy(order)
    h = lines.select(doc, order, F.regexp_extract(text, r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+\p{Lu}", 1).alias("number"), F.trim(F.regexp_extract(text, r"^\s*[0-9.]+\s+(\p{Lu}.{2,80})$", 1)).alias("heading")).where("number != '' and heading != ''")
    return h.withColumn("next", F.lead("heading").over(w))


def carried_state(pages: DataFrame, doc: str, page: str, state: str) -> DataFrame:
    """Each page with the last known state of the pages before."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("carried", F.last(state, ignorenulls=True).over(w))


def prioritised(candidates: DataFrame, key: str) -> DataFrame:
    """Best value of each field by source priority with its provenance (D23): (key, field, value, source).

    ``candidates`` is (key, field, value, source, priority, pos); null and blank values don't count.
    """
    c = candidates.where("value is not null and trim(value) != ''")
    return c.groupBy(key, "field").agg(F.min_by(F.struct("value", "source"), F.struct("priority", "pos")).alias("b")).select(key, "field", "b.value", "b.source")


def better_result(a: DataFrame, b: DataFrame, key: str, quality: list[str]) -> DataFrame:
    """The row of each key with the better quality tuple, a's where they are equal."""
    q = lambda p: F.struct(*[F.col(f"{p}.{c}") for c in quality])
    j = a.alias("a").join(b.alias("b"), key, "full_outer")
    take_b = F.col(f"a.{quality[0]}").isNull() | (q("b") > q("a"))
    cols = [c for c in a.columns if c != key]
    return j.select(key, *[F.when(F.coalesce(take_b, F.lit(False)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in cols])


def append_documents(parts: list[DataFrame], key: str, flag: str, methods: str) -> DataFrame:
    """Union of partial results: flags OR-ed, method lists concatenated once each."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.bool_or(flag).alias(flag), F.array_sort(F.array_distinct(F.flatten(F.collect_list(methods)))).alias(methods))
