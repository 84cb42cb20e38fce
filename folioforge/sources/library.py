"""A reference library's tables and landed answers (S27 to S31, A34, P12), TEI headers and references (S40), a LaTeX folder."""
from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.urls import link_header
from folioforge.operators import catalog as C


def library_items(tables: dict[str, DataFrame]) -> DataFrame:
    """(itemID, record, creators, collections) of the live items (S27, P12), from the library's own tables by their names."""
    live = C.live_items(tables["items"], tables["deletedItems"], tables["itemTypes"]).select("itemID")
    fields = C.item_fields(tables["itemData"], tables["fields"], tables["itemDataValues"])
    people = C.item_creators(tables["itemCreators"], tables["creators"], tables["creatorTypes"])
    groups = C.memberships(tables["collectionItems"], tables["collections"])
    return live.join(fields, "itemID", "left").join(people, "itemID", "left").join(groups, "itemID", "left").select("itemID", C.record_of(F.col("fields")).alias("record"), "creators", "collections")


def library_collections(collections: DataFrame) -> DataFrame:
    """Collections with the name of their parent."""
    parent = collections.select(F.col("collectionID").alias("parentCollectionID"), F.col("collectionName").alias("parent"))
    return collections.join(parent, "parentCollectionID", "left").select("collectionID", "collectionName", "parent")


_ITEM = "array<struct<key:string,version:bigint,data:struct<itemType:string,title:string,date:string,DOI:string,creators:array<struct<creatorType:string,firstName:string,lastName:string>>>>>"


def items_page(answers: DataFrame, body: str = "body", total: str = "total", link: str = "link") -> DataFrame:
    """(page, total, next, key, version, title, doi, kind) of landed item pages with their headers."""
    x = answers.select("page", F.col(total).try_cast("bigint").alias("total"), F.element_at(link_header(link), "next").alias("next"), F.explode_outer(F.from_json(body, _ITEM)).alias("i"))
    return x.select("page", "total", "next", "i.key", "i.version", "i.data.title", F.lower("i.data.DOI").alias("doi"), F.col("i.data.itemType").alias("kind"))


def collections_page(answers: DataFrame, body: str = "body") -> DataFrame:
    """(key, name, parent) of landed collections; a top-level one has the parent false."""
    x = answers.select(F.explode(F.from_json(body, "array<struct<key:string,data:struct<name:string,parentCollection:string>>>")).alias("c"))
    return x.select("c.key", "c.data.name", F.nullif(F.col("c.data.parentCollection"), F.lit("false")).alias("parent"))


def write_result(answers: DataFrame, body: str = "body") -> DataFrame:
    """(page, idx, outcome, detail) of a batch write's answer: success, unchanged or failed by index."""
    parse = lambda k: F.map_entries(F.coalesce(F.from_json(F.get_json_object(body, f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    tag = lambda k: F.transform(parse(k), lambda e: F.struct(e["key"].cast("int").alias("idx"), F.lit(k).alias("outcome"), e["value"].alias("detail")))
    return answers.select("page", F.explode(F.concat(tag("success"), tag("unchanged"), tag("failed"))).alias("r")).select("page", "r.*")


def parse_tei(xml: str | None, limit: int | None = None) -> list[tuple]:
    """(idx, title, year, doi, authors, raw) of a TEI document: its header as idx 0, then its references."""
    if not xml or "<!DOCTYPE" in xml[:4096]:
        return []
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    ns = {"t": root.tag[1:].split("}")[0]} if root.tag.startswith("{") else {"t": ""}
    p = "t:" if ns["t"] else ""

    def text(node, path: str) -> str | None:
        x = node.find(path.replace("/", "/" + p).replace("./" + p + "/", ".//"), ns) if node is not None else None
        return " ".join("".join(x.itertext()).split()) or None if x is not None else None

    def one(node, idx: int) -> tuple:
        find = lambda tag, **kv: next((x for x in node.iter(f"{{{ns['t']}}}{tag}" if p else tag) if all(x.get(k) == v for k, v in kv.items())), None)
        flat = lambda x: " ".join("".join(x.itertext()).split()) or None if x is not None else None
        date = find("date")
        year = (date.get("when") or "")[:4] if date is not None else ""
        doi = find("idno", type="DOI")
        people = [" ".join(" ".join(n.itertext()).split()) for n in node.iter(f"{{{ns['t']}}}persName" if p else "persName")]
        note = find("note", type="raw_reference")
        return idx, flat(find("title", level="a")) or flat(find("title")), int(year) if year.isdigit() else None, (flat(doi) or "").lower() or None, people, flat(note)

    q = (lambda t: f"{{{ns['t']}}}{t}") if p else (lambda t: t)
    head = next(root.iter(q("teiHeader")), None)
    out = [one(head, 0)] if head is not None else []
    lists = next(root.iter(q("listBibl")), None)
    refs = list(lists.iter(q("biblStruct"))) if lists is not None else []
    return out + [one(x, k) for k, x in enumerate(refs[:limit], 1)]


def tei(df: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, idx, title, year, doi, authors, raw) of TEI documents; a document that can't be read gives no row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, x in zip(b[key], b[xml]) for r in parse_tei(x)]
            yield pd.DataFrame(rows, columns=[key, "idx", "title", "year", "doi", "authors", "raw"]).astype({"year": "Int32"})

    return df.select(key, xml).mapInPandas(run, f"`{key}` {kind}, idx int, title string, year int, doi string, authors array<string>, raw string")


def latex_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text) of all .tex, .bbl and .bib files below a folder."""
    x = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return x.withColumn("kind", F.lower(F.regexp_extract("path", r"\.(tex|bbl|bib)$", 1))).where("kind != ''").select("path", "kind", "text")
