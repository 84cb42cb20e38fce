"""Readers of landed files and parsers of landed API answers."""
from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "source string, source_id string, title string, authors array<string>, year int, venue string, doi string, abstract string, url string"


def snapshot(spark: SparkSession, path: str, glob: str = "*.pdf", max_bytes: int | None = None) -> DataFrame:
    """Files with their SHA-256 identity (S01 to S03): path, length, modificationTime, hash; larger ones are left out."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    return df.select("path", "length", "modificationTime", F.sha2("content", 256).alias("hash"), "content")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line stays as a row with its text in _bad."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file of one JSON document."""
    return spark.read.option("multiLine", True).json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files (S51): path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cookies(spark: SparkSession, path: str) -> DataFrame:
    """Netscape cookie files."""
    return spark.read.schema("domain string, include_subdomains string, path string, secure string, expires bigint, name string, value string").option("sep", "\t").option("comment", "#").csv(path)


def cookies_for(urls: DataFrame, jar: DataFrame, now: int) -> DataFrame:
    """Cookies that apply to each URL: not expired, domain, path and scheme fit (F39, F40, J19); longest path first."""
    from folioforge.functions.urls import host_of, host_suffixes
    u = urls.withColumn("host", host_of("url")).withColumn("upath", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)).withColumn("sfx", F.explode(host_suffixes(F.col("host"))))
    j = jar.where((F.col("expires") == 0) | (F.col("expires") > now)).withColumn("sfx", F.regexp_replace("domain", r"^\.", "")).withColumnRenamed("path", "cpath")
    ok = (F.col("host") == F.col("sfx")) | (F.col("include_subdomains") == "TRUE")
    ok = ok & F.when(F.col("upath") == "", "/").otherwise(F.col("upath")).startswith(F.col("cpath")) & ((F.col("secure") != "TRUE") | F.col("url").startswith("https"))
    return u.join(j, "sfx").where(ok).select("url", "name", "value", "cpath", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("url").orderBy(F.desc(F.length("cpath")), "name")).alias("pos"))


def unpack(df: DataFrame, max_members: int = 10_000) -> DataFrame:
    """(path, member, content, error) of gzip, tar and zip files; absolute and parent paths give an error row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    raw = bytes(data)
                    if raw[:2] == b"\x1f\x8b":
                        raw = gzip.decompress(raw)
                    if raw[:4] == b"PK\x03\x04":
                        z = zipfile.ZipFile(io.BytesIO(raw))
                        members = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                    elif raw[257:262] == b"ustar":
                        t = tarfile.open(fileobj=io.BytesIO(raw))
                        members = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                    else:
                        members = [(None, raw)]
                    if len(members) > max_members:
                        rows.append((path, None, None, f"more than {max_members} members"))
                        continue
                    for name, content in members:
                        bad = name is not None and (name.startswith("/") or ".." in name.split("/"))
                        rows.append((path, name, None if bad else content, "path outside the archive" if bad else None))
                except Exception as e:  # a bad file is a row, not the end of the job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def _year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def crossref(df: DataFrame, body: str = "body") -> DataFrame:
    """Records of Crossref /works answers."""
    s = "message struct<items array<struct<DOI string, title array<string>, author array<struct<given string, family string, name string>>, issued struct<`date-parts` array<array<int>>>, `container-title` array<string>, abstract string, URL string>>>"
    i = df.select(F.explode(F.from_json(body, s)["message"]["items"]).alias("i"))
    name = F.transform("i.author", lambda a: F.coalesce(F.nullif(F.concat_ws(" ", a["given"], a["family"]), F.lit("")), a["name"]))
    return i.select(F.lit("crossref").alias("source"), F.col("i.DOI").alias("source_id"), F.get("i.title", F.lit(0)).alias("title"), name.alias("authors"), F.get(F.get("i.issued.date-parts", F.lit(0)), F.lit(0)).alias("year"),
                    F.get("i.container-title", F.lit(0)).alias("venue"), F.lower("i.DOI").alias("doi"), F.trim(F.regexp_replace("i.abstract", "<[^>]*>", " ")).alias("abstract"), F.col("i.URL").alias("url"))


def abstract_from_index(c: Column) -> Column:
    """Text from an inverted index of words and positions."""
    pos = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pos), lambda x: x["w"]), " ")


def openalex(df: DataFrame, body: str = "body") -> DataFrame:
    """Records of OpenAlex works answers."""
    s = "results array<struct<id string, doi string, title string, publication_year int, authorships array<struct<author struct<display_name string>>>, primary_location struct<source struct<display_name string>, landing_page_url string>, abstract_inverted_index map<string, array<int>>>>"
    i = df.select(F.explode(F.from_json(body, s)["results"]).alias("i"))
    return i.select(F.lit("openalex").alias("source"), F.col("i.id").alias("source_id"), F.col("i.title").alias("title"), F.transform("i.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("i.publication_year").alias("year"),
                    F.col("i.primary_location.source.display_name").alias("venue"), F.regexp_replace(F.lower("i.doi"), "^https?://doi.org/", "").alias("doi"), abstract_from_index(F.col("i.abstract_inverted_index")).alias("abstract"), F.col("i.primary_location.landing_page_url").alias("url"))


def semantic_scholar(df: DataFrame, body: str = "body") -> DataFrame:
    """Records of Semantic Scholar search answers."""
    s = "data array<struct<paperId string, title string, year int, venue string, abstract string, url string, authors array<struct<name string>>, externalIds struct<DOI string>>>"
    i = df.select(F.explode(F.from_json(body, s)["data"]).alias("i"))
    return i.select(F.lit("semantic_scholar").alias("source"), F.col("i.paperId").alias("source_id"), F.col("i.title").alias("title"), F.transform("i.authors", lambda a: a["name"]).alias("authors"), F.col("i.year").alias("year"), F.col("i.venue").alias("venue"),
                    F.lower("i.externalIds.DOI").alias("doi"), F.col("i.abstract").alias("abstract"), F.col("i.url").alias("url"))


def europepmc(df: DataFrame, body: str = "body") -> DataFrame:
    """Records of Europe PMC answers."""
    s = "resultList struct<result array<struct<id string, title string, authorString string, pubYear string, journalTitle string, doi string, abstractText string>>>"
    i = df.select(F.explode(F.from_json(body, s)["resultList"]["result"]).alias("i"))
    return i.select(F.lit("europepmc").alias("source"), F.col("i.id").alias("source_id"), F.col("i.title").alias("title"), F.filter(F.transform(F.split("i.authorString", ","), lambda a: F.trim(F.regexp_replace(a, r"\.$", ""))), lambda a: a != "").alias("authors"),
                    F.col("i.pubYear").cast("int").alias("year"), F.col("i.journalTitle").alias("venue"), F.lower("i.doi").alias("doi"), F.trim(F.regexp_replace("i.abstractText", "<[^>]*>", " ")).alias("abstract"), F.lit(None).cast("string").alias("url"))


def esearch_ids(df: DataFrame, body: str = "body") -> DataFrame:
    """Ids of an esearch answer in order."""
    return df.select(F.posexplode(F.from_json(body, "esearchresult struct<idlist array<string>>")["esearchresult"]["idlist"]).alias("pos", "id"))


def esummary(df: DataFrame, body: str = "body") -> DataFrame:
    """Records of an esummary answer, whose keys are the ids."""
    m = df.select(F.explode(F.from_json(F.get_json_object(body, "$.result"), "map<string,string>")).alias("k", "j")).where("k != 'uids'")
    r = m.select("k", F.from_json("j", "title string, pubdate string, source string, authors array<struct<name string>>, articleids array<struct<idtype string, value string>>").alias("r"))
    doi = F.get(F.transform(F.filter("r.articleids", lambda a: a["idtype"] == "doi"), lambda a: F.lower(a["value"])), F.lit(0))
    return r.select(F.lit("pmc").alias("source"), F.col("k").alias("source_id"), F.col("r.title").alias("title"), F.transform("r.authors", lambda a: a["name"]).alias("authors"), _year(F.col("r.pubdate")).alias("year"), F.col("r.source").alias("venue"), doi.alias("doi"),
                    F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("string").alias("url"))


def unpaywall(df: DataFrame, body: str = "body") -> DataFrame:
    """Full-text candidates of an Unpaywall answer (S39): doi, url, pdf_url, version."""
    s = "doi string, oa_locations array<struct<url string, url_for_pdf string, version string, host_type string>>"
    i = df.select(F.from_json(body, s).alias("r")).select(F.lower("r.doi").alias("doi"), F.explode("r.oa_locations").alias("l"))
    return i.select("doi", F.col("l.url").alias("url"), F.col("l.url_for_pdf").alias("pdf_url"), F.col("l.version").alias("version")).dropDuplicates(["doi", "url", "pdf_url"])


def feed(df: DataFrame, body: str = "body") -> DataFrame:
    """Entries of RSS feeds (S50): title, link, published."""
    s = "channel struct<item array<struct<title string, link string, pubDate string>>>"
    return df.select(F.explode(F.from_xml(F.col(body), s)["channel"]["item"]).alias("i")).select("i.title", "i.link", F.col("i.pubDate").alias("published"))


def jats_references(df: DataFrame, key: str = "pmcid", xml: str = "xml") -> DataFrame:
    """Reference rows of JATS articles in list order."""
    s = "back struct<`ref-list` struct<ref array<struct<_id string, label string, `mixed-citation` string>>>>"
    return df.select(key, F.posexplode(F.from_xml(F.col(xml), s)["back"]["ref-list"]["ref"]).alias("idx", "r")).select(key, "idx", F.col("r._id").alias("ref"), F.col("r.label").alias("label"), F.col("r.mixed-citation").alias("raw"))


def records_per_paper(df: DataFrame, key: str, expected_version: int, version: str = "schema_version") -> DataFrame:
    """Each record with its error: duplicate, version or none."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    return df.join(n, key).withColumn("error", F.when(F.col("__n") > 1, "duplicate").when(F.col(version) != expected_version, "version")).drop("__n")
