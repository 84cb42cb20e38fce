"""Citation markers with their targets (D35 to D40, J22, J23, X106), body text and list extents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.lines import author_surname

NUMERIC = r"(\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\])"
SUPERSCRIPT = r"(?:\p{L},?|[.;:)\]”’])([⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:[,⁻–-][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*)"
DETACHED = r"(?m)^[ \t]*([⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:[,⁻–-][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*)[ \t]*$"
AUTHOR_YEAR = r"(\p{Lu}[\p{L}’'-]+(?:\s+(?:et al\.?|(?:and|&)\s+\p{Lu}[\p{L}’'-]+))?,?\s+\(?(?:18|19|20)[0-9]{2}[a-z]?)"


def numbers_of(c: Column) -> Column:
    """The numbers of a marker "3, 7-9"; ranges are written out, reversed ones give nothing."""
    parts = F.split(F.regexp_replace(F.translate(F.regexp_replace(c, r"[\[\]\s]", ""), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻–", "0123456789--"), "-+", "-"), ",")
    lo = lambda p: F.try_element_at(F.split(p, "-"), F.lit(1)).try_cast("int")
    hi = lambda p: F.coalesce(F.try_element_at(F.split(p, "-"), F.lit(2)), F.try_element_at(F.split(p, "-"), F.lit(1))).try_cast("int")
    ok = lambda p: F.coalesce((lo(p) > 0) & (hi(p) >= lo(p)) & (hi(p) - lo(p) < 100), F.lit(False))
    return F.flatten(F.transform(F.filter(parts, ok), lambda p: F.sequence(lo(p), hi(p))))


def numeric_markers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, pos, marker, number): bracketed, superscript and detached superscript markers, a row for each number."""
    out = None
    for kind, p in (("bracket", NUMERIC), ("superscript", SUPERSCRIPT), ("detached", DETACHED)):
        m = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))).alias("pos", "marker"))
        m = m.select(*keys, F.lit(kind).alias("kind"), "pos", "marker", F.explode(numbers_of(F.col("marker"))).alias("number"))
        out = m if out is None else out.unionByName(m)
    return out


def name_markers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, marker, name, year, suffix, shape, second): author-year markers with what they say of the co-authors."""
    m = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(AUTHOR_YEAR), F.lit(1))).alias("pos", "marker"))
    second = F.nullif(F.lower(F.regexp_extract("marker", r"\s(?:and|&)\s+(\p{Lu}[\p{L}’'-]+)", 1)), F.lit(""))
    shape = F.when(F.col("marker").rlike(r"\set al"), "et_al").when(second.isNotNull(), "named").otherwise("single")
    return m.select(*keys, "pos", "marker", F.lower(F.regexp_extract("marker", r"^(\p{Lu}[\p{L}’'-]+)", 1)).alias("name"), F.regexp_extract("marker", "((?:18|19|20)[0-9]{2})[a-z]?$", 1).cast("int").alias("year"),
                    F.nullif(F.regexp_extract("marker", "[0-9]([a-z])$", 1), F.lit("")).alias("suffix"), shape.alias("shape"), second.alias("second"))


def resolve_numbers(markers: DataFrame, refs: DataFrame, by: list[str]) -> DataFrame:
    """Markers with the entry of their number in the same list."""
    return markers.join(refs.select(*by, "number", "ref_id"), [*by, "number"])


def resolve_names(markers: DataFrame, refs: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(key, ref_id) of author-year markers (J22, J23, X106).

    ``refs`` is (by, surname, whole, year, n_authors, second, idx, ref_id). The surname is looked up first, then a
    whole name that ends with it; of several entries those whose co-authors fit the marker stay, unless none
    would; a letter behind the year picks the n-th of those left in list order.
    """
    exact = F.lit(0).alias("rank")
    tail = F.element_at(F.split("whole", " "), -1)
    cand = markers.join(refs.withColumnRenamed("surname", "name").drop("whole").withColumnRenamed("second", "r_second"), [*by, "name", "year"]).withColumn("rank", exact)
    loose = refs.where(tail != F.col("surname")).withColumn("name", tail).drop("surname", "whole").withColumnRenamed("second", "r_second")
    cand = cand.unionByName(markers.join(loose, [*by, "name", "year"]).withColumn("rank", F.lit(1)))
    w = Window.partitionBy(*key)
    cand = cand.withColumn("least", F.min("rank").over(w)).where("rank = least")
    fits = F.when(F.col("shape") == "single", F.col("n_authors") == 1).when(F.col("shape") == "et_al", F.col("n_authors") >= 3).otherwise(F.col("r_second") == F.col("second"))
    cand = cand.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("some", F.max("fits").over(w)).where("fits or not some")
    nth = F.row_number().over(w.orderBy("idx", "ref_id"))
    cand = cand.withColumn("nth", nth).withColumn("many", F.count("*").over(w))
    wanted = F.ascii("suffix") - F.ascii(F.lit("a")) + 1
    return cand.where(F.col("suffix").isNull() | (F.col("many") < wanted) | (F.col("nth") == wanted)).select(*key, "ref_id").distinct()


def reference_index(refs: DataFrame, by: list[str]) -> DataFrame:
    """(by, surname, whole, year, n_authors, second, idx, ref_id) of extracted entries with an author and a year."""
    # names typed as "Surname, I." or "Surname I"; others count by what separates them
    head = F.regexp_replace(F.col("raw"), r"\(?(?:18|19|20)[0-9]{2}.*$", "")
    names = F.regexp_extract_all(head, F.lit(r"(\p{Lu}[\p{L}’'-]{2,}),?\s+\p{Lu}\.?(?:[\s,.;]|$)"), F.lit(1))
    n = F.greatest(F.size(names), F.size(F.regexp_extract_all(head, F.lit(r"(\band\b|&|;)"), F.lit(1))) + 1)
    return refs.where("author is not null and year is not null").select(*by, author_surname("author").alias("surname"), F.lower("author").alias("whole"), "year", n.alias("n_authors"), F.lower(F.get(names, F.lit(1))).alias("second"), "idx", "ref_id")


#: Lines that are no body text: captions, page numbers, contents.
NOT_BODY = r"^\s*(?:(?:Figure|Fig\.|Table|Scheme|Plate)\s+[0-9IVX]+[.:]|[-–—]?\s*[0-9]{1,4}\s*[-–—]?\s*$|.*(?:\.\s?){4,}\s*[0-9]*\s*$)"


def body_only(text: Column) -> Column:
    """Text without captions, page numbers, contents and numeric markers."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NOT_BODY))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\s?\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]", "")


def reference_extents(lines: DataFrame, by: str, no: str, line: str) -> DataFrame:
    """(by, first, last): the lines of each reference list, from its heading to the next one's or the end."""
    from folioforge.operators.documents import HEADINGS
    ends = lines.groupBy(by).agg(F.max(no).alias("end"))
    heads = lines.where(F.col(line).rlike(HEADINGS)).select(by, F.col(no).alias("first"))
    after = F.lead("first").over(Window.partitionBy(by).orderBy("first"))
    return heads.withColumn("after", after).join(ends, by).select(by, (F.col("first") + 1).alias("first"), F.coalesce(F.col("after") - 1, F.col("end")).alias("last")).where("first <= last")
