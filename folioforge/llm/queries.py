"""Queries and SQL of the problems, p1 to p9."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, encodings, glyphs, linkage, names, packing, repeated, scans, splitting
from folioforge.session import table


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "chunks"), table(spark, d, "extracted_refs"), table(spark, d, "manifest_item"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_repaired(spark, d).where("affected").select("tab_name", "row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "extracted_refs"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "extracted_refs"))


def p2_partners(spark: SparkSession, d: str) -> DataFrame:
    return names.partners(table(spark, d, "extracted_refs"))


def _repeated(spark: SparkSession, d: str) -> repeated.Repeated:
    return repeated.Repeated(table(spark, d, "chunks"), table(spark, d, "manifest_item"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d).found(short=False).select("chunk_id", "line_no")


def p3_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d).patterns(gap=None)


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d).cleaned()


def _forms(spark: SparkSession, d: str, only_changed: bool) -> DataFrame:
    refs = glyphs.forms(table(spark, d, "extracted_refs"), "ref_id", ["title", "surname"], only_changed)
    truth = glyphs.forms(table(spark, d, "latex_refs"), "truth_id", ["title"], only_changed)
    return refs.withColumn("tab_name", F.lit("extracted_refs")).unionByName(truth.withColumn("tab_name", F.lit("latex_refs")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d, True).select("tab_name", "field_name", "row_id")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d, False).select("tab_name", "field_name", "row_id", "form")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_table(table(spark, d, "chunks")).where("n_pieces > 1 and piece = 0").select("chunk_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_table(table(spark, d, "chunks"))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matches(table(spark, d, "extracted_refs"), table(spark, d, "latex_refs"), table(spark, d, "match_labels"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("ref_id", "truth_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_table(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(table(spark, d, "documents")).where("affected").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(table(spark, d, "documents")).where("affected").select("doc_id", "how", "restored", "gain")


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_entities, p2_partners, p3_found, p3_patterns, p3_cleaned, p4_found, p4_forms, p5_found, p5_pieces, p6_found, p6_matches, p7_ids, p8_containers, p9_found, p9_restored)}
SQL = {
    "p5_found": "SELECT chunk_id FROM chunks WHERE length(text) > 1500",
}
