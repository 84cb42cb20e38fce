"""Command line over a folder of tables.

    python -m folioforge list
    python -m folioforge run NAME TABLES OUT
    python -m folioforge stats TABLES
    python -m folioforge show TABLES PREFIX
    python -m folioforge bibliography TABLES OUT
    python -m folioforge eval TABLES
    python -m folioforge readers
    python -m folioforge index TABLES FOLDER
    python -m folioforge query FOLDER TEXT
"""
from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Readers by the name they are asked for.
READERS = {"files": "snapshot", "json_lines": "json_lines", "manifest": "manifest", "text": "texts", "cookies": "cookies", "archive": "unpack", "feed": "feed", "jats": "jats_references",
           "office": "office_rows", "tei": "tei", "latex": "latex_files"}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioforge")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, names in (("list", ()), ("run", ("name", "tables", "out")), ("stats", ("tables",)), ("show", ("tables", "prefix")), ("bibliography", ("tables", "out")), ("eval", ("tables",)), ("readers", ()),
                        ("index", ("tables", "folder")), ("query", ("folder", "text"))):
        s = sub.add_parser(verb)
        for n in names:
            s.add_argument(n)
    a = p.parse_args(args)
    if a.verb == "readers":
        print("\n".join(sorted(READERS)))
        return 0
    from folioforge.plans import registry
    q = registry.queries()
    if a.verb == "list":
        print("\n".join(sorted(q)))
        return 0
    if a.verb == "run" and a.name not in q:
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    from folioforge.operators.store import SearchIndex
    from folioforge.session import DEFAULTS, table
    spark = spark or SparkSession.builder.config(map=DEFAULTS).appName("folioforge").getOrCreate()
    if a.verb == "run":
        q[a.name](spark, a.tables).write.mode("errorifexists").parquet(a.out)
    elif a.verb == "stats":
        for k, v in q["a01_stats"](spark, a.tables).first().asDict().items():
            print(f"{k}\t{v}")
    elif a.verb == "show":
        runs = table(spark, a.tables, "runs").where(F.col("doc_hash").startswith(a.prefix)).select("run_id")
        q["s26_document_detail"](spark, a.tables).join(runs.distinct(), "run_id").orderBy("run_id").show(truncate=False)
    elif a.verb == "bibliography":
        q["s20_load_references"](spark, a.tables).write.mode("errorifexists").json(a.out)
    elif a.verb == "eval":
        q["a06_evaluation"](spark, a.tables).show()
    elif a.verb == "index":
        _, worked, gone = SearchIndex(spark, a.folder).refresh(table(spark, a.tables, "chunks"))
        print(f"{worked} documents indexed, {gone} removed")
    elif a.verb == "query":
        SearchIndex(spark, a.folder).query(spark.createDataFrame([(1, a.text)], "query_id int, query string"), 10).orderBy("rank").show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
