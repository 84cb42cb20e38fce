"""Writers: idempotent publish, CSV of references, cookie jars, partitioned dumps."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.ledger import merge_runs


def publish(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], partition: str | None = None) -> None:
    """Replace rows of equal identity by those of ``batch``.

    With a partition column only the partitions of the batch are read and written (dynamic overwrite),
    so the cost follows the batch and not the table. The result is written beside the table and read
    back before it replaces anything, since a plan can't overwrite what it reads.
    """
    from folioforge.session import materialize
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not exists:
        out = batch
    else:
        old = spark.read.schema(batch.schema).parquet(path)
        if partition:
            old = old.join(batch.select(partition).distinct(), partition, "left_semi").select(*batch.columns)
        out = materialize(merge_runs(old, batch, keys))
    w = out.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def references_csv(refs: DataFrame, path: str) -> None:
    """References as CSV with a derived resolution column."""
    res = F.when(F.col("doi").isNotNull(), "doi").when(F.col("title").isNotNull() & F.col("year").isNotNull(), "title_year").otherwise("unresolved")
    cols = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in refs.dtypes]
    refs.select(*cols, res.alias("resolution")).write.mode("append").option("header", True).option("escape", '"').csv(path)


def dumps(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON for each value of a key."""
    df.write.mode("errorifexists").partitionBy(by).json(path)


def netscape(jar: DataFrame, path: str) -> None:
    """A cookie jar in Netscape form."""
    jar.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("domain", "include_subdomains", "path", "secure", "expires", "name", "value")]).alias("value")).write.mode("overwrite").text(path)


def compare_and_set(table: DataFrame, updates: DataFrame, key: str, value: str, base: str) -> DataFrame:
    """Rows after updates that apply only where the stored value still is the base (K23); applied tells which did."""
    u = updates.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.col(base).alias("__b"))
    ok = F.col("__k").isNotNull() & F.col(value).eqNullSafe(F.col("__b"))
    j = table.join(u, F.col(key) == F.col("__k"), "left")
    return j.select(*[F.when(ok, F.col("__v")).otherwise(F.col(value)).alias(value) if c == value else F.col(c) for c in table.columns], ok.alias("applied"))


#: Most rows of a report.
MOST_ROWS = 10_000


def markdown(df: DataFrame, title: str) -> str:
    """A small report table as Markdown (K16); more than MOST_ROWS rows are refused, not cut."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def save_manifest(df: DataFrame, path: str) -> None:
    """A manifest as one JSON file of lines in a new folder (K18); a manifest is a list of papers, written by one task."""
    df.coalesce(1).write.mode("errorifexists").json(path)
