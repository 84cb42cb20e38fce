"""Streaming queries, run over all available input; each result is read back as a table."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.plans.registry import query
from folioforge.session import shared_dir, table
from folioforge.streaming import streams as S


def _drain(spark, df, mode: str = "append"):
    """Run a stream to the end into a table of the shared folder.

    A batch overwrites the folder of its id, so one that is played again after a failure isn't written twice; with
    complete output the last batch holds all.
    """
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    S.run_once(df, lambda b, i: b.write.mode("overwrite").parquet(f"{root}/out/{0 if mode == 'complete' else i:09d}"), f"{root}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(f"{root}/out/*")


@query("st01_incremental_index", "SELECT doc_hash, count(*) AS chunks, sum(('0x' || substring(sha256(chunk_id::VARCHAR || ':' || coalesce(text, '')), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM chunks GROUP BY doc_hash")
def st01(spark, d):
    """Fingerprint of each document's chunks, only where the stored one differs.

    A sum of digests: it doesn't depend on the order and is combined on the map side.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    now = table(spark, d, "chunks").groupBy("doc_hash").agg(F.count("*").alias("chunks"), F.sum(h).cast("string").alias("fingerprint"))
    return S.changed_only(now, None, "doc_hash", "fingerprint")


@query("st02_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def st02(spark, d):
    out = _drain(spark, S.windowed_counts(S.read_parquet_stream(spark, d, "events")), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("st08_deliveries_once", "SELECT DISTINCT run_id FROM runs")
def st08(spark, d):
    return _drain(spark, S.deliveries_once(S.read_parquet_stream(spark, d, "runs"))).select("run_id").distinct()
