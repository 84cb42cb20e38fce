"""Fill fixed-capacity containers with texts measured in tokens (problem 8).

Method: mixture-controlled packing. Texts stand in one queue per source, in an order given by a hash. A deficit
round-robin draws from the queues so that every window holds the sources in their target token proportions: in
each window a source may take as many tokens as its target share of the window; an item that reaches beyond it
is charged to the next window, so what a source got too much or too little in one window is carried to the next.
As a queue's items are drawn in order, the window of an item follows from the tokens before it in its queue:
running sums over partitions and inside them give every item's window without a queue ever being in one place,
and deficits are carried over all windows and partitions. A source whose queue is empty leaves the others their
proportions. Each window is packed best-fit decreasing into containers of its own.

Targets are the sources' shares of all tokens unless given. A source without a target comes in windows of its
own after the others.

Scale: a window has about ``window_tokens`` tokens, so no task grows with the data, and a source that holds a
third of all rows spreads over all windows.

Defined results: null and empty texts are left out; a text longer than the capacity is cut into
pieces of exactly the capacity and one rest; other texts are never split; a null source is a source
of its own; repeated rows are separate items; an empty table gives an empty result.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.bpe import DEFAULT_VOCAB, encoder, send
from folioforge.session import materialize

WINDOW_TOKENS = 4_000_000


def token_pieces(df: DataFrame, capacity: int, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, source, piece, start_token, n_tokens) of all texts with at least one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            rows: list[tuple] = []
            for doc, text, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = enc.count(text)
                rows += [(doc, source, k, s, min(capacity, n - s)) for k, s in enumerate(range(0, n, capacity))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32()))],
                                             ["doc_id", "source", "piece", "start_token", "n_tokens"])

    send(df.sparkSession, vocab)
    return df.select(F.col("doc_id").cast("bigint"), "text", "source").where("text is not null and text != ''").mapInArrow(
        run, "doc_id bigint, source string, piece int, start_token bigint, n_tokens int")


class Bins:
    """Open containers by free space; an item goes where it leaves the least."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free, self.n = capacity, [], 0

    def put(self, size: int) -> int:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, k = self.free.pop(at)
        else:
            room, k, self.n = self.capacity, self.n, self.n + 1
        if room > size:
            insort(self.free, (room - size, k))
        return k


def draw(pieces: DataFrame, total: int, window_tokens: int, targets: dict[str | None, float] | None) -> DataFrame:
    """``pieces`` with the window_id in which the deficit round-robin draws each of them."""
    spark = pieces.sparkSession
    parts = max(1, -(-total // window_tokens))
    x = pieces.withColumn("salt", F.xxhash64("doc_id", "piece", "start_token")).withColumn("part", F.pmod("salt", F.lit(parts)))
    had = x.groupBy("part", "source").agg(F.sum("n_tokens").alias("had"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    had = had.withColumn("before", F.coalesce(F.sum("had").over(before), F.lit(0)))
    queues = had.groupBy("source").agg(F.sum("had").alias("all"))
    if targets is None:
        queues = queues.select("source", (F.col("all") / F.lit(float(max(total, 1)))).alias("share"), F.lit(0).alias("first"))
    else:
        if min(targets.values(), default=0) < 0:
            raise ValueError("targets are shares of 0 or more")
        whole = sum(targets.values()) or 1.0
        given = spark.createDataFrame([(k, v / whole) for k, v in targets.items() if v > 0], "name string, share double")
        queues = queues.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        # the windows that the sources with a target need; the others follow
        last = queues.where("share is not null").agg(F.max(F.ceil(F.col("all") / (F.col("share") * window_tokens)))).first()[0] or 0
        rest = queues.where("share is null").agg(F.sum("all")).first()[0] or 1
        queues = queues.select("source", F.coalesce("share", F.col("all") / F.lit(float(rest))).alias("share"), F.when(F.col("share").isNull(), int(last)).otherwise(0).alias("first"))
    offsets = had.join(queues.withColumnRenamed("source", "q_source"), F.col("source").eqNullSafe(F.col("q_source"))).select(
        F.col("part").alias("q_part"), "q_source", "before", "share", "first")
    x = x.join(offsets, (F.col("part") == F.col("q_part")) & F.col("source").eqNullSafe(F.col("q_source"))).drop("q_part", "q_source")
    own = Window.partitionBy("part", "source").orderBy("salt", "doc_id", "piece", "start_token").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    return x.withColumn("window_id", F.col("first") + F.floor(at / (F.col("share") * window_tokens))).select(*pieces.columns, "salt", "window_id")


def pack(df: DataFrame, capacity: int = 2048, vocab: str = DEFAULT_VOCAB, window_tokens: int = WINDOW_TOKENS, targets: dict[str | None, float] | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, source, window_id, container_id) of each text or piece.

    ``df`` has doc_id, text, source; ``targets`` are the sources' shares of each window's tokens.
    """
    pieces = materialize(token_pieces(df, capacity, vocab))
    total = int(pieces.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])

    def fill(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "salt", "doc_id", "piece"], ascending=[False, True, True, True], kind="mergesort")
        bins = Bins(capacity)
        items["container"] = [bins.put(n) for n in items["n_tokens"].tolist()]
        return items

    drawn = draw(pieces, total, window_tokens, targets)
    packed = drawn.groupBy("window_id").applyInPandas(fill, "doc_id bigint, source string, piece int, start_token bigint, n_tokens int, salt bigint, window_id bigint, container int")
    ident = (F.shiftleft(F.col("window_id"), 24) + F.col("container")).alias("container_id")
    return packed.select("doc_id", "piece", "start_token", "n_tokens", "source", "window_id", ident)
