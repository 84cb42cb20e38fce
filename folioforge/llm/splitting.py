"""Cut oversized texts at natural boundaries with an overlap (problem 5).

Method: agglomerative merging. A text falls into atoms (words with the space after them; unspaced
scripts also break after their sentence marks, and a word above the limit is cut hard, never before a
combining mark). All adjacent pairs lie in a heap by the strength of the boundary between them, word,
line, clause, sentence, paragraph, and the weakest are merged first while the combined size plus the
overlap fits the limit. The boundaries that remain are the strongest ones. Each piece but the first
begins with the end of the piece before it, at most ``overlap`` characters, from a word start on.

Defined results: a null text gives one piece with null text; an empty text or one within the limit is
its own single piece; joining the pieces without their overlaps gives the text back exactly.
"""
from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATOM = re.compile(r"\s*(?:[^\s。！？]+[。！？]+[」』）”’]*|[^\s。！？]+|[。！？]+)\s*|\s+")
_SENTENCE = re.compile(r"(?:[.!?…][\"'”’)\]]*\s+|[。！？][」』）”’]*\s*)$")
_CLAUSE = re.compile(r"[,;:、，；：]\s+$")
#: Strengths of the boundaries, from weak to strong.
HARD, WORD, LINE, CLAUSE, SENTENCE, PARAGRAPH = range(6)
#: Pieces may be numbered up to this many in one text; new idx = old idx * ORDER + piece.
ORDER = 1 << 20


def atoms(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of each atom."""
    out = []
    for m in _ATOM.finditer(text):
        s, e = m.span()
        while e - s > limit:
            cut = s + limit
            while cut > s + 1 and unicodedata.combining(text[cut]):
                cut -= 1
            out.append((s, cut, HARD))
            s = cut
        part = text[max(s, e - 12):e]
        gap = part[len(part.rstrip()):]
        strength = (PARAGRAPH if gap.count("\n") > 1 else SENTENCE if _SENTENCE.search(part) else CLAUSE if _CLAUSE.search(part)
                    else LINE if "\n" in gap else WORD if gap else HARD)
        out.append((s, e, strength))
    return out


def cut(text: str, limit: int = 1500, overlap: int = 150) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece; text[start:end] of all pieces join to the text."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap
    a = atoms(text, room)
    start, end = [x[0] for x in a], [x[1] for x in a]
    n = len(a)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(a[i][2], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not alive[i] or right[i] != j or end[j] - start[i] != size or size > room:
            if alive[i] and right[i] == j < n and end[j] - start[i] <= room:
                heapq.heappush(heap, (strength, end[j] - start[i], i, j))  # grown since it was pushed
            continue
        # i takes j in; the boundary behind j is now behind i
        end[i], alive[j], right[i] = end[j], False, right[j]
        a[i] = (start[i], end[i], a[j][2])
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (a[i][2], end[right[i]] - start[i], i, right[i]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (a[k][2], end[i] - start[k], k, i))
    out = []
    for i in range(n):
        if alive[i]:
            s = start[i]
            low = max(start[i] - overlap, out[-1][1] if out else 0) if out else start[i]
            if low > 0 and not text[low - 1].isspace():
                m = re.compile(r"\s+\S").search(text, low, s)
                low = m.end() - 1 if m else low
            out.append((low if out else s, s, end[i]))
    return out


def split_table(df: DataFrame, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Pieces of every row of ``df`` (chunk_id, doc_hash, run_id, page, idx, text).

    Columns: those keys, piece, n_pieces, new_idx (orders all pieces of a document), text, overlap_chars.
    A map over partitions without a shuffle; only rows above the limit leave the JVM.
    """
    keys = ["chunk_id", "doc_hash", "run_id", "page", "idx"]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", piece int, n_pieces int, new_idx bigint, text string, overlap_chars int"
    base = df.select(*keys, "text")
    new_idx = (F.col("idx").cast("bigint") * ORDER).alias("new_idx")
    small = base.where(f"text is null or length(text) <= {limit}").select(
        *keys, F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), new_idx, "text", F.lit(0).alias("overlap_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take: list[int] = []
            piece, count, new, text, over = [], [], [], [], []
            for row, (t, idx) in enumerate(zip(b.column("text").to_pylist(), b.column("idx").to_pylist())):
                parts = cut(t, limit, overlap)
                for k, (low, s, e) in enumerate(parts):
                    take.append(row), piece.append(k), count.append(len(parts))
                    new.append(None if idx is None else idx * ORDER + k), text.append(t[low:e]), over.append(s - low)
            kept = b.select(keys).take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(piece, pa.int32()), pa.array(count, pa.int32()), pa.array(new, pa.int64()), pa.array(text, pa.string()), pa.array(over, pa.int32())],
                [*keys, "piece", "n_pieces", "new_idx", "text", "overlap_chars"])

    return small.unionByName(base.where(f"length(text) > {limit}").mapInArrow(run, schema))
