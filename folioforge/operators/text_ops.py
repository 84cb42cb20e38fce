"""Per-document text operators: windows, lines, vocabulary, furniture, alignment, intervals."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from folioforge.functions.text import col, digit_key

_END = re.compile(r"[.!?][\"'”’)\]]*$")


def word_windows(words: list[str], size: int = 200, overlap: int = 40) -> list[tuple[int, int]]:
    """(start, end) of sliding windows cut at the last sentence end of their second half."""
    out, start, n = [], 0, len(words)
    while start < n:
        end = min(n, start + size)
        if end < n:
            floor = start + overlap + (size - overlap) // 2
            for k in range(end, floor, -1):
                if _END.search(words[k - 1]) and (k == n or words[k][:1].isupper()):
                    end = k
                    break
        out.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_words(df: DataFrame, key: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """(key, idx, start_word, text) of each window; null and blank texts have none. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, idx, start, out = [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                ws = (t or "").split()
                for k, (s, e) in enumerate(word_windows(ws, size, overlap)):
                    at.append(row), idx.append(k), start.append(s), out.append(" ".join(ws[s:e]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(idx, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], [key, "idx", "start_word", "text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, idx int, start_word int, text string")


def stride_windows(df: DataFrame, key: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """(key, idx, words) of windows at a fixed stride, all in built-in expressions."""
    w = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")
    step = size - overlap
    n = F.size(w)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.transform(starts, lambda i: F.struct(i.alias("idx"), F.array_join(F.slice(w, i * step + 1, size), " ").alias("text")))).alias("x")).select(key, "x.idx", "x.text")


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no from 1, line) of each line."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(w, n): lower-case words, hyphens inside kept, over all texts."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+(?:-\p{L}+)*)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def hyphen_policy(cases: DataFrame, vocab: DataFrame, left: str, right: str) -> DataFrame:
    """Keep or join the two parts of a word met at a line end, by corpus counts of both forms.

    The form seen more often wins; with neither seen, a short known first part that stands before other
    words with a hyphen (self-, non-) keeps it; otherwise the parts are joined.
    """
    j, k = F.lower(F.concat(left, right)), F.lower(F.concat(F.col(left), F.lit("-"), F.col(right)))
    c = cases.withColumn("__j", j).withColumn("__k", k).withColumn("__l", F.lower(F.col(left))).withColumn("__r", F.lower(F.col(right)))
    heads = vocab.where("w like '%-%'").select(F.substring_index("w", "-", 1).alias("__l"), "n").groupBy("__l").agg(F.sum("n").alias("as_head"))
    c = c.join(vocab.select(F.col("w").alias("__j"), F.col("n").alias("joined")), "__j", "left").join(vocab.select(F.col("w").alias("__k"), F.col("n").alias("pair")), "__k", "left")
    c = c.join(heads, "__l", "left").join(vocab.select(F.col("w").alias("__r"), F.col("n").alias("right_n")), "__r", "left")
    z = lambda x: F.coalesce(x, F.lit(0))
    d = F.when(z("joined") + z("pair") > 0, F.when(z("pair") > z("joined"), "keep").otherwise("join")).when((z("as_head") > 0) & (z("right_n") > 0), "keep").otherwise("join")
    return c.select(*cases.columns, d.alias("decision"))


def hyphen_lines(pairs: DataFrame, vocab: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """``pairs`` of successive lines with decision, new_first and new_second.

    It applies where the first line ends in a hyphen behind letters and the next begins with a small letter, or both
    parts are capitals; then ``hyphen_policy`` decides. A joined word stands at the end of the first line.
    """
    left = F.regexp_extract(first, r"(?:^|[\s(\[“\"'‘])(\p{L}+)[-¬‐]\s*$", 1)
    right = F.regexp_extract(second, r"^\s*([\p{L}\p{N}]+)", 1)
    small = right.rlike(r"^\p{Ll}")
    capitals = (F.length(left) >= 2) & left.rlike(r"^\p{Lu}+$") & right.rlike(r"^\p{Lu}+$")
    x = pairs.withColumn("__pl", left).withColumn("__pr", right).withColumn("__ok", (left != "") & (right != "") & (small | capitals))
    d = hyphen_policy(x, vocab, "__pl", "__pr").withColumn("decision", F.when(F.coalesce("__ok", F.lit(False)), F.col("decision")).otherwise("none"))
    joined = F.col("decision") == "join"
    head = F.regexp_extract(second, r"^\s*(\S+)", 1)
    new_first = F.when(joined, F.concat(F.regexp_replace(first, r"[-¬‐]\s*$", ""), head)).otherwise(F.col(first))
    new_second = F.when(joined, F.regexp_replace(second, r"^\s*\S+\s*", "")).otherwise(F.col(second))
    return d.select(*pairs.columns, "decision", new_first.alias("new_first"), new_second.alias("new_second"))


def edge_lines(df: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """First and last non-blank line of each text with its digit-normalised key."""
    ls = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    x = df.select(doc, page, ls.alias("ls")).where("size(ls) > 0")
    return x.select(doc, page, F.explode(F.array(F.struct(F.lit("top").alias("edge"), F.get("ls", F.lit(0)).alias("line")), F.struct(F.lit("bottom").alias("edge"), F.element_at("ls", -1).alias("line")))).alias("e")).select(
        doc, page, "e.edge", "e.line", digit_key("e.line").alias("key"))


def furniture(df: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Edge lines found on at least two pages of a document, strong ones on three pages of one parity or 40 %."""
    e = edge_lines(df, doc, page, text)
    pages = df.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    d = e.select(doc, "edge", "key", page).distinct()
    g = d.groupBy(doc, "edge", "key").agg(F.count("*").alias("n"), F.count_if(F.col(page) % 2 == 1).alias("odd"), F.count_if(F.col(page) % 2 == 0).alias("even")).where("n >= 2").join(pages, doc)
    strong = (F.col("odd") >= 3) | (F.col("even") >= 3) | (F.col("n") >= 3) & (F.col("n") * 5 >= F.col("pages") * 2)
    return g.select(doc, "edge", "key", "n", strong.alias("strong"))


def islands(df: DataFrame, by: str, start: str, end: str, gap) -> DataFrame:
    """Intervals of a key merged where they touch or lie within ``gap`` (U09): (by, start, end, n)."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.select(by, F.col(start).alias("s"), F.col(end).alias("e"), F.when(F.col(start) <= reach + gap, 0).otherwise(1).alias("new"))
    w2 = Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("island", F.sum("new").over(w2)).groupBy(by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island")


def rate_slots(df: DataFrame, by: str, at: str, key: str, interval: int) -> DataFrame:
    """Slot of each request: max(its time, slot before + interval), without a fold (W20, ST07).

    slot(i) = i * interval + max over j <= i of (t(j) - j * interval).
    """
    w = Window.partitionBy(by).orderBy(at, key)
    x = df.withColumn("i", F.row_number().over(w))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("slot", F.col("i") * interval + F.max(F.col(at) - F.col("i") * interval).over(run)).drop("i")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Exact length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_ALIGNED = StructType([StructField("n_left", IntegerType()), StructField("n_right", IntegerType()), StructField("matched", IntegerType()), StructField("score", DoubleType())])


@F.pandas_udf(_ALIGNED)
def word_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Words of both sides, matched ones and 2 * LCS / (n + m); 1 if both are empty."""
    rows = []
    for x, y in zip(a, b):
        u, v = (x or "").split(), (y or "").split()
        m = lcs_length(u, v)
        rows.append((len(u), len(v), m, 1.0 if not u and not v else 2 * m / (len(u) + len(v))))
    return pd.DataFrame(rows, columns=["n_left", "n_right", "matched", "score"])


def word_error_rate(ref, hyp) -> Column:
    """Word edit distance over the reference's words; null without any.

    Each different word of both becomes a character of its own, so the distance is the built-in one of strings.
    """
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    a, b = split(col(ref)), split(col(hyp))
    known = F.array_distinct(F.concat(a, b))
    spell = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0")), "UTF-32")), "")
    return F.when(F.size(a) > 0, F.levenshtein(spell(a), spell(b)) / F.size(a))


#: Ranges into which each group's values are cut to find a position.
RANGES = 1024


def order_statistic(df: DataFrame, by: str, value: str, index) -> DataFrame:
    """(by, value): the value at a position of each group's sorted values.

    ``index`` maps the group's size (a Column) to a position from 0. Values are counted on the map side; RANGES
    counts a group tell the range that holds the position, and only the different values of that range are
    sorted, so no group is gathered or sorted as a whole.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__c"))
    x = F.col(value).cast("double")
    g = c.groupBy(by).agg(F.sum("__c").alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi")).select(F.col(by).alias("__by"), "__lo", "__hi", index(F.col("__n")).alias("__k"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    c = c.join(g, same(by, "__by")).withColumn("__r", F.when(F.col("__hi") > F.col("__lo"), F.floor((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES)).otherwise(F.lit(0).cast("bigint")))
    upto = F.sum("__c").over(Window.partitionBy("__by").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = c.groupBy("__by", "__r").agg(F.sum("__c").alias("__c"), F.first("__k").alias("__k")).withColumn("__before", F.coalesce(upto, F.lit(0)))
    ranges = ranges.where((F.col("__before") <= F.col("__k")) & (F.col("__before") + F.col("__c") > F.col("__k"))).select(F.col("__by").alias("__b2"), F.col("__r").alias("__r2"), "__before")
    c = c.join(ranges, same("__by", "__b2") & (F.col("__r") == F.col("__r2")))
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("__upto", F.col("__before") + F.sum("__c").over(w))
    return c.where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__c") <= F.col("__k"))).select(by, value)


def nearest_rank(p: float):
    """Position of the nearest-rank percentile: ceil(p n) - 1."""
    return lambda n: F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0))


def rounded_rank(p: float):
    """Position round((n - 1) p)."""
    return lambda n: F.round((n - 1) * F.lit(p)).cast("bigint")


def upper_median(n: Column) -> Column:
    """Position n / 2."""
    return F.floor(n / 2)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility form of texts, in Arrow batches (X20); Spark has no expression for it."""
    return s.str.normalize("NFKC")
