"""Queries over texts, events and the star schema."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import text_ops as O
from folioforge.plans.registry import query
from folioforge.session import table

WS = r"list_filter(regexp_split_to_array(trim({c}), '\s+'), lambda x: x <> '')"
LINES = "(SELECT chunk_id, doc_hash, page, publisher_line.no AS line_no, publisher_line.line AS line FROM (SELECT chunk_id, doc_hash, page, unnest(list_transform(string_split(text, chr(10)), lambda l, i: {'no': i, 'line': l})) AS publisher_line FROM chunks WHERE text IS NOT NULL))"


@query("w04_word_windows", None)
def w04(spark, d):
    return O.chunk_words(table(spark, d, "chunks"), "chunk_id", "text")


@query("w04_stride_windows", f"SELECT chunk_id, i::INT AS idx, array_to_string(list_slice(w, i * 160 + 1, i * 160 + 200), ' ') AS text FROM (SELECT chunk_id, w, unnest(range(greatest(ceil((len(w) - 200) / 160.0), 0)::INT + 1)) AS i FROM (SELECT chunk_id, {WS.format(c='text')} AS w FROM chunks WHERE text IS NOT NULL) WHERE len(w) > 0)")
def w04s(spark, d):
    return O.stride_windows(table(spark, d, "chunks"), "chunk_id", "text")


@query("w05_sentence_starts", r"SELECT chunk_id, len(regexp_extract_all(text, '[.!?][\"”’)\]]*\s+\p{Lu}')) AS starts FROM chunks WHERE text IS NOT NULL")
def w05(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", F.size(F.regexp_extract_all("text", F.lit(r"""([.!?]["”’)\]]*\s+\p{Lu})"""), F.lit(1))).alias("starts"))


@query("a11_role_counts", rf"""SELECT role, count(*) AS n FROM (SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '{T.PAGE_NUMBER}') OR regexp_matches(trim(line), '{T.ROMAN}') THEN 'page_number'
WHEN regexp_matches(line, '^\s*(?:Figure|Fig\.|Table|Scheme|Plate)\s+[0-9IVX]+[.:]') THEN 'caption' WHEN regexp_matches(line, '(?:\.\s?){{4,}}\s*[0-9]*\s*$') THEN 'toc' ELSE 'body' END AS role FROM {LINES}) GROUP BY role""")
def a11(spark, d):
    ln = O.lines(table(spark, d, "chunks").where("text is not null"), "chunk_id")
    role = F.when(F.trim("line") == "", "blank").when(T.is_page_number("line"), "page_number").when(T.is_caption("line"), "caption").when(T.is_toc("line"), "toc").otherwise("body")
    return ln.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("f06_page_number_lines", rf"SELECT chunk_id, line_no, line FROM {LINES} WHERE regexp_matches(trim(line), '{T.PAGE_NUMBER}') OR regexp_matches(trim(line), '{T.ROMAN}')")
def f06(spark, d):
    return O.lines(table(spark, d, "chunks").where("text is not null"), "chunk_id").where(T.is_page_number("line"))


@query("f12_prose_lines", rf"SELECT chunk_id, count(*) AS prose FROM (SELECT chunk_id, {WS.format(c='line')} AS w FROM {LINES}) WHERE len(w) >= 6 AND len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{2,}}[,;]?$'))) * 2 >= len(w) GROUP BY chunk_id")
def f12(spark, d):
    return O.lines(table(spark, d, "chunks").where("text is not null"), "chunk_id").where(T.is_prose("line")).groupBy("chunk_id").agg(F.count("*").alias("prose"))


@query("f16_numeric_tokens", rf"SELECT chunk_id, len(list_filter({WS.format(c='text')}, lambda x: regexp_matches(x, '^[-+−]?[0-9][0-9.,]*%?$'))) AS numbers FROM chunks WHERE text IS NOT NULL")
def f16(spark, d):
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: T.is_numeric_token(x))
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", F.size(w).alias("numbers"))


@query("a12_vocabulary", r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '(\p{L}+(?:-\p{L}+)*)', 1)) AS w FROM chunks) GROUP BY w")
def a12(spark, d):
    return O.vocabulary(table(spark, d, "chunks"), "text")


@query("x28_hyphen_policy", r"""WITH v AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '(\p{L}+(?:-\p{L}+)*)', 1)) AS w FROM chunks) GROUP BY w),
h AS (SELECT split_part(w, '-', 1) AS l, sum(n) AS as_head FROM v WHERE w LIKE '%-%' GROUP BY 1)
SELECT left_part, right_part, expected, CASE WHEN coalesce(j.n, 0) + coalesce(k.n, 0) > 0 THEN CASE WHEN coalesce(k.n, 0) > coalesce(j.n, 0) THEN 'keep' ELSE 'join' END WHEN coalesce(as_head, 0) > 0 AND coalesce(r.n, 0) > 0 THEN 'keep' ELSE 'join' END AS decision
FROM hyphen_cases LEFT JOIN v j ON j.w = lower(left_part || right_part) LEFT JOIN v k ON k.w = lower(left_part || '-' || right_part) LEFT JOIN h ON h.l = lower(left_part) LEFT JOIN v r ON r.w = lower(right_part)""")
def x28(spark, d):
    return O.hyphen_policy(table(spark, d, "hyphen_cases"), O.vocabulary(table(spark, d, "chunks"), "text"), "left_part", "right_part")


_EDGE = r"""e AS (SELECT doc_hash, page, unnest([{'edge': 'top', 'line': ls[1]}, {'edge': 'bottom', 'line': ls[-1]}]) AS x FROM (SELECT doc_hash, page, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM chunks WHERE text IS NOT NULL) WHERE len(ls) > 0),
k AS (SELECT DISTINCT doc_hash, x.edge AS edge, trim(regexp_replace(regexp_replace(x.line, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key, page FROM e),
p AS (SELECT doc_hash, count(DISTINCT page) AS pages FROM chunks GROUP BY 1)"""


@query("a13_furniture", f"WITH {_EDGE} SELECT doc_hash, edge, key, count(*) AS n, (count(*) FILTER (page % 2 = 1) >= 3 OR count(*) FILTER (page % 2 = 0) >= 3 OR (count(*) >= 3 AND count(*) * 5 >= any_value(pages) * 2)) AS strong FROM k JOIN p USING (doc_hash) GROUP BY doc_hash, edge, key HAVING count(*) >= 2")
def a13(spark, d):
    return O.furniture(table(spark, d, "chunks"), "doc_hash", "page")


@query("a07_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def a07(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    p = lambda q, name: O.order_statistic(e, "event_type", "value", O.nearest_rank(q)).withColumnRenamed("value", name)
    return p(0.5, "p50").join(p(0.95, "p95"), "event_type")


@query("a08_rounded_rank", "SELECT doc_hash, list_sort(list(idx))[(round((count(*) - 1) * 0.95) + 1)::INT] AS p95 FROM extracted_refs WHERE idx IS NOT NULL GROUP BY 1")
def a08(spark, d):
    return O.order_statistic(table(spark, d, "extracted_refs"), "doc_hash", "idx", O.rounded_rank(0.95)).select("doc_hash", F.col("idx").alias("p95"))


@query("a10_median", "SELECT event_type, round(median(value), 9) AS median FROM events GROUP BY 1")
def a10(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    p = lambda up, name: O.order_statistic(e, "event_type", "value", lambda n: F.floor((n - 1 + up) / 2)).withColumnRenamed("value", name)
    return p(0, "a").join(p(1, "b"), "event_type").select("event_type", F.round((F.col("a") + F.col("b")) / 2, 9).alias("median"))


@query("a16_upper_median", "SELECT doc_hash, list_sort(list(length(raw)))[(count(*) // 2 + 1)::INT] AS med FROM extracted_refs WHERE raw IS NOT NULL GROUP BY 1")
def a16(spark, d):
    return O.order_statistic(table(spark, d, "extracted_refs").select("doc_hash", F.length("raw").alias("med")), "doc_hash", "med", O.upper_median)


@query("a28_ratio", "SELECT doc_hash, round(count(doi)::DOUBLE / nullif(count(*), 0), 6) AS r_null, round(coalesce(count(doi)::DOUBLE / nullif(count(year), 0), 0), 6) AS r_zero FROM extracted_refs GROUP BY 1")
def a28(spark, d):
    return table(spark, d, "extracted_refs").groupBy("doc_hash").agg(F.round(F.try_divide(F.count("doi"), F.count("*")), 6).alias("r_null"), F.round(F.coalesce(F.try_divide(F.count("doi"), F.count("year")), F.lit(0.0)), 6).alias("r_zero"))


@query("u09_merge_intervals", """SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 THEN 0 ELSE 1 END AS new
FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS e FROM events))) GROUP BY user_id, island""")
def u09(spark, d):
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return O.islands(table(spark, d, "events").select("user_id", s.alias("a"), (s + 1800).alias("b")), "user_id", "a", "b", 3600)


@query("w20_rate_slots", """SELECT event_id, i * 600 + max(t - i * 600) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS slot FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS i FROM events)""")
def w20(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return O.rate_slots(e, "user_id", "t", "event_id", 600).select("event_id", "slot")


@query("x19_word_alignment", None)
def x19(spark, d):
    x = table(spark, d, "extracted_refs").where("title is not null and raw is not null")
    return x.select("ref_id", O.word_alignment(T.normalize_title("title"), T.normalize_title("raw")).alias("a")).select("ref_id", "a.*")


@query("x27_word_error_rate", None)
def x27(spark, d):
    x = table(spark, d, "extracted_refs").where("title is not null")
    return x.select("ref_id", F.round(O.word_error_rate(T.normalize_title("title"), T.normalize_title("raw")), 6).alias("wer"))


@query("t10_longest_titles", "SELECT ref_id, length(title) AS n FROM extracted_refs WHERE title IS NOT NULL ORDER BY n DESC, ref_id LIMIT 30")
def t10(spark, d):
    return table(spark, d, "extracted_refs").where("title is not null").select("ref_id", F.length("title").alias("n")).orderBy(F.desc("n"), "ref_id").limit(30)


@query("q1_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q1(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("q5_nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def q5(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("s_nationkey").agg(F.sum("r").alias("r")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"))


@query("a29_customer_orders", "SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice) / nullif(count(o_orderkey), 0), 0), 6) AS mean_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def a29(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("s"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce(F.col("s") / F.col("orders"), F.lit(0.0)), 6).alias("mean_price"))


@query("a23_events_rollup", "SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def a23(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 6).alias("total"))
