"""One query for each scalar function: its value over every row of a whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import ids, text
from folioforge.plans.registry import QUERIES, SQL
from folioforge.session import table


def scalar(name: str, tab: str, key: str, value: Callable[[], Column], sql: str | None) -> None:
    """Register (key, value) of one function over a table; ``sql`` is the expression for the SQL side."""
    QUERIES[name] = lambda spark, d, t=tab, k=key, v=value: table(spark, d, t).select(F.col(k), v().alias("value"))
    if sql:
        SQL[name] = f"SELECT {key}, {sql} AS value FROM {tab}"


NT = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NT + ", ' '), lambda x: x <> '')"
nt, wd = (lambda c: NT.format(c=c)), (lambda c: WORDS.format(c=c))
joined = lambda c: F.array_join(c, " ")
collapse = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
LIG = "replace(replace(replace(replace(replace(replace(replace({c}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st')"

scalar("x01_normalize_title", "extracted_refs", "ref_id", lambda: text.normalize_title("title"), nt("title"))
scalar("x03_words", "extracted_refs", "ref_id", lambda: joined(text.words("title")), f"array_to_string({wd('title')}, ' ')")
scalar("x04_alignment_words", "extracted_refs", "ref_id", lambda: joined(text.alignment_words("title")), f"array_to_string(list_filter({wd('title')}, lambda x: NOT regexp_matches(x, '^[0-9]+$')), ' ')")
scalar("x05_digit_key", "extracted_refs", "ref_id", lambda: text.digit_key("raw"), r"trim(regexp_replace(regexp_replace(raw, '[0-9]+', '#', 'g'), '\s+', ' ', 'g'))")
scalar("x06_short_digit_key", "extracted_refs", "ref_id", lambda: text.short_digit_key("raw"),
       "array_to_string(list_transform(regexp_extract_all(raw, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]{1,3}$') THEN '#' ELSE x END), '')")
scalar("x12_long_words", "extracted_refs", "ref_id", lambda: F.size(text.long_words("title")), f"len(list_distinct(list_filter({wd('title')}, lambda x: length(x) >= 4)))")
scalar("x11_title_overlap", "extracted_refs", "ref_id", lambda: F.round(text.title_overlap("title", "raw"), 6),
       f"CASE WHEN len(list_distinct(list_filter({wd('title')}, lambda x: length(x) >= 4))) >= 2 THEN round(len(list_intersect(list_distinct(list_filter({wd('title')}, lambda x: length(x) >= 4)), {wd('raw')}))::DOUBLE / len(list_distinct(list_filter({wd('title')}, lambda x: length(x) >= 4))), 6) END")
# DuckDB's levenshtein counts bytes, so these two, over whole texts and the stored letters, have no SQL and are tested by brute force
scalar("x09_similarity", "extracted_refs", "ref_id", lambda: F.round(text.similarity(F.coalesce("author", F.lit("")), F.coalesce("surname", F.lit(""))), 6), None)
scalar("x10_title_agreement", "extracted_refs", "ref_id", lambda: F.round(text.title_agreement(F.coalesce("title", F.lit("")), F.coalesce("raw", F.lit(""))), 6), None)
scalar("u05_jaccard", "extracted_refs", "ref_id", lambda: F.round(text.jaccard(F.array_distinct(text.words(F.coalesce("title", F.lit("")))), F.array_distinct(text.words("raw"))), 6),
       f"CASE WHEN len({wd(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}) = 0 OR len({wd('raw')}) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct({wd('coalesce(title, ' + chr(39) * 2 + ')')}), list_distinct({wd('raw')})))::DOUBLE / len(list_distinct(list_concat({wd('coalesce(title, ' + chr(39) * 2 + ')')}, {wd('raw')}))), 6) END")
scalar("x17_author_year_key", "extracted_refs", "ref_id", lambda: ids.author_year_key("surname", "year"), f"CASE WHEN year IS NOT NULL AND {nt('surname')} <> '' THEN {nt('surname')} || '|' || year::VARCHAR END")
scalar("x21_join_break_hyphens", "chunks", "chunk_id", lambda: text.join_break_hyphens("text"), r"regexp_replace(text, '(\p{L})-\s+(\p{L})', '\1\2', 'g')")
scalar("x24_collapse_whitespace", "chunks", "chunk_id", lambda: text.collapse("text"), collapse.format(c="text"))
scalar("x25_leading_words", "chunks", "chunk_id", lambda: text.leading_words("text", 12), f"array_to_string(list_slice(string_split({collapse.format(c='text')}, ' '), 1, 12), ' ')")
scalar("x26_fts_query", "extracted_refs", "ref_id", lambda: text.fts_terms("title"), f"CASE WHEN len({wd('title')}) > 0 THEN '\"' || array_to_string({wd('title')}, '\" OR \"') || '\"' END")
scalar("x30_script_form", "extracted_refs", "ref_id", lambda: text.script_form(F.col("year").cast("string")), "translate(year::VARCHAR, '0123456789+-=()', '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾')")
scalar("x31_expand_ligatures", "extracted_refs", "ref_id", lambda: text.expand_ligatures("title"), LIG.format(c="title"))
scalar("x33_safe_file_stem", "extracted_refs", "ref_id", lambda: text.safe_file_stem(F.coalesce("title", F.lit(""))),
       r"CASE WHEN regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'file' ELSE substring(regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) END")
scalar("x34_short_hash", "chunks", "chunk_id", lambda: F.substring("doc_hash", 1, 12), "substring(doc_hash, 1, 12)")
scalar("x35_strip_label", "extracted_refs", "ref_id", lambda: text.strip_label("raw"), r"regexp_replace(raw, '^\s*(?:\[[^\]]{1,12}\]|[0-9]{1,4}[.)])\s*', '')")
scalar("a35_label_style", "extracted_refs", "ref_id", lambda: text.reference_label("raw"),
       r"CASE WHEN regexp_matches(raw, '^\s*\[[0-9]+\]') THEN 'bracket' WHEN regexp_matches(raw, '^\s*[0-9]{1,4}\.') THEN 'dot' WHEN regexp_matches(raw, '^\s*[0-9]{1,4}\)') THEN 'paren' ELSE 'none' END")
scalar("x67_normalize_doi", "extracted_refs", "ref_id", lambda: ids.normalize_doi("doi"), None)
scalar("x68_loose_doi", "extracted_refs", "ref_id", lambda: ids.loose_doi("doi"), r"regexp_replace(regexp_replace(lower(trim(doi)), '^.*?(10\.[0-9]{4,9}/)', '\1'), '[.,;:)\]}'']+$', '')")
SQL["x67_normalize_doi"] = r"""SELECT ref_id, CASE WHEN regexp_matches(d, '^10\.[0-9]{4,9}/\S+$') THEN d END AS value FROM (
SELECT ref_id, CASE WHEN d LIKE '%)' AND length(d) - length(replace(d, ')', '')) > length(d) - length(replace(d, '(', '')) THEN substring(d, 1, length(d) - 1) ELSE d END AS d FROM (
SELECT ref_id, regexp_replace(regexp_replace(lower(trim(doi)), '^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*', ''), '[.,;:\s]+$', '') AS d FROM extracted_refs))"""
scalar("x72_scan_dois", "extracted_refs", "ref_id", lambda: joined(ids.scan_dois(F.concat_ws(" ", "raw", "doi"))), None)
_LOOSE = r"regexp_replace(regexp_replace(lower(trim(doi)), '^.*?(10\.[0-9]{4,9}/)', '\1'), '[.,;:)\]}'']+$', '')"
scalar("f30_placeholder_doi", "extracted_refs", "ref_id", lambda: ids.is_placeholder_doi("doi"), f"{_LOOSE} IN ('10.1145/1122445.1122456', '10.475/123_4') OR regexp_matches({_LOOSE}, '^[^/]*/[nx._#-]+$')")
scalar("x77_normalize_arxiv", "latex_refs", "truth_id", lambda: ids.normalize_arxiv("arxiv_id"),
       r"CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/|^arxiv:\s*', ''), 'v[0-9]+$|\.pdf$', ''), '^(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})$') THEN regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/|^arxiv:\s*', ''), 'v[0-9]+$|\.pdf$', '') END")
scalar("x79_find_arxiv", "latex_refs", "truth_id", lambda: ids.find_arxiv("text"), r"nullif(regexp_extract(lower(text), 'arxiv[:\s]+\s*([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})', 1), '')")
scalar("x82_normalize_pmid", "manifest_item", "doc_hash", lambda: ids.normalize_pmid("pmid"), "CASE WHEN pmid IS NOT NULL THEN pmid::VARCHAR END")
scalar("x83_normalize_pmcid", "manifest_item", "doc_hash", lambda: ids.normalize_pmcid("pmcid"), "CASE WHEN regexp_matches(upper(trim(pmcid)), '^PMC[0-9]{1,10}$') THEN upper(trim(pmcid)) END")
scalar("x84_arxiv_from_doi", "extracted_refs", "ref_id", lambda: ids.arxiv_from_doi("doi"), r"nullif(regexp_extract(lower(doi), '^10\.48550/arxiv\.(.+)$', 1), '')")
scalar("x85_find_year", "extracted_refs", "ref_id", lambda: ids.find_year("raw"),
       r"coalesce(nullif(regexp_extract(raw, '\(((?:19|20)[0-9]{2})[a-z]?\)', 1), ''), nullif(regexp_extract(raw, '(?:^|[^0-9–\-—])((?:19|20)[0-9]{2})(?:[–\-][a-z](?:[^\p{L}0-9]|$)|[a-z]?(?:[^0-9–\-—]|$))', 1), ''))::INT")
scalar("x87_first_year", "latex_refs", "truth_id", lambda: ids.first_year("text"), r"nullif(regexp_extract(text, '\b((?:18|19|20)[0-9]{2})\b', 1), '')::INT")
scalar("x86_all_years", "chunks", "chunk_id", lambda: F.array_join(ids.all_years("text").cast("array<string>"), " "), r"array_to_string(regexp_extract_all(text, '\b((?:18|19|20)[0-9]{2})\b', 1), ' ')")
scalar("x89_year_from_arxiv", "latex_refs", "truth_id", lambda: ids.year_from_arxiv("arxiv_id"),
       r"CASE WHEN nullif(regexp_extract(arxiv_id, '^(?:[a-z.-]+/)?([0-9]{2})', 1), '')::INT >= 90 THEN nullif(regexp_extract(arxiv_id, '^(?:[a-z.-]+/)?([0-9]{2})', 1), '')::INT + 1900 ELSE nullif(regexp_extract(arxiv_id, '^(?:[a-z.-]+/)?([0-9]{2})', 1), '')::INT + 2000 END")
scalar("x90_year_from_doi", "extracted_refs", "ref_id", lambda: ids.year_from_doi("doi"), r"CASE WHEN NOT contains(lower(doi), 'arxiv') THEN nullif(regexp_extract(lower(doi), '[./](19[0-9]{2}|20[0-9]{2})(?:[./]|$)', 1), '')::INT END")
scalar("x94_year_from_date", "runs", "run_id", lambda: ids.year_from_date(F.col("landed_at").cast("string")), "extract(year FROM landed_at)::INT")
_W14 = r"string_split(trim(regexp_replace(authors[1], '\s+', ' ', 'g')), ' ')"
scalar("x14_family_of", "latex_refs", "truth_id", lambda: ids.family_of(F.get("authors", F.lit(0))),
       f"CASE WHEN regexp_matches({_W14}[-2], '^\\p{{Ll}}') AND strlen({_W14}[-2]) <= 4 THEN {_W14}[-2] || ' ' || {_W14}[-1] ELSE {_W14}[-1] END")
scalar("x15_printed_family", "extracted_refs", "ref_id", lambda: ids.printed_family("author"),
       r"CASE WHEN contains(trim(author), ',') THEN trim(split_part(trim(author), ',', 1)) ELSE regexp_extract(trim(author), '((?:(?:van|von|de|di|da|du|der|den|del|la|le)\s+)*\S+)$', 1) END")
_W27 = r"list_transform(list_filter(regexp_split_to_array(trim(author), '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[,()]+|[,()]+$', '', 'g'))"
_IN = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
_ASIDE = f"(w IN {_IN(ids.NAME_PARTICLES)} OR lower(rtrim(w, '.')) IN {_IN(ids.NAME_SUFFIXES)})"
scalar("f27_person_name", "extracted_refs", "ref_id", lambda: ids.looks_like_person("author"),
       rf"CASE WHEN author IS NOT NULL THEN len({_W27}) BETWEEN 2 AND 6 AND len(list_filter({_W27}, lambda w: NOT (length(w) BETWEEN 1 AND 25 AND ({_ASIDE} OR regexp_matches(w, '^\p{{Lu}}[\p{{L}}''’.-]*$'))))) = 0 AND len(list_filter({_W27}, lambda w: NOT {_ASIDE})) >= 2 END")
scalar("f26_author_generic", "extracted_refs", "ref_id", lambda: ids.author_is_generic("author"),
       rf"lower(trim(author)) IN {_IN(ids.GENERIC_AUTHORS)} OR NOT regexp_matches(lower(trim(author)), '\p{{L}}')")
scalar("f25_title_generic", "extracted_refs", "ref_id", lambda: ids.title_is_generic("title"),
       rf"lower(trim(title)) IN {_IN(ids.GENERIC_TITLES)} OR regexp_matches(lower(trim(title)), '^microsoft (?:word|powerpoint)|\.(?:{ids.FILE_ENDINGS})$') OR NOT regexp_matches(lower(trim(title)), '\p{{L}}') OR (NOT contains(lower(trim(title)), ' ') AND regexp_matches(lower(trim(title)), '[._]'))")
scalar("f28_reference_evidence", "extracted_refs", "ref_id", lambda: text.has_reference_evidence("raw"), r"regexp_matches(raw, '\b(?:1[89]|20)[0-9]{2}\b|10\.[0-9]{4,9}/|https?://|\b[0-9]+[–-][0-9]+\b')")
scalar("f29_author_year_start", "extracted_refs", "ref_id", lambda: text.is_author_year_start("raw"), r"regexp_matches(raw, '^\s*\p{Lu}[\p{L}’''-]+(?:,\s*\p{Lu}|\s+\p{Lu}{1,3}\b)')")
scalar("f22_replacement_share", "documents", "doc_id", lambda: F.round(text.replacement_share("text"), 6),
       "CASE WHEN length(text) > 0 THEN round((length(text) - length(regexp_replace(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]', '', 'g')))::DOUBLE / length(text), 6) ELSE 0.0 END")
scalar("f21_looks_scanned", "documents", "doc_id", lambda: F.length(F.regexp_replace("text", r"\s", "")) < 20, r"length(regexp_replace(text, '\s', '', 'g')) < 20")
scalar("f17_math_share", "documents", "doc_id", lambda: F.round(text.math_share("text"), 6),
       r"CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 THEN round(length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[^=+<>≤≥±×÷∑∫√∂∞≈∝∈∀∃→←−*/^|]', '', 'g'))::DOUBLE / length(regexp_replace(text, '\s', '', 'g')), 6) ELSE 0.0 END")
scalar("x104_cited_numbers", "chunks", "chunk_id", lambda: F.size(F.flatten(F.transform(text.markers("text"), lambda m: text.cited_numbers(m)))), None)
scalar("d36_numeric_markers", "chunks", "chunk_id", lambda: F.array_join(text.markers("text"), " "), r"array_to_string(regexp_extract_all(text, '(\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\])', 1), ' ')")
scalar("a19_digit_bag", "extracted_refs", "ref_id", lambda: joined(text.digit_bag("title")), "array_to_string(list_sort(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: NOT regexp_matches(x, '^(1[89]|20)[0-9]{2}$'))), ' ')")
scalar("f33_digits_conflict", "extracted_refs", "ref_id", lambda: text.digits_conflict(text.digit_bag(F.coalesce("title", F.lit(""))), text.digit_bag(F.coalesce("raw", F.lit("")))),
       "len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0 AND len(list_filter({b}, lambda x: NOT list_contains({a}, x))) > 0".format(**{k: f"list_filter(regexp_extract_all(coalesce({c}, ''), '[0-9]+'), lambda y: NOT regexp_matches(y, '^(1[89]|20)[0-9]{{2}}$'))" for k, c in (("a", "title"), ("b", "raw"))}))
scalar("x115_sha256", "chunks", "chunk_id", lambda: F.sha2("text", 256), "sha256(text)")
scalar("x116_config_digest", "runs", "run_id", lambda: ids.config_digest(F.create_map(F.lit("backend"), "backend_name", F.lit("version"), "backend_version", F.lit("schema"), F.col("schema_version").cast("string"))),
       "sha256('backend=' || backend_name || chr(10) || 'schema=' || schema_version::VARCHAR || chr(10) || 'version=' || backend_version || chr(10))")
scalar("x117_range_digest", "chunks", "chunk_id", lambda: F.sha2(F.concat_ws(":", "doc_hash", F.col("page").cast("string"), F.col("idx").cast("string")), 256), "sha256(doc_hash || ':' || page::VARCHAR || ':' || idx::VARCHAR)")
scalar("x118_fingerprint", "runs", "run_id", lambda: F.sha2(F.concat_ws("|", *[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("doc_hash", "backend_name", "backend_version", "config_digest")]), 256),
       "sha256(" + " || '|' || ".join(f"length({c})::VARCHAR || ':' || {c}" for c in ("doc_hash", "backend_name", "backend_version", "config_digest")) + ")")
scalar("x120_civil_days", "orders", "o_orderkey", lambda: F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")), "datediff('day', DATE '1970-01-01', o_orderdate::DATE)")
scalar("x124_positive", "customer", "c_custkey", lambda: F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), "CASE WHEN c_acctbal > 0 THEN c_acctbal END")
scalar("x125_json_field", "events", "event_id", lambda: F.get_json_object("props", "$.k").cast("bigint"), "json_extract_string(props, '$.k')::BIGINT")
scalar("x128_split_keywords", "manifest_item", "doc_hash", lambda: F.array_join(text.split_keywords("title"), "|"), "array_to_string(list_filter(list_transform(regexp_split_to_array(title, '[,;·]'), lambda x: trim(x)), lambda x: x <> ''), '|')")
scalar("x130_candidates", "manifest_item", "doc_hash", lambda: F.concat_ws(" ", F.concat(F.lit("https://doi.org/"), F.col("doi")), F.concat(F.lit("https://example.org/articles/"), F.col("pmcid"), F.lit("/pdf"))),
       "concat_ws(' ', 'https://doi.org/' || doi, 'https://example.org/articles/' || pmcid || '/pdf')")
scalar("x54_media_type", "runs", "run_id", lambda: F.lower(F.trim(F.split_part(F.concat("backend_name", F.lit("; v="), "backend_version"), F.lit(";"), F.lit(1)))), "lower(trim(backend_name))")
scalar("f04_extraction_status", "runs", "run_id", lambda: F.exists(F.coalesce(F.from_json("warnings_json", "array<string>"), F.array().cast("array<string>")), lambda w: w.rlike("^(failed|resource_limit|unicode_mapping|extraction_incomplete):")),
       "len(list_filter(coalesce(from_json(warnings_json, '[\"VARCHAR\"]'), []), lambda w: regexp_matches(w, '^(failed|resource_limit|unicode_mapping|extraction_incomplete):'))) > 0")
scalar("x13_verify_record", "extracted_refs", "ref_id", lambda: text.verify_record("title", "surname", "year", "raw")["reason"], None)
scalar("x08_fold_ascii", "extracted_refs", "ref_id", lambda: text.fold_ascii("surname"), None)
scalar("f20_page_route", "chunks", "chunk_id", lambda: text.page_route("text")["reason"],
       r"CASE WHEN length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) = 0 THEN 'empty' WHEN (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\x{FFFD}\x{E000}-\x{F8FF}]', '', 'g')))::DOUBLE / length(text) >= 0.01 THEN 'damaged' ELSE 'ok' END")
scalar("f45_glued_marker", "chunks", "chunk_id", lambda: text.glued_marker("text"), r"regexp_matches(text, '\p{L}\[[0-9]+\]\p{L}')")
scalar("x97_numbers", "extracted_refs", "ref_id", lambda: F.concat_ws("|", F.coalesce(text.bibliographic_numbers("raw")["volume"], F.lit("")), F.coalesce(text.bibliographic_numbers("raw")["pages"], F.lit(""))),
       r"coalesce(nullif(regexp_extract(raw, 'vol\.\s*([0-9]+)(?:,\s*no\.\s*([0-9]+))?,\s*pp\.\s*([0-9]+\s*[–-]\s*[0-9]+)', 1), ''), nullif(regexp_extract(raw, '([0-9]+)\s*(?:\(([0-9]+)\))?\s*[,:]\s*([0-9]+\s*[–-]\s*[0-9]+)', 1), ''), '') || '|' || coalesce(regexp_replace(coalesce(nullif(regexp_extract(raw, 'vol\.\s*([0-9]+)(?:,\s*no\.\s*([0-9]+))?,\s*pp\.\s*([0-9]+\s*[–-]\s*[0-9]+)', 3), ''), nullif(regexp_extract(raw, '([0-9]+)\s*(?:\(([0-9]+)\))?\s*[,:]\s*([0-9]+\s*[–-]\s*[0-9]+)', 3), '')), '\s', '', 'g'), '')")
scalar("x102_quoted_title", "extracted_refs", "ref_id", lambda: text.quoted_title("raw"), "nullif(regexp_extract(raw, '[“\"]([^“”\"]{4,}?),?[”\"]', 1), '')")
scalar("x103_find_url", "extracted_refs", "ref_id", lambda: text.find_url("raw"), r"""nullif(regexp_replace(regexp_extract(raw, '(https?://[^\s<>"]+)', 1), '[.,;)\]]+$', ''), '')""")
scalar("t11_byte_prefix", "extracted_refs", "ref_id", lambda: text.byte_prefix("title", 40),
       "CASE WHEN strlen(title) <= 40 THEN title WHEN title IS NOT NULL THEN substring(title, 1, list_max(list_filter(range(0, 41), lambda k: strlen(substring(title, 1, k::INT)) <= 40))::INT) END")
scalar("u06_multiset_overlap", "extracted_refs", "ref_id", lambda: text.multiset_overlap(text.words(F.coalesce("title", F.lit(""))), text.words(F.coalesce("raw", F.lit("")))),
       "coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)::INT".format(a=wd("coalesce(title, '')"), b=wd("coalesce(raw, '')")))
