"""SQL of the queries of scores and audits."""

from __future__ import annotations

from vellum.functions.text import SYNONYMS
from vellum.operators import answers as A
from vellum.plans.scoring import UNIT

_A = "a AS (SELECT DISTINCT * FROM agent_cases)"
_H = "h AS (SELECT DISTINCT * EXCLUDE (query_id), query_id AS case_id FROM search_hits WHERE query_id IS NOT NULL)"
_PQ = "pq AS (SELECT DISTINCT * FROM page_quality)"
_V = "v AS (SELECT DISTINCT * FROM version_manifest)"
_S = "s AS (SELECT DISTINCT * FROM source_manifest)"
_F = f"{_A}, f0 AS (SELECT case_id, unnest(expected_facts) AS f FROM a), f AS (SELECT case_id, f.fact_id AS fact_id, unnest(f.acceptable_values) AS value FROM f0)"
_G = f"{_A}, g0 AS (SELECT case_id, split, unnest(evidence_sources) AS e FROM a), g AS (SELECT case_id, split, e.document_key AS document_key, e.pages AS pages FROM g0 WHERE e.document_key IS NOT NULL)"
_B = "b AS (SELECT document_key, page_number, proof_id, section, cell_value, value_bbox.x0 AS x0, value_bbox.y0 AS y0, value_bbox.x1 AS x1, value_bbox.y1 AS y1 FROM (SELECT DISTINCT * FROM cell_proofs) WHERE value_bbox IS NOT NULL AND document_key IS NOT NULL AND page_number IS NOT NULL)"
_OCR = "coalesce(extraction_route IN ('partial_ocr', 'full_ocr'), false)"
_PLAIN = "translate(replace(replace(cell_value, ',', ''), '+', ''), '−', '-')"
_BARE = r"regexp_replace({}, '[\s,，]', '', 'g')"
_LANES = f"""{_PQ}, l AS (SELECT coalesce(extraction_route, '(none)') AS lane, count(*) AS cases, round(avg(CAST(char_count > 0 AS INT)), 6) AS has_text, round(avg(CAST(replacement_char_ratio > 0 AS INT)), 6) AS replaced, round(avg(CAST(coalesce(ocr_succeeded, false) AS INT)) FILTER (coalesce(ocr_attempted, false)), 6) AS succeeded FROM pq GROUP BY 1)"""
_ROUTED = f"""{_G}, {_H}, w AS (SELECT case_id, split, list_distinct(list(document_key)) AS e FROM g GROUP BY 1, 2), r AS (SELECT case_id, list_distinct(list(document_key)) AS a FROM h WHERE document_key IS NOT NULL GROUP BY 1),
      x AS (SELECT w.case_id, split, list_sort(list_filter(e, lambda i: NOT list_contains(r.a, i))) AS missing, list_sort(list_filter(r.a, lambda i: NOT list_contains(e, i))) AS extra FROM w JOIN r ON w.case_id = r.case_id)"""
_COV = f"""f1 AS (SELECT DISTINCT case_id, fact_id FROM f WHERE value IS NOT NULL), m AS (SELECT DISTINCT f.case_id, f.fact_id FROM f JOIN h ON h.case_id = f.case_id WHERE text IS NOT NULL AND {_BARE.format('value')} <> '' AND contains({_BARE.format('text')}, {_BARE.format('value')})),
      cov AS (SELECT f1.case_id, count(*) AS facts, count(m.fact_id) AS covered, round(count(m.fact_id) / count(*), 6) AS coverage FROM f1 LEFT JOIN m ON m.case_id = f1.case_id AND m.fact_id IS NOT DISTINCT FROM f1.fact_id GROUP BY 1)"""
_SCORED = f"""{_F}, g0 AS (SELECT case_id, split, unnest(evidence_sources) AS e FROM a), g AS (SELECT case_id, e.document_key AS document_key FROM g0), {_H}, {_COV}, hit AS (SELECT DISTINCT h.case_id FROM h JOIN g ON g.case_id = h.case_id AND g.document_key = h.document_key), z AS (SELECT DISTINCT case_id FROM h),
      sc AS (SELECT a.case_id, split, coalesce(coverage, 0) AS coverage, hit.case_id IS NOT NULL AS source_found, hit.case_id IS NOT NULL AND coalesce(coverage, 0) = 1 AS passed, z.case_id IS NOT NULL AS searched FROM a LEFT JOIN cov ON cov.case_id = a.case_id LEFT JOIN hit ON hit.case_id = a.case_id LEFT JOIN z ON z.case_id = a.case_id)"""
_CAND = f"""{_PQ}, k AS (SELECT document_key, page_number, unnest(list_filter([CASE WHEN needs_ocr THEN {{'label': 'needs_recognition', 'score': CAST(coalesce(image_count, 0) AS DOUBLE)}} END, CASE WHEN char_count < 100 THEN {{'label': 'sparse', 'score': CAST(100 - char_count AS DOUBLE)}} END,
      CASE WHEN image_count >= 2 THEN {{'label': 'pictures', 'score': CAST(image_count AS DOUBLE)}} END, CASE WHEN replacement_char_ratio > 0.01 THEN {{'label': 'damaged', 'score': round(replacement_char_ratio * 1000, 6)}} END], lambda x: x IS NOT NULL)) AS c FROM (SELECT DISTINCT document_key, page_number, needs_ocr, char_count, image_count, replacement_char_ratio FROM pq WHERE document_key IS NOT NULL)),
      cand AS (SELECT document_key, page_number, c.label AS label, c.score AS label_score FROM k)"""
_NUMS = r"list_distinct(list_filter(list_transform(regexp_extract_all({}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: NOT regexp_matches(x, '^(?:19[0-9][0-9]|20[0-9][0-9]|2100)$')))"


def _expanded(query: str) -> str:
    for alias, wording in SYNONYMS.items():
        query = f"replace({query}, '{alias}', '{wording}')"
    return query


def _metrics(query: str) -> str:
    names = "|".join(sorted(A.CANONICAL, key=len, reverse=True))
    canonical = "MAP {" + ", ".join(f"'{n}': '{m}'" for n, m in A.CANONICAL.items()) + "}"
    return f"list_distinct(list_transform(regexp_extract_all({query}, '({names})', 1), lambda n: {canonical}[n]))"


def _named(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{'|'.join(names)}') THEN '{metric}' END" for metric, names in A.EVIDENCE_NAMES.items()) + "], lambda x: x IS NOT NULL)"


SQL = {
    "m_complete_hits": 'WITH h AS (SELECT DISTINCT * FROM search_hits) SELECT count_if(score IS NOT NULL AND lexical_rank IS NOT NULL AND dense_rank IS NOT NULL AND hit_rank IS NOT NULL) AS complete, count(*) AS "rows" FROM h',
    "m_lane_rates": f"WITH {_LANES} SELECT * FROM l",
    "m_lane_deltas": f"""WITH {_LANES}, d AS (SELECT unnest(['has_text', 'replaced']) AS metric), p AS (SELECT metric, max(CASE WHEN lane = 'native' THEN CASE metric WHEN 'has_text' THEN has_text ELSE replaced END END) AS base, max(CASE WHEN lane = 'full_ocr' THEN CASE metric WHEN 'has_text' THEN has_text ELSE replaced END END) AS other FROM d, l GROUP BY 1)
      SELECT *, round(other - base, 6) AS delta FROM p""",
    "m_cell_agreement": f"""WITH p AS (SELECT DISTINCT table_id, row_label, column_label, {_PLAIN} AS v FROM cell_proofs WHERE table_id IS NOT NULL), x AS (SELECT DISTINCT table_id, row_label, column_label, {_PLAIN} AS v FROM extracted_cells WHERE table_id IS NOT NULL),
      i AS (SELECT table_id, count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM x) GROUP BY 1), e AS (SELECT table_id, count(*) AS n FROM p GROUP BY 1), k AS (SELECT table_id, count(*) AS n FROM x GROUP BY 1), t AS (SELECT table_id FROM e UNION SELECT table_id FROM k),
      c AS (SELECT t.table_id, coalesce(e.n, 0) AS expected, coalesce(k.n, 0) AS found, coalesce(i.n, 0) AS shared FROM t LEFT JOIN e USING (table_id) LEFT JOIN k USING (table_id) LEFT JOIN i USING (table_id)), u AS (SELECT * FROM c UNION ALL SELECT '(all)', CAST(coalesce(sum(expected), 0) AS BIGINT), CAST(coalesce(sum(found), 0) AS BIGINT), CAST(coalesce(sum(shared), 0) AS BIGINT) FROM c)
      SELECT *, round(coalesce(shared / nullif(found, 0), 0), 6) AS precision, round(coalesce(shared / nullif(expected, 0), 0), 6) AS recall, round(coalesce(2 * shared / nullif(found + expected, 0), 0), 6) AS f1 FROM u""",
    "m_area_ratios": f"WITH {_B} SELECT document_key, page_number, round(least(1.0, sum((x1 - x0) * (y1 - y0)) / (595.0 * 842.0)), 6) AS area_ratio FROM b GROUP BY 1, 2",
    "m_grid_supports": f"WITH {_B}, c AS (SELECT document_key, page_number, round(x0 / 15) AS x, count(DISTINCT round(y0 / 4)) AS n FROM b GROUP BY ALL) SELECT document_key, page_number, count_if(n >= 2) AS columns, max(n) AS widest FROM c GROUP BY 1, 2",
    "m_page_lines": f"WITH {_B} SELECT document_key, page_number, CAST(count(*) AS INT) AS spans, sha256(string_agg(cell_value, chr(10) ORDER BY y0, x0, proof_id)) AS digest FROM b WHERE cell_value IS NOT NULL GROUP BY 1, 2",
    "m_sections_above": f"WITH {_B} SELECT proof_id, last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY document_key ORDER BY page_number, y0, x0, proof_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_above FROM b",
    "m_source_differences": f"WITH {_ROUTED} SELECT case_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, len(missing) = 0 AND len(extra) = 0 AS exact FROM x",
    "m_routing_rates": f"WITH {_ROUTED} SELECT split, count(*) AS cases, round(avg(CAST(len(missing) > 0 AS INT)), 6) AS miss_rate, round(avg(CAST(len(extra) > 0 AS INT)), 6) AS extra_rate, round(avg(CAST(len(missing) = 0 AND len(extra) = 0 AS INT)), 6) AS exact_rate FROM x GROUP BY 1",
    "m_fact_coverage": f"WITH {_F}, {_H}, {_COV} SELECT * FROM cov",
    "m_case_scores": f"WITH {_SCORED} SELECT * FROM sc",
    "m_suite_metrics": f"WITH {_SCORED}, k AS (SELECT split, count(*) AS cases, count_if(searched) AS supported, count_if(passed) AS passed FROM sc GROUP BY 1) SELECT *, round(passed / nullif(supported, 0), 6) AS supported_rate, round(passed / cases, 6) AS end_to_end_rate FROM k",
    "m_recall_failures": f"""WITH {_G}, {_H}, k AS (SELECT DISTINCT case_id, document_key FROM g), r AS (SELECT k.case_id, min(lexical_rank) AS l, min(dense_rank) AS d FROM k LEFT JOIN h ON h.case_id = k.case_id AND h.document_key = k.document_key GROUP BY 1)
      SELECT CASE WHEN coalesce(l <= 5, false) AND coalesce(d <= 5, false) THEN 'found' WHEN coalesce(l <= 5, false) THEN 'lexical_only' WHEN coalesce(d <= 5, false) THEN 'dense_only' WHEN l IS NOT NULL OR d IS NOT NULL THEN 'ranked_low' ELSE 'not_retrieved' END AS failure, count(*) AS cases FROM r GROUP BY 1""",
    "m_review_agreement": f"WITH {_PQ} SELECT coalesce(extraction_route, '(none)') AS route, count(*) AS pages, round(avg(CAST(coalesce(needs_ocr, false) = {_OCR} AS INT)), 6) AS agreement FROM pq GROUP BY 1",
    "m_page_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "m_top_candidates": f"WITH {_CAND}, r AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY label_score DESC, document_key, page_number) AS INT) AS place, document_key, page_number, label_score FROM cand WHERE document_key IN (SELECT document_key FROM source_manifest WHERE split IN ('calibration', 'dev') AND document_key IS NOT NULL)) SELECT * FROM r WHERE place <= 3",
    "m_scan_coverage": f"WITH {_PQ} SELECT CASE WHEN NOT coalesce(ocr_attempted, false) THEN 'not_tried' WHEN coalesce(ocr_succeeded, false) THEN 'recognised' ELSE 'failed' END AS state, count(*) AS pages, count_if(ocr_char_count IS NULL) AS without_count FROM pq WHERE needs_ocr GROUP BY 1",
    "m_active_versions": f"WITH {_V}, k AS (SELECT document_key, min(report_year) AS report_year, min(source) AS source FROM source_manifest GROUP BY 1) SELECT version_id, v.document_key, report_year, source FROM v JOIN k ON k.document_key = v.document_key WHERE status = 'active'",
    "m_query_instances": f"WITH {_A}, q AS (SELECT case_id, query, {_expanded('query')} AS w FROM a WHERE query IS NOT NULL) SELECT case_id, 'canonical' AS kind, sha256(query) AS text_hash FROM q UNION ALL SELECT case_id, 'variant', sha256(w) FROM q WHERE w <> query",
    "m_answerable_rows": f"WITH {_A} SELECT case_id, query, coalesce(array_to_string(list_transform(expected_facts, lambda f: coalesce(f.acceptable_values[1], '')), '|'), '') AS reference FROM a WHERE expected_behavior = 'answer' AND query IS NOT NULL",
    "m_tuning_items": f"WITH {_A} SELECT split, task_type, count(*) AS items FROM a WHERE split IN ('calibration', 'dev') GROUP BY 1, 2",
    "m_run_eligibility": f"""WITH {_G}, {_H}, r AS (SELECT case_id, count(*) AS n, min(hit_rank) AS first FROM h GROUP BY 1), k AS (SELECT DISTINCT case_id FROM g)
      SELECT CASE WHEN a.split IS NULL THEN 'no_split' WHEN NOT coalesce(trim(query) <> '', false) THEN 'no_query' WHEN n IS NULL THEN 'not_run' WHEN NOT coalesce(first = 1, false) THEN 'no_first_hit' WHEN k.case_id IS NULL THEN 'no_gold' WHEN source IS NULL THEN 'no_source' ELSE 'eligible' END AS gate, count(*) AS cases FROM a LEFT JOIN r ON r.case_id = a.case_id LEFT JOIN k ON k.case_id = a.case_id GROUP BY 1""",
    "m_corpus_plan": f"""WITH {_S} SELECT coalesce(split, '(none)') AS split, count(*) AS "rows", count(DISTINCT document_key) AS documents, count(DISTINCT security_code) AS issuers, CAST(coalesce(sum(question_target), 0) AS BIGINT) AS questions FROM s GROUP BY 1""",
    "m_number_bindings": f"""WITH {_F}, {_H}, x AS (SELECT DISTINCT case_id, fact_id, unnest({_NUMS.format('value')}) AS n FROM f WHERE value IS NOT NULL), x2 AS (SELECT case_id, fact_id, n FROM (SELECT case_id, fact_id, value, unnest({_NUMS.format('value')}) AS n FROM f WHERE value IS NOT NULL)), y AS (SELECT case_id, hit_id, unnest({_NUMS.format('text')}) AS n FROM h WHERE text IS NOT NULL),
      j AS (SELECT x2.case_id, fact_id, hit_id, count(*) AS shared FROM x2 JOIN y ON x2.case_id = y.case_id AND x2.n = y.n GROUP BY ALL) SELECT case_id, fact_id, hit_id, shared, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, fact_id ORDER BY shared DESC, hit_id) AS INT) AS place FROM j) WHERE place <= 4""",
    "m_best_citations": f"WITH {_H} SELECT case_id, hit_id, score FROM (SELECT case_id, hit_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, hit_id) AS r FROM h WHERE score IS NOT NULL) WHERE r = 1",
    "m_citation_numbers": f"WITH {_A}, {_H}, k AS (SELECT split, chunk_id, row_number() OVER (PARTITION BY split ORDER BY h.case_id, hit_rank, hit_id) AS o FROM h JOIN (SELECT DISTINCT case_id, split FROM a) a ON a.case_id = h.case_id WHERE split IS NOT NULL AND chunk_id IS NOT NULL), m AS (SELECT split, chunk_id, min(o) AS o FROM k GROUP BY 1, 2) SELECT split, chunk_id, CAST(row_number() OVER (PARTITION BY split ORDER BY o) AS INT) AS ordinal FROM m",
    "m_review_queue": f"WITH {_A} SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY created_at DESC NULLS LAST, case_id) AS INT) AS place, case_id FROM a WHERE expected_behavior <> 'answer' AND split IS NOT NULL",
    "m_complete_bundles": "WITH x AS (SELECT DISTINCT * FROM extracted_cells WHERE table_id IS NOT NULL AND row_label IS NOT NULL AND column_label IS NOT NULL), w AS (SELECT table_id, count(DISTINCT column_label) AS width FROM x GROUP BY 1) SELECT x.table_id, row_label, count(DISTINCT column_label) AS columns, count(DISTINCT column_label) = any_value(width) AS complete FROM x JOIN w ON w.table_id = x.table_id GROUP BY 1, 2",
    "m_period_labels": r"SELECT DISTINCT row_label, regexp_replace(regexp_replace(regexp_replace(row_label, '\s+', '', 'g'), '年初|上年末|上年年末', '期初', 'g'), '(?:本)?年末', '期末', 'g') AS period_label FROM extracted_cells WHERE row_label IS NOT NULL",
    "m_company_mentions": f"""WITH q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases WHERE query IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT company_name AS company FROM source_manifest WHERE company_name <> '' AND length(company_name) <= 40), m AS (SELECT query_id, company, CAST(instr(query, company) AS INT) AS position FROM q JOIN n ON contains(query, company))
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position, company DESC) AS INT) AS place FROM m""",
    "m_missing_metrics": rf"""WITH q AS (SELECT case_id, {_metrics('min(query)')} AS required FROM agent_cases WHERE query IS NOT NULL GROUP BY 1), {_H}, n AS (SELECT case_id, {_named("regexp_replace(text, chr(92) || 's+', '', 'g')")} AS named FROM h WHERE text IS NOT NULL), u AS (SELECT q.case_id, unnest(required) AS metric, named FROM q JOIN n ON n.case_id = q.case_id)
      SELECT case_id, metric FROM u GROUP BY 1, 2 HAVING NOT bool_or(list_contains(named, metric))""",
    "m_supported_numbers": f"""WITH {_H}, x AS (SELECT case_id, min(text) AS t FROM h WHERE hit_rank = 1 AND text IS NOT NULL GROUP BY 1), y AS (SELECT case_id, min(text) AS t FROM h WHERE hit_rank = 2 AND text IS NOT NULL GROUP BY 1), z AS (SELECT x.case_id, {_NUMS.format('x.t')} AS m, {_NUMS.format('y.t')} AS n FROM x JOIN y ON y.case_id = x.case_id)
      SELECT case_id, CAST(len(m) AS INT) AS numbers, CAST(len(list_filter(m, lambda i: list_contains(n, i))) AS INT) AS supported FROM z""",
    "m_fact_changes": rf"""WITH {_F}, m AS (SELECT case_id, fact_id, min(value) AS value FROM f GROUP BY 1, 2), n AS (SELECT case_id, fact_id, CAST(replace(value, ',', '') AS DECIMAL(20, 4)) AS n FROM m WHERE regexp_matches(value, '^-?[0-9][0-9,]*([.][0-9]+)?$')),
      g AS (SELECT case_id, min(CASE WHEN fact_id = 'value_current' THEN n END) AS now, min(CASE WHEN fact_id = 'value_prior' THEN n END) AS before FROM n GROUP BY 1) SELECT case_id, format('{{:,.2f}}', round_even(CAST(now - before AS DOUBLE), 2)) AS difference, round((CAST(now AS DOUBLE) - before) / CAST(before AS DOUBLE) * 100, 4) AS growth_percent FROM g WHERE now IS NOT NULL AND before <> 0""",
    "m_detected_units": f"SELECT DISTINCT section, regexp_extract(section, '{UNIT.replace(chr(39), chr(39) * 2)}', 1) AS unit FROM cell_proofs WHERE section IS NOT NULL AND regexp_extract(section, '{UNIT.replace(chr(39), chr(39) * 2)}', 1) <> ''",
    "m_publication_times": "SELECT document_key, CAST(floor(epoch(min(published_at))) AS BIGINT) AS seconds FROM source_manifest WHERE published_at IS NOT NULL AND document_key IS NOT NULL GROUP BY 1",
    "m_registry_updates": f"WITH {_V}, p AS (SELECT document_key, max(split) AS ps FROM source_manifest GROUP BY 1), k AS (SELECT DISTINCT document_key FROM page_quality WHERE extraction_route = 'manual_review') SELECT version_id, v.document_key, CASE WHEN k.document_key IS NOT NULL AND status <> 'active' THEN 'failed' ELSE status END AS status, coalesce(split, ps) AS split FROM v LEFT JOIN p ON p.document_key = v.document_key LEFT JOIN k ON k.document_key = v.document_key",
    "m_decision_counts": f"WITH {_A} SELECT coalesce(expected_behavior, '(none)') AS decision, count(*) AS cases FROM a GROUP BY 1",
    "m_rescored_cases": f"WITH {_A}, o AS (SELECT DISTINCT unnest(query_ids) AS case_id FROM split_overlaps) SELECT coalesce(split, '(none)') AS split, CASE WHEN o.case_id IS NOT NULL THEN 'overlap' ELSE expected_behavior END AS outcome, count(*) AS cases FROM a LEFT JOIN o ON o.case_id = a.case_id GROUP BY 1, 2",
    "m_retrieval_snapshots": f"WITH {_H}, r AS (SELECT case_id, hit_id, row_number() OVER (PARTITION BY case_id ORDER BY hit_rank NULLS FIRST, hit_id) AS r FROM h) SELECT case_id, string_agg(CAST(hit_id AS VARCHAR), ',' ORDER BY r) AS hits FROM r WHERE r <= 3 GROUP BY 1",
    "m_source_audit": f"""WITH {_S}, x AS (SELECT unnest(list_filter([CASE WHEN document_key IS NULL OR document_key NOT IN (SELECT document_key FROM version_manifest WHERE document_key IS NOT NULL) THEN 'no_version' END, CASE WHEN security_code IS NULL THEN 'no_code' END, CASE WHEN security_code <> split_part(document_key, ':', 2) THEN 'other_code' END, CASE WHEN coalesce(size_bytes <= 0, true) THEN 'no_size' END,
      CASE WHEN NOT coalesce(regexp_matches(sha256, '^[0-9a-f]{{64}}$'), false) THEN 'bad_digest' END, CASE WHEN downloaded_at < published_at THEN 'early_download' END], lambda i: i IS NOT NULL)) AS fault FROM s) SELECT fault, count(*) AS "rows" FROM x GROUP BY 1""",
    "m_legacy_ids": f"WITH {_V} SELECT version_id, left(sha256(concat_ws(chr(31), document_key, content_sha256)), 16) AS derived_id FROM v",
    "m_dataset_errors": f"""WITH {_A}, x AS (SELECT unnest(list_filter([CASE WHEN split IS NULL THEN 'split' END, CASE WHEN coalesce(trim(query) = '', true) THEN 'query' END, CASE WHEN coalesce(len(expected_facts) < 1, true) AND expected_behavior = 'answer' THEN 'facts' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN created_at IS NULL THEN 'created_at' END], lambda i: i IS NOT NULL)) AS error FROM a) SELECT error, count(*) AS cases FROM x GROUP BY 1""",
    "m_value_places": rf"""WITH {_F}, {_H}, j AS (SELECT f.case_id, fact_id, value, hit_id, text, array_to_string(list_transform(list_filter(string_split(replace(value, ',', ''), ''), lambda c: c <> ''), lambda c: CASE WHEN regexp_matches(c, '[0-9A-Za-z%]') THEN c ELSE '[' || c || ']' END), '[\s,]*') AS pattern FROM f JOIN h ON h.case_id = f.case_id WHERE regexp_matches(value, '^[0-9][0-9,.]*$') AND text IS NOT NULL)
      SELECT DISTINCT case_id, fact_id, value, hit_id, CAST(instr(text, regexp_extract(text, pattern)) AS INT) AS place FROM j WHERE pattern <> '' AND regexp_matches(text, pattern)""",
    "m_faulty_questions": r"""WITH q AS (SELECT DISTINCT case_id, query FROM agent_cases WHERE query IS NOT NULL), x AS (SELECT case_id, query, regexp_extract(query, '([0-9][0-9,.]*[0-9]|[0-9])', 1) AS n, regexp_split_to_array(query, '[，,；;。]') AS c FROM q), y AS (SELECT *, instr(query, n) AS pos, list_position(list_transform(c, lambda i: length(i)), list_max(list_transform(c, lambda i: length(i)))) AS p FROM x)
      SELECT case_id, CASE WHEN n = '' THEN query ELSE substr(query, 1, pos + length(n) - 2) || translate(right(n, 1), '0123456789', '1234567890') || substr(query, pos + length(n)) END AS other_number, CASE WHEN len(c) > 1 THEN array_to_string(list_filter(c, lambda i, k: k <> p), '，') ELSE query END AS shortened FROM y""",
    "m_dense_texts": "WITH t AS (SELECT 'query: ' || query AS t FROM agent_cases WHERE query IS NOT NULL UNION SELECT 'passage: ' || label_text FROM label_refs WHERE label_text IS NOT NULL) SELECT md5(t) AS digest, split_part(t, ':', 1) AS kind FROM t",
    "m_document_profiles": f"WITH {_PQ}, g AS (SELECT document_key, list_sort(list(char_count)) AS vs, count(char_count) AS n, max(char_count) AS largest FROM pq WHERE document_key IS NOT NULL AND char_count IS NOT NULL GROUP BY 1) SELECT document_key, n, vs[CAST(round_even((n - 1) * 0.5, 0) AS INT) + 1] AS p50, vs[CAST(round_even((n - 1) * 0.95, 0) AS INT) + 1] AS p95, largest FROM g",
    "m_majority_names": f"WITH {_S}, n AS (SELECT security_code, company_name, count(*) AS votes FROM s WHERE security_code IS NOT NULL AND company_name IS NOT NULL GROUP BY 1, 2) SELECT security_code, company_name, votes FROM (SELECT *, row_number() OVER (PARTITION BY security_code ORDER BY votes DESC, company_name) AS r FROM n) WHERE r = 1",
    "m_evidence_pages": f"WITH {_G}, p AS (SELECT DISTINCT case_id, document_key, unnest(pages) AS page FROM g) SELECT document_key, page, array_to_string(list_sort(list(DISTINCT case_id)), ',') AS gold_for FROM p GROUP BY 1, 2",
    "m_conflicting_ids": "WITH u AS (SELECT 'chunk' AS kind, chunk_id AS id, coalesce(payload_json, '') AS content FROM chunks UNION SELECT 'version', version_id, coalesce(content_sha256, '') FROM version_manifest), g AS (SELECT kind, id, count(DISTINCT content) AS n FROM u WHERE id IS NOT NULL GROUP BY 1, 2) SELECT kind, count(*) AS ids, count_if(n > 1) AS conflicting FROM g GROUP BY 1",
    "m_retrieval_grid": f"""WITH {_G}, {_H}, k AS (SELECT DISTINCT case_id, document_key FROM g), q AS (SELECT DISTINCT case_id, TRY_CAST(regexp_extract(query, '20[0-9]{{2}}') AS INT) AS asked FROM a), x AS (SELECT h.case_id, document_key, lexical_rank, dense_rank, coalesce(TRY_CAST(split_part(document_key, ':', 4) AS INT) >= asked, false) AS fits FROM h JOIN q ON q.case_id = h.case_id WHERE document_key IS NOT NULL),
      m AS (SELECT case_id, document_key, 'lexical' AS mode, lexical_rank AS rank, fits FROM x UNION ALL SELECT case_id, document_key, 'dense', dense_rank, fits FROM x), b AS (SELECT case_id, document_key, mode, rank, 'none' AS filter FROM m WHERE rank IS NOT NULL UNION ALL SELECT case_id, document_key, mode, rank, 'year' FROM m WHERE rank IS NOT NULL AND fits),
      p AS (SELECT b.case_id, mode, filter, count(DISTINCT CASE WHEN rank <= 5 AND k.case_id IS NOT NULL THEN b.document_key END) AS r, count(DISTINCT CASE WHEN rank <= 5 THEN b.document_key END) AS s, count(DISTINCT CASE WHEN k.case_id IS NOT NULL THEN b.document_key END) AS w FROM b LEFT JOIN k ON k.case_id = b.case_id AND k.document_key = b.document_key GROUP BY 1, 2, 3), n AS (SELECT case_id, count(*) AS n FROM k GROUP BY 1)
      SELECT mode, filter, count(*) AS cases, round(avg(coalesce(r / nullif(s, 0), 0)), 6) AS precision, round(avg(r / n), 6) AS recall, round(avg(w / n), 6) AS candidate_recall FROM p JOIN n ON n.case_id = p.case_id GROUP BY 1, 2""",
    "m_character_errors": "WITH p AS (SELECT document_key, row_label, column_label, min(cell_value) AS r FROM cell_proofs WHERE regexp_matches(cell_value, '^[!-~]+$') GROUP BY ALL), x AS (SELECT document_key, row_label, column_label, min(cell_value) AS c FROM extracted_cells WHERE regexp_matches(cell_value, '^[!-~]+$') GROUP BY ALL) SELECT p.document_key, p.row_label, p.column_label, CAST(levenshtein(r, c) AS INT) AS distance, round(levenshtein(r, c) / length(r), 6) AS error_rate FROM p JOIN x ON x.document_key = p.document_key AND x.row_label = p.row_label AND x.column_label = p.column_label",
}
