"""Queries over pages, lines and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import documents as D
from vellum.operators.retrieval import read_chunks
from vellum.plans.retrieval import _C
from vellum.runtime import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_chunks(table(spark, d, "chunks")).where("text is not null")


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """The recommended route of each page beside the stored one."""
    p = table(spark, d, "page_quality").distinct()
    chars, images = F.coalesce("native_char_count", F.lit(0)), F.coalesce("image_count", F.lit(0))
    ratio = F.when(images > 0, F.least(F.lit(1.0), images * 0.35)).otherwise(0.0)
    best = D.route(chars, images, ratio, F.coalesce("replacement_char_ratio", F.lit(0.0)), F.lit(0.0))
    return p.select("document_key", "page_number", "extraction_route", best.alias("recommended_route"), (best != F.coalesce("extraction_route", F.lit(""))).alias("differs"))


def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_quality").distinct().where("document_key is not null")
    n = F.coalesce("char_count", F.lit(0))
    unresolved = ((n < 20) & ((F.coalesce("image_count", F.lit(0)) > 0) | (n == 0))) | (F.coalesce("needs_ocr", F.lit(False)) & F.coalesce(F.col("extraction_route").isin("partial_ocr", "full_ocr"), F.lit(False)) & ~F.coalesce("ocr_succeeded", F.lit(False)))
    pages = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("page_number")))).cast("array<string>"), ",")
    return p.groupBy("document_key").agg(
        F.count("*").alias("pages"), pages(unresolved).alias("unresolved_pages"), pages(n == 0).alias("empty_pages"), pages(F.coalesce("replacement_char_ratio", F.lit(0.0)) > 0.01).alias("replacement_pages"),
        F.round(F.avg((n > 0).cast("int")), 6).alias("text_coverage"),
    )


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", T.token_estimate(F.col("text")).alias("tokens"))


def chunk_reports(spark: SparkSession, d: str) -> DataFrame:
    return D.chunk_report(_chunks(spark, d).where("document_id is not null"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.repeated_lines(_chunks(spark, d))


def duplicate_shares(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_share(_chunks(spark, d))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(_chunks(spark, d)).withColumn("level", T.heading_level(F.col("line"))).where("level is not null")
    return rows.select("chunk_id", "line_no", "level")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("unit_no", "unit")).where(F.trim("unit") != "")


def packed_documents(spark: SparkSession, d: str) -> DataFrame:
    return D.pack_documents(_units(spark, d))


def packed_texts(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    p = D.packed_texts(u.withColumn("page", F.lit(None).cast("int")), D.pack_documents(u))
    return p.select("document_id", "chunk_index", "digest", F.char_length("text").alias("characters"), "units")


def section_stacks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id", "line_no")
    rows = D.lines(_chunks(spark, d)).join(_chunks(spark, d).select("chunk_id", "document_id", "page_start", "chunk_index").distinct(), ["chunk_id", "document_id", "page_start"])
    return D.section_stack(rows.select("document_id", F.row_number().over(w).alias("unit_no"), F.col("line").alias("unit"))).where("section <> ''")


def suspicious_documents(spark: SparkSession, d: str) -> DataFrame:
    share = D.suspicious_share(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(share, 9).alias("suspicious_share")).where("suspicious_share > 0")


def number_totals(spark: SparkSession, d: str) -> DataFrame:
    n = T.number_tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(n).alias("numbers"), F.size(F.array_distinct(n)).alias("distinct_numbers"))


QUERIES = {f"d_{f.__name__}": f for f in (page_routes, quality_reports, token_estimates, chunk_reports, repeated_lines, duplicate_shares, heading_lines, packed_documents, packed_texts, section_stacks, suspicious_documents, number_totals)}

_BLANK = T.BLANK
_EST = f"CAST(greatest(1, len(regexp_extract_all(text, '{T.HAN}')) + ceil(len(regexp_extract_all(lower(regexp_replace(text, '{T.HAN}', ' ', 'g')), '{T.LATIN}')) * 1.3)) AS INT)"
_LINES = "l AS (SELECT chunk_id, document_id, page_start, CAST(i AS INT) AS line_no, line FROM (SELECT chunk_id, document_id, page_start, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c WHERE text IS NOT NULL) WHERE trim(line) <> '')"
_NUM = "一二三四五六七八九十百千万零〇"
_T = f"trim(regexp_replace(line, '{_BLANK}', ' ', 'g'))"
_FREE = "length(t) <= 60 AND NOT regexp_matches(t, '[。；;，,：:]$')"
_LEVEL = f"""CASE WHEN t = '' OR length(t) > 100 OR len(regexp_extract_all(t, '[-+]?[0-9][0-9,.]*')) >= 2 OR regexp_matches(t, '\\.{{5,}}|…{{3,}}') THEN NULL WHEN regexp_matches(t, '^第[{_NUM}0-9]+[编章节] *[^ ]+') THEN 1
      WHEN regexp_matches(t, '^[{_NUM}]+、 *[^ ]+') AND {_FREE} THEN 2 WHEN regexp_matches(t, '^[（(][{_NUM}0-9]+[）)] *[^ ]+') AND {_FREE} THEN 3 WHEN regexp_matches(t, '^[0-9]+(?:\\.[0-9]+)+[.、]? *[^ ]+') AND {_FREE} THEN 4 WHEN regexp_matches(t, '^[0-9]+[.、] *[^ ]+') AND {_FREE} THEN 4 END"""
#: Packing as a fold over the units of each document, one unit a step.
_PACKED = f"""RECURSIVE u AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no FROM documents WHERE text IS NOT NULL),
      v AS (SELECT document_id, unit_no, line AS text, {_T} AS t FROM u WHERE trim(line) <> ''), n AS (SELECT document_id, unit_no, text, {_EST} AS tokens, {_LEVEL} IS NOT NULL AS head FROM v),
      e AS (SELECT *, row_number() OVER w - 1 AS i, sum(tokens) OVER w AS upto, sum(tokens) OVER w - tokens AS before, coalesce(max(CASE WHEN head THEN unit_no END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS mark FROM n WINDOW w AS (PARTITION BY document_id ORDER BY unit_no)),
      b AS (SELECT x.document_id, x.i, coalesce(min(y.i), any_value(x.i)) AS back FROM e x LEFT JOIN e y ON y.document_id = x.document_id AND y.i < x.i AND y.unit_no > x.mark AND x.before - y.before <= 60 GROUP BY x.document_id, x.i),
      f AS (SELECT document_id, i, 0 AS k, i AS first, before AS base FROM e WHERE i = 0
        UNION ALL SELECT g.document_id, g.i, g.k + CAST(g.shut AS INT), CASE WHEN NOT g.shut THEN g.first WHEN g.head OR g.upto - o.before > 650 THEN g.i ELSE g.again END, CASE WHEN NOT g.shut THEN g.base WHEN g.head OR g.upto - o.before > 650 THEN g.before ELSE o.before END
        FROM (SELECT e.document_id, e.i, e.head, e.upto, e.before, f.k, f.first, f.base, greatest(b.back, f.first) AS again, (e.head AND e.before - f.base >= 100) OR e.upto - f.base > 650 OR e.before - f.base >= 450 AS shut FROM f JOIN e ON e.document_id = f.document_id AND e.i = f.i + 1 JOIN b ON b.document_id = e.document_id AND b.i = e.i) g JOIN e o ON o.document_id = g.document_id AND o.i = g.again),
      packed AS (SELECT f.document_id, CAST(f.k AS INT) AS chunk_index, min(a.unit_no) AS unit_from, max(z.unit_no) AS unit_to, max(z.upto) - min(a.before) AS tokens FROM f JOIN e a ON a.document_id = f.document_id AND a.i = f.first JOIN e z ON z.document_id = f.document_id AND z.i = f.i GROUP BY f.document_id, f.k)"""
SQL = {
    "d_page_routes": """WITH p AS (SELECT DISTINCT * FROM page_quality), x AS (SELECT *, coalesce(native_char_count, 0) AS n, coalesce(image_count, 0) AS i, coalesce(replacement_char_ratio, 0) AS s FROM p), y AS (SELECT *, CASE WHEN i > 0 THEN least(1.0, i * 0.35) ELSE 0 END AS a FROM x),
      r AS (SELECT *, CASE WHEN n = 0 AND i > 0 THEN 'full_ocr' WHEN n = 0 THEN 'manual_review' WHEN s > 0.02 AND a >= 0.65 THEN 'full_ocr' WHEN s > 0.02 THEN 'manual_review' WHEN i > 0 AND a >= 0.65 AND n < 100 THEN 'partial_ocr' WHEN i > 0 AND n < 20 THEN 'partial_ocr' ELSE 'native' END AS recommended_route FROM y)
      SELECT document_key, page_number, extraction_route, recommended_route, recommended_route <> coalesce(extraction_route, '') AS differs FROM r""",
    "d_quality_reports": """WITH p AS (SELECT DISTINCT * FROM page_quality WHERE document_key IS NOT NULL), x AS (SELECT *, coalesce(char_count, 0) AS n, coalesce(image_count, 0) AS i FROM p),
      y AS (SELECT *, (n < 20 AND (i > 0 OR n = 0)) OR (coalesce(needs_ocr, false) AND coalesce(extraction_route IN ('partial_ocr', 'full_ocr'), false) AND NOT coalesce(ocr_succeeded, false)) AS u FROM x)
      SELECT document_key, count(*) AS pages, coalesce(array_to_string(list_sort(list(page_number) FILTER (u)), ','), '') AS unresolved_pages, coalesce(array_to_string(list_sort(list(page_number) FILTER (n = 0)), ','), '') AS empty_pages,
      coalesce(array_to_string(list_sort(list(page_number) FILTER (coalesce(replacement_char_ratio, 0) > 0.01)), ','), '') AS replacement_pages, round(avg(CAST(n > 0 AS INT)), 6) AS text_coverage FROM y GROUP BY 1""",
    "d_token_estimates": f"WITH {_C} SELECT chunk_id, {_EST} AS tokens FROM c WHERE text IS NOT NULL",
    "d_chunk_reports": f"""WITH {_C}, r AS (SELECT document_id, {_EST} AS n, page_start <> page_end AS x, len(section_path) > 0 AS s FROM c WHERE text IS NOT NULL AND document_id IS NOT NULL), g AS (SELECT document_id, count(*) AS chunks, count_if(n < 100) AS below, count_if(n > 650) AS above, count_if(x) AS crossing, count_if(s) AS sectioned, list_sort(list(n)) AS ns FROM r GROUP BY 1)
      SELECT document_id, chunks, below, above, crossing, sectioned, ns[1] AS token_min, ns[CAST(floor(len(ns) / 2) AS INT) + 1] AS token_p50, ns[CAST(least(len(ns), ceil(len(ns) * 0.95)) AS INT)] AS token_p95, ns[-1] AS token_max FROM g""",
    "d_repeated_lines": f"""WITH {_C}, {_LINES}, k AS (SELECT document_id, page_start, lower(regexp_replace(regexp_replace(line, '{_BLANK}', '', 'g'), '[0-9]+', '#', 'g')) AS key FROM l WHERE length(line) <= 160),
      t AS (SELECT document_id, count(DISTINCT page_start) AS total FROM c WHERE text IS NOT NULL GROUP BY 1), s AS (SELECT document_id, key, count(DISTINCT page_start) AS pages FROM k WHERE key <> '' GROUP BY ALL)
      SELECT s.document_id, key, pages FROM s JOIN t ON s.document_id = t.document_id WHERE pages >= greatest(3, ceil(total * 0.2))""",
    "d_duplicate_shares": f"""WITH {_C}, {_LINES}, k AS (SELECT chunk_id, regexp_replace(line, '{_BLANK}', '', 'g') AS key, count(*) AS n FROM l GROUP BY ALL) SELECT chunk_id, round(least(sum((n - 1) * length(key)) / sum(n * length(key)), 1.0), 6) AS duplicate_share FROM k WHERE key <> '' GROUP BY 1""",
    "d_heading_lines": f"""WITH {_C}, {_LINES}, x AS (SELECT chunk_id, line_no, {_T} AS t FROM l), y AS (SELECT *, {_LEVEL} AS level FROM x) SELECT chunk_id, line_no, level FROM y WHERE level IS NOT NULL""",
    "d_packed_documents": f"WITH {_PACKED} SELECT document_id, chunk_index, CAST(unit_from AS INT) AS unit_from, CAST(unit_to AS INT) AS unit_to, CAST(tokens AS INT) AS tokens FROM packed",
    "d_packed_texts": f"""WITH {_PACKED}, j AS (SELECT p.document_id, p.chunk_index, string_agg(v.text, chr(10) ORDER BY v.unit_no) AS text, count(*) AS units FROM packed p JOIN v ON v.document_id = p.document_id AND v.unit_no BETWEEN p.unit_from AND p.unit_to GROUP BY 1, 2)
      SELECT document_id, chunk_index, sha256(text) AS digest, CAST(length(text) AS INT) AS characters, CAST(units AS INT) AS units FROM j""",
    "d_suspicious_documents": r"""WITH x AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, round(coalesce(len(regexp_extract_all(t, '[\p{Cc}\p{Co}\x{FFFD}]')) / nullif(length(t), 0), 0), 9) AS suspicious_share FROM x) SELECT * FROM y WHERE suspicious_share > 0""",
    "d_number_totals": r"""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: NOT regexp_matches(x, '^(?:19[0-9][0-9]|20[0-9][0-9]|2100)$')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(n) AS numbers, len(list_distinct(n)) AS distinct_numbers FROM x""",
}
