"""Queries over evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import evidence as E
from vellum.operators.answers import CANONICAL
from vellum.plans.answers import _h, _q
from vellum.plans.retrieval import _C, _chunks
from vellum.runtime import table

PAGE = ["document_key", "page_number"]


def _regions(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    t = table(spark, d, name).distinct().where("value_bbox is not null and document_key is not null and page_number is not null")
    return t.select(*PAGE, F.col(key).alias("box_id"), F.col("cell_value").alias("text"), F.col("value_bbox").alias("box"))


def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    out = E.merge_regions(_regions(spark, d, "cell_proofs", "proof_id"), _regions(spark, d, "extracted_cells", "cell_id"), PAGE)
    return out.select(*PAGE, "box_id", "origin", "reading_order")


def nearest_boxes(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda n, k: _regions(spark, d, n, k).select(*PAGE, "box_id", "box.*")
    return E.nearest_boxes(flat("extracted_cells", "cell_id"), flat("cell_proofs", "proof_id"), PAGE)


def authority_scores(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).groupBy("chunk_id").agg(F.min(F.array_join("section_path", " ")).alias("section"))
    rows = _h(spark, d).join(_q(spark, d), "query_id").join(c, "chunk_id")
    return rows.select("hit_id", E.authority(F.col("query"), F.coalesce("section", F.lit("")), F.col("text")).alias("authority"))


def chunk_targets(spark: SparkSession, d: str) -> DataFrame:
    e = _h(spark, d).select("chunk_id", F.col("query_id").alias("target"))
    return E.bind_targets(e).select("chunk_id", F.array_join("targets", ",").alias("targets"), "uses")


def sufficient_targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "agent_cases").select(F.col("case_id").alias("target"))
    return E.sufficiency(t, _h(spark, d).select("chunk_id", F.col("query_id").alias("target")), least=3)


def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    r = _h(spark, d).groupBy("query_id", "chunk_id").agg(F.min("lexical_rank").alias("lexical_rank"), F.min("dense_rank").alias("dense_rank"))
    return E.weight_sweep(r, [(1, 0), (2, 1), (1, 1), (1, 2), (0, 1)]).select("weights", "query_id", "chunk_id", "rank")


def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    """The first hit's text as a claim, checked against the second hit and the question."""
    at = lambda k: _h(spark, d).where(F.col("hit_rank") == k).groupBy("query_id").agg(F.min("text").alias(f"t{k}"))
    rows = at(1).join(at(2), "query_id").join(_q(spark, d), "query_id").withColumn("risks", E.claim_risks(F.col("t1"), F.col("t2"), F.col("query")))
    return rows.select("query_id", F.array_join(F.transform("risks", lambda r: r["check"]), ",").alias("checks"), E.verdict(F.col("risks")).alias("verdict"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return E.within_budget(_h(spark, d), "query_id", ["hit_rank", "hit_id"], "text", 2000).select("query_id", "hit_id", "used")


QUERIES = {f"v_{f.__name__}": f for f in (merged_regions, nearest_boxes, authority_scores, chunk_targets, sufficient_targets, weight_sweep, claim_checks, context_budget)}

_Q = "q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases WHERE query IS NOT NULL GROUP BY 1)"
_H = "h AS (SELECT DISTINCT * FROM search_hits WHERE query_id IS NOT NULL AND text IS NOT NULL)"
_box = lambda t, k: f"SELECT document_key, page_number, {k} AS box_id, cell_value AS text, value_bbox AS box, value_bbox.x0 AS x0, value_bbox.y0 AS y0, value_bbox.x1 AS x1, value_bbox.y1 AS y1 FROM (SELECT DISTINCT * FROM {t}) WHERE value_bbox IS NOT NULL AND document_key IS NOT NULL AND page_number IS NOT NULL"
_B = f"n AS ({_box('cell_proofs', 'proof_id')}), o AS ({_box('extracted_cells', 'cell_id')})"
_sq = r"regexp_replace({}, '[ \t\r\n\f\x{{00a0}}\x{{3000}}]+', '', 'g')"
_num = lambda t: rf"list_filter(list_transform(regexp_extract_all({t}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: NOT regexp_matches(x, '^(?:19[0-9][0-9]|20[0-9][0-9]|2100)$'))"
_sgn = lambda t: rf"list_filter(list_transform(regexp_extract_all(regexp_replace({t}, '[(（]([0-9][0-9,]*(?:\.[0-9]+)?%?)[)）]', '-\1', 'g'), '-?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda x: replace(x, ',', '')), lambda x: NOT regexp_matches(x, '^-?(?:19[0-9][0-9]|20[0-9][0-9]|2100)$'))"
_yr = lambda t: f"regexp_extract_all({t}, '(?:19|20)[0-9]{{2}}')"
_ML = "[" + ", ".join(f"'{m}'" for m in CANONICAL) + "]"
_met = lambda t: f"list_filter({_ML}, lambda m: contains({t}, m))"
_less = lambda a, b: f"len(list_filter({a}, lambda v: NOT list_contains({b}, v))) > 0"
SQL = {
    "v_merged_regions": f"""WITH {_B}, f AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.document_key = o.document_key AND n.page_number = o.page_number AND {_sq.format('n.text')} <> '' AND {_sq.format('n.text')} = {_sq.format('o.text')})),
      k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.document_key = f.document_key AND n.page_number = f.page_number AND (f.x1 - f.x0) * (f.y1 - f.y0) > 0 AND greatest(least(f.x1, n.x1) - greatest(f.x0, n.x0), 0) * greatest(least(f.y1, n.y1) - greatest(f.y0, n.y0), 0) / ((f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.6)),
      u AS (SELECT *, 'native' AS origin FROM n UNION ALL SELECT *, 'recognised' FROM k) SELECT document_key, page_number, box_id, origin, CAST(row_number() OVER (PARTITION BY document_key, page_number ORDER BY y0, x0, origin, box_id) - 1 AS INT) AS reading_order FROM u""",
    "v_nearest_boxes": f"""WITH {_B}, j AS (SELECT o.document_key, o.page_number, o.box_id AS left_id, n.box_id AS right_id, round(sqrt(power((o.x0 + o.x1) / 2 - (n.x0 + n.x1) / 2, 2) + power((o.y0 + o.y1) / 2 - (n.y0 + n.y1) / 2, 2)), 6) AS distance FROM o JOIN n ON n.document_key = o.document_key AND n.page_number = o.page_number)
      SELECT document_key, page_number, left_id, right_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY document_key, page_number, left_id ORDER BY distance, right_id) AS r FROM j WHERE distance <= 20) WHERE r = 1""",
    "v_authority_scores": f"""WITH {_C}, {_Q}, {_H}, s AS (SELECT chunk_id, coalesce(min(array_to_string(section_path, ' ')), '') AS section FROM c GROUP BY 1), x AS (SELECT hit_id, query, concat_ws(' ', section, text) AS t FROM h JOIN q ON q.query_id = h.query_id JOIN s ON s.chunk_id = h.chunk_id)
      SELECT hit_id, CAST({" + ".join(f"CASE WHEN contains(t, '{k}') THEN {w} ELSE 0 END" for k, w in E.AUTHORITY.items())} + CASE WHEN contains(query, '可比') AND contains(t, '可比口径') THEN 30 ELSE 0 END + CASE WHEN contains(query, '调整后') AND regexp_matches(t, '调整后|追溯调整') THEN 20 ELSE 0 END + 12 * len(list_filter({_ML}, lambda m: contains(query, m) AND contains(t, m))) AS INT) AS authority FROM x""",
    "v_chunk_targets": f"WITH {_H} SELECT chunk_id, array_to_string(list_sort(list(DISTINCT query_id)), ',') AS targets, count(*) AS uses FROM h WHERE chunk_id IS NOT NULL GROUP BY 1",
    "v_sufficient_targets": f"WITH {_H}, n AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM h GROUP BY 1) SELECT case_id AS target, coalesce(n, 0) AS chunks, coalesce(n, 0) >= 3 AS sufficient FROM (SELECT DISTINCT case_id FROM agent_cases) LEFT JOIN n ON query_id = case_id",
    "v_weight_sweep": f"""WITH {_H}, g AS (SELECT query_id, chunk_id, min(lexical_rank) AS l, min(dense_rank) AS d FROM h GROUP BY 1, 2), w AS (SELECT * FROM (VALUES ('1:0', 1, 0), ('2:1', 2, 1), ('1:1', 1, 1), ('1:2', 1, 2), ('0:1', 0, 1)) v(weights, a, b)), s AS (SELECT weights, query_id, chunk_id, coalesce(a / (60.0::DOUBLE + l), 0) + coalesce(b / (60.0::DOUBLE + d), 0) AS raw FROM g, w)
      SELECT weights, query_id, chunk_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY weights, query_id ORDER BY round(raw, 12) DESC, chunk_id) AS INT) AS rank FROM s) WHERE rank <= 5""",
    "v_claim_checks": f"""WITH {_Q}, {_H}, a AS (SELECT query_id, min(text) AS t FROM h WHERE hit_rank = 1 GROUP BY 1), b AS (SELECT query_id, min(text) AS e FROM h WHERE hit_rank = 2 GROUP BY 1), x AS (SELECT a.query_id, t AS c, e, query AS k FROM a JOIN b ON b.query_id = a.query_id JOIN q ON q.query_id = a.query_id),
      r AS (SELECT query_id, {_less(_num('c'), f"list_concat({_num('e')}, {_num('k')})")} AS n, {_less(_yr('c'), f"list_concat({_yr('e')}, {_yr('k')})")} AS y, len(list_filter({_sgn('c')}, lambda v: starts_with(v, '-') AND list_contains(list_filter({_sgn('k')}, lambda z: NOT starts_with(z, '-')), substr(v, 2)))) > 0 AS s, {_less(_met('k'), _met('c'))} AS m, trim(e) = '' AS z FROM x)
      SELECT query_id, array_to_string(list_filter([CASE WHEN n THEN 'unsupported_number' END, CASE WHEN y THEN 'unsupported_year' END, CASE WHEN s THEN 'sign_conflict' END, CASE WHEN m THEN 'missing_metric' END, CASE WHEN z THEN 'no_evidence' END], lambda v: v IS NOT NULL), ',') AS checks, CASE WHEN n OR s OR z THEN 'reject' WHEN y OR m THEN 'review' ELSE 'pass' END AS verdict FROM r""",
    "v_context_budget": f"WITH {_H} SELECT query_id, hit_id, used FROM (SELECT query_id, hit_id, CAST(sum(length(text)) OVER (PARTITION BY query_id ORDER BY hit_rank, hit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM h) WHERE used <= 2000",
}
