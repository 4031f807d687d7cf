"""Queries of answers out of tables and of comparison plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.finance import REPORT_YEAR
from vellum.operators import regulated as G
from vellum.operators import scoring as S
from vellum.operators import tabular as B
from vellum.plans.scoring_sql import _metrics
from vellum.plans.tables import _shown, _SHOWN, _tables_sql
from vellum.runtime import cut, table

#: Which company's and which statement's the shown notes are.
SCOPES = [("x-note", "x", "consolidated", 1), ("x-parent", "x", "parent", 2)]
#: Texts that plan a revenue, beside the documents.
PLANS = [("x-plan", "2024 年，公司计划实现营业总收入 1,234.5 亿元。上述目标不构成对投资者的业绩承诺。"), ("x-open", "2024年计划实现营业总收入12亿元。")]
#: Questions that compare what the stored ones don't: statements, restated years, companies.
QUESTIONS = [("x1", "甲乙股份2023年合并口径与母公司口径的营业收入相差多少？"), ("x2", "甲乙股份2024年年报中，2023年归母净利润调整前与调整后相差多少？"), ("x3", "比较甲乙股份与丙丁股份2022年和2023年的毛利率"), ("x4", "甲乙股份合并与母公司的净利润"), ("x5", "甲乙股份2021年和2022年营业收入的同比增长率，按2023年年报调整后口径"), ("x6", "甲乙股份的毛利率")]
NAMES = ["甲乙股份", "丙丁股份"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return cut(G.extract_tables(_shown(spark, d), "chunk_id", "text"))


def _kind(cells: DataFrame, kind: str) -> DataFrame:
    return cells.where(F.col("table_kind") == kind).drop("table_kind")


def _values(cells: DataFrame) -> DataFrame:
    annual = _kind(cells, "annual_data")
    return B.year_values(annual, "key", annual.select("key").distinct().withColumn("year", F.lit(2023)))


def year_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(_cells(spark, d))


def quarter_totals(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return _plain(B.quarter_totals(_kind(cells, "quarterly"), _values(cells), "key"), ["total", "annual", "difference"])


def _plain(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns})


def note_differences(spark: SparkSession, d: str) -> DataFrame:
    return _plain(B.note_differences(_kind(_cells(spark, d), "note_cost"), "key"), ["main", "total", "other"])


def scope_differences(spark: SparkSession, d: str) -> DataFrame:
    owner = spark.createDataFrame(SCOPES, "key string, company string, scope string, ordinal int")
    totals = _kind(_cells(spark, d), "note_cost").where("row_label = '合计' and column_label = '本期收入'").join(owner, "key").select("company", "scope", "ordinal", B.exact("cell_value").alias("value"))
    return _plain(B.scope_differences(totals, "company"), ["consolidated", "parent", "difference"])


def profit_differences(spark: SparkSession, d: str) -> DataFrame:
    texts = _shown(spark, d).select(F.col("chunk_id").alias("key"), "text")
    return _plain(B.profit_differences(_values(_cells(spark, d)), texts, "key"), ["reported", "deducted", "nonrecurring"])


def segment_margins(spark: SparkSession, d: str) -> DataFrame:
    return _plain(B.segment_margins(_kind(_cells(spark, d), "segment"), "key"), ["margin"])


def share_differences(spark: SparkSession, d: str) -> DataFrame:
    """Whether customers or suppliers are more concentrated, where both shares are known."""
    shares = _kind(_cells(spark, d), "concentration").where(F.col("column_label").endswith("占比(%)")).select("key", "row_label", B.exact("cell_value").alias("share"))
    return _plain(B.pair_differences(shares, ["key"], "row_label", "share"), ["difference"])


def refused_promises(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text").unionByName(spark.createDataFrame(PLANS, "key string, text string"))
    return B.refused_promises(docs, "key")


def preferred_cells(spark: SparkSession, d: str) -> DataFrame:
    """The proved cells of a table, and the extracted ones of tables without any."""
    one = lambda n: table(spark, d, n).distinct().where("table_id is not null").select("table_id", "row_label", "column_label", "cell_value")
    return B.preferred_cells(one("cell_proofs"), one("extracted_cells"), ["table_id"]).groupBy("table_id", "origin").agg(F.count("*").alias("cells"))


def comparison_targets(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "agent_cases").where("query is not null").groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("query"))
    q = stored.unionByName(spark.createDataFrame(QUESTIONS, "query_id string, query string"))
    names = table(spark, d, "source_manifest").select(F.col("company_name").alias("company")).unionByName(spark.createDataFrame([(n,) for n in NAMES], "company string"))
    return B.comparison_targets(q, S.company_mentions(q, names))


QUERIES = {f"b_{f.__name__}": f for f in (year_values, quarter_totals, note_differences, scope_differences, profit_differences, segment_margins, share_differences, refused_promises, preferred_cells, comparison_targets)}

_N = "TRY_CAST({} AS DECIMAL(24, 4))"
_T = f"t AS ({_tables_sql()})"
_Y = """y AS (SELECT key, row_label, 2023 AS year, coalesce(arg_min(cell_value, cell_no) FILTER (column_label = '2023年'), arg_min(cell_value, cell_no)) AS value, count(*) FILTER (column_label = '2023年') > 0 AS exact_year FROM t WHERE table_kind = 'annual_data' GROUP BY 1, 2)"""


def _target(company: str, year: str, document: str, scope: str, version: str, together: str) -> str:
    return f"{{'company': {company}, 'fact_year': {year}, 'document_year': {document}, 'scope': '{scope}', 'version': {version}, 'together': {together}}}"


def _plans_sql() -> str:
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    distinct = lambda xs: f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"
    found = "list_transform(regexp_extract_all(query, '{}', {}), lambda v: CAST(v AS INT))"
    of_year = lambda c, y: _target(c, y, f"CASE WHEN adj IS NOT NULL AND {y} <= adj THEN adj ELSE {y} END", "unspecified", f"CASE WHEN adj IS NOT NULL AND {y} < adj THEN 'restated' ELSE 'current' END", "grp")
    scopes = ", ".join(_target("c[1]", "ys[1]", "ys[1]", s, "'current'", "'scope'") for s in ("consolidated", "parent"))
    versions = ", ".join(_target("c[1]", "facts[1]", "rs[-1]", "unspecified", f"'{v}'", "'restatement'") for v in ("as_reported", "restated"))
    none = _target("CAST(NULL AS VARCHAR)", "CAST(NULL AS INT)", "CAST(NULL AS INT)", "unspecified", "'none'", "CAST(NULL AS VARCHAR)")
    return f"""WITH q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases WHERE query IS NOT NULL GROUP BY 1 UNION ALL SELECT * FROM (VALUES {values(QUESTIONS)}) v(query_id, query)),
      n AS (SELECT DISTINCT company FROM (SELECT company_name AS company FROM source_manifest UNION ALL SELECT unnest([{", ".join(f"'{x}'" for x in NAMES)}])) WHERE company <> '' AND length(company) <= 40),
      m AS (SELECT query_id, list(company ORDER BY instr(query, company), company) AS c FROM q JOIN n ON contains(query, company) GROUP BY 1),
      x AS (SELECT q.query_id, query, coalesce(c, []) AS c, {distinct(found.format('20[0-9]{2}', 0))} AS ys, {distinct(found.format(REPORT_YEAR, 1))} AS rs FROM q LEFT JOIN m ON m.query_id = q.query_id),
      z AS (SELECT *, list_filter(ys, lambda v: v <> rs[-1]) AS facts, CASE WHEN contains(query, '调整后') AND len(rs) > 0 THEN rs[-1] END AS adj, CASE WHEN regexp_matches(query, '调整|同比|增长率') THEN 'comparative-table' END AS grp, contains(query, '合并') AND contains(query, '母公司') AS sides FROM x),
      p AS (SELECT query_id, query, sides, CASE WHEN sides AND len(c) = 1 AND len(ys) = 1 THEN [{scopes}] WHEN sides THEN NULL WHEN contains(query, '调整前') AND contains(query, '调整后') AND len(c) = 1 AND len(rs) > 0 AND len(facts) = 1 THEN [{versions}]
        WHEN len(c) >= 2 THEN flatten(list_transform(c, lambda k: list_transform(CASE WHEN len(ys) >= 2 THEN ys ELSE [ys[1]] END, lambda y: {of_year('k', 'y')}))) WHEN len(ys) >= 2 THEN list_transform(ys, lambda y: {of_year('c[1]', 'y')}) END AS plan FROM z),
      w AS (SELECT query_id, query, plan, CASE WHEN plan IS NULL AND sides THEN 'scope' WHEN plan IS NULL THEN 'objects' WHEN len(plan) > 8 THEN 'budget' END AS clarification FROM p),
      u AS (SELECT query_id, query, clarification, unnest(CASE WHEN clarification IS NULL THEN plan ELSE [{none}] END) AS t, generate_subscripts(CASE WHEN clarification IS NULL THEN plan ELSE [{none}] END, 1) - 1 AS place FROM w)
      SELECT query_id, CAST(place AS INT) AS place, t.company AS company, t.fact_year AS fact_year, t.document_year AS document_year, t.scope AS scope, t.version AS version, t.together AS together, clarification, array_to_string(list_filter({_metrics('query').replace('list_distinct(', '(', 1)}, lambda v, i: list_position({_metrics('query').replace('list_distinct(', '(', 1)}, v) = i), ',') AS metrics FROM u"""


def _d(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 4)"


SQL = {
    "b_year_values": f"WITH {_T}, {_Y} SELECT key, row_label, CAST(year AS INT) AS year, value, exact_year FROM y",
    "b_quarter_totals": f"WITH {_T}, {_Y}, q AS (SELECT key, row_label, sum({_N.format('cell_value')}) AS total FROM t WHERE table_kind = 'quarterly' GROUP BY 1, 2 HAVING count(*) = 4 AND count({_N.format('cell_value')}) = 4) SELECT q.key, q.row_label, {_d('total')} AS total, {_d(_N.format('value'))} AS annual, {_d('total - ' + _N.format('value'))} AS difference, total = {_N.format('value')} AS agrees FROM q LEFT JOIN y ON y.key = q.key AND y.row_label = q.row_label",
    "b_note_differences": f"""WITH {_T}, g AS (SELECT key, CASE column_label WHEN '本期成本' THEN 'cost' ELSE 'revenue' END AS measure, min({_N.format('cell_value')}) FILTER (row_label = '主营业务') AS main, min({_N.format('cell_value')}) FILTER (row_label = '合计') AS total, min({_N.format('cell_value')}) FILTER (row_label = '其他业务') AS stated FROM t WHERE table_kind = 'note_cost' AND column_label IN ('本期成本', '本期收入') GROUP BY 1, 2)
      SELECT key, measure, {_d('main')} AS main, {_d('total')} AS total, {_d('total - main')} AS other, total - main = stated AS agrees FROM g WHERE main IS NOT NULL AND total IS NOT NULL""",
    "b_scope_differences": f"""WITH {_T}, o AS (SELECT * FROM (VALUES {", ".join(str(s) for s in SCOPES)}) v(key, company, scope, ordinal)), v AS (SELECT company, scope, arg_min({_N.format('cell_value')}, ordinal) AS n FROM t JOIN o USING (key) WHERE table_kind = 'note_cost' AND row_label = '合计' AND column_label = '本期收入' GROUP BY 1, 2),
      g AS (SELECT company, min(n) FILTER (scope = 'consolidated') AS c, min(n) FILTER (scope = 'parent') AS p FROM v GROUP BY 1) SELECT company, {_d('c')} AS consolidated, {_d('p')} AS parent, {_d('abs(c - p)')} AS difference, CASE WHEN c >= p THEN 'consolidated' ELSE 'parent' END AS higher FROM g WHERE c IS NOT NULL AND p IS NOT NULL""",
    "b_profit_differences": f"""WITH {_T}, {_Y}, g AS (SELECT key, min({_N.format('value')}) FILTER (row_label = '{B.REPORTED}') AS r, min({_N.format('value')}) FILTER (row_label IN ({", ".join(f"'{x}'" for x in B.DEDUCTED)})) AS d FROM y GROUP BY 1), z AS ({_SHOWN})
      SELECT key, {_d('r')} AS reported, {_d('d')} AS deducted, {_d('r - d')} AS nonrecurring, coalesce(contains(regexp_replace(z.text, '\\s+', '', 'g'), format('{{:,.2f}}', CAST(r - d AS DOUBLE))), false) AS stated FROM g LEFT JOIN z ON z.k = key WHERE r IS NOT NULL AND d IS NOT NULL""",
    "b_segment_margins": f"WITH {_T}, m AS (SELECT key, section, row_label, arg_min({_N.format('cell_value')}, cell_no) AS margin FROM t WHERE table_kind = 'segment' AND column_label = '毛利率' GROUP BY 1, 2, 3) SELECT key, section, row_label, {_d('margin')} AS margin, CAST(row_number() OVER (PARTITION BY key, section ORDER BY margin DESC, row_label) AS INT) AS place FROM m WHERE margin IS NOT NULL",
    "b_share_differences": f"WITH {_T}, s AS (SELECT key, row_label, {_N.format('cell_value')} AS n FROM t WHERE table_kind = 'concentration' AND ends_with(column_label, '占比(%)')) SELECT key, arg_max(row_label, n) AS higher, arg_min(row_label, n) AS lower, {_d('max(n) - min(n)')} AS difference FROM s GROUP BY 1 HAVING count(*) = 2",
    "b_refused_promises": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents UNION ALL SELECT * FROM (VALUES {", ".join(str(p) for p in PLANS)}) v(key, text)), b AS (SELECT key, regexp_replace(text, '\\s+', '', 'g') AS t FROM d)
      SELECT key, regexp_extract(t, '20[0-9]{{2}}') AS year, regexp_extract(t, '{B.PLANNED}', 1) AS target FROM b WHERE regexp_matches(t, '{"|".join(B.NO_PROMISE)}') AND regexp_matches(t, '{B.PLANNED}')""",
    "b_preferred_cells": "WITH p AS (SELECT DISTINCT * FROM cell_proofs WHERE table_id IS NOT NULL), x AS (SELECT DISTINCT * FROM extracted_cells WHERE table_id IS NOT NULL) SELECT table_id, 'structured' AS origin, count(*) AS cells FROM p GROUP BY 1 UNION ALL SELECT table_id, 'text', count(*) FROM x WHERE table_id NOT IN (SELECT table_id FROM p) GROUP BY 1",
    "b_comparison_targets": _plans_sql(),
}
