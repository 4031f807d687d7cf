"""Retrieval queries over the tables of the data set, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import finance, text
from vellum.operators import retrieval as R
from vellum.runtime import table

#: Searches other than bm25_top10 take every row whose id is divisible by this as a query, against all rows.
EVERY = 50


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.read_chunks(table(spark, d, "chunks"))


def _index_text():
    return R.index_text(F.col("section_path"), F.col("text"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_cases").where("query is not null").select(F.col("case_id").alias("query_id"), "query").distinct()


def _some_queries(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("query_id", "([0-9]+)$", 1).try_cast("bigint")
    return _queries(spark, d).where(F.pmod(number, F.lit(EVERY)) == 0)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").distinct()


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.term_statistics(_chunks(spark, d), "chunk_id", _index_text())


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.index_summary(_chunks(spark, d), "chunk_id", _index_text())


def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(_queries(spark, d), R.parse_chunks(table(spark, d, "chunks")), _index_text())


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    keep = F.coalesce(F.col("report_year").isin(2022, 2023, 2024) & (F.col("document_type") == "annual_report"), F.lit(False))
    return R.bm25(_some_queries(spark, d), R.parse_chunks(table(spark, d, "chunks")), _index_text(), keep=keep)


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    ranks = _hits(spark, d).where("query_id is not null").groupBy("query_id", "chunk_id").agg(F.min("lexical_rank").alias("lexical_rank"), F.min("dense_rank").alias("dense_rank"))
    return R.rank_fusion(ranks, weights={"lexical_rank": 2.0, "dense_rank": 1.0})


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.nearest_vectors(e, e.where(F.col("vec_id") % EVERY == 0))


def page_windows(spark: SparkSession, d: str) -> DataFrame:
    return R.page_windows(_hits(spark, d), _chunks(spark, d))


def statement_scopes(spark: SparkSession, d: str) -> DataFrame:
    return R.statement_scopes(_chunks(spark, d))


def scope_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).where("query_id is not null").select("hit_id", "query_id", "hit_rank", "chunk_id")
    q = table(spark, d, "agent_cases").groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("query"))
    c = _chunks(spark, d).groupBy("chunk_id").agg(F.min(F.array_join("section_path", " ")).alias("section"))
    rows = hits.join(q, "query_id").join(c, "chunk_id").withColumn("scope", finance.query_scope(F.col("query")))
    return R.rerank(rows, finance.scope_score(F.col("scope"), F.coalesce("section", F.lit("")))).select("query_id", "chunk_id", "hit_id", "scope", F.col("rerank_score").alias("scope_score"), "new_rank", "rank_delta")


def structured_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).where("query_id is not null").select("hit_id", "query_id", "hit_rank", "chunk_id")
    q = table(spark, d, "agent_cases").groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("query"))
    kinds = table(spark, d, "cell_proofs").where("chunk_id is not null").groupBy("chunk_id").agg(F.sort_array(F.collect_set("table_type")).alias("kinds"))
    rows = hits.join(q, "query_id").join(kinds, "chunk_id", "left")
    return R.rerank(rows, finance.structured_score(F.col("query"), F.col("kinds"))).select("query_id", "chunk_id", "hit_id", F.col("rerank_score").alias("structured_score"), "new_rank")


def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids in the order given, repeated and unknown ones included."""
    ids = table(spark, d, "split_overlaps").distinct().select("unit_id", F.posexplode("query_ids").alias("position", "case_id"))
    known = table(spark, d, "agent_cases").groupBy("case_id").agg(F.min("query").alias("query"), F.min("split").alias("split"))
    return ids.join(known, "case_id", "left").select("unit_id", "position", "case_id", "query", "split")


def company_years(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where("company_name is not null").groupBy("company_name").agg(F.array_join(F.sort_array(F.collect_set(F.col("report_year").cast("string"))), ",").alias("years"), F.count("*").alias("chunks"))


def query_routes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    rows = table(spark, d, "agent_cases").where("query is not null").select("case_id", "query").distinct()
    join = lambda a: F.array_join(F.transform(a, lambda y: y.cast("string")), ",")
    return rows.select("case_id", join(finance.years(q)).alias("years"), join(finance.report_years(q)).alias("report_years"), finance.year_policy(q).alias("policy"), finance.query_scope(q).alias("scope"), finance.scope_budget(q, 20, 100).alias("budget"), text.expand_query(q).alias("expanded"))


def english_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = text.english_tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit, recall, reciprocal rank and nDCG at 5 of the stored rankings against the cases' evidence pages."""
    gold = table(spark, d, "agent_cases").distinct().select(F.col("case_id").alias("query_id"), F.explode("evidence_sources").alias("e")).select("query_id", F.col("e.document_key").alias("document_key"), F.explode("e.pages").alias("page")).where("document_key is not null").distinct()
    hits = _hits(spark, d).where("query_id is not null and hit_rank <= 5").groupBy("query_id", "hit_rank").agg(F.min(F.struct("document_key", "page_start")).alias("h")).select("query_id", "hit_rank", "h.document_key", F.col("h.page_start").alias("page"))
    found = hits.join(gold, ["query_id", "document_key", "page"], "left_semi").select("query_id", "hit_rank")
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    gain = found.groupBy("query_id").agg(F.min("hit_rank").alias("first"), F.count("*").alias("found"), F.sum(1 / F.log2(F.col("hit_rank") + 1)).alias("dcg"))
    asked = hits.select("query_id").distinct().join(wanted, "query_id").join(gain, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(5)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return asked.select(
        "query_id", F.col("first").isNotNull().cast("int").alias("hit_at_5"), F.round(F.least(F.coalesce("found", F.lit(0)) / F.col("gold"), F.lit(1.0)), 6).alias("recall_at_5"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_5"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_at_5"),
    )


def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Lexical against dense ranks as two runs over the same questions: fixed, regressed, same."""
    hits = _hits(spark, d).where("query_id is not null").groupBy("query_id").agg(F.coalesce(F.min("lexical_rank"), F.lit(0)).alias("a"), F.coalesce(F.min("dense_rank"), F.lit(0)).alias("b"))
    good = lambda c: (F.col(c) > 0) & (F.col(c) <= 3)
    change = F.when(~good("a") & good("b"), "fixed").when(good("a") & ~good("b"), "regressed").otherwise("same")
    return hits.groupBy(change.alias("change")).agg(F.count("*").alias("questions"))


def bigram_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each question's tokens that its first hit's text holds."""
    q = table(spark, d, "agent_cases").where("query is not null").groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("query"))
    h = _hits(spark, d).where("query_id is not null and text is not null and hit_rank = 1").groupBy("query_id").agg(F.min("text").alias("text"))
    words = F.array_distinct(text.search_tokens(F.col("query")))
    rows = q.join(h, "query_id").select("query_id", words.alias("w"), text.search_tokens(F.col("text")).alias("t"))
    return rows.select("query_id", F.size("w").alias("tokens"), F.size(F.array_intersect("w", "t")).alias("covered"))


QUERIES = {
    f"r_{f.__name__}": f
    for f in (term_statistics, index_summary, bm25_top10, bm25_filtered, rank_fusion, nearest_vectors, page_windows, statement_scopes, scope_rerank, structured_rerank, ordered_lookup, company_years, query_routes, english_lengths, retrieval_metrics, paired_runs, bigram_coverage)
}

_C = """c AS (SELECT DISTINCT chunk_id, document_id, chunk_index, document_key, company_name, report_year, document_type,
  json_extract_string(payload_json, '$.text') AS text, CAST(json_extract(payload_json, '$.page_start') AS INT) AS page_start,
  CAST(json_extract(payload_json, '$.page_end') AS INT) AS page_end, CAST(json_extract(payload_json, '$.section_path') AS VARCHAR[]) AS section_path FROM chunks)"""
_HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def _tokens(t: str) -> str:
    """The search tokens of an expression, in DuckDB's dialect."""
    terms = "[" + ", ".join(f"'{x}'" for x in text.DOMAIN_TERMS) + "]"
    pairs = f"flatten(list_transform(regexp_extract_all(lower({t}), '{_HAN}+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    latin = f"regexp_extract_all(regexp_replace(lower({t}), '{_HAN}+', ' ', 'g'), '{text.LATIN}')"
    return f"list_concat(list_concat({latin}, {pairs}), list_filter({terms}, lambda x: contains(lower({t}), x)))"


_IT = "trim(concat_ws(' ', array_to_string(coalesce(section_path, []), ' '), array_to_string(coalesce(section_path, []), ' '), text))"
_Q = "q AS (SELECT DISTINCT case_id AS query_id, query FROM agent_cases WHERE query IS NOT NULL)"
_SOME_Q = f"q AS (SELECT DISTINCT case_id AS query_id, query FROM agent_cases WHERE query IS NOT NULL AND TRY_CAST(regexp_extract(case_id, '([0-9]+)$', 1) AS BIGINT) % {EVERY} = 0)"


def _bm25(questions: str, keep: str) -> str:
    return f"""WITH {_C}, {questions}, d AS (SELECT chunk_id, {keep} AS kept, {_tokens(_IT)} AS tokens FROM c), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
    tf AS (SELECT chunk_id, kept, length, term, count(*) AS tf FROM (SELECT chunk_id, kept, len(tokens) AS length, unnest(tokens) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM q) GROUP BY ALL),
    r AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS raw FROM w JOIN tf USING (term) JOIN df USING (term), s WHERE kept GROUP BY ALL)
    SELECT query_id, chunk_id, round(raw, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS INT) AS rank FROM r) WHERE rank <= 10"""


def _case(words: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _scope(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_case(cues, column)} THEN '{s}'" for s, cues in finance.SCOPE_CUES.items()) + f" WHEN {_case(finance.SCOPE_METRICS, column)} THEN 'annual_summary' ELSE 'unspecified' END"


def _count(words: list[str], column: str) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) + ")"


_SCOPE_SCORE = "CASE scope " + " ".join(f"WHEN '{s}' THEN 2 * {_count(finance.SCOPE_FOR[s], 'section')} - 2 * {_count(finance.SCOPE_AGAINST[s], 'section')}" for s in finance.SCOPE_FOR) + " ELSE 0 END"
_STRUCTURED = """(CASE WHEN contains(query, '季度') AND list_contains(kinds, 'quarterly') THEN 20 ELSE 0 END + CASE WHEN contains(query, '季度') AND (contains(query, '合计') OR contains(query, '全年')) AND list_contains(kinds, 'annual_data') THEN 16 ELSE 0 END
 + CASE WHEN contains(query, '毛利率') AND list_contains(kinds, 'segment') THEN 20 ELSE 0 END + CASE WHEN contains(query, '主营业务') AND regexp_matches(query, '分产品|分行业|毛利率') AND list_contains(kinds, 'segment') THEN 20 ELSE 0 END
 + CASE WHEN contains(query, '合并') AND contains(query, '母公司') AND contains(query, '营业收入') AND list_contains(kinds, 'note_cost') THEN 20 ELSE 0 END + CASE WHEN contains(query, '成本') AND regexp_matches(query, '差额|不同|为什么|附注') AND list_contains(kinds, 'note_cost') THEN 20 ELSE 0 END
 + CASE WHEN contains(query, '营业收入') AND list_contains(kinds, 'annual_data') AND NOT regexp_matches(query, '合并|母公司|主营业务') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(query, '归母净利润|扣非归母净利润') AND list_contains(kinds, 'annual_data') THEN 20 ELSE 0 END)"""
_H = "h AS (SELECT DISTINCT * FROM search_hits)"
_last = lambda marks: "greatest(" + ", ".join(f"CASE WHEN contains(x, '{m}') THEN length(x) - length(list_last(string_split(x, '{m}'))) - {len(m)} ELSE -1 END" for m in marks) + ")"
_YEARS = "list_distinct_ordered"


def _distinct(x: str) -> str:
    """A list's values in order, each once."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_ALL_YEARS = "regexp_extract_all(query, '20[0-9]{2}')"
_OWN_YEARS = f"regexp_extract_all(query, '{finance.REPORT_YEAR}', 1)"
_NEAR = "CASE WHEN position(y IN query) = 0 THEN query ELSE substr(query, greatest(position(y IN query) - 18, 1), position(y IN query) - greatest(position(y IN query) - 18, 1) + 22) END"
_expand = "query"
for _a, _b in text.SYNONYMS.items():
    _expand = f"replace({_expand}, '{_a}', '{_b}')"

SQL = {
    "r_term_statistics": f"WITH {_C}, t AS (SELECT chunk_id, unnest({_tokens(_IT)}) AS term FROM c), f AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM f GROUP BY term",
    "r_index_summary": f"WITH {_C} SELECT count(*) AS documents, round(avg(len({_tokens(_IT)})), 6) AS average_length FROM c",
    "r_bm25_top10": _bm25(_Q, "true"),
    "r_bm25_filtered": _bm25(_SOME_Q, "coalesce(report_year IN (2022, 2023, 2024) AND document_type = 'annual_report', false)"),
    "r_rank_fusion": f"""WITH {_H}, g AS (SELECT query_id, chunk_id, min(lexical_rank) AS lexical_rank, min(dense_rank) AS dense_rank FROM h WHERE query_id IS NOT NULL GROUP BY ALL),
      s AS (SELECT *, coalesce(2.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS raw FROM g)
      SELECT query_id, chunk_id, lexical_rank, dense_rank, round(raw, 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, chunk_id) AS INT) AS rank FROM s) WHERE rank <= 10""",
    "r_nearest_vectors": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS raw FROM e q, e WHERE q.vec_id % {EVERY} = 0)
      SELECT query_id, vec_id, round(raw, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS INT) AS rank FROM p) WHERE rank <= 10""",
    "r_page_windows": f"""WITH {_C}, {_H}, a AS (SELECT DISTINCT chunk_id AS anchor_id FROM h), w AS (SELECT anchor_id, document_id, chunk_index AS idx, greatest(page_start - 1, 1) AS low, page_end + 1 AS high FROM a JOIN c ON chunk_id = anchor_id),
      n AS (SELECT anchor_id, c.chunk_id, c.chunk_index, row_number() OVER (PARTITION BY anchor_id ORDER BY abs(c.chunk_index - idx), c.chunk_index, c.chunk_id) AS near FROM w JOIN c USING (document_id) WHERE page_end >= low AND page_start <= high)
      SELECT anchor_id, chunk_id, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY chunk_index, chunk_id) AS INT) AS position FROM n WHERE near <= 12""",
    "r_statement_scopes": f"""WITH {_C}, x AS (SELECT chunk_id, document_id, chunk_index, regexp_replace(array_to_string(coalesce(section_path, []), '') || substr(text, 1, 800), '[ \\t\\r\\n\\f\\x{{3000}}]+', '', 'g') AS x FROM c),
      m AS (SELECT chunk_id, document_id, chunk_index, {_last(R.PARENT_MARKS)} AS p, {_last(R.GROUP_MARKS)} AS g FROM x)
      SELECT chunk_id, coalesce(last_value(CASE WHEN p < 0 AND g < 0 THEN NULL WHEN p > g THEN 'parent' ELSE 'consolidated' END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unspecified') AS statement_scope FROM m""",
    "r_scope_rerank": f"""WITH {_C}, {_H}, q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases GROUP BY 1), s AS (SELECT chunk_id, coalesce(min(array_to_string(section_path, ' ')), '') AS section FROM c GROUP BY 1),
      r AS (SELECT h.query_id, h.chunk_id, hit_id, hit_rank, section, {_scope('query')} AS scope FROM h JOIN q ON q.query_id = h.query_id JOIN s ON s.chunk_id = h.chunk_id), k AS (SELECT *, {_SCOPE_SCORE} AS scope_score FROM r)
      SELECT query_id, chunk_id, hit_id, scope, scope_score, new_rank, hit_rank - new_rank AS rank_delta FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY scope_score DESC, hit_rank, chunk_id) AS INT) AS new_rank FROM k) WHERE new_rank <= 10""",
    "r_structured_rerank": f"""WITH {_H}, q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases GROUP BY 1), t AS (SELECT chunk_id, list(DISTINCT table_type) AS kinds FROM cell_proofs WHERE chunk_id IS NOT NULL GROUP BY 1),
      k AS (SELECT h.query_id, h.chunk_id, hit_id, hit_rank, {_STRUCTURED} AS structured_score FROM h JOIN q ON q.query_id = h.query_id LEFT JOIN t ON t.chunk_id = h.chunk_id)
      SELECT query_id, chunk_id, hit_id, structured_score, new_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY structured_score DESC, hit_rank, chunk_id) AS INT) AS new_rank FROM k) WHERE new_rank <= 10""",
    "r_ordered_lookup": """WITH i AS (SELECT unit_id, unnest(query_ids) AS case_id, CAST(generate_subscripts(query_ids, 1) - 1 AS INT) AS position FROM (SELECT DISTINCT * FROM split_overlaps)), k AS (SELECT case_id, min(query) AS query, min(split) AS split FROM agent_cases GROUP BY 1)
      SELECT unit_id, position, i.case_id, query, split FROM i LEFT JOIN k ON k.case_id = i.case_id""",
    "r_company_years": f"WITH {_C} SELECT company_name, coalesce(array_to_string(list_sort(list(DISTINCT CAST(report_year AS VARCHAR)) FILTER (report_year IS NOT NULL)), ','), '') AS years, count(*) AS chunks FROM c WHERE company_name IS NOT NULL GROUP BY company_name",
    "r_query_routes": f"""WITH q AS (SELECT DISTINCT case_id, query FROM agent_cases WHERE query IS NOT NULL), y AS (SELECT *, {_distinct(_ALL_YEARS)} AS ys, {_distinct(_OWN_YEARS)} AS own FROM q),
      p AS (SELECT *, list_filter(ys, lambda y: NOT list_contains(own, y) AND regexp_matches({_NEAR}, '{"|".join(finance.FORECAST_CUES)}') AND NOT regexp_matches({_NEAR}, '{"|".join(finance.STRONG_ACTUAL_CUES)}')) AS plan FROM y),
      f AS (SELECT *, len(list_filter(ys, lambda y: NOT list_contains(own, y) AND NOT list_contains(plan, y))) > 0 AS facts FROM p)
      SELECT case_id, array_to_string(ys, ',') AS years, array_to_string(own, ',') AS report_years, CASE WHEN len(own) > 0 AND len(plan) > 0 THEN 'explicit_report_and_forecast_target' WHEN len(own) > 0 THEN 'explicit_report_year' WHEN len(plan) > 0 AND NOT facts THEN 'forecast_target_no_report_filter' WHEN facts THEN 'fact_period_as_report_year' ELSE 'none' END AS policy,
      {_scope('query')} AS scope, CASE {_scope('query')} {" ".join(f"WHEN '{s}' THEN {max(20, n)}" for s, n in finance.SCOPE_BUDGETS.items())} END AS budget, {_expand} AS expanded FROM f""",
    "r_english_lengths": f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.ENGLISH.replace(chr(39), chr(39) * 2)}') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM t",
    "r_retrieval_metrics": f"""WITH {_H}, a AS (SELECT DISTINCT * FROM agent_cases), e AS (SELECT case_id AS query_id, unnest(evidence_sources) AS e FROM a), g AS (SELECT DISTINCT query_id, e.document_key AS document_key, unnest(e.pages) AS page FROM e WHERE e.document_key IS NOT NULL),
      f AS (SELECT query_id, hit_rank, min({{'document_key': document_key, 'page_start': page_start}}) AS x FROM h WHERE query_id IS NOT NULL AND hit_rank <= 5 GROUP BY ALL), r AS (SELECT query_id, hit_rank, x.document_key AS document_key, x.page_start AS page FROM f),
      k AS (SELECT query_id, min(hit_rank) AS first, count(*) AS found, sum(1 / log2(hit_rank + 1)) AS dcg FROM r WHERE EXISTS (SELECT 1 FROM g WHERE g.query_id = r.query_id AND g.document_key = r.document_key AND g.page = r.page) GROUP BY 1), w AS (SELECT query_id, count(*) AS gold FROM g GROUP BY 1)
      SELECT n.query_id, CAST(first IS NOT NULL AS INT) AS hit_at_5, round(least(coalesce(found, 0) / gold, 1.0), 6) AS recall_at_5, round(coalesce(1 / first, 0.0), 6) AS mrr_at_5, round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(gold, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_5
      FROM (SELECT DISTINCT query_id FROM r) n JOIN w ON w.query_id = n.query_id LEFT JOIN k ON k.query_id = n.query_id""",
    "r_paired_runs": f"""WITH {_H}, g AS (SELECT query_id, coalesce(min(lexical_rank), 0) BETWEEN 1 AND 3 AS a, coalesce(min(dense_rank), 0) BETWEEN 1 AND 3 AS b FROM h WHERE query_id IS NOT NULL GROUP BY 1)
      SELECT CASE WHEN NOT a AND b THEN 'fixed' WHEN a AND NOT b THEN 'regressed' ELSE 'same' END AS change, count(*) AS questions FROM g GROUP BY 1""",
    "r_bigram_coverage": f"""WITH {_H}, q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases WHERE query IS NOT NULL GROUP BY 1), t AS (SELECT query_id, min(text) AS text FROM h WHERE query_id IS NOT NULL AND text IS NOT NULL AND hit_rank = 1 GROUP BY 1),
      r AS (SELECT q.query_id, list_distinct({_tokens('query')}) AS w, {_tokens('text')} AS t FROM q JOIN t ON t.query_id = q.query_id) SELECT query_id, len(w) AS tokens, len(list_filter(w, lambda x: list_contains(t, x))) AS covered FROM r""",
}
