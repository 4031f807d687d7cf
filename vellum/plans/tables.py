"""Queries over table cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import plain_label, plain_value
from vellum.operators import regulated as G
from vellum.operators import tables as T
from vellum.plans.documents import _chunks
from vellum.plans.retrieval import _C
from vellum.runtime import table

KEYS = ["table_id", "row_label", "column_label", "cell_value"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cell_proofs").distinct()


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).where("value_bbox is not null and document_key is not null and page_number is not null").select("document_key", "page_number", "table_id", F.col("proof_id").alias("box_id"), "value_bbox.*")


def row_indexes(spark: SparkSession, d: str) -> DataFrame:
    return T.first_appearance_index(_cells(spark, d), "table_id", "row_label", "proof_id")


def unique_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Text cells with the place of the one coordinate cell that reads the same in their document."""
    keys = ["document_key", "row_label", "column_label", "cell_value"]
    c = _cells(spark, d)
    known = c.where("geometry_status = 'coordinate'").select(*keys, "page_number", F.col("value_bbox.y0").alias("y0"))
    found = T.attach_unique(c.where("geometry_status = 'text_only'").select("proof_id", *keys), known, keys, ["page_number", "y0"])
    return found.select("proof_id", "page_number", "y0")


def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "extracted_cells").distinct()
    return T.cell_union(c, KEYS, [F.col("page_number").asc_nulls_first(), F.col("cell_id")]).select("cell_id", *KEYS)


def restored_sections(spark: SparkSession, d: str) -> DataFrame:
    """Cells without a section take the last one that their table names before them."""
    c = table(spark, d, "extracted_cells").distinct().withColumn("own", F.when(F.col("section") != "", F.col("section")))
    last = c.groupBy("table_id").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("cell_id"))).alias("table_section"))
    return c.join(last, "table_id", "left").select("cell_id", "table_id", F.coalesce("own", "table_section", F.lit("")).alias("section"))


def plain_values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "extracted_cells").distinct()
    v = plain_value(F.col("cell_value"))
    return c.select("cell_id", plain_label(F.col("row_label")).alias("row_label"), v.alias("cell_value"), v.rlike("^ *-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][0-9]+)? *$").alias("is_number"))


def row_bands(spark: SparkSession, d: str) -> DataFrame:
    return T.row_bands(_boxes(spark, d), ["document_key", "page_number"]).select("box_id", "document_key", "page_number", F.col("band").cast("int").alias("band"))


def column_bounds(spark: SparkSession, d: str) -> DataFrame:
    centres = _boxes(spark, d).groupBy("table_id", F.round((F.col("x0") + F.col("x1")) / 2, 1).alias("x")).agg(F.count("*").alias("cells"))
    return T.column_bounds(centres, ["table_id"], "x").select("table_id", "x", "cells", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


def covering_boxes(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, 3).alias(n)
    return _boxes(spark, d).groupBy("table_id", "page_number").agg(r(F.min("x0"), "x0"), r(F.min("y0"), "y0"), r(F.max("x1"), "x1"), r(F.max("y1"), "y1"), F.count("*").alias("cells"))


def rotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    turn = T.rotate_box(F.struct("x0", "y0", "x1", "y1"), F.lit(595.0), F.lit(842.0), F.pmod("page_number", F.lit(4)) * 90)
    return b.select("box_id", *[F.round(turn[c], 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def proof_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("proof_id", T.proof_hash(["table_id", "table_type", "chunk_id", "chunk_sha256", "row_label", "row_index", "column_label", "cell_value", "page_number"]).alias("binding"))


def table_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", F.array_join(G.table_kinds(F.col("text")), ",").alias("kinds"))


#: Texts that show the regulated tables, as no test table does; they are read beside the chunks and documents.
SHOWN = [
    ("x-quarterly", "2023年分季度主要财务数据 第一季度（1-3 月份） 第二季度（4-6 月份） 第三季度（7-9 月份） 第四季度（10-12 月份） 营业收入 1,200.50 1,310.00 1,405.75 1,500.25 归属于上市公司股东的净利润 100.5 -20.25 130 145.75"),
    ("x-uneven", "第一季度 第二季度 第三季度 第四季度 营业收入 1 2 3"),
    ("x-note", "营业收入和营业成本 项目 本期发生额 上期发生额 收入 成本 收入 成本 主营业务 9,000.10 5,000.20 8,000.30 4,000.40 其他业务 10 5 8 4 合计 9,010.10 5,005.20 8,008.30 4,004.40"),
    ("x-segment", "主营业务分行业情况 分行业 营业收入 营业成本 毛利率（%） 营业收入比上年增减（%） 食品 500.00 300.00 40.00 5.1 4.2 纺织品 200 150 25 -3.0 -2.0 1.5 营业收入 1 2 3 4 5 主营业务分地区情况 分地区 毛利率比上年增减（%） 华东 77.5 66.5 14.19 1 2 增加 3 个百分点"),
    ("x-annual", "主要会计数据 2023年 2022年 本期比上年同期增减(%) 2021年 营业收入 1,000.5 900.25 11.1 800 归属于上市公司股东的净利润 -10.5 20 30.25 2023年末 2022年末 本期末比上年同期末增减（%） 2021年末 总资产 5,000 4,500 11 4,000 归属于上市公司股东的净资产 2,000 1,900 5.3 1,800"),
    ("x-parent", "母公司 营业收入和营业成本 本期发生额 上期发生额 收入 成本 收入 成本 主营业务 700 500 650 450 其他业务 2 1 2 1 合计 702 501 652 451"),
    ("x-both", "主要会计数据 2023年 2022年 2021年 营业收入 5,416.50 5,000 4,500 归属于上市公司股东的净利润 400.25 380 350 归属于上市公司股东的扣除非经常性损益的净利润 390.15 370 340 非经常性损益合计 10.10 第一季度 第二季度 第三季度 第四季度 营业收入 1,200.50 1,310.00 1,405.75 1,500.25 归属于上市公司股东的净利润 100.5 90 100 110"),
    ("x-shares", "前五名客户销售额 12,345.67 万元，占年度销售总额 23.45%；前五名供应商采购额 2,345 万元，占年度采购总额 8.9%。"),
]


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", "text").unionByName(spark.createDataFrame(SHOWN, "chunk_id string, text string"))


def concentration(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(spark.createDataFrame(SHOWN, "doc_id string, text string"))
    return docs.select("doc_id", F.inline(G.concentration_cells(F.col("text")))).drop("section")


def extracted_tables(spark: SparkSession, d: str) -> DataFrame:
    return G.extract_tables(_shown(spark, d), "chunk_id", "text")


def column_clusters(spark: SparkSession, d: str) -> DataFrame:
    return T.cluster_columns(_boxes(spark, d), ["document_key", "page_number"])


def number_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Multiset precision, recall and F1 of the extracted numbers against the proved ones, per document."""
    one = lambda t, n: table(spark, d, t).distinct().where("document_key is not null").select("document_key", plain_value(F.col("cell_value")).alias("v")).where(F.col("v").rlike("^-?[0-9]+([.][0-9]+)?$")).groupBy("document_key", "v").agg(F.count("*").alias(n))
    both = one("cell_proofs", "a").join(one("extracted_cells", "b"), ["document_key", "v"], "full")
    g = both.groupBy("document_key").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("reference"), F.coalesce(F.sum("b"), F.lit(0)).alias("candidate"), F.coalesce(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))), F.lit(0)).alias("shared"))
    p, r = F.try_divide(F.col("shared"), F.col("candidate")), F.try_divide(F.col("shared"), F.col("reference"))
    return g.select("document_key", "reference", "candidate", "shared", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * F.col("shared"), F.col("candidate") + F.col("reference")), F.lit(0.0)), 6).alias("f1"))


QUERIES = {f"t_{f.__name__}": f for f in (row_indexes, unique_geometry, merged_cells, restored_sections, plain_values, row_bands, column_bounds, covering_boxes, rotated_boxes, proof_hashes, table_kinds, concentration, extracted_tables, column_clusters, number_agreement)}

_P = "p AS (SELECT DISTINCT * FROM cell_proofs)"
_X = "x AS (SELECT DISTINCT * FROM extracted_cells)"
_B = f"{_P}, b AS (SELECT document_key, page_number, table_id, proof_id AS box_id, value_bbox.x0 AS x0, value_bbox.y0 AS y0, value_bbox.x1 AS x1, value_bbox.y1 AS y1 FROM p WHERE value_bbox IS NOT NULL AND document_key IS NOT NULL AND page_number IS NOT NULL)"
_V = "translate(replace(replace(cell_value, ',', ''), '+', ''), '−', '-')"
_L = r"regexp_replace({}, '[ \t\r\n\f\x{{00a0}}\x{{3000}}]+', '', 'g')"
_TL = _L.format("text")
_all = lambda ws: " AND ".join(f"contains(t, '{w}')" for w in ws)
_any = lambda ws: "(" + " OR ".join(f"contains(t, '{w}')" for w in ws) + ")"
_SHOWN = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in SHOWN) + ") v(k, text)"


def _tables_sql() -> str:
    """All families in one statement: regions, runs of numbers, labels behind the header words."""
    lst = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    plain = "translate(replace(replace({}, ',', ''), '+', ''), '−', '-')"
    words = lambda hs: "|".join(h.replace("(", "[(]").replace(")", "[)]") for h in hs)
    label = lambda hs: f"regexp_replace(regexp_replace(regexp_replace(l, '^.*(?:{words(hs)})', ''), '\\s+', '', 'g'), '{G.EDGES}', '', 'g')"
    nums = lambda c: f"regexp_extract_all({c}, '{G.NUMBER}')"
    runs = lambda c: f"unnest(regexp_extract_all({c}, '{G.RUN}', 1)) AS l, unnest(regexp_extract_all({c}, '{G.RUN}', 2)) AS r, generate_subscripts(regexp_extract_all({c}, '{G.RUN}', 1), 1) AS i"
    segments = " UNION ALL ".join(
        f"SELECT k, {n} AS o, '{t}' AS section, substr(t, instr(t, '{t}') + {len(t)}) AS rest FROM s WHERE contains(t, '{t}')" for n, t in enumerate(G.SEGMENT_TITLES)
    )
    ends = "least(" + ", ".join(f"CASE WHEN section <> '{t}' AND instr(rest, '{t}') > 0 THEN instr(rest, '{t}') ELSE length(rest) + 1 END" for t in G.SEGMENT_TITLES) + ")"
    cell = lambda kind, row, column, value, section, order: f"SELECT k AS key, '{kind}' AS table_kind, {row} AS row_label, {column} AS column_label, {plain.format(value)} AS cell_value, {section} AS section, CAST(row_number() OVER (PARTITION BY k ORDER BY {order}) - 1 AS INT) AS cell_no"
    notes = " UNION ALL ".join(f"SELECT k, {n} AS o, '{r}' AS row, {nums(f'substr(t, instr(t, {chr(39)}{r}{chr(39)}) + {len(r)})')} AS n FROM note WHERE contains(t, '{r}')" for n, r in enumerate(G.NOTE_ROWS))
    shares = " UNION ALL ".join(f"SELECT k, {n} AS o, '{r}' AS row, '{c}' AS col, regexp_extract(t, '{p}', 1) AS v FROM s WHERE list_contains(kinds, 'concentration')" for n, (r, c, p) in enumerate(G.CONCENTRATION))
    tl = _L.format("text")
    kinds = f"""list_filter([CASE WHEN {_all(G.QUARTERS)} THEN 'quarterly' END, CASE WHEN {_all(['营业收入和营业成本', '本期发生额', '上期发生额', '收入', '成本'])} THEN 'note_cost' END, CASE WHEN {_any(G.SEGMENT_TITLES)} THEN 'segment' END,
      CASE WHEN contains(t, '主要会计数据') AND len(list_distinct(regexp_extract_all(t, '20[0-9]{{2}}年'))) >= 3 THEN 'annual_data' END, CASE WHEN {_any(['前五名客户销售额', '前五名供应商采购额'])} THEN 'concentration' END], lambda x: x IS NOT NULL)"""
    return f"""WITH {_C}, u AS (SELECT chunk_id AS k, text FROM c WHERE text IS NOT NULL UNION ALL {_SHOWN}), z AS (SELECT k, text, {tl} AS t FROM u), s AS (SELECT k, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, {kinds} AS kinds FROM z),
      q0 AS (SELECT k, regexp_replace(t, '[（(]\\s*[0-9]+\\s*[-—]\\s*[0-9]+\\s*月份?[）)]', '', 'g') AS t FROM s WHERE list_contains(kinds, 'quarterly')),
      q1 AS (SELECT k, substr(t, greatest(instr(t, '{G.QUARTERS[0]}'), 1)) AS t FROM q0), q2 AS (SELECT k, list_filter({lst(G.QUARTER_ROWS)}, lambda r: contains(replace(t, ' ', ''), r)) AS rows, {nums('t')} AS n FROM q1),
      q AS (SELECT k, rows, n[i + 1] AS v, i FROM (SELECT k, rows, n, unnest(range(len(n))) AS i FROM q2 WHERE len(rows) > 0 AND len(n) = 4 * len(rows))),
      note AS (SELECT * FROM s WHERE list_contains(kinds, 'note_cost')), n1 AS ({notes}), n2 AS (SELECT k, o, row, n, unnest(range(4)) AS i FROM n1 WHERE len(n) >= 4),
      g0 AS (SELECT * FROM ({segments}) WHERE k IN (SELECT k FROM s WHERE list_contains(kinds, 'segment'))), g1 AS (SELECT k, o, section, substr(rest, 1, {ends} - 1) AS x FROM g0), g2 AS (SELECT k, o, section, {runs('x')} FROM g1),
      g3 AS (SELECT k, o, section, i, {label(G.SEGMENT_HEADS)} AS row, {nums('r')} AS n FROM g2), g AS (SELECT *, unnest(range(3)) AS j FROM g3 WHERE len(n) IN (5, 6) AND row <> '' AND length(row) <= 24 AND NOT regexp_matches(row, '{'|'.join(G.SEGMENT_JUNK)}')),
      a0 AS (SELECT k, t, length(regexp_extract(t, '^(.*?)20[0-9]{{2}}\\s*年末', 1)) AS cutat, regexp_matches(t, '20[0-9]{{2}}\\s*年末') AS two FROM s WHERE list_contains(kinds, 'annual_data')),
      a1 AS (SELECT k, 0 AS o, CASE WHEN two THEN substr(t, 1, cutat) ELSE t END AS x FROM a0 UNION ALL SELECT k, 1, substr(t, cutat + 1) FROM a0 WHERE two), y0 AS (SELECT k, o, x, regexp_extract_all(x, '(20[0-9]{{2}})\\s*年', 1) AS ys FROM a1),
      y AS (SELECT k, o, x, list_filter(ys, lambda v, i: list_position(ys, v) = i)[1:3] AS ys FROM y0), a2 AS (SELECT k, o, ys, {runs('x')} FROM y WHERE len(ys) = 3), a3 AS (SELECT k, o, ys, i, {label(G.ANNUAL_HEADS)} AS row, {nums('r')} AS n FROM a2),
      a AS (SELECT *, unnest(range(3)) AS j FROM a3 WHERE list_contains({lst(G.ANNUAL_ROWS)}, row) AND len(n) IN (3, 4)), c5 AS ({shares})
      {cell('quarterly', 'rows[i // 4 + 1]', lst(G.QUARTERS) + '[i % 4 + 1]', 'v', "''", 'i')} FROM q UNION ALL {cell('note_cost', 'row', lst(G.NOTE_COLUMNS) + '[i + 1]', 'n[i + 1]', "''", 'o, i')} FROM n2
      UNION ALL {cell('segment', 'row', lst(G.SEGMENT_COLUMNS) + '[j + 1]', 'n[j + 1]', 'section', 'o, i, j')} FROM g UNION ALL {cell('annual_data', 'row', "ys[j + 1] || '年'", 'n[CASE WHEN j = 2 THEN len(n) ELSE j + 1 END]', "''", 'o, i, j')} FROM a
      UNION ALL {cell('concentration', 'row', 'col', 'v', f"'{G.CONCENTRATION_SECTION}'", 'o')} FROM c5 WHERE v <> ''"""


SQL = {
    "t_row_indexes": f"WITH {_P}, f AS (SELECT table_id, row_label, min(proof_id) AS first FROM p WHERE row_label IS NOT NULL AND table_id IS NOT NULL GROUP BY ALL) SELECT table_id, row_label, CAST(row_number() OVER (PARTITION BY table_id ORDER BY first, row_label) AS INT) AS label_index FROM f",
    "t_unique_geometry": f"""WITH {_P}, k AS (SELECT document_key, row_label, column_label, cell_value, count(*) AS n, any_value(page_number) AS page_number, any_value(value_bbox.y0) AS y0 FROM p WHERE geometry_status = 'coordinate' GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)
      SELECT proof_id, k.page_number, k.y0 FROM p LEFT JOIN k ON p.document_key = k.document_key AND p.row_label = k.row_label AND p.column_label = k.column_label AND p.cell_value = k.cell_value WHERE geometry_status = 'text_only'""",
    "t_merged_cells": f"WITH {_X} SELECT cell_id, table_id, row_label, column_label, cell_value FROM (SELECT *, row_number() OVER (PARTITION BY table_id, row_label, column_label, cell_value ORDER BY page_number NULLS FIRST, cell_id) AS r FROM x) WHERE r = 1",
    "t_restored_sections": f"WITH {_X}, l AS (SELECT table_id, arg_max(section, cell_id) AS s FROM x WHERE section <> '' GROUP BY 1) SELECT cell_id, x.table_id, coalesce(nullif(section, ''), s, '') AS section FROM x LEFT JOIN l ON l.table_id = x.table_id",
    "t_plain_values": f"WITH {_X} SELECT cell_id, {_L.format('row_label')} AS row_label, {_V} AS cell_value, regexp_matches({_V}, '^ *-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][0-9]+)? *$') AS is_number FROM x",
    "t_row_bands": f"""WITH {_B}, s AS (SELECT *, max(y1) OVER (PARTITION BY document_key, page_number ORDER BY y0, y1, x0, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
      SELECT box_id, document_key, page_number, CAST(sum(CASE WHEN reach IS NULL OR y0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY document_key, page_number ORDER BY y0, y1, x0, box_id ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM s""",
    "t_column_bounds": f"WITH {_B}, c AS (SELECT table_id, round((x0 + x1) / 2, 1) AS x, count(*) AS cells FROM b GROUP BY ALL) SELECT table_id, x, cells, round((lag(x) OVER w + x) / 2, 3) AS low, round((lead(x) OVER w + x) / 2, 3) AS high FROM c WINDOW w AS (PARTITION BY table_id ORDER BY x)",
    "t_covering_boxes": f"WITH {_B} SELECT table_id, page_number, round(min(x0), 3) AS x0, round(min(y0), 3) AS y0, round(max(x1), 3) AS x1, round(max(y1), 3) AS y1, count(*) AS cells FROM b GROUP BY 1, 2",
    "t_rotated_boxes": f"""WITH {_B} SELECT box_id, round(CASE page_number % 4 WHEN 1 THEN 842.0 - y1 WHEN 2 THEN 595.0 - x1 WHEN 3 THEN y0 ELSE x0 END, 3) AS x0, round(CASE page_number % 4 WHEN 1 THEN x0 WHEN 2 THEN 842.0 - y1 WHEN 3 THEN 595.0 - x1 ELSE y0 END, 3) AS y0,
      round(CASE page_number % 4 WHEN 1 THEN 842.0 - y0 WHEN 2 THEN 595.0 - x0 WHEN 3 THEN y1 ELSE x1 END, 3) AS x1, round(CASE page_number % 4 WHEN 1 THEN x1 WHEN 2 THEN 842.0 - y0 WHEN 3 THEN 595.0 - x0 ELSE y1 END, 3) AS y1 FROM b""",
    "t_proof_hashes": f"WITH {_P} SELECT proof_id, sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("table_id", "table_type", "chunk_id", "chunk_sha256", "row_label", "row_index", "column_label", "cell_value", "page_number")) + ")) AS binding FROM p",
    "t_table_kinds": f"""WITH {_C}, y AS (SELECT chunk_id, {_TL} AS t FROM c WHERE text IS NOT NULL) SELECT chunk_id, array_to_string(list_filter([CASE WHEN {_all(G.QUARTERS)} THEN 'quarterly' END, CASE WHEN {_all(['营业收入和营业成本', '本期发生额', '上期发生额', '收入', '成本'])} THEN 'note_cost' END, CASE WHEN {_any(G.SEGMENT_TITLES)} THEN 'segment' END,
      CASE WHEN contains(t, '主要会计数据') AND len(list_distinct(regexp_extract_all(t, '20[0-9]{{2}}年'))) >= 3 THEN 'annual_data' END, CASE WHEN {_any(['前五名客户销售额', '前五名供应商采购额'])} THEN 'concentration' END], lambda x: x IS NOT NULL), ',') AS kinds FROM y""",
    "t_concentration": f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL {_SHOWN}), r AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS row_label, '{c}' AS column_label, replace(regexp_extract(text, '{p}', 1), ',', '') AS cell_value FROM d WHERE text IS NOT NULL" for r, c, p in G.CONCENTRATION) + ") SELECT * FROM r WHERE cell_value <> ''",
    "t_extracted_tables": _tables_sql(),
    "t_number_agreement": f"""WITH a AS (SELECT document_key, v, count(*) AS na FROM (SELECT document_key, {_V} AS v FROM (SELECT DISTINCT * FROM cell_proofs) WHERE document_key IS NOT NULL) WHERE regexp_matches(v, '^-?[0-9]+([.][0-9]+)?$') GROUP BY ALL), b AS (SELECT document_key, v, count(*) AS nb FROM (SELECT document_key, {_V} AS v FROM (SELECT DISTINCT * FROM extracted_cells) WHERE document_key IS NOT NULL) WHERE regexp_matches(v, '^-?[0-9]+([.][0-9]+)?$') GROUP BY ALL),
      j AS (SELECT coalesce(a.document_key, b.document_key) AS document_key, na, nb FROM a FULL JOIN b ON a.document_key = b.document_key AND a.v = b.v), g AS (SELECT document_key, CAST(coalesce(sum(na), 0) AS BIGINT) AS reference, CAST(coalesce(sum(nb), 0) AS BIGINT) AS candidate, CAST(coalesce(sum(CASE WHEN na IS NULL THEN 0 ELSE least(na, coalesce(nb, 0)) END), 0) AS BIGINT) AS shared FROM j GROUP BY 1)
      SELECT *, round(coalesce(shared / nullif(candidate, 0), 0), 6) AS precision, round(coalesce(shared / nullif(reference, 0), 0), 6) AS recall, round(coalesce(2 * shared / nullif(candidate + reference, 0), 0), 6) AS f1 FROM g""",
}
