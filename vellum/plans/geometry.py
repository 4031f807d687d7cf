"""Queries of token geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import geometry as O
from vellum.operators.regulated import ANNUAL_ROWS
from vellum.plans.documents import _chunks
from vellum.plans.retrieval import _C
from vellum.plans.scoring import _boxes
from vellum.plans.scoring_sql import _B

#: Spans of drawn numbers: page, box, text, left, right.
DRAWN = [(1, 1, "收入", 0.0, 20.0), (1, 2, "360", 30.0, 45.0), (1, 3, ",", 45.5, 47.0), (1, 4, "403", 47.5, 60.0), (1, 5, "2024", 90.0, 110.0), (1, 6, "12", 111.0, 120.0), (2, 7, "1", 0.0, 5.0), (2, 8, ".", 5.2, 6.0), (2, 9, "5", 6.1, 9.0), (2, 10, ",", 9.2, 10.0), (3, 11, "7", 0.0, 5.0), (3, 12, ",", 60.0, 61.0), (3, 13, "123", 61.5, 70.0), (4, 14, "1", 0.0, 4.0), (4, 15, ",", 4.2, 5.0), (4, 16, "2", 5.1, 9.0), (4, 17, ",", 9.1, 10.0), (4, 18, "3", 10.1, 14.0)]


def span_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Row label and value of each cell as one span, cut into pieces."""
    spans = _boxes(spark, d).where("cell_value is not null").select(F.col("proof_id").alias("box_id"), F.concat(F.lit("合计 "), "cell_value").alias("text"), "x0", "x1")
    return O.split_spans(spans).groupBy("box_id").agg(F.count("*").alias("pieces"), F.count_if("numeric").alias("numbers"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def joined_fragments(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(DRAWN, "line int, box_id int, text string, x0 double, x1 double").withColumn("height", F.lit(10.0))
    return O.join_fragments(t, ["line"])


def label_segments(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", F.posexplode(O.label_segments(F.col("text"), ANNUAL_ROWS)).alias("place", "s")).select("chunk_id", "place", "s.label", F.char_length("s.content").alias("characters"))


def centre_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.centre_rows(_boxes(spark, d).withColumnRenamed("proof_id", "box_id"), ["document_key", "page_number"])


def assigned_columns(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each line of a page to the page's columns, which are the distinct left edges of its first line."""
    b = _boxes(spark, d).select("document_key", "page_number", "proof_id", F.round((F.col("x0") + F.col("x1")) / 2, 1).alias("x"), F.round(F.col("y0"), 0).cast("int").alias("line"))
    page = F.concat_ws("|", "document_key", F.col("page_number").cast("string"))
    n = b.select(page.alias("page"), "line", F.col("proof_id").alias("box_id"), "x")
    heads = n.groupBy("page").agg(F.min("x").alias("low"), F.max("x").alias("high")).select("page", F.inline(F.array(F.struct(F.lit("first").alias("column_label"), F.col("low").alias("x")), F.struct(F.lit("last").alias("column_label"), F.col("high").alias("x")))))
    return O.assign_columns(n, heads, ["page", "line"])


QUERIES = {f"g_{f.__name__}": f for f in (span_pieces, joined_fragments, label_segments, centre_rows, assigned_columns)}

_LABELS = "|".join(r"\s*".join(label) for label in sorted(ANNUAL_ROWS, key=len, reverse=True))
SQL = {
    "g_span_pieces": rf"""WITH {_B}, s AS (SELECT proof_id AS box_id, '合计 ' || cell_value AS text, x0, x1 FROM b WHERE cell_value IS NOT NULL), p AS (SELECT box_id, x0, x1, length(text) AS n, unnest(regexp_extract_all(text, '({O.PIECE})', 1)) AS t, generate_subscripts(regexp_extract_all(text, '({O.PIECE})', 1), 1) AS i FROM s),
      e AS (SELECT *, sum(length(t)) OVER (PARTITION BY box_id ORDER BY i) AS stop0 FROM p), q AS (SELECT box_id, x0, greatest(0.01, x1 - x0) AS w, n, trim(t) AS t, stop0 - length(t) + length(t) - length(ltrim(t)) AS a FROM e)
      SELECT box_id, count(*) AS pieces, CAST(count_if(regexp_matches(t, '{O.NUMERIC}')) AS BIGINT) AS numbers, min(round(x0 + w * a / n, 4)) AS x0, max(round(x0 + w * (a + length(t)) / n, 4)) AS x1 FROM q WHERE NOT regexp_matches(t, '{O.PUNCTUATION}') GROUP BY 1""",
    "g_joined_fragments": f"""WITH t AS (SELECT * FROM (VALUES {", ".join(str(x) for x in DRAWN)}) v(line, box_id, text, x0, x1)), k AS (SELECT *, regexp_matches(text, '^[-−]?[0-9][0-9,.]*%?$') AS num, text IN (',', '.') AS mark, coalesce(lead(x0) OVER w - x1 <= 4.5, false) AS tight FROM t WINDOW w AS (PARTITION BY line ORDER BY x0, box_id)),
      o AS (SELECT *, coalesce(num AND tight AND lead(mark) OVER w AND lead(tight) OVER w AND lead(num, 2) OVER w, false) AS over FROM k WINDOW w AS (PARTITION BY line ORDER BY x0, box_id)), j AS (SELECT *, NOT (coalesce(lag(over) OVER w, false) OR coalesce(lag(over, 2) OVER w, false)) AS start FROM o WINDOW w AS (PARTITION BY line ORDER BY x0, box_id)),
      r AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY line ORDER BY x0, box_id) AS run FROM j), g AS (SELECT line, run, string_agg(text, '' ORDER BY x0, box_id) AS joined, count(*) AS n FROM r GROUP BY 1, 2), h AS (SELECT *, n = 1 OR regexp_matches(joined, '^[-−]?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?%?$|^[-−]?[0-9]+(?:\\.[0-9]+)?%?$') AS good FROM g)
      SELECT r.line, min(box_id) AS first_id, any_value(joined) AS text, CAST(min(x0) AS DOUBLE) AS x0, CAST(max(x1) AS DOUBLE) AS x1, CAST(count(*) AS INT) AS parts FROM r JOIN h ON h.line = r.line AND h.run = r.run WHERE good GROUP BY r.line, r.run UNION ALL SELECT r.line, box_id, text, CAST(x0 AS DOUBLE), CAST(x1 AS DOUBLE), 1 FROM r JOIN h ON h.line = r.line AND h.run = r.run WHERE NOT good""",
    "g_label_segments": rf"""WITH {_C}, x AS (SELECT chunk_id, regexp_extract_all(text, '({_LABELS})', 1) AS f, regexp_split_to_array(text, '{_LABELS}') AS p FROM c WHERE text IS NOT NULL), y AS (SELECT chunk_id, unnest(range(len(f))) AS i, f, p FROM x)
      SELECT chunk_id, CAST(i AS INT) AS place, regexp_replace(f[i + 1], '\s+', '', 'g') AS label, CAST(length(trim(p[i + 2])) AS INT) AS characters FROM y""",
    "g_assigned_columns": f"""WITH {_B}, n AS (SELECT concat_ws('|', document_key, CAST(page_number AS VARCHAR)) AS page, CAST(round(y0, 0) AS INT) AS line, proof_id AS box_id, round((x0 + x1) / 2, 1) AS x FROM b), h AS (SELECT page, min(x) AS low, max(x) AS high FROM n GROUP BY 1),
      f AS (SELECT n.page, line, box_id, x, row_number() OVER (PARTITION BY n.page, line ORDER BY abs(x - low), x, box_id) AS r, high FROM n JOIN h ON h.page = n.page), g AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY abs(x - high), x, box_id) AS q FROM f WHERE r > 1)
      SELECT page, line, 'first' AS column_label, box_id FROM f WHERE r = 1 UNION ALL SELECT page, line, 'last', box_id FROM g WHERE q = 1""",
}
