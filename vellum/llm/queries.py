"""Queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import leaks, lookalikes, overlaps, packing, pieces, scans, splits, textforms, truncation
from vellum.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: Splits of agent_cases.
TRAINING, EVALUATION = ["calibration"], ["dev", "frozen_test"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lookalikes.fields(spark, table(spark, sf_dir, "extracted_cells"), table(spark, sf_dir, "cell_proofs"))
    return lookalikes.find_lookalikes(cells, table(spark, sf_dir, "label_refs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_noise(table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "page_quality"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_texts(table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "page_quality"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_conflicts(table(spark, sf_dir, "version_manifest"), table(spark, sf_dir, "source_manifest"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "version_manifest"), table(spark, sf_dir, "source_manifest"), table(spark, sf_dir, "split_targets"))[0]


def p4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the earlier half of the versions first, then all of them with the component table that the first run kept."""
    versions, source, targets = (table(spark, sf_dir, t) for t in ("version_manifest", "source_manifest", "split_targets"))
    middle = versions.select(F.timestamp_seconds((F.unix_timestamp(F.min("created_at")) + F.unix_timestamp(F.max("created_at"))) / 2)).first()[0]
    early = versions.where(F.col("created_at") <= F.lit(middle))
    first, components = splits.assign_splits(early, source.join(early.select("document_key").distinct(), "document_key", "left_semi"), targets)
    again, _ = splits.assign_splits(versions, source, targets, kept=splits.kept_table(components))
    return again.join(first.select("version_id", F.col("split").alias("first_split")).distinct(), "version_id", "left").select("version_id", "document_key", "group_code", "first_split", "split", "status")


def _canon(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    return overlaps.canonical_cases(table(spark, sf_dir, "agent_cases"), TRAINING, EVALUATION, **options)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlapping_pairs(overlaps.cross_split_pairs(_canon(spark, sf_dir)))


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_units(_canon(spark, sf_dir))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_counts(_canon(spark, sf_dir))


def p5_exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts for records that are the same but for case, punctuation, blanks and letter width."""
    return overlaps.overlap_counts(_canon(spark, sf_dir, rounds=0))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.found(table(spark, sf_dir, "chunks"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.rechunk(table(spark, sf_dir, "chunks"))


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coverage(pieces.rechunk(table(spark, sf_dir, "chunks")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with whether their parts follow one another and lie in containers that hold no more than they can."""
    return packing.containment(packing.pack(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(_judged(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(_judged(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p3_found, p3_paragraphs, p4_found, p4_splits, p4_incremental, p5_found, p5_overlaps, p5_counts, p5_exact_counts, p6_found, p6_pieces, p6_coverage, p7_containers, p7_containment, p8_found, p9_found, p9_shares)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def _p4_sql() -> str:
    """Components as the closure of all edges, which only a small data set bears."""
    wide, narrow = textforms._WIDE, textforms._ASCII.replace("'", "''")
    name = f"regexp_replace(upper(regexp_replace(translate(company_name, '{wide}', '{narrow}'), '[ \\x{{3000}}\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\t]', '', 'g')), '^(\\*?ST)+', '')"
    return f"""WITH RECURSIVE d AS (SELECT DISTINCT document_key, security_code, company_name FROM source_manifest WHERE document_key IS NOT NULL), n AS (SELECT document_key, {name} AS nm FROM d),
      k AS (SELECT 'd:' || document_key AS a, 'c:' || trim(security_code) AS b FROM d WHERE trim(security_code) <> '' UNION SELECT 'd:' || document_key, 'n:' || nm FROM n WHERE nm <> '' UNION SELECT 'd:' || document_key, 'd:' || document_key FROM version_manifest WHERE document_key IS NOT NULL),
      e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
      g AS (SELECT node, min(other) AS root, min(CASE WHEN starts_with(other, 'c:') THEN substr(other, 3) END) AS group_code FROM r WHERE starts_with(node, 'd:') GROUP BY 1),
      v AS (SELECT DISTINCT version_id, split, root, group_code FROM version_manifest JOIN g ON node = 'd:' || document_key WHERE split IS NOT NULL)
      SELECT DISTINCT version_id, group_code FROM v WHERE root IN (SELECT root FROM v GROUP BY root HAVING count(DISTINCT split) > 1)"""


def _exact_sql() -> str:
    wide, narrow = textforms._WIDE + textforms._BLANKS, textforms._ASCII.replace("'", "''") + " " * len(textforms._BLANKS)
    bare = f"regexp_replace(lower(translate(query, '{wide}{textforms._UNSEEN}', '{narrow}')), '[\\p{{P}}\\p{{S}}]', ' ', 'g')"
    return f"""WITH c AS (SELECT DISTINCT case_id AS id, split, source, array_to_string(regexp_extract_all({bare}, '[a-z]+|[0-9]+|[^\\sa-z0-9]'), ' ') AS canon FROM agent_cases WHERE case_id IS NOT NULL AND query IS NOT NULL AND split IN ('calibration', 'dev', 'frozen_test')),
      t AS (SELECT canon, count(DISTINCT id) AS n FROM c WHERE split = 'calibration' AND canon <> '' GROUP BY 1), e AS (SELECT DISTINCT id, split, source, canon FROM c WHERE split <> 'calibration')
      SELECT split AS eval_split, source AS eval_source, count(DISTINCT id) AS leaked, CAST(sum(n) AS BIGINT) AS pairs FROM e JOIN t USING (canon) GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _p4_sql(),
        "p5_exact_counts": _exact_sql(),
        "p6_coverage": "SELECT DISTINCT chunk_id, CAST(length(json_extract_string(payload_json, '$.text')) AS INT) AS characters, true AS within, true AS gapless FROM chunks WHERE json_extract_string(payload_json, '$.text') IS NOT NULL",
        "p7_containment": "SELECT DISTINCT doc_id, true AS whole, true AS fits FROM documents",
        "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(json_extract_string(payload_json, '$.text')) > 1200 AND chunk_id IS NOT NULL",
    }
