"""Registered queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import units
from vellum.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.p1_units(spark, table(spark, sf_dir, "cell_proofs"), table(spark, sf_dir, "agent_cases"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.converted_figures(_converted(spark, sf_dir))


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir)


def p1_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures whose unit is missing and can't be told with confidence."""
    return _converted(spark, sf_dir).where(F.col("status") == "review").select("record_table", "record_key", "figure", "confidence").distinct()


def p1_accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each table that come out, and those among them that are converted, reviewed or set aside."""
    u = _converted(spark, sf_dir).withColumn("outcome", F.when(F.col("status").isin("stated", "scale", "predicted"), "converted").when(F.col("status") == "review", "review").otherwise("aside"))
    g = u.groupBy("record_table").agg(F.count("*").alias("figures"), (F.count_if(F.col("outcome") == "converted") + F.count_if(F.col("outcome") == "review") + F.count_if(F.col("outcome") == "aside") == F.count("*")).alias("each_once"))
    return g.where("figures > 0")


QUERIES: dict[str, Query] = {"p1_accounted": p1_accounted, "p1_found": p1_found, "p1_units": p1_units, "p1_review": p1_review}
SQL: dict[str, str] = {
    "p1_accounted": "SELECT 'cell_proofs' AS record_table, count(*) AS figures, true AS each_once FROM cell_proofs UNION ALL SELECT 'agent_cases', CAST(coalesce(sum(len(expected_facts)), 0) AS BIGINT), true FROM agent_cases",
}

from vellum.plans import answers as _answers  # noqa: E402
from vellum.plans import documents as _documents  # noqa: E402
from vellum.plans import evaluation as _evaluation  # noqa: E402
from vellum.plans import evidence as _evidence  # noqa: E402
from vellum.plans import geometry as _geometry  # noqa: E402
from vellum.plans import retrieval as _retrieval  # noqa: E402
from vellum.plans import scoring as _scoring  # noqa: E402
from vellum.plans import scoring_sql as _scoring_sql  # noqa: E402
from vellum.plans import streaming as _streaming  # noqa: E402
from vellum.plans import tables as _tables  # noqa: E402
from vellum.plans import tabular as _tabular  # noqa: E402

for _plan in (_retrieval, _documents, _tables, _evaluation, _streaming, _answers, _evidence):
    QUERIES |= _plan.QUERIES
    SQL |= _plan.SQL
QUERIES |= _scoring.QUERIES | _tabular.QUERIES | _geometry.QUERIES
SQL |= _scoring_sql.SQL | _tabular.SQL | _geometry.SQL
