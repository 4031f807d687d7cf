"""Sources and sinks: JSON lines that fail closed, generations of an index, filings, PDF pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F



def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a line that isn't of it is an error when the rows are read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """JSON lines; without overwrite a sink that exists is an error (write once)."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def content_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (rows, sha256) that depends on the rows and not on their order: hashes of rows, summed by bucket, hashed."""
    one = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    low = rows.select(F.pmod(F.xxhash64(*keys), F.lit(1024)).alias("b"), F.conv(F.substring(one, 1, 12), 16, 10).cast("decimal(20,0)").alias("h")).groupBy("b").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    return low.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "n", "h"))), lambda x: F.concat_ws(":", x["b"].cast("string"), x["n"].cast("string"), x["h"].cast("string"))), "|"), 256).alias("sha256"))


def publish(tables: dict[str, DataFrame], root: str, generation: str) -> str:
    """Write a generation of tables under root and point to it once all are there; the earlier one stays.

    A generation that exists is an error, so a run that was cut off never shows.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", generation) or generation.startswith("."):
        raise ValueError("a generation's name holds letters, digits, dots, dashes and underlines")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{generation}/{name}")
    # pointers are only added, so a reader finds the earlier one until the new one is there
    last = _pointers(spark, root)
    pointer = spark.createDataFrame([((last[-1]["number"] if last else 0) + 1, generation, json.dumps(sorted(tables)))], POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/current")
    return f"{root}/{generation}"


POINTER = "number long, generation string, tables string"


def _pointers(spark: SparkSession, root: str) -> list[Row]:
    """The pointers of a root from the first to the last (one a generation); none if there is no root."""
    try:
        return spark.read.schema(POINTER).json(f"{root}/current").orderBy("number", "generation").collect()
    except AnalysisException:
        return []


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the generation that root points to."""
    rows = _pointers(spark, root)
    if not rows or not re.fullmatch(r"[A-Za-z0-9._-]+", rows[-1]["generation"] or ""):
        raise LookupError(f"{root} points to no generation")
    return {t: spark.read.parquet(f"{root}/{rows[-1]['generation']}/{t}") for t in json.loads(rows[-1]["tables"])}


def incremental(new: DataFrame, old: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """New rows with the kept columns (vectors, say) of the old rows of the same key; reused tells which had any."""
    return new.join(old.select(key, *kept, F.lit(True).alias("reused")), key, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def plain_title(title: Column) -> Column:
    """A title without tags, with the common entities resolved."""
    t = F.regexp_replace(title, "<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(t)


def select_annual_report(announcements: DataFrame, company: str, year: int) -> DataFrame:
    """The one announcement that is a company's annual report of a year; none or several are an error when read.

    announcements: title, security_name.  An exact title goes before the titles of the
    same security that end in the report's name; summaries and other editions are none.
    """
    names = [f"{year}年年度报告", f"{year}年度报告"]
    exact = F.col("title").isin(*[company + n for n in names])
    suffix = (F.col("security_name") == company) & (F.col("title").endswith(names[0]) | F.col("title").endswith(names[1]))
    rows = announcements.withColumn("__grade", F.when(exact, 1).when(suffix, 2)).where("__grade is not null")
    counts = rows.agg(F.min("__grade").alias("best"), F.count_if(F.col("__grade") == 1).alias("n1"), F.count_if(F.col("__grade") == 2).alias("n2"))
    n = F.when(F.col("best") == 1, F.col("n1")).otherwise(F.coalesce("n2", F.lit(0)))
    fault = F.when(F.col("best").isNull(), F.raise_error(F.lit(f"no annual report of {year} for {company}")).cast("boolean")).when(n > 1, F.raise_error(F.lit(f"several annual reports of {year} for {company}")).cast("boolean")).otherwise(F.lit(True))
    return counts.where(fault).join(rows, F.col("best") == F.col("__grade"), "left").drop("best", "n1", "n2", "__grade")


PAGE = "path string, page_number int, width double, height double, text string, error string"


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of the PDF files under path, read by PyMuPDF where it is installed; else one row a file with the error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError:
            pymupdf = None
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if content[:5] != b"%PDF-":
                    rows.append((name, None, None, None, None, "not a PDF file"))
                elif pymupdf is None:
                    rows.append((name, None, None, None, None, "no PDF reader is installed"))
                else:
                    with pymupdf.open(stream=content, filetype="pdf") as doc:
                        rows += [(name, i + 1, p.rect.width, p.rect.height, p.get_text(), None) for i, p in enumerate(doc)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "width", "height", "text", "error"])

    return files.mapInPandas(pages, PAGE)


def replace_pages(base: DataFrame, retry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base with those of retry in their place where the keys are the same."""
    return base.join(retry.select(*keys), keys, "left_anti").unionByName(retry)
