"""Queries of scores and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import number_tokens, plain_value
from vellum.operators import answers as A
from vellum.operators import evaluation as E
from vellum.operators import scoring as S
from vellum.runtime import table

OCR = ["partial_ocr", "full_ocr"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).distinct()


def _facts(spark: SparkSession, d: str) -> DataFrame:
    f = _t(spark, d, "agent_cases").select("case_id", F.explode("expected_facts").alias("f"))
    return f.select("case_id", F.col("f.fact_id").alias("fact_id"), F.explode("f.acceptable_values").alias("value")).where("value is not null")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "agent_cases").select("case_id", "split", F.explode("evidence_sources").alias("e")).select("case_id", "split", F.col("e.document_key").alias("document_key"), F.col("e.pages").alias("pages")).where("document_key is not null")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "search_hits").where("query_id is not null").withColumnRenamed("query_id", "case_id")


def complete_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.complete_rows(_t(spark, d, "search_hits"), ["score", "lexical_rank", "dense_rank", "hit_rank"])


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    flags = {"has_text": F.col("char_count") > 0, "replaced": F.col("replacement_char_ratio") > 0, "succeeded": F.coalesce("ocr_succeeded", F.lit(False))}
    return S.lane_rates(_t(spark, d, "page_quality"), "extraction_route", flags, {"succeeded": F.coalesce("ocr_attempted", F.lit(False))})


def lane_rates(spark: SparkSession, d: str) -> DataFrame:
    return _lanes(spark, d)


def lane_deltas(spark: SparkSession, d: str) -> DataFrame:
    return S.lane_deltas(_lanes(spark, d), "native", "full_ocr", ["has_text", "replaced"])


def cell_agreement(spark: SparkSession, d: str) -> DataFrame:
    cells = lambda n: _t(spark, d, n).where("table_id is not null").select("table_id", "row_label", "column_label", plain_value(F.col("cell_value")).alias("cell_value"))
    return S.set_agreement(cells("cell_proofs"), cells("extracted_cells"), "table_id", ["row_label", "column_label", "cell_value"])


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "cell_proofs").where("value_bbox is not null and document_key is not null and page_number is not null").select("document_key", "page_number", "proof_id", "section", "cell_value", "value_bbox.*")


def area_ratios(spark: SparkSession, d: str) -> DataFrame:
    return S.area_ratios(_boxes(spark, d), ["document_key", "page_number"], 595.0, 842.0)


def grid_supports(spark: SparkSession, d: str) -> DataFrame:
    return S.grid_supports(_boxes(spark, d), ["document_key", "page_number"])


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a page as one text in reading order, as its digest."""
    spans = _boxes(spark, d).where("cell_value is not null").groupBy("document_key", "page_number").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "proof_id", "cell_value"))).alias("s"))
    return spans.select("document_key", "page_number", F.size("s").alias("spans"), F.sha2(F.array_join(F.transform("s", lambda x: x["cell_value"]), "\n"), 256).alias("digest"))


def sections_above(spark: SparkSession, d: str) -> DataFrame:
    """Each cell with the last section named at or above it, carried over pages."""
    named = F.when(F.col("section") != "", F.col("section"))
    return S.last_before(_boxes(spark, d), "document_key", ["page_number", "y0", "x0", "proof_id"], named, "section_above").select("proof_id", "section_above")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    want = _gold(spark, d).groupBy("case_id", "split").agg(F.collect_set("document_key").alias("expected"))
    got = _hits(spark, d).where("document_key is not null").groupBy("case_id").agg(F.collect_set("document_key").alias("actual"))
    return S.set_differences(want.join(got, "case_id"), "expected", "actual")


def source_differences(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "exact")


def routing_rates(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _routed(spark, d).groupBy("split").agg(F.count("*").alias("cases"), r(F.size("missing") > 0).alias("miss_rate"), r(F.size("extra") > 0).alias("extra_rate"), r(F.col("exact")).alias("exact_rate"))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.fact_coverage(_facts(spark, d), _hits(spark, d).where("text is not null"))


def fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Cases with coverage, whether a gold document was hit, and both together."""
    hit = _hits(spark, d).join(_gold(spark, d).select("case_id", "document_key").distinct(), ["case_id", "document_key"], "left_semi").select("case_id").distinct().withColumn("h", F.lit(True))
    searched = _hits(spark, d).select("case_id").distinct().withColumn("searched", F.lit(True))
    base = _t(spark, d, "agent_cases").select("case_id", "split", "expected_behavior")
    rows = base.join(_coverage(spark, d), "case_id", "left").join(hit, "case_id", "left").join(searched, "case_id", "left")
    ok = F.coalesce(F.col("h"), F.lit(False))
    return rows.select("case_id", "split", "expected_behavior", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), ok.alias("source_found"), (ok & (F.coalesce("coverage", F.lit(0.0)) == 1)).alias("passed"), F.coalesce("searched", F.lit(False)).alias("searched"))


def case_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).drop("expected_behavior")


def suite_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pass rates over the cases that were searched, and over all."""
    g = _scored(spark, d).groupBy("split").agg(F.count("*").alias("cases"), F.count_if("searched").alias("supported"), F.count_if("passed").alias("passed"))
    return g.select("split", "cases", "supported", "passed", F.round(F.try_divide("passed", "supported"), 6).alias("supported_rate"), F.round(F.col("passed") / F.col("cases"), 6).alias("end_to_end_rate"))


def recall_failures(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d).select("case_id", "document_key").distinct()
    best = gold.join(_hits(spark, d), ["case_id", "document_key"], "left").groupBy("case_id").agg(F.min("lexical_rank").alias("lexical"), F.min("dense_rank").alias("dense"))
    return best.groupBy(S.failure_class(F.col("lexical"), F.col("dense")).alias("failure")).agg(F.count("*").alias("cases"))


def review_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two judgements of a page agree exactly: whether it needs recognition, and whether its route has it."""
    exact = F.coalesce(F.col("needs_ocr"), F.lit(False)) == F.coalesce(F.col("extraction_route").isin(*OCR), F.lit(False))
    return _t(spark, d, "page_quality").groupBy(F.coalesce("extraction_route", F.lit("(none)")).alias("route")).agg(F.count("*").alias("pages"), F.round(F.avg(exact.cast("int")), 6).alias("agreement"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "needs_recognition": (F.col("needs_ocr"), F.coalesce("image_count", F.lit(0))), "sparse": (F.col("char_count") < 100, 100 - F.col("char_count")),
        "pictures": (F.col("image_count") >= 2, F.col("image_count")), "damaged": (F.col("replacement_char_ratio") > 0.01, F.round(F.col("replacement_char_ratio") * 1000, 6)),
    }
    return S.labelled(_t(spark, d, "page_quality").where("document_key is not null").select("document_key", "page_number", "needs_ocr", "char_count", "image_count", "replacement_char_ratio"), rules)


def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("document_key", "page_number", "label", "label_score")


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three best candidates of each kind, from documents of splits that may be looked at."""
    open_ = _t(spark, d, "source_manifest").where(F.col("split").isin("calibration", "dev")).select("document_key").distinct()
    w = Window.partitionBy("label").orderBy(F.col("label_score").desc(), "document_key", "page_number")
    return _candidates(spark, d).join(open_, "document_key", "left_semi").withColumn("place", F.row_number().over(w)).where("place <= 3").select("label", "place", "document_key", "page_number", "label_score")


def scan_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Pages that need recognition, by whether it was tried and worked."""
    state = F.when(~F.coalesce("ocr_attempted", F.lit(False)), "not_tried").when(F.coalesce("ocr_succeeded", F.lit(False)), "recognised").otherwise("failed")
    return _t(spark, d, "page_quality").where("needs_ocr").groupBy(state.alias("state")).agg(F.count("*").alias("pages"), F.count_if(F.col("ocr_char_count").isNull()).alias("without_count"))


def active_versions(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "source_manifest").groupBy("document_key").agg(F.min("report_year").alias("report_year"), F.min("source").alias("source"))
    return _t(spark, d, "version_manifest").where("status = 'active'").join(s, "document_key").select("version_id", "document_key", "report_year", "source")


def query_instances(spark: SparkSession, d: str) -> DataFrame:
    """Each question as it is, and as a variant in the wording of filings where that differs."""
    from vellum.functions.text import expand_query

    q = _t(spark, d, "agent_cases").where("query is not null").select("case_id", "query")
    forms = F.array_distinct(F.array(F.struct(F.lit("canonical").alias("kind"), F.col("query").alias("text")), F.when(expand_query(F.col("query")) != F.col("query"), F.struct(F.lit("variant").alias("kind"), expand_query(F.col("query")).alias("text")))))
    return q.select("case_id", F.explode(F.array_compact(forms)).alias("v")).select("case_id", "v.kind", F.sha2("v.text", 256).alias("text_hash"))


def answerable_rows(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "agent_cases").where("expected_behavior = 'answer' and query is not null")
    return a.select("case_id", "query", F.array_join(F.transform(F.coalesce("expected_facts", F.array()), lambda f: F.coalesce(F.get(f["acceptable_values"], F.lit(0)), F.lit(""))), "|").alias("reference"))


def tuning_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that a tuning run may see; a frozen split among them would be an error."""
    from vellum.operators.governance import require

    items = _t(spark, d, "agent_cases").where(F.col("split").isin("calibration", "dev"))
    return require(items, F.col("split") == "frozen_test", "a frozen split can't be tuned on").groupBy("split", "task_type").agg(F.count("*").alias("items"))


def run_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Cases by the first gate that keeps them out of a run."""
    runs = _hits(spark, d).groupBy("case_id").agg(F.count("*").alias("hits"), F.min("hit_rank").alias("first"))
    gold = _gold(spark, d).select("case_id").distinct().withColumn("gold", F.lit(True))
    rows = _t(spark, d, "agent_cases").join(runs, "case_id", "left").join(gold, "case_id", "left")
    gates = {"no_split": F.col("split").isNotNull(), "no_query": F.trim("query") != "", "not_run": F.col("hits").isNotNull(), "no_first_hit": F.col("first") == 1, "no_gold": F.col("gold"), "no_source": F.col("source").isNotNull()}
    return rows.groupBy(S.first_failing(gates).alias("gate")).agg(F.count("*").alias("cases"))


def corpus_plan(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "source_manifest")
    return s.groupBy(F.coalesce("split", F.lit("(none)")).alias("split")).agg(F.count("*").alias("rows"), F.countDistinct("document_key").alias("documents"), F.countDistinct("security_code").alias("issuers"), F.coalesce(F.sum("question_target"), F.lit(0)).alias("questions"))


def number_bindings(spark: SparkSession, d: str) -> DataFrame:
    left = _facts(spark, d).select("case_id", "fact_id", F.col("value").alias("text"))
    right = _hits(spark, d).where("text is not null").select("case_id", "hit_id", "text")
    return S.bind_by_numbers(left, right, "case_id", "fact_id", "hit_id").select("case_id", "fact_id", "hit_id", "shared", "place")


def best_citations(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).where("score is not null")
    return h.groupBy("case_id").agg(F.max_by("hit_id", F.struct("score", F.negate("hit_id"))).alias("hit_id"), F.max("score").alias("score"))


def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the questions of a split cite, numbered where they first come up."""
    h = _hits(spark, d).join(_t(spark, d, "agent_cases").select("case_id", "split"), "case_id").where("split is not null and chunk_id is not null")
    return S.renumbered(h, "split", ["case_id", "hit_rank", "hit_id"], "chunk_id").withColumnRenamed("number", "ordinal")


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Cases to be looked at, the newest first."""
    w = Window.partitionBy("split").orderBy(F.col("created_at").desc_nulls_last(), "case_id")
    return _t(spark, d, "agent_cases").where("expected_behavior <> 'answer' and split is not null").select("split", F.row_number().over(w).alias("place"), "case_id")


def complete_bundles(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "extracted_cells").where("table_id is not null and row_label is not null and column_label is not null")
    return S.complete_bundles(c, "table_id", "row_label", "column_label")


def period_labels(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "extracted_cells").where("row_label is not null").select("row_label").distinct()
    return c.select("row_label", S.period_label(F.col("row_label")).alias("period_label"))


def company_mentions(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "agent_cases").where("query is not null").groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("query"))
    names = _t(spark, d, "source_manifest").select(F.col("company_name").alias("company"))
    m = S.company_mentions(q, names)
    return m.select("query_id", "company", "position", F.row_number().over(Window.partitionBy("query_id").orderBy("position", F.col("company").desc())).cast("int").alias("place"))


def missing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that a question names and none of its hits does."""
    q = _t(spark, d, "agent_cases").where("query is not null").groupBy("case_id").agg(F.min("query").alias("query")).select("case_id", A.metric_mentions(F.col("query")).alias("required"))
    h = _hits(spark, d).where("text is not null").select("case_id", "text")
    left = q.join(h, "case_id").select("case_id", "required", A.missing_metrics(F.col("required"), F.col("text")).alias("missing"))
    each = left.select("case_id", F.explode("required").alias("metric"), "missing").groupBy("case_id", "metric").agg(F.min(F.array_contains("missing", F.col("metric")).cast("int")).alias("missing"))
    return each.where("missing = 1").select("case_id", "metric")


def supported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each first hit, and how many of them the second hit supports."""
    h = _hits(spark, d).where("text is not null")
    one = lambda r, n: h.where(F.col("hit_rank") == r).groupBy("case_id").agg(F.min("text").alias(n))
    a, b = F.array_distinct(number_tokens(F.col("a"))), F.array_distinct(number_tokens(F.col("b")))
    return one(1, "a").join(one(2, "b"), "case_id").select("case_id", F.size(a).alias("numbers"), F.size(F.array_intersect(a, b)).alias("supported"))


def fact_changes(spark: SparkSession, d: str) -> DataFrame:
    """Difference and growth from the prior to the current value of a case, where both are plain numbers."""
    v = _facts(spark, d).groupBy("case_id", "fact_id").agg(F.min("value").alias("value")).where(F.col("value").rlike(r"^-?[0-9][0-9,]*([.][0-9]+)?$"))
    n = F.replace("value", F.lit(","), F.lit("")).cast("decimal(20,4)")
    g = v.groupBy("case_id").agg(F.min(F.when(F.col("fact_id") == "value_current", n)).alias("now"), F.min(F.when(F.col("fact_id") == "value_prior", n)).alias("before")).where("now is not null and before is not null and before <> 0")
    return g.select("case_id", S.money(F.col("now") - F.col("before")).alias("difference"), F.round((F.col("now").cast("double") - F.col("before").cast("double")) / F.col("before").cast("double") * 100, 4).alias("growth_percent"))


UNIT = r"(?:单位|Unit|unit)\s*[:：]\s*((?:人民币)?[十百千万亿]*元|RMB [a-z']+|[0-9A-Za-z%]+)"


def detected_units(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "cell_proofs").where("section is not null").select("section").distinct()
    return c.select("section", F.regexp_extract("section", UNIT, 1).alias("unit")).where("unit <> ''")


def publication_times(spark: SparkSession, d: str) -> DataFrame:
    """PDF date literals of the publication times, read back."""
    s = _t(spark, d, "source_manifest").where("published_at is not null and document_key is not null").groupBy("document_key").agg(F.min("published_at").alias("at"))
    literal = F.concat(F.lit("D:"), F.date_format(F.timestamp_seconds(F.unix_timestamp(F.col("at").cast("timestamp")) + 8 * 3600), "yyyyMMddHHmmss"), F.lit("+08'00'"))
    return s.select("document_key", F.unix_timestamp(S.pdf_time(literal)).alias("seconds"))


def registry_updates(spark: SparkSession, d: str) -> DataFrame:
    """Versions after a failure report and a profile: active ones are protected, known metadata fills what is missing."""
    profile = _t(spark, d, "source_manifest").groupBy("document_key").agg(F.max("split").alias("p_split"))
    failed = _t(spark, d, "page_quality").where("extraction_route = 'manual_review' and document_key is not null").select("document_key").distinct().withColumn("failed", F.lit(True))
    v = _t(spark, d, "version_manifest").join(profile, "document_key", "left").join(failed, "document_key", "left")
    return v.select("version_id", "document_key", F.when(F.col("failed") & (F.col("status") != "active"), "failed").otherwise(F.col("status")).alias("status"), F.coalesce("split", "p_split").alias("split"))


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "agent_cases").groupBy(F.coalesce("expected_behavior", F.lit("(none)")).alias("decision")).agg(F.count("*").alias("cases"))


def rescored_cases(spark: SparkSession, d: str) -> DataFrame:
    """Audited outcomes take the place of scored ones: an earlier audit marks cases as overlapping."""
    audited = _t(spark, d, "split_overlaps").select(F.explode("query_ids").alias("case_id")).distinct().withColumn("audited", F.lit("overlap"))
    rows = _t(spark, d, "agent_cases").select("case_id", "split", "expected_behavior").join(audited, "case_id", "left")
    return rows.groupBy(F.coalesce("split", F.lit("(none)")).alias("split"), F.coalesce("audited", "expected_behavior").alias("outcome")).agg(F.count("*").alias("cases"))


def retrieval_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The first three hits of each question as one row."""
    w = Window.partitionBy("case_id").orderBy("hit_rank", "hit_id")
    first = _hits(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3")
    return first.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "hit_id"))), lambda x: x["hit_id"].cast("string")), ",").alias("hits"))


def source_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the source manifest against the versions and its own keys."""
    v = _t(spark, d, "version_manifest").select("document_key").distinct().withColumn("versioned", F.lit(True))
    s = _t(spark, d, "source_manifest").join(v, "document_key", "left")
    code = F.split_part("document_key", F.lit(":"), F.lit(2))
    faults = F.array_compact(F.array(
        F.when(F.col("versioned").isNull(), "no_version"), F.when(F.col("security_code").isNull(), "no_code"), F.when(F.col("security_code") != code, "other_code"), F.when(F.coalesce(F.col("size_bytes") <= 0, F.lit(True)), "no_size"),
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_digest"), F.when(F.col("downloaded_at") < F.col("published_at"), "early_download"),
    ))
    return s.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count("*").alias("rows"))


def legacy_ids(spark: SparkSession, d: str) -> DataFrame:
    """Version ids derived from key and content, as a migration of old rows gives them."""
    return _t(spark, d, "version_manifest").select("version_id", F.left(F.sha2(F.concat_ws("\x1f", "document_key", "content_sha256"), 256), F.lit(16)).alias("derived_id"))


def dataset_errors(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "agent_cases")
    errors = F.array_compact(F.array(F.when(F.col("split").isNull(), "split"), F.when(F.coalesce(F.trim("query") == "", F.lit(True)), "query"), F.when(F.coalesce(F.size("expected_facts") < 1, F.lit(True)) & (F.col("expected_behavior") == "answer"), "facts"), F.when(F.col("source").isNull(), "source"), F.when(F.col("created_at").isNull(), "created_at")))
    return a.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("cases"))


def value_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the acceptable values of a case stand in its hits."""
    v = _facts(spark, d).where(F.col("value").rlike("^[0-9][0-9,.]*$"))
    j = v.join(_hits(spark, d).where("text is not null").select("case_id", "hit_id", "text"), "case_id")
    return j.select("case_id", "fact_id", "value", "hit_id", S.value_span(F.col("text"), F.col("value")).alias("place")).where("place > 0").distinct()


def faulty_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions with one fault put in: another number, or the longest clause left out."""
    q = _t(spark, d, "agent_cases").where("query is not null").select("case_id", "query").distinct()
    return q.select("case_id", S.mutate_number(F.col("query")).alias("other_number"), S.drop_longest_clause(F.col("query")).alias("shortened"))


def dense_texts(spark: SparkSession, d: str) -> DataFrame:
    """Questions and labels with the prefixes that an embedding model expects, as digests."""
    q = _t(spark, d, "agent_cases").where("query is not null").select(F.concat(F.lit("query: "), "query").alias("t"))
    p = _t(spark, d, "label_refs").where("label_text is not null").select(F.concat(F.lit("passage: "), "label_text").alias("t"))
    return q.unionByName(p).distinct().select(F.md5("t").alias("digest"), F.split_part("t", F.lit(":"), F.lit(1)).alias("kind"))


def document_profiles(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest_percentiles(_t(spark, d, "page_quality").where("document_key is not null"), "document_key", "char_count", {"p50": 0.5, "p95": 0.95})


def majority_names(spark: SparkSession, d: str) -> DataFrame:
    return S.majority(_t(spark, d, "source_manifest").where("security_code is not null"), "security_code", "company_name")


def evidence_pages(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of all cases as pages of documents, each once, with the cases that rest on it."""
    g = _gold(spark, d).select("case_id", "document_key", F.explode("pages").alias("page")).distinct()
    return g.groupBy("document_key", "page").agg(F.array_join(F.sort_array(F.collect_set("case_id")), ",").alias("gold_for"))


def conflicting_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of chunks and versions that stand for different contents."""
    c = _t(spark, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.md5(F.coalesce("payload_json", F.lit(""))).alias("content"))
    v = _t(spark, d, "version_manifest").select(F.lit("version").alias("kind"), F.col("version_id").alias("id"), F.coalesce("content_sha256", F.lit("")).alias("content"))
    g = c.unionByName(v).where("id is not null").groupBy("kind", "id").agg(F.countDistinct("content").alias("contents"))
    return g.groupBy("kind").agg(F.count("*").alias("ids"), F.count_if(F.col("contents") > 1).alias("conflicting"))


def retrieval_grid(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and candidate recall of gold documents at five: two filters by two retrievers."""
    gold = _gold(spark, d).select("case_id", "document_key").distinct()
    year = F.split_part("document_key", F.lit(":"), F.lit(4)).try_cast("int")
    h = _hits(spark, d).where("document_key is not null").join(_t(spark, d, "agent_cases").select("case_id", F.regexp_extract("query", "20[0-9]{2}", 0).try_cast("int").alias("asked")).distinct(), "case_id")
    h = h.select("case_id", "document_key", F.explode(F.array(F.struct(F.lit("lexical").alias("mode"), F.col("lexical_rank").alias("rank")), F.struct(F.lit("dense").alias("mode"), F.col("dense_rank").alias("rank")))).alias("m"), (year >= F.col("asked")).alias("fits")).select("case_id", "document_key", "m.*", "fits").where("rank is not null")
    both = h.withColumn("filter", F.explode(F.when(F.coalesce("fits", F.lit(False)), F.array(F.lit("none"), F.lit("year"))).otherwise(F.array(F.lit("none")))))
    hit = both.join(gold.withColumn("good", F.lit(1)), ["case_id", "document_key"], "left")
    near = F.col("rank") <= 5
    per = hit.groupBy("case_id", "mode", "filter").agg(F.countDistinct(F.when(near & F.col("good").isNotNull(), F.col("document_key"))).alias("right"), F.countDistinct(F.when(near, F.col("document_key"))).alias("shown"), F.countDistinct(F.when(F.col("good").isNotNull(), F.col("document_key"))).alias("anywhere"))
    n = gold.groupBy("case_id").agg(F.count("*").alias("gold"))
    r = lambda c: F.round(F.avg(c), 6)
    return per.join(n, "case_id").groupBy("mode", "filter").agg(F.count("*").alias("cases"), r(F.coalesce(F.try_divide("right", "shown"), F.lit(0.0))).alias("precision"), r(F.col("right") / F.col("gold")).alias("recall"), r(F.col("anywhere") / F.col("gold")).alias("candidate_recall"))


def character_errors(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and character error rate of extracted values against the proved ones of the same place (plain ASCII values)."""
    keys = ["document_key", "row_label", "column_label"]
    ascii_ = lambda c: F.col(c).rlike("^[!-~]+$")
    one = lambda t, n: _t(spark, d, t).where(ascii_("cell_value")).groupBy(*keys).agg(F.min("cell_value").alias(n))
    j = one("cell_proofs", "reference").join(one("extracted_cells", "candidate"), keys)
    distance = F.levenshtein("reference", "candidate")
    return j.select(*keys, distance.alias("distance"), F.round(distance / F.char_length("reference"), 6).alias("error_rate"))


QUERIES = {
    f"m_{f.__name__}": f
    for f in (
        complete_hits, lane_rates, lane_deltas, cell_agreement, area_ratios, grid_supports, page_lines, sections_above, source_differences, routing_rates, fact_coverage, case_scores, suite_metrics, recall_failures,
        review_agreement, page_candidates, top_candidates, scan_coverage, active_versions, query_instances, answerable_rows, tuning_items, run_eligibility, corpus_plan, number_bindings, best_citations, citation_numbers,
        review_queue, complete_bundles, period_labels, company_mentions, missing_metrics, supported_numbers, fact_changes, detected_units, publication_times, registry_updates, decision_counts, rescored_cases, retrieval_snapshots,
        source_audit, legacy_ids, dataset_errors, value_places, faulty_questions, dense_texts, document_profiles, majority_names, evidence_pages, conflicting_ids, retrieval_grid, character_errors,
    )
}
