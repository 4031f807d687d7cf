"""Assign records to splits so that all records of one issuer share a split.

Documents, codes and names are the nodes of a graph; its components are found by
contraction: every node points at the smallest hash among its neighbours, pointers
are jumped, edges are rewritten to the new roots and repeated ones dropped, until no
edge is left.  The components are a table that is written to the shared folder and kept:
on the next run it joins as further edges, known components keep their split and
components that a merge brings together with different splits are set apart (quarantined).
A hub that a third of all nodes hang on skews the joins on roots: they are equi-joins with
one row a root on the other side, which the adaptive engine splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.textforms import half_width
from vellum.runtime import cut, shared_folder

#: Buckets of small components; with the large ones they are what the driver allots.
BUCKETS = 4096


def issuer_name(c: Column) -> Column:
    """A company name without blanks, letter width and a leading ST or *ST; null if nothing is left."""
    bare = F.upper(F.regexp_replace(half_width(c), " ", ""))
    bare = F.regexp_replace(bare, r"^(?:\*?ST)+", "")
    return F.when(bare != "", bare)


def issuer_edges(source_manifest: DataFrame, version_manifest: DataFrame) -> DataFrame:
    """Edges (a, b) between a document and its code, name and, for isolated ones, itself."""
    doc = F.concat(F.lit("d:"), "document_key")
    code = F.trim("security_code")
    keys = F.array_compact(F.array(F.when(code != "", F.concat(F.lit("c:"), code)), F.concat(F.lit("n:"), issuer_name(F.col("company_name")))))
    known = source_manifest.where(F.col("document_key").isNotNull()).select(doc.alias("a"), F.explode(keys).alias("b"))
    alone = version_manifest.where(F.col("document_key").isNotNull()).select(doc.alias("a"), doc.alias("b"))
    return known.unionByName(alone).distinct()


def _jump(pointers: DataFrame) -> DataFrame:
    """Pointer jumping: follow (node, root) until every root points at itself."""
    while True:
        up = pointers.select(F.col("node").alias("root"), F.col("root").alias("top"))
        longer = cut(pointers.join(up, "root", "left").select("node", F.col("root").alias("old"), F.coalesce("top", "root").alias("root")))
        pointers = longer.select("node", "root")
        if longer.where("old <> root").isEmpty():
            return pointers


def _hashed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of hashes, names): a hash that two names share is found and the next seed taken, so no groups are merged by chance."""
    for seed in range(16):
        one = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        named = edges.select(F.inline(F.array(F.struct(F.col("a").alias("name"), one("a").alias("node")), F.struct(F.col("b").alias("name"), one("b").alias("node"))))).distinct()
        names = cut(named)
        if names.groupBy("node").count().where("count > 1").isEmpty():
            return edges.select(one("a").alias("a"), one("b").alias("b")), names
    raise ValueError("no seed tells the nodes apart")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of the edges (a, b), each with the smallest hash of its component.

    Nodes are strings; roots are their 64-bit hashes.  Repeated edges and loops are
    allowed; rows with a null end are dropped.  Every round at least halves the number
    of roots that still have an edge, so the rounds grow with the logarithm of the graph.
    """
    hashed, names = _hashed(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    roots = None
    live = hashed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while not (live := cut(live)).isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
        step = _jump(cut(smallest))
        if roots is None:
            roots = step
        else:
            moved = roots.withColumnRenamed("root", "mid").join(step.select(F.col("node").alias("mid"), "root"), "mid", "left")
            roots = cut(moved.select("node", F.coalesce("root", "mid").alias("root")))
        for end in ("a", "b"):
            live = live.join(step.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
        live = live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if roots is None:
        return names.select(F.col("name").alias("node"), F.col("node").alias("root"))
    return names.join(roots, "node", "left").select(F.col("name").alias("node"), F.coalesce("root", "node").alias("root"))


def kept_table(components: DataFrame) -> DataFrame:
    """The component table, written to the folder that all executors share and read again; the next run takes it."""
    path = f"{shared_folder(components.sparkSession)}/components-{uuid.uuid4().hex}"
    components.write.parquet(path)
    return components.sparkSession.read.parquet(path)


def issuer_groups(source_manifest: DataFrame, version_manifest: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(node, root, group_code): the component table; group_code is the smallest code of the group, null without one.

    kept: an earlier component table (node, component, ...), whose components stay together.
    """
    edges = issuer_edges(source_manifest, version_manifest)
    if kept is not None:
        edges = edges.unionByName(kept.select(F.col("node").alias("a"), F.concat(F.lit("k:"), F.col("component").cast("string")).alias("b")))
    components = kept_table(connected_components(edges))
    code = F.when(F.col("node").startswith("c:"), F.substring("node", 3, 1_000_000))
    return components.join(components.groupBy("root").agg(F.min(code).alias("group_code")), "root")


def _records(version_manifest: DataFrame, groups: DataFrame) -> DataFrame:
    docs = groups.where(F.col("node").startswith("d:")).select(F.expr("substring(node, 3)").alias("document_key"), "root", "group_code")
    own = version_manifest.dropDuplicates().select("version_id", "document_key", "split")
    return own.join(docs, "document_key", "left")


def split_conflicts(version_manifest: DataFrame, source_manifest: DataFrame) -> DataFrame:
    """(version_id, group_code): records with a split whose group now stands in more than one.

    Repeated rows count once; records with a null split or a null document_key give no row.
    """
    records = _records(version_manifest, issuer_groups(source_manifest, version_manifest)).where(F.col("split").isNotNull() & F.col("root").isNotNull())
    torn = records.groupBy("root").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high").select("root")
    return records.select("root", "version_id", "group_code").join(torn, "root").select("version_id", "group_code").distinct()


def assign_splits(version_manifest: DataFrame, source_manifest: DataFrame, split_targets: DataFrame, kept: DataFrame | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(records, components): a split for every record, one per group.

    version_manifest: document_key, split, version_id.  split_targets: split, proportion.
    kept: the component table of an earlier run (node, component, split, status), or none.

    A group with one known split (kept, else the records' own) keeps it; groups with none
    fill what the targets lack; groups whose known splits differ are quarantined: marked
    for review, and until then allotted as one, like new groups.  Allotted are single
    groups of more than 1/buckets of all records and hash buckets of the others, the
    largest first, each to the split that lacks most; so the driver sees at most two
    times `buckets` numbers.  Records with a null document_key are groups of their own.
    """
    groups = cut(issuer_groups(source_manifest, version_manifest, kept))
    own = F.coalesce("root", F.xxhash64(F.lit("alone"), F.col("version_id")))
    records = _records(version_manifest, groups).withColumn("root", own)
    if kept is not None:
        held = groups.join(kept.select("node", F.col("split").alias("held")), "node").where("held is not null").groupBy("root").agg(F.min("held").alias("low"), F.max("held").alias("high"))
    else:
        held = records.groupBy("root").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low is not null")
    sizes = cut(records.groupBy("root").agg(F.count("*").alias("n")).join(held, "root", "left"))
    targets = {r["split"]: float(r["proportion"]) for r in split_targets.where("split is not null").distinct().collect()}
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keeps = F.coalesce((F.col("low") == F.col("high")) & F.col("low").isin(*targets), F.lit(False))
    taken = {r["low"]: r["n"] for r in sizes.where(keeps).groupBy("low").agg(F.sum("n").alias("n")).collect()}
    unit = F.when(F.col("n") * buckets > total, F.col("root")).otherwise(F.pmod("root", F.lit(buckets)))
    units = sizes.where(~keeps).groupBy((F.col("n") * buckets > total).alias("single"), unit.alias("unit")).agg(F.sum("n").alias("n")).collect()
    lack = {s: p * total - taken.get(s, 0) for s, p in sorted(targets.items())}
    plan = []
    for u in sorted(units, key=lambda r: (-r["n"], r["single"], r["unit"])):
        split = max(lack, key=lambda s: lack[s]) if lack else None
        if split is not None:
            lack[split] -= u["n"]
        plan.append((u["single"], u["unit"], split))
    allotted = F.broadcast(records.sparkSession.createDataFrame(plan, "single boolean, unit long, allotted string"))  # at most 2 x buckets rows
    placed = sizes.withColumn("single", F.col("n") * buckets > total).withColumn("unit", unit).join(allotted, ["single", "unit"], "left")
    status = F.when(keeps, "kept").when(F.col("low").isNotNull() & (F.col("low") != F.col("high")), "quarantined").otherwise("filled")
    chosen = cut(placed.select("root", F.when(keeps, F.col("low")).otherwise(F.col("allotted")).alias("new_split"), status.alias("status")))
    out = records.join(chosen, "root")
    table = groups.select("node", "root").join(chosen, "root").select("node", F.col("root").alias("component"), F.col("new_split").alias("split"), "status")
    return out.select("version_id", "document_key", "group_code", F.col("split").alias("old_split"), F.col("new_split").alias("split"), "status"), table
