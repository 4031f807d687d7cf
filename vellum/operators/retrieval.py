"""Inverted-index statistics, ranked retrieval and reranking over whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import search_tokens
from vellum.runtime import cut, shared_folder

K1, B = 1.5, 0.75
PAYLOAD = "text string, page_start int, page_end int, section_path array<string>"


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with text, pages and section path out of their payload, as often as they come."""
    p = F.from_json("payload_json", PAYLOAD)
    return chunks.select("chunk_id", "document_id", "chunk_index", "document_key", "company_name", "report_year", "document_type", p.alias("p")).select("chunk_id", "document_id", "chunk_index", "document_key", "company_name", "report_year", "document_type", "p.*")


def read_chunks(chunks: DataFrame) -> DataFrame:
    """The distinct chunks, parsed; rows are told apart by a hash before they are parsed."""
    columns = ["chunk_id", "document_id", "chunk_index", "document_key", "company_name", "report_year", "document_type", "payload_json"]
    return parse_chunks(chunks.withColumn("__h", F.xxhash64(*columns)).dropDuplicates(["chunk_id", "__h"]))


def index_text(section_path: Column, text: Column) -> Column:
    """What is indexed: the section path twice, then the text."""
    section = F.array_join(F.coalesce(section_path, F.array().cast("array<string>")), " ")
    return F.trim(F.concat_ws(" ", section, section, text))


def postings(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, length, term, tf) of all documents."""
    rows = documents.select(key, search_tokens(text).alias("tokens")).withColumn("length", F.size("tokens"))
    return rows.select(key, "length", F.explode("tokens").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def term_statistics(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, df, cf): documents with the term, and its occurrences."""
    return postings(documents, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_summary(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """(documents, average_length) of an index."""
    return documents.select(F.size(search_tokens(text)).alias("n")).agg(F.count("*").alias("documents"), F.round(F.avg("n"), 6).alias("average_length"))


def top(ranked: DataFrame, group: str, order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered; ties go by the order given."""
    w = Window.partitionBy(group).orderBy(*order)
    return ranked.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Chunks and postings that a task scores at once, and queries that it holds at once.
BLOCK_CHUNKS, BLOCK_POSTINGS, BLOCK_QUERIES = 32_768, 2_000_000, 131_072
#: Sums that a task holds at once; share of a query's bound that its common terms may reach without being added up; slack of bounds.
BLOCK_SUMS, COMMON, SLACK = 1_000_000, 0.65, 1e-6
TERMS = pa.list_(pa.struct([("term", pa.int32()), ("qtf", pa.int32())]))
COUNTED = "kept boolean, h bigint, length int, ids array<int>, tfs array<int>"


def _known_terms(batches: Iterator[pa.RecordBatch], terms: Broadcast) -> Iterator[pa.RecordBatch]:
    """Token lists as (ids, tfs) of the terms, ids ascending; other tokens only count in the length."""
    for batch in batches:
        tokens = batch["tokens"]
        length = tokens.value_lengths().to_numpy(zero_copy_only=False)
        flat = tokens.flatten()
        ids = pc.fill_null(pc.index_in(flat, value_set=pa.array(terms.value, flat.type)), -1).to_numpy()
        row = np.repeat(np.arange(len(length)), length)[ids >= 0]
        pairs, tf = np.unique(row * np.int64(len(terms.value) + 1) + ids[ids >= 0], return_counts=True)
        row, ids = np.divmod(pairs, len(terms.value) + 1)
        ends = pa.array(np.searchsorted(row, np.arange(len(length) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (ids, tf)]
        yield pa.RecordBatch.from_arrays([batch["chunk_id"], batch["kept"], batch["h"], pa.array(length.astype(np.int32)), *lists], names=["chunk_id", "kept", "h", "length", "ids", "tfs"])


def _blocks(batches: Iterator[pa.RecordBatch], share: float = 1) -> Iterator[pa.Table]:
    """The batches, joined up to the bounds of a block; the first one up to a share of them, which doubles."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + len(batch["versions"].flatten().field("ids").flatten())
        if rows >= share * BLOCK_CHUNKS or size >= share * BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size, share = [], 0, 0, min(1, 2 * share)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _unpack(versions: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(length of each version; chunk, kept and length of each document; term, document and tf of each posting, by term).

    Versions of a chunk that agree in kept and length are one document, of which the counts are summed.
    """
    v = versions.flatten()
    chunk = np.repeat(np.arange(len(versions)), versions.value_lengths().to_numpy(zero_copy_only=False))
    kept, length = (v.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kept", "length"))
    wide = int(length.max(initial=0)) + 1
    keys, document = np.unique((chunk * 2 + kept) * wide + length, return_inverse=True)
    ids, tfs = v.field("ids"), v.field("tfs").flatten().to_numpy()
    posting = ids.flatten().to_numpy().astype(np.int64) * max(1, len(keys)) + np.repeat(document, ids.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(posting)
    posting = posting[order]
    first = np.flatnonzero(np.diff(posting, prepend=-1))
    term, document = np.divmod(posting[first], max(1, len(keys)))
    return length, keys // wide // 2, keys // wide % 2 == 1, keys % wide, term, document, np.add.reduceat(tfs[order].astype(np.float64), first) if len(first) else np.zeros(0)


def _index_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n): documents with each term; at -1 all versions of chunks, at -2 their tokens."""
    for block in _blocks(batches):
        length, _, _, _, term, _, _ = _unpack(block["versions"].chunk(0))
        ids, n = np.unique(term, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, [-1, -2]).astype(np.int32)), pa.array(np.append(n, [len(length), length.sum()]).astype(np.int64))], names=["id", "n"])


class _Postings:
    """The kept postings of a block by term and chunk, with the weight of each and the largest of each term."""

    def __init__(self, block: pa.Table, idf: np.ndarray, average: float):
        self.ids = block["chunk_id"].chunk(0)
        self.chunks = len(self.ids)
        _, chunk, kept, length, term, document, tf = _unpack(block["versions"].chunk(0))
        kept = kept[document]
        term, document, tf = term[kept], document[kept], tf[kept]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[document] / average))
        key = term * self.chunks + chunk[document]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, term = key[first], term[first]
        self.weight = np.add.reduceat(weight, first) if len(first) else weight
        self.chunk = self.key - term * self.chunks
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))
        self.count = np.diff(self.starts)
        there = np.flatnonzero(self.count)
        self.most = np.zeros(len(idf))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.weight, self.starts[there])
        # terms in more than an eighth of the chunks have their weights by chunk, too
        self.common = np.flatnonzero(self.count * 8 > self.chunks)
        self.place = np.full(len(idf), -1)
        self.place[self.common] = np.arange(len(self.common))
        self.dense = np.zeros(len(self.common) * self.chunks)
        for i, t in enumerate(self.common):
            own = slice(self.starts[t], self.starts[t + 1])
            self.dense[i * self.chunks + self.chunk[own]] = self.weight[own]

    def sums(self, row: np.ndarray, term: np.ndarray, qtf: np.ndarray, rows: int) -> np.ndarray:
        """Sum of weights of the terms of each row, for all chunks."""
        n = self.count[term]
        own = [slice(*x) for x in zip(self.starts[term].tolist(), self.starts[term + 1].tolist())]
        weight = np.concatenate([self.weight[x] for x in own])
        if (qtf != 1).any():
            weight *= np.repeat(qtf, n)
        cell = np.concatenate([self.chunk[x] for x in own])
        cell += np.repeat(row * self.chunks, n)
        return np.bincount(cell, weight, rows * self.chunks)

    def weights(self, term: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """The weight of each term in each chunk, 0 where it isn't."""
        out, place = np.zeros(len(term)), self.place[term]
        near = place >= 0
        out[near] = self.dense[place[near] * self.chunks + chunk[near]]
        far = np.flatnonzero(~near)
        if len(far) and len(self.key):
            key = term[far] * self.chunks + chunk[far]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[far] = np.where(self.key[at] == key, self.weight[at], 0)
        return out


class _Best:
    """The k best chunks of each query so far; equal ones by id, null last."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids, self.seen = k, [], 0
        self.near, self.raw, self.at = np.zeros((queries, k)), np.zeros((queries, k)), np.full((queries, k), -1)
        self.floor = np.zeros(queries)

    def add(self, query: np.ndarray, chunk: np.ndarray, raw: np.ndarray) -> None:
        """Chunks of the last block of ids, by place in it; a query comes in one call a block."""
        own = np.unique(query)
        held, place = np.nonzero(self.at[own] >= 0)
        held = own[held]
        query, at = np.append(held, query), np.append(self.at[held, place], chunk + self.seen - len(self.ids[-1]))
        near, raw = np.append(self.near[held, place], np.round(raw, 9)), np.append(self.raw[held, place], raw)
        order = np.lexsort((-near, query))
        equal = np.flatnonzero((np.diff(near[order]) == 0) & (np.diff(query[order]) == 0))
        if len(equal):  # ids are compared only where scores are equal
            tied = order[np.union1d(equal, equal + 1)]
            known, again = np.unique(at[tied], return_inverse=True)
            rank, by_id = np.zeros(len(at), np.int64), np.empty(len(known), np.int64)
            by_id[pc.sort_indices(self.take(known)).to_numpy()] = np.arange(len(known))
            rank[tied] = by_id[again]
            order = np.lexsort((rank, -near, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.near[query, place], self.raw[query, place], self.at[query, place] = near[order], raw[order], at[order]
        full = own[self.at[own, -1] >= 0]
        self.floor[full] = np.maximum(0, self.near[full, -1] - 1e-9)

    def take(self, at: np.ndarray) -> pa.Array:
        found = pa.chunked_array(self.ids).take(pa.array(at))
        return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _best_chunks(batches: Iterator[pa.RecordBatch], sent: Broadcast, stats: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, raw, near): the k best of the chunks for each query; near is raw to 9 places.

    A chunk that has only terms whose largest weights sum up to less than the k-th best score so far
    can't come in: of each query, common terms up to a share of it are not added up for all chunks,
    but looked up for those that could come in still.
    """
    (names, kind, queries), (idf, average) = sent.value, stats.value
    names, queries = (x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((names, kind), (queries, TERMS)))
    size = queries.value_lengths().to_numpy(zero_copy_only=False)
    query, pairs = np.repeat(np.arange(len(size)), size), queries.flatten()
    term, qtf = (pairs.field(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.lexsort((term, idf[term], query))  # common terms first
    term, qtf = term[order], qtf[order]
    begin = np.cumsum(size) - size
    best, key = _Best(len(size), k), None
    for block in _blocks(batches, 1 / 8):
        p = _Postings(block, idf, average)
        key = p.ids.type
        best.ids.append(p.ids)
        best.seen += p.chunks
        bound = p.most[term] * qtf
        up_to = np.cumsum(bound)
        up_to -= np.repeat(np.append(0, up_to)[begin], size)
        rare = up_to > COMMON * best.floor[query] - SLACK
        commons = np.bincount(query[~rare], minlength=len(size))
        rest = np.bincount(query[~rare], bound[~rare], len(size))
        asked = np.flatnonzero(rare & (bound > 0))
        whole = rest + np.bincount(query[asked], bound[asked], len(size))
        asked = asked[whole[query[asked]] > best.floor[query[asked]] - SLACK]
        work = np.bincount(query[asked], p.count[term[asked]], len(size))
        todo = np.flatnonzero(work)
        part = np.cumsum(p.chunks + work[todo]) // BLOCK_SUMS
        for own in np.split(todo, np.flatnonzero(np.diff(part)) + 1) if len(todo) else []:
            at = asked[np.searchsorted(query[asked], own[0]) : np.searchsorted(query[asked], own[-1], "right")]
            sums = p.sums(np.searchsorted(own, query[at]), term[at], qtf[at], len(own)).reshape(len(own), p.chunks)
            floor = best.floor[own]
            new = np.flatnonzero(floor == 0)
            if len(new) and p.chunks > k:  # what is added up so far bounds the k-th best, too
                floor[new] = np.maximum(0, np.partition(sums[new], -k, axis=1)[:, -k] - 2e-9)
            row, chunk = np.divmod(np.flatnonzero(sums > np.maximum(0, floor - rest[own] - SLACK)[:, None]), p.chunks)
            raw, left = sums[row, chunk], commons[own][row]
            done = []
            while len(row):
                ended = left == 0
                done.append((row[ended], chunk[ended], raw[ended]))
                row, chunk, raw, left = row[~ended], chunk[~ended], raw[~ended], left[~ended] - 1
                if len(row):
                    at = begin[own[row]] + left
                    raw = raw + qtf[at] * p.weights(term[at], chunk)
                    good = raw + up_to[at] - bound[at] > floor[row] - SLACK
                    row, chunk, raw, left = row[good], chunk[good], raw[good], left[good]
            if done:
                row, chunk, raw = (np.concatenate(x) for x in zip(*done))
                good = raw > floor[row]
                if good.any():
                    best.add(own[row[good]], chunk[good], raw[good])
    query, place = np.nonzero(best.at >= 0)
    if len(query):
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), best.take(best.at[query, place]).cast(key), pa.array(best.raw[query, place]), pa.array(best.near[query, place])], names=["query_id", "chunk_id", "raw", "near"])


def _read(files: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(1024, columns=["chunk_id", "versions"])


def _search(batches: Iterator[pa.RecordBatch], files: list[str], terms: Broadcast, stats: Broadcast, k: int, most: int) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, score, rank) of the queries of a task against the index in the files; equal queries are searched once."""
    vocabulary = pa.array(terms.value, pa.string())

    def found(ids: list[pa.Array], bags: dict[bytes, int], bag: list[int]) -> Iterator[pa.RecordBatch]:
        counted = [np.unique(np.frombuffer(b, np.int32), return_counts=True) for b in bags]
        ends = np.cumsum([0, *(len(t) for t, _ in counted)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*counted)], fields=list(TERMS.value_type))
        sent = SimpleNamespace(value=(pa.array(np.arange(len(bags))), pa.int64(), pa.ListArray.from_arrays(pa.array(ends), pairs)))
        names, by_bag = pa.concat_arrays(ids), np.argsort(bag, kind="stable")
        members = np.bincount(bag, minlength=len(bags))
        first = np.cumsum(members) - members
        for part in _best_chunks(_read(files), sent, stats, k):
            own = part["query_id"].to_numpy()
            rank = np.arange(len(own)) - np.searchsorted(own, own) + 1
            for low in range(0, len(own), 65_536):  # a row a member of each
                at = np.arange(low, min(low + 65_536, len(own)))
                n = members[own[at]]
                row = np.repeat(at, n)
                member = by_bag[np.repeat(first[own[at]] - np.cumsum(n) + n, n) + np.arange(len(row))]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(member)), part["chunk_id"].take(pa.array(row)), part["raw"].take(pa.array(row)), pa.array(rank[row].astype(np.int32))], names=["query_id", "chunk_id", "raw", "rank"])

    ids, bags, bag = [], {}, []
    for batch in batches:
        tokens = batch["tokens"]
        own = pc.index_in(tokens.flatten(), value_set=vocabulary).to_numpy().astype(np.int32)
        ends = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))
        ids.append(batch["query_id"])
        bag += [bags.setdefault(x.tobytes(), len(bags)) for x in np.split(own, ends[:-1])]
        if len(bag) >= most:
            yield from found(ids, bags, bag)
            ids, bags, bag = [], {}, []
    if bag:
        yield from found(ids, bags, bag)


def bm25(queries: DataFrame, documents: DataFrame, text: Column, *, query_key: str = "query_id", query: str = "query", key: str = "chunk_id", k: int = 10, keep: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best documents of each query.

    Statistics are those of the whole index, whatever `keep` filters; a term that a query
    repeats counts as often.  The documents are cut into tokens once; counts of the terms that
    queries have, no text, are written to the shared folder, where they stay until the session
    ends.  A task takes a part of the queries and reads all counts, block by block, so no pair
    of query and chunk is shuffled; what can't come in by its bounds is not added up.  The
    driver sees the terms that queries have.  An exact repeat of a row counts once, queries of
    the same terms are searched once.  Exact; ties go by chunk_id, null last.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    each = cut(queries.groupBy(F.col(query_key).alias("query_id")).agg(F.sort_array(F.flatten(F.collect_list(search_tokens(F.col(query))))).alias("tokens")).where(F.size("tokens") > 0))
    terms = sorted(r["term"] for r in each.select(F.explode("tokens").alias("term")).distinct().toLocalIterator())
    vocabulary = sc.broadcast(terms)
    kind = documents.select(F.col(key)).schema[0].dataType.simpleString()
    # a null leaves the hash as it is, so its place goes in, too
    own = F.xxhash64(*[x for c in documents.columns for x in (F.col(c), F.col(c).isNull())])
    rows = documents.select(F.col(key).alias("chunk_id"), F.coalesce(keep if keep is not None else F.lit(True), F.lit(False)).alias("kept"), own.alias("h"), search_tokens(text).alias("tokens")).where("tokens is not null")
    counted = rows.mapInArrow(lambda batches: _known_terms(batches, vocabulary), f"chunk_id {kind}, {COUNTED}")
    tasks = 2 * sc.defaultParallelism
    spread = counted.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk_id")
    folder = f"{shared_folder(spark).rstrip('/')}/vellum-index-{uuid4().hex}"
    spread.groupBy("chunk_id").agg(F.collect_set(F.struct("kept", "h", "length", "ids", "tfs")).alias("versions")).coalesce(tasks).write.parquet(folder)
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    index = spark.read.parquet(folder)
    files = sorted(index.inputFiles())
    counts = {r["id"]: r["n"] for r in index.mapInArrow(_index_counts, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator()}
    n, tokens = counts.get(-1, 0), counts.get(-2, 0)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], dtype=np.float64)
    stats = sc.broadcast((np.log(1 + (n - df + 0.5) / (df + 0.5)), tokens / n if tokens else 1.0))

    asked, most = each.schema["query_id"].dataType.simpleString(), BLOCK_QUERIES
    parts = max(sc.defaultParallelism, -(-each.count() // most))
    found = each.repartition(parts, F.xxhash64("tokens")).mapInArrow(lambda batches: _search(batches, files, vocabulary, stats, k, most), f"query_id {asked}, chunk_id {kind}, raw double, rank int")
    return found.select("query_id", "chunk_id", F.round("raw", 6).alias("score"), "rank")


def rank_fusion(ranked: DataFrame, *, group: str = "query_id", key: str = "chunk_id", weights: dict[str, float], rrf_k: int = 60, k: int = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion of rank columns; a missing rank adds nothing, ties go by key."""
    score = sum((F.coalesce(F.lit(w) / (rrf_k + F.col(c)), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return top(ranked.withColumn("raw", score), group, [F.round("raw", 12).desc(), F.col(key)], k).select(group, key, *weights, F.round("raw", 9).alias("score"), "rank")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of largest cosine for each query.

    Queries are taken in blocks of `block`; a task multiplies its vectors with a block and
    keeps its own k best, so what is shuffled is k rows a task and query.  Exact; ties go
    by key.  Null vectors and zero vectors have no partner.
    """
    spark = vectors.sparkSession
    rows = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where("q is not null and v is not null")
    total = rows.count()
    result, after = None, None
    for _ in range(max(1, -(-total // block))):
        part = (rows if after is None else rows.where(F.col("q") > after)).orderBy("q").limit(block).collect()
        after = part[-1]["q"] if part else None
        ids = np.array([r["q"] for r in part])
        m = np.array([r["v"] for r in part], dtype=np.float64).reshape(len(part), -1)
        norm = np.linalg.norm(m, axis=1) if len(part) else np.zeros(0)
        ids, m = ids[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
        sent = spark.sparkContext.broadcast((ids, m))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            held = None
            for batch in batches:
                batch = batch[batch["v"].notna() & batch["i"].notna()]
                if not len(batch) or not len(ids):
                    continue
                x = np.array(batch["v"].tolist(), dtype=np.float64)
                n = np.linalg.norm(x, axis=1)
                own = batch["i"].to_numpy()[n > 0]
                s = np.round(m @ (x[n > 0] / n[n > 0][:, None]).T, 9)
                near = np.broadcast_to(own, s.shape)
                if held is not None:
                    near, s = np.concatenate([held[0], near], axis=1), np.concatenate([held[1], s], axis=1)
                first = np.lexsort((near, -s), axis=1)[:, :k]
                held = np.take_along_axis(near, first, axis=1), np.take_along_axis(s, first, axis=1)
            if held is not None:
                yield pd.DataFrame({"query_id": np.repeat(ids, held[0].shape[1]), "vec_id": held[0].ravel(), "raw": held[1].ravel()})

        kind = vectors.schema[key].dataType.simpleString()
        found = vectors.select(F.col(key).alias("i"), F.col(vector).alias("v")).mapInPandas(best, f"query_id {kind}, vec_id {kind}, raw double")
        result = found if result is None else result.unionByName(found)
    return top(result, "query_id", [F.col("raw").desc(), F.col("vec_id")], k).select("query_id", "vec_id", F.round("raw", 6).alias("score"), "rank")


#: Pages of a document that meet in one task; most chunks lie on one or two.
PAGE_BUCKET = 8


def page_windows(anchors: DataFrame, chunks: DataFrame, *, before: int = 1, after: int = 1, most: int = 12) -> DataFrame:
    """(anchor_id, chunk_id, position): chunks of the anchor's document that touch its pages and those beside them.

    Of more than `most` the nearest by index stay; positions follow the index.  Anchors and chunks meet by
    document and bucket of pages, so that a long document is spread over tasks; of the buckets a pair has
    in common the first counts.
    """

    def buckets(rows: DataFrame, first: str, last: str, name: str) -> DataFrame:
        bucket = lambda c: F.floor(c / PAGE_BUCKET)
        own = rows.where(F.col(first).isNotNull() & F.col(last).isNotNull()).withColumn(name, bucket(F.least(first, last)))
        return own.withColumn("bucket", F.explode(F.sequence(name, bucket(F.greatest(first, last)))))

    a = anchors.select(F.col("chunk_id").alias("anchor_id")).distinct().join(chunks.select(F.col("chunk_id").alias("anchor_id"), "document_id", F.col("chunk_index").alias("at"), F.greatest(F.col("page_start") - before, F.lit(1)).alias("low"), (F.col("page_end") + after).alias("high")), "anchor_id")
    c = chunks.select("document_id", "chunk_id", "chunk_index", "page_start", "page_end")
    near = buckets(a, "low", "high", "a_first").join(buckets(c, "page_start", "page_end", "c_first"), ["document_id", "bucket"]).where("page_end >= low and page_start <= high and bucket = greatest(a_first, c_first)")
    kept = top(near, "anchor_id", [F.abs(F.col("chunk_index") - F.col("at")), F.col("chunk_index"), F.col("chunk_id")], most, "nearness")
    return kept.select("anchor_id", "chunk_id", F.row_number().over(Window.partitionBy("anchor_id").orderBy("chunk_index", "chunk_id")).alias("position"))


# Titles that open the statements of the parent company and of the group.
PARENT_MARKS = ["母公司资产负债表", "母公司利润表", "母公司现金流量表", "母公司所有者权益变动表", "母公司财务报表主要项目注释"]
GROUP_MARKS = ["合并资产负债表", "合并利润表", "合并现金流量表", "合并所有者权益变动表", "合并财务报表项目注释"]


def statement_scopes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, statement_scope): the scope of the last statement title, carried forward through each document."""
    context = F.regexp_replace(F.concat(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), ""), F.substring(F.coalesce("text", F.lit("")), 1, 800)), r"[ \t\r\n\f\x{3000}]+", "")
    last = lambda marks: F.greatest(*[F.length(context) - F.length(F.substring_index(context, m, -1)) - F.when(F.contains(context, F.lit(m)), len(m)).otherwise(10**6) for m in marks])
    parent, group = last(PARENT_MARKS), last(GROUP_MARKS)
    mark = F.when((parent < 0) & (group < 0), None).when(parent > group, "parent").otherwise("consolidated")
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.select("chunk_id", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("unspecified")).alias("statement_scope"))


def rerank(hits: DataFrame, score: Column, *, group: str = "query_id", rank: str = "hit_rank", k: int = 10) -> DataFrame:
    """Hits by score, ties by their rank before: adds new_rank, score and how far they moved."""
    scored = hits.withColumn("rerank_score", score)
    return top(scored, group, [F.col("rerank_score").desc(), F.col(rank), F.col("chunk_id")], k, "new_rank").withColumn("rank_delta", F.col(rank) - F.col("new_rank"))


def choose_query(rows: DataFrame, *, least_overlap: float = 0.4, score_ratio: float = 0.8) -> Column:
    """'rewritten' or 'original': the rewrite is given up if its best score and its overlap with the original's hits are both low.

    rows: original_ids, rewritten_ids (arrays), original_top, rewritten_top.
    """
    union = F.size(F.array_union("original_ids", "rewritten_ids"))
    overlap = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("original_ids", "rewritten_ids")) / union)
    worse = (F.col("rewritten_top") < F.col("original_top") * score_ratio) & (overlap < least_overlap)
    return F.when(F.size("original_ids") == 0, "rewritten").when(F.size("rewritten_ids") == 0, "original").when(worse, "original").otherwise("rewritten")
