"""Block-max BM25 for many queries over all texts at once: numpy scores blocks inside the tasks.

`blockmax` has a row for each query, term and block, which suits a few short queries over a stored index; with hundreds of long ones these
rows outgrow the texts. Here a row is a block of SIZE nodes of like length, with the bounds of its terms and its postings as arrays of
numbers, and only of terms that are asked for. A search

1. reads the bounds and takes the k blocks of the highest ones for each query;
2. scores these blocks, which gives each query a score that its k-th answer cannot fall below;
3. reads all blocks and scores those queries in a block whose bounds reach that score, or the k-th best that the task has met.

Each task gives at most k rows a query, so no exchange grows with the product of queries and blocks. The answer is exact: scores are rounded
to 9 digits and ties are broken by id. Queries are few: their terms go to the tasks with the code. They may be of any length: PAIRS bounds
what is summed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept, scratch_path
from . import search
from .blockmax import SIZE, SLACK, _best

CHUNK = 64  # blocks that are put together at once, a power of two
SLICE = 32  # blocks that are scored at once
PAIRS = 1 << 20  # pairs of a posting and a query that are summed at once


def _below(score):
    """What is surely below a score, summed in any order: long queries have large sums."""
    return score - SLACK * np.maximum(1.0, score)


def _lists(values: np.ndarray, sizes: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _slices(parts):
    return (part.slice(n, SLICE) for part in parts for n in range(0, len(part), SLICE))


def _counts(part: pa.RecordBatch, terms: pa.Array) -> pa.RecordBatch:
    """(id, ts) as (id, length, terms, tfs): how often each text has the terms asked for, by their numbers."""
    lists = part.column(1)
    n = len(lists)
    found = pc.index_in(lists.flatten(), value_set=terms)
    rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    there = found.is_valid().to_numpy(zero_copy_only=False)
    key, tf = np.unique(rows[there] * len(terms) + found.drop_null().to_numpy(), return_counts=True)
    sizes = np.bincount(key // len(terms), minlength=n) if len(terms) else np.zeros(n, int)
    number = key % len(terms) if len(terms) else key
    return pa.RecordBatch.from_arrays([part.column(0), lists.value_lengths().cast(pa.int32()), _lists(number.astype("int32"), sizes), _lists(tf.astype("int32"), sizes)], ["id", "length", "terms", "tfs"])


def _put_together(chunk: pa.Table) -> pa.Table:
    """The texts of some blocks as a row for each block; texts of one id and length are one node, as postings() has them."""
    chunk = chunk.sort_by([("block", "ascending"), ("id", "ascending"), ("length", "ascending")])
    block, length = chunk["block"].to_numpy(), chunk["length"].to_numpy()
    ids = chunk["id"].combine_chunks()
    new = np.ones(len(ids), bool)
    same = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    new[1:] = ~(same & (length[1:] == length[:-1]) & (block[1:] == block[:-1]))
    node = np.cumsum(new) - 1
    ids, block, length = ids.filter(pa.array(new)), block[new], length[new]
    term, row = _flat(chunk["terms"])
    tf, _ = _flat(chunk["tfs"])
    width = int(term.max()) + 1 if len(term) else 1
    key, where = np.unique(node[row] * width + term, return_inverse=True)
    tf = np.bincount(where, tf, len(key)).astype("int32")
    node, term = key // width, (key % width).astype("int32")
    names, first, size = np.unique(block, return_index=True, return_counts=True)
    at = np.searchsorted(names, block)  # the row of each node's block
    n = np.bincount(at[node], minlength=len(names))
    # bounds: the largest tf and the smallest length of each term in each block
    order = np.argsort(at[node] * width + term, kind="stable")
    pair, begin = np.unique((at[node] * width + term)[order], return_index=True)
    most = np.maximum.reduceat(tf[order], begin) if len(pair) else tf
    least = np.minimum.reduceat(length[node][order], begin) if len(pair) else tf
    terms = np.bincount(pair // width, minlength=len(names))
    df = np.diff(np.append(begin, len(order)))
    return pa.table({
        "block": names, "b_terms": _lists((pair % width).astype("int32"), terms), "b_n": _lists(df.astype("int32"), terms), "b_tf": _lists(most, terms), "b_length": _lists(least.astype("int32"), terms),
        "ids": pa.ListArray.from_arrays(pa.array(np.append(first, len(block)), pa.int32()), ids), "lengths": _lists(length.astype("int32"), size),
        "nodes": _lists((node - first[at[node]]).astype("int32"), n), "terms": _lists(term, n), "tfs": _lists(tf, n),
    })


class _Scorer:
    """What tasks need of the queries: the weight of each term, and the queries that have it."""

    def __init__(self, wanted: list[list[int]], idf: np.ndarray, avg_length: float, k: int):
        pairs = np.array(sorted((t, q) for q, ts in enumerate(wanted) for t in ts), int).reshape(-1, 2)
        self.of = pairs[:, 1]
        self.count = np.bincount(pairs[:, 0], minlength=len(idf))
        self.begin = np.cumsum(self.count) - self.count
        self.idf, self.avg, self.k, self.n = idf, avg_length, k, len(wanted)

    def sums(self, group: np.ndarray, groups: int, term: np.ndarray, tf: np.ndarray, length: np.ndarray, live=None) -> np.ndarray:
        """For each group and query: the sum of what these postings add. live(posting, query): those that count."""
        part = self.idf[term] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / self.avg))
        total = np.zeros(groups * self.n)
        cuts = np.flatnonzero(np.diff((np.cumsum(self.count[term]) - 1) // PAIRS, prepend=-1))
        for first, last in zip(cuts, np.append(cuts[1:], len(term))):
            many = self.count[term[first:last]]
            posting = first + np.repeat(np.arange(last - first), many)
            query = self.of[np.arange(len(posting)) - np.repeat(np.cumsum(many) - many, many) + self.begin[term[posting]]]
            if live is not None:
                there = live(posting, query)
                posting, query = posting[there], query[there]
            total += np.bincount(group[posting] * self.n + query, part[posting], groups * self.n)
        return total.reshape(groups, self.n)

    def bounds(self, part: pa.RecordBatch) -> np.ndarray:
        term, row = _flat(part["b_terms"])
        return self.sums(row, len(part), term, _flat(part["b_tf"])[0], _flat(part["b_length"])[0])

    def best(self, scores: list, query: np.ndarray, name: np.ndarray, score: np.ndarray):
        """The k best of each query among the rows so far and these."""
        if scores:
            query, name, score = (np.concatenate(x) for x in zip(scores.pop(), (query, name, score)))
        order = np.lexsort((name, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        scores.append((query[keep], name[order][keep], score[order][keep]))

    def bound_rows(self, parts):
        best: list = []
        for part in _slices(parts):
            sums = self.bounds(part)
            row, query = np.nonzero(sums)
            self.best(best, query, part["block"].to_numpy()[row], sums[row, query])
        for query, name, score in best:
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(name, pa.int64()), pa.array(score)], ["number", "block", "bound"])

    def score_rows(self, parts, threshold: np.ndarray, kind: pa.DataType):
        best: list = []
        floor = threshold.copy()
        for part in _slices(parts):
            live = self.bounds(part) >= floor
            part = part.filter(pa.array(live.any(axis=1)))
            if not len(part):
                continue
            live = live[live.any(axis=1)]
            ids, row = _flat(part["ids"])
            ids = ids.astype(str) if ids.dtype == object else ids
            first = np.cumsum(np.bincount(row, minlength=len(part))) - np.bincount(row, minlength=len(part))
            node, block = _flat(part["nodes"])
            node = node + first[block]
            sums = self.sums(node, len(ids), _flat(part["terms"])[0], _flat(part["tfs"])[0], _flat(part["lengths"])[0][node], lambda p, q: live[block[p], q])
            names, where = np.unique(ids, return_inverse=True)
            if len(names) < len(ids):  # texts of one id and several lengths
                both = np.zeros((len(names), self.n))
                np.add.at(both, where, sums)
                ids, sums = names, both
            at, query = np.nonzero((sums > 0) & (sums >= floor))
            self.best(best, query, ids[at], np.round(sums[at, query], 9))
            query, _, score = best[0]
            full = np.bincount(query, minlength=self.n) >= self.k
            last = np.searchsorted(query, np.arange(self.n), side="right") - 1
            floor[full] = np.maximum(floor[full], _below(score[last[full]]))
        for query, name, score in best:
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(name.tolist(), kind), pa.array(score)], ["number", "id", "score"])


def build(nodes: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes(id, content) as one row (id, length) for each text that has terms, and the blocks with the postings of `terms`."""
    spark = nodes.sparkSession
    name = nodes.select("id").schema["id"].dataType.simpleString()
    value_set = pa.array(terms, pa.string())
    cut = nodes.select("id", T.terms(F.col("content")).alias("ts")).filter(F.size("ts") > 0)
    at = scratch_path(spark, "batch-texts")
    cut.mapInArrow(lambda parts: (_counts(p, value_set) for p in parts), f"id {name}, length int, terms array<int>, tfs array<int>").write.parquet(at)
    texts = spark.read.parquet(at)
    lengths = texts.groupBy("id").agg(F.max("length").alias("longest")).repartitionByRange("longest", "id").sortWithinPartitions("longest", "id")
    numbered = lengths.select("id", F.shiftright(F.monotonically_increasing_id(), SIZE.bit_length() - 1).alias("block"))
    ints = ", ".join(f"{c} array<int>" for c in ("b_terms", "b_n", "b_tf", "b_length"))
    rest = ", ".join(f"{c} array<int>" for c in ("lengths", "nodes", "terms", "tfs"))
    chunks = texts.join(numbered, "id").groupBy(F.shiftright("block", CHUNK.bit_length() - 1).alias("chunk"))  # at most CHUNK * SIZE ids
    at = scratch_path(spark, "batch-blocks")
    chunks.applyInArrow(_put_together, f"block long, {ints}, ids array<{name}>, {rest}").write.parquet(at)
    return texts.select("id", "length"), spark.read.parquet(at)


def top_k(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, bm25) of the k best of nodes(id, content) for each of queries(query, terms); lower is better."""
    spark = nodes.sparkSession
    asked = queries.select("query", "terms").collect()  # few
    terms = sorted({t for q in asked for t in q.terms or ()})
    number = {t: n for n, t in enumerate(terms)}
    texts, blocks = build(nodes, terms)
    docs, avg = texts.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = np.zeros(len(terms))
    for t, n in blocks.select(F.inline(F.arrays_zip("b_terms", "b_n"))).groupBy("b_terms").agg(F.sum("b_n")).collect():  # at most a row a term
        df[t] = n
    s = _Scorer([sorted({number[t] for t in q.terms or ()}) for q in asked], np.log(1 + (docs - df + 0.5) / (df + 0.5)), avg or 1.0, k)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]

    def scored(rows: DataFrame, threshold: np.ndarray) -> DataFrame:
        found = rows.mapInArrow(lambda parts: s.score_rows(parts, threshold, arrow), f"number int, id {kind}, score double")
        return _best(found.withColumnRenamed("number", "query"), k, "score", "id")

    bounds = blocks.select("block", "b_terms", "b_tf", "b_length").mapInArrow(s.bound_rows, "number int, block long, bound double")
    seeds = _best(bounds.withColumnRenamed("number", "query"), k, "bound", "block").select("block").distinct()
    threshold = np.zeros(len(asked))
    for q, n, least in scored(blocks.join(F.broadcast(seeds), "block", "left_semi"), threshold).groupBy("query").agg(F.count(F.lit(1)), F.min("score")).collect():  # k blocks a query; a row a query
        if n == k:
            threshold[q] = _below(least)
    names = spark.createDataFrame([(n, q.query) for n, q in enumerate(asked)], f"query int, name {queries.schema['query'].dataType.simpleString()}")
    found = kept(scored(blocks, threshold))  # k rows a query
    return found.join(F.broadcast(names), "query").select(F.col("name").alias("query"), "rank", "id", (-F.col("score")).alias("bm25"))
