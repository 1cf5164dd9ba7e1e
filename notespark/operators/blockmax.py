"""BM25 top-k that leaves most postings unread: blocks of postings with an upper bound (block-max), and essential terms (MaxScore).

Nodes are numbered by length and cut into blocks of SIZE; the index has one row for each term and block, with its postings and the two
numbers that bound the score of any of them: the largest term frequency and the smallest length. Both hold whatever the corpus numbers
become, so the index outlives other notes' changes. A search reads bounds only (the postings are another column) and then

1. scores the k blocks of the highest bounds, which gives a k-th best score that the answer cannot fall below;
2. drops blocks whose bounds add up to less;
3. parts the terms: the cheapest ones whose bounds together stay below the threshold cannot carry a node alone, so only the other,
   essential ones are read in the blocks that are left;
4. reads the rest for blocks with nodes that may still get there.

The answer is exact: the same rows as scoring every posting, with scores rounded to 9 digits and ties broken by id. `queries` is a table,
so many searches are one job; all joins are on (query, block) or term, and a group never holds more than the postings of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import search

SIZE = 16
DEAL = 32  # groups of a query that are cut to the best before they meet
SLACK = 1e-9  # sums of doubles in another order


def build(posted: DataFrame, size: int = SIZE) -> DataFrame:
    """posted(id, term, tf, length) as (term, block, n, max_tf, min_length, postings): one row for each term and block of nodes."""
    if size & (size - 1) or size < 1:
        raise ValueError("the size of a block is a power of two")
    nodes = posted.groupBy("id").agg(F.max("length").alias("length")).repartitionByRange("length", "id").sortWithinPartitions("length", "id")
    numbered = nodes.select("id", F.shiftright(F.monotonically_increasing_id(), size.bit_length() - 1).alias("block"))
    rows = F.sort_array(F.collect_list(F.struct("id", "tf", "length")))  # at most `size` of them
    blocks = posted.join(numbered, "id").groupBy("term", "block")
    return blocks.agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), rows.alias("postings"))


def impact(tf: Column, length: Column) -> Column:
    """What a posting adds to a score, without the weight of its term. Grows with tf, falls with length."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / F.col("avg_length")))


def _best(rows: DataFrame, k: int, score: str, by: str) -> DataFrame:
    """The k best rows of each query: in DEAL groups first, so that no task orders all rows of one."""
    order = [F.desc(score), F.asc(by)]
    dealt = F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64(by), F.lit(DEAL))).orderBy(*order))
    first = rows.withColumn("__k", dealt).filter(F.col("__k") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("__k")


class Run:
    """A search in steps. found: (query, rank, id, bm25); read: (query, postings, read)."""

    def __init__(self, blocks: DataFrame, stats: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None):
        """queries(query, terms); allowed(id): the nodes that may be found, all if None; stats as search.corpus_stats() has them."""
        self.blocks, self.stats, self.k, self.allowed = blocks, F.broadcast(stats), k, allowed  # stats is one row
        wanted = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
        hits = blocks.select("term", "block", "n", "max_tf", "min_length").join(wanted, "term").crossJoin(self.stats)
        bounds = hits.select("query", "term", "block", "n", "docs", impact(F.col("max_tf"), F.col("min_length")).alias("part"))
        weights = bounds.groupBy("query", "term").agg(F.sum("n").alias("df"), F.max("part").alias("most"), F.first("docs").alias("docs"))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = kept(weights.select("query", "term", "df", idf.alias("idf"), (idf * F.col("most")).alias("most")))  # a row for each term of a query
        bounds = bounds.join(self.weights.select("query", "term", "idf"), ["query", "term"])
        self.bounds = kept(bounds.select("query", "term", "block", "n", "idf", (F.col("idf") * F.col("part")).alias("bound")))  # no postings
        sums = self.bounds.groupBy("query", "block").agg(F.sum("bound").alias("bound"))
        self.seeds = kept(_best(sums, k, "bound", "block").select("query", "block"))  # k rows a query
        seeded = self._scored(self.bounds.join(self.seeds, ["query", "block"]))
        threshold = _best(seeded, k, "score", "id").groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("t"))
        threshold = queries.select("query").join(threshold, "query", "left").select("query", F.when(F.col("c") >= k, F.col("t") - SLACK).otherwise(0.0).alias("threshold"))
        self.threshold = kept(threshold)  # a row a query
        running = F.sum("most").over(Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        terms = self.weights.join(self.threshold, "query").withColumn("essential", running >= F.col("threshold"))
        live = sums.join(self.threshold, "query").filter(F.col("bound") >= F.col("threshold")).select("query", "block")
        self.live = kept(self.bounds.join(live, ["query", "block"]).join(terms.select("query", "term", "essential"), ["query", "term"]))
        first = self._scored(self.live.filter("essential"))
        more = self.live.filter("NOT essential").groupBy("query", "block").agg(F.sum("bound").alias("more"))
        hope = F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.col("threshold")
        # few rows: nodes that can still be among the best
        self.hopeful = kept(first.join(more, ["query", "block"], "left").join(self.threshold, "query").filter(hope).select("query", "block", "id", "score"))
        self.rest = self.live.filter("NOT essential").join(self.hopeful.select("query", "block").distinct(), ["query", "block"])
        late = self._scored(self.rest).select("query", "id", F.col("score").alias("late"))
        total = self.hopeful.join(late, ["query", "id"], "left").select("query", "id", F.round(F.col("score") + F.coalesce("late", F.lit(0.0)), 9).alias("score"))
        self.found = _best(total, k, "score", "id").select("query", "rank", "id", (-F.col("score")).alias("bm25"))

    def _scored(self, chosen: DataFrame) -> DataFrame:
        """(query, block, id, score) over the postings of the chosen (query, term, block, idf)."""
        rows = self.blocks.select("term", "block", "postings").join(chosen.select("query", "term", "block", "idf"), ["term", "block"])
        rows = rows.select("query", "block", "idf", F.inline("postings")).crossJoin(self.stats)
        if self.allowed is not None:
            rows = rows.join(self.allowed.select("id"), "id", "left_semi")
        return rows.groupBy("query", "block", "id").agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("length"))).alias("score"))

    @property
    def read(self) -> DataFrame:
        """For each query: the postings of its terms, and how many of them were read, those of the first blocks counted again."""
        n = lambda rows, name: rows.groupBy("query").agg(F.sum("n").alias(name))
        parts = [n(self.bounds.join(self.seeds, ["query", "block"]), "a"), n(self.live.filter("essential"), "b"), n(self.rest, "c")]
        out = self.weights.groupBy("query").agg(F.sum("df").alias("postings"))
        for part in parts:
            out = out.join(part, "query", "left")
        return out.select("query", "postings", sum(F.coalesce(c, F.lit(0)) for c in ("a", "b", "c")).alias("read"))


def top_k(blocks: DataFrame, stats: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query, rank, id, bm25) of the k best nodes for each of queries(query, terms); lower is better."""
    return Run(blocks, stats, queries, k, allowed).found
