"""Retrieval: BM25 over postings, exact nearest neighbours, phased search, snippets, stitching."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import l2, literal
from ..session import kept
from . import ranking, tree
from .cells import CellIndex
from .filters import notes_with_tag, request_filter, with_tag

K1, B = 1.2, 0.75
DEFAULT_K, DEFAULT_COARSE, TAG_LIMIT = 20, 32, 200
COARSE_TYPES = ["note", "topic", "subtopic"]
SEPARATOR = "\n\n---\n\n"


@dataclass
class SearchRequest:
    query: str
    k: int | None = None
    coarse_k: int | None = None
    tags: list[str] = field(default_factory=list)
    path_globs: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    hybrid: bool = True
    total_tokens: int = T.SNIPPET_TOKENS
    fractions: tuple = T.FRACTIONS


def clamp_coarse(k) -> int:
    try:
        return max(1, min(256, int(k)))
    except (TypeError, ValueError, OverflowError):
        return DEFAULT_COARSE


def coarse_setting(raw: str) -> tuple[int, str | None]:
    """Coarse K as a user types it, and what to say where it was not taken as it is: blank is the default, a fraction is cut off."""
    if not raw.strip():
        return DEFAULT_COARSE, None
    try:
        asked = float(raw)
        whole = int(asked)
    except (ValueError, OverflowError):
        return DEFAULT_COARSE, f"not a number; the default of {DEFAULT_COARSE} is used"
    value = clamp_coarse(whole)
    return value, None if value == asked else f"{value} is used"


def fallback_floor(coarse_k: int) -> int:
    return max(4, coarse_k // 4)


# --- keyword search


def postings(nodes: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, term, tf, length): one aggregation, combined on the map side."""
    words = nodes.select(F.col(id_col).alias("id"), T.terms(F.col(content)).alias("ts")).filter(F.size("ts") > 0)
    return words.select("id", F.size("ts").cast("long").alias("length"), F.explode("ts").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def matches(nodes: DataFrame, terms: list[str], id_col: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Postings of these terms and the corpus numbers, where there is no index: texts are cut into terms once, and only lengths and the
    terms sought are kept."""
    words = nodes.select(F.col(id_col).alias("id"), T.terms(F.col(content)).alias("ts"))
    narrow = kept(words.select("id", F.size("ts").cast("long").alias("length"), F.filter("ts", lambda t: t.isin(terms)).alias("hit")).filter("length > 0"))
    posted = narrow.select("id", "length", F.explode("hit").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    return posted, narrow.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))


def corpus_stats(nodes: DataFrame, content: str = "content") -> DataFrame:
    """One row: number of nodes with terms and their mean length."""
    size = F.size(T.terms(F.col(content)))
    return nodes.select(size.alias("n")).filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_length"))


def bm25(posted: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(id, bm25), lower is better, over the given terms only: the filter on term reaches the scan of a stored posting table."""
    hits = posted.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most as many rows as the query has terms
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return joined.groupBy("id").agg((-F.sum(idf * tf)).alias("bm25"))


def python_terms(query: str) -> list[str]:
    """The keyword terms of a query, as query_terms has them."""
    import re

    words = [w for w in re.split(r"[^0-9a-z\u0080-\uffff]+", T.python_fold(query)) if w and w not in T.OPERATORS]
    return list(dict.fromkeys(words))[: T.MAX_TERMS]


def keyword_top(nodes: DataFrame | None, posted: DataFrame, stats: DataFrame, query: str, k: int, where: Column | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """The k best nodes by BM25 among `nodes` (None: all) that pass `where`; statistics are those of all nodes. blocks: the block index
    of the postings, of which then only a part is read."""
    found = python_terms(query)
    spark = posted.sparkSession
    if not found:
        return spark.createDataFrame([], "id string, bm25 double")
    allowed = None if nodes is None else (nodes if where is None else nodes.filter(where)).select("id")
    if blocks is not None:
        from . import blockmax

        asked = spark.createDataFrame([(0, found)], "query int, terms array<string>")
        return blockmax.top_k(blocks.filter(F.col("term").isin(found)), stats, asked, k, allowed).select("id", "bm25")
    scored = bm25(posted, stats, found)
    return (scored if allowed is None else scored.join(allowed, "id")).orderBy("bm25", "id").limit(k)


# --- vectors


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """The k nearest of vectors that have been filtered: (id, distance)."""
    return vectors.select(F.col(id_col).alias("id"), l2(F.col(column), literal(query)).alias("distance")).orderBy("distance", "id").limit(k)


def vector_rows(nodes: DataFrame, embeddings: DataFrame, kind: str) -> DataFrame:
    e = embeddings.filter(F.col("vector_type") == kind).select(F.col("node_id").alias("id"), "embedding")
    return nodes.select("id").join(e, "id")


# --- phased search


@dataclass
class Corpus:
    """The tables that a search reads. nodes carry vault_path, note_date and ancestor_ids."""

    nodes: DataFrame
    embeddings: DataFrame
    summaries: DataFrame
    tags: DataFrame
    postings: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None  # the block index of the postings
    cells: dict[str, CellIndex] = field(default_factory=dict)  # the cell index of the vectors of a kind

    def nearest(self, nodes: DataFrame, kind: str, vector: list[float], k: int) -> DataFrame:
        """The k of these nodes whose vectors of a kind are nearest."""
        if kind in self.cells:
            return self.cells[kind].nearest(vector, k, nodes)
        return nearest(vector_rows(nodes, self.embeddings, kind), vector, k)


def coarse(c: Corpus, kept: DataFrame, request: SearchRequest, vector: list[float], coarse_k: int) -> DataFrame:
    """(id, rank) of the coarse phase: summary vectors fused with keywords, or summary vectors alone."""
    by_vector = ranking.ranked(c.nearest(kept, "summary", vector, coarse_k), "distance")
    if not request.hybrid:
        return by_vector.select("id", "rank")
    words = keyword_top(kept, c.postings, c.stats, request.query, coarse_k, F.col("type").isin(COARSE_TYPES), c.blocks)
    fused = ranking.fuse([by_vector, ranking.ranked(words, "bm25")])
    best = fused.orderBy(F.desc("rrf_score"), "id").limit(coarse_k)
    return ranking.ranked(best, "rrf_score", descending=True).select("id", "rank")


def gate(hits: DataFrame, counted: DataFrame, below: int) -> DataFrame:
    """hits, if counted has fewer than `below` rows, else none. counted is a cut list, so its count is one small row."""
    few = counted.agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < below)
    return hits.join(F.broadcast(few)).drop("__n")


def search_hits(c: Corpus, request: SearchRequest, vector: list[float], kept: DataFrame) -> DataFrame:
    """(id, distance) of the drill-down and, where the coarse phase found too little, of the fallback."""
    k, coarse_k = request.k or DEFAULT_K, clamp_coarse(request.coarse_k if request.coarse_k is not None else DEFAULT_COARSE)
    roots = coarse(c, kept, request, vector, coarse_k)
    inside = tree.descendants(kept.select("id", "ancestor_ids"), roots).select("id")
    drill = c.nearest(inside, "content", vector, k)
    wide = gate(c.nearest(kept, "content", vector, coarse_k), roots, fallback_floor(coarse_k))
    return ranking.merge_min([drill, wide]).orderBy("distance", "id").limit(k)


def search(c: Corpus, request: SearchRequest, embed) -> DataFrame:
    """(rank, node_id, note_path, distance, snippet). embed turns the query into a vector. A blank query finds nothing."""
    T.check_assembly(request.total_tokens, request.fractions)
    schema = "rank int, node_id string, note_path string, distance double, snippet string"
    if not request.query.strip():
        return c.nodes.sparkSession.createDataFrame([], schema)
    f, _ = request_filter(request.tags, request.path_globs, request.start, request.end)
    kept = c.nodes.filter(f.column())
    if request.tags:
        tagged = with_tag(kept, c.tags, request.tags).select("id").orderBy("id").limit(TAG_LIMIT)
        hits = tagged.withColumn("distance", F.lit(0.0))
    else:
        hits = search_hits(c, request, embed(request.query.strip()), notes_with_tag(kept, c.tags, []))
    found = snippets(c, hits, request.total_tokens, request.fractions)
    return ranking.ranked(found, "distance", "node_id").select("rank", "node_id", "note_path", "distance", "snippet")


def snippets(c: Corpus, hits: DataFrame, total: int = T.SNIPPET_TOKENS, fractions: tuple = T.FRACTIONS) -> DataFrame:
    """hits(id, distance) with their blocks: siblings and ancestors' summaries are joined for all hits at once."""
    ids = hits.select("id")
    rows = F.sort_array(F.collect_list(F.struct("sibling_order", "sibling_id", "content")))
    beside = tree.siblings(c.nodes, ids).groupBy("id").agg(F.array_join(F.transform(rows, lambda r: r["content"]), "\n").alias("sib"))
    above = tree.ancestors(c.nodes, ids).join(c.summaries.select(F.col("node_id").alias("ancestor_id"), "summary"), "ancestor_id").filter("summary <> ''")
    said = F.sort_array(F.collect_list(F.struct("pos", "summary")))
    above = above.groupBy("id").agg(F.array_join(F.transform(said, lambda r: r["summary"]), "\n\n").alias("par"))
    own = hits.join(c.nodes.select("id", "vault_path", "heading_trail", "content"), "id").join(beside, "id", "left").join(above, "id", "left")
    block = T.snippet(F.col("vault_path"), F.col("heading_trail"), F.col("content"), F.col("sib"), F.col("par"), total, fractions)
    return own.select(F.col("id").alias("node_id"), F.col("vault_path").alias("note_path"), "distance", block.alias("snippet"))


def stitch(results: DataFrame, limit: int, separator: str = SEPARATOR) -> DataFrame:
    """The ranked prefix of results whose joined snippets fit in `limit` tokens."""
    return ranking.fitting_prefix(results, F.length("snippet"), "rank", limit, len(separator))


def stitched_context(prefix: DataFrame, separator: str = SEPARATOR) -> str:
    rows = prefix.orderBy("rank").select("snippet").collect()  # at most k rows within the token budget
    return separator.join(r.snippet for r in rows)
