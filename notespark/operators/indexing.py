"""Incremental indexing: what changed, what is dirty, what to embed and to summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, job_id, note_title_for, truncate_summary
from ..ports import Embedder, Summarizer, embed_rows, summarize_rows
from . import ranking, tree
from .filters import non_leaves

RUBRIC_VERSION = "SUMMARY_RUBRIC_V1"
SUMMARY_CHARS = 2048
SUMMARISED = ("note", "topic", "subtopic")


def plan(files: DataFrame, note_meta: DataFrame, deleted: DataFrame | None = None, force: bool = False, prune: bool = False) -> DataFrame:
    """(path, action): deleted, skipped (equal stored hash) or enqueued. prune also deletes notes that are no longer there."""
    stored = note_meta.select(F.col("note_id").alias("path"), F.col("content_hash").alias("stored"))
    same = F.col("hash").eqNullSafe(F.col("stored")) & F.lit(not force)
    out = files.join(stored, "path", "left").select("path", F.when(same, "skipped").otherwise("enqueued").alias("action"))
    gone = deleted.select("path") if deleted is not None else None
    if prune:
        missing = stored.join(files, "path", "left_anti").select("path")
        gone = missing if gone is None else gone.unionByName(missing).distinct()
    return out if gone is None else out.unionByName(gone.withColumn("action", F.lit("deleted")))


def run_counts(planned: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return planned.agg(n("enqueued"), n("deleted"), n("skipped"))


def jobs(files: DataFrame, planned: DataFrame, run: str) -> DataFrame:
    """Jobs of the files to index."""
    todo = files.join(planned.filter("action = 'enqueued'").select("path"), "path", "left_semi")
    return todo.select(job_id(F.lit(run), F.col("path")).alias("job_id"), F.lit(run).alias("run_id"), F.col("path").alias("note_id"), note_title_for(F.col("path")).alias("title"), F.col("content").alias("markdown"), F.col("hash").alias("content_hash"))


def need_content_vector(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Nodes with text whose stored content vector is of another text."""
    have = embeddings.filter("vector_type = 'content'").select(F.col("node_id").alias("id"), F.col("content_hash").alias("had"))
    return nodes.filter("content <> ''").join(have, "id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("had"))).drop("had")


def need_summary_vector(nodes: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, text, content_hash) of non-leaves whose summary has changed since its vector was made."""
    have = embeddings.filter("vector_type = 'summary'").select(F.col("node_id").alias("id"), F.col("content_hash").alias("had"))
    said = summaries.select(F.col("node_id").alias("id"), F.col("summary").alias("text")).filter("text <> ''")
    return non_leaves(nodes).select("id").join(said, "id").withColumn("content_hash", content_hash(F.col("text"))).join(have, "id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("had"))).drop("had")


def embedded(rows: DataFrame, embedder: Embedder, kind: str) -> DataFrame:
    """rows(id, text, content_hash) as embeddings."""
    made = embed_rows(rows.select(F.col("id").alias("node_id"), "text", "content_hash"), embedder)
    return made.select("node_id", F.lit(kind).alias("vector_type"), "embedding", F.lit(embedder.model).alias("model"), F.lit(embedder.dimension).alias("dimension"), "content_hash")


def dirty(new: DataFrame, old: DataFrame) -> DataFrame:
    """Ids of new nodes to summarise again. Both in preorder (note_id, pre, id, type, content_hash); new with ancestor_ids, is_leaf.

    Notes of equal size: where type or text differ, the node and all above it. Otherwise, or without an old version, every non-leaf.
    """
    sizes = new.groupBy("note_id").agg(F.count(F.lit(1)).alias("n")).join(old.groupBy("note_id").agg(F.count(F.lit(1)).alias("m")), "note_id", "left")
    reshaped = sizes.filter("m IS NULL OR n <> m").select("note_id")
    whole = new.join(reshaped, "note_id", "left_semi").filter("NOT is_leaf").select("id")
    was = old.select("note_id", "pre", F.col("type").alias("t0"), F.col("content_hash").alias("h0"))
    changed = new.join(was, ["note_id", "pre"]).join(reshaped, "note_id", "left_anti").filter("type <> t0 OR content_hash <> h0")
    lines = changed.select(F.explode(F.concat("ancestor_ids", F.array("id"))).alias("id"))
    return whole.unionByName(lines).distinct()


def may_skip(is_dirty: Column, summary: Column, version: Column, generated_at: Column, updated_at: Column) -> Column:
    """A summary that still stands: clean, there, of this rubric, not older than its node."""
    return F.coalesce(~is_dirty & (summary != "") & (version == RUBRIC_VERSION) & (generated_at >= updated_at), F.lit(False))


def wants_summary(kind: Column) -> Column:
    return kind.isin(*SUMMARISED)


def prompts(level: DataFrame, kids: DataFrame, summaries: DataFrame) -> DataFrame:
    """(node_id, prompt): a section for each child, its summary if it has one, else its text."""
    said = summaries.select(F.col("node_id").alias("id"), "summary")
    text = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.col("content"))
    part = F.concat(F.lit("### "), F.col("type"), F.lit(" ("), F.array_join("heading_trail", " > "), F.lit(")\n"), text)
    rows = kids.join(said, "id", "left").groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("sibling_order", part.alias("p")))).alias("ps"))
    return level.select(F.col("id").alias("node_id")).join(rows, "node_id").select("node_id", F.array_join(F.transform("ps", lambda r: r["p"]), "\n\n").alias("prompt"))


def clipped(made: DataFrame) -> DataFrame:
    """Summaries with over-full sections and over-long texts cut."""
    lines = made.select(F.col("node_id").alias("id"), F.posexplode(F.split("summary", "\n")).alias("pos", "line"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "line")))
    joined = ranking.clip_rubric(lines).groupBy("id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("s"))
    return joined.select(F.col("id").alias("node_id"), truncate_summary(F.col("s"), SUMMARY_CHARS).alias("summary"))


def summarize(nodes: DataFrame, todo: DataFrame, summaries: DataFrame, summarizer: Summarizer, write) -> DataFrame:
    """Summaries of todo(id), from the deepest level up: a stage a depth. write(df) stores a level and reads it back."""
    targets = non_leaves(nodes).filter(wants_summary(F.col("type"))).join(todo, "id", "left_semi")
    depths = [r.depth for r in targets.select("depth").distinct().orderBy(F.desc("depth")).collect()]  # as many rows as levels
    known, out = summaries.select("node_id", "summary"), None
    for depth in depths:
        level = targets.filter(F.col("depth") == depth)
        kids = nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
        made = write(clipped(summarize_rows(prompts(level, kids, known), summarizer)))
        known = known.join(made.select("node_id"), "node_id", "left_anti").unionByName(made)
        out = made if out is None else out.unionByName(made)
    if out is None:
        return nodes.sparkSession.createDataFrame([], "node_id string, summary string, model string, prompt_version string, generated_at timestamp")
    return out.select("node_id", "summary", F.lit(summarizer.model).alias("model"), F.lit(RUBRIC_VERSION).alias("prompt_version"), F.current_timestamp().alias("generated_at"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("note_id").agg(F.count(F.lit(1)).alias("node_count"))


def leaf_flags(nodes: DataFrame) -> DataFrame:
    parents = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("__p", F.lit(True))
    return nodes.join(parents, "id", "left").withColumn("is_leaf", F.col("__p").isNull()).drop("__p")


def prepared(nodes: DataFrame) -> DataFrame:
    """nodes in preorder with leaf flags, as dirty() takes them."""
    return leaf_flags(tree.preorder(nodes))
