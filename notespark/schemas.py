"""Table schemas and the invariants of the node tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_TYPES = ("note", "topic", "subtopic", "paragraph", "sentence_part", "bullet_group", "bullet")
STEPS = ("queued", "parsing", "parsed", "storing", "stored", "summarizing", "summarized", "embedding", "embedded", "failed", "dead_letter")
QUEUE_STATUS = ("pending", "processing", "completed", "dead_letter")
SCHEMA_VERSION = 3

NODES = "id string, note_id string, parent_id string, type string, heading_trail array<string>, depth int, sibling_order int, content string, content_hash string, ancestor_ids array<string>, ordinal int"
SUMMARIES = "node_id string, summary string, model string, prompt_version string, generated_at timestamp"
TAGS = "node_id string, tag string, source string"
CROSS_REFS = "source_node_id string, target_path string, link_text string"
NOTE_META = "note_id string, vault_path string, content_hash string, indexed_at timestamp, node_count long, note_date string"
EMBEDDINGS = "node_id string, vector_type string, embedding array<float>, model string, dimension int, content_hash string"
QUEUE = "id string, queue_name string, payload string, status string, retry_count int, error_message string, enqueued_at timestamp, updated_at timestamp"
JOBS = "job_id string, note_path string, current_step string, content_hash string, retry_count int, error_message string, updated_at timestamp"
PROGRESS = "job_id string, run_id string, note_path string, step string, status string, detail string, at timestamp"
POSTINGS = "id string, term string, tf long, length long"
CONFIG = "key string, value string"

TABLES = {"nodes": NODES, "summaries": SUMMARIES, "tags": TAGS, "cross_refs": CROSS_REFS, "note_meta": NOTE_META, "embeddings": EMBEDDINGS, "postings": POSTINGS, "queue_items": QUEUE, "job_steps": JOBS, "progress_events": PROGRESS, "config": CONFIG}


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """nodes, failing at run time on a type outside the enum."""
    ok = F.col("type").isin(*NODE_TYPES)
    return nodes.withColumn("type", F.when(ok, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown node type: "), F.coalesce("type", F.lit("null"))))))


def tree_faults(nodes: DataFrame) -> DataFrame:
    """Rows that break an invariant: one root a note, depth = parent's depth + 1, parent in the same note."""
    parent = nodes.select(F.col("id").alias("pid"), F.col("note_id").alias("pn"), F.col("depth").alias("pd"))
    joined = nodes.join(parent, nodes["parent_id"] == parent["pid"], "left")
    orphan = F.col("parent_id").isNotNull() & F.col("pid").isNull()
    wrong = F.when(orphan, "missing parent").when(F.col("pn") != F.col("note_id"), "parent in another note").when(F.col("pd") + 1 != F.col("depth"), "depth")
    roots = nodes.filter("parent_id IS NULL").groupBy("note_id").count().filter("count <> 1").select("note_id", F.lit("roots").alias("fault"))
    return joined.select("note_id", wrong.alias("fault")).filter("fault IS NOT NULL").unionByName(roots)
