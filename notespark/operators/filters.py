"""Retrieval filters as Columns and semi joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs


@dataclass
class NodeFilter:
    """AND of its parts; an absent or empty part is no constraint."""

    note_ids: list[str] = field(default_factory=list)
    node_types: list[str] = field(default_factory=list)
    subtree_roots: list[str] = field(default_factory=list)
    tags_any: list[str] = field(default_factory=list)
    path_regex: str | None = None
    path_likes: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None

    def column(self) -> Column:
        """What needs no join, over nodes with vault_path and note_date."""
        parts = [date_range(F.col("note_date"), self.start, self.end)]
        if self.note_ids:
            parts.append(F.col("note_id").isin(self.note_ids))
        if self.node_types:
            parts.append(F.col("type").isin(self.node_types))
        if self.path_regex:
            parts.append(path_regex(F.col("vault_path"), self.path_regex))
        if self.path_likes:
            parts.append(reduce(lambda a, b: a | b, [F.col("vault_path").ilike(p) for p in self.path_likes]))
        return reduce(lambda a, b: a & b, parts)

    def apply(self, nodes: DataFrame, tags: DataFrame | None = None) -> DataFrame:
        """nodes that pass: filters first, so that a top-k after them is full."""
        out = nodes.filter(self.column())
        if self.subtree_roots:
            inside = F.arrays_overlap("ancestor_ids", F.array(*[F.lit(r) for r in self.subtree_roots]))
            out = out.filter(inside | F.col("id").isin(self.subtree_roots))
        if self.tags_any and tags is not None:
            out = with_tag(out, tags, self.tags_any)
        return out


def date_range(c: Column, start: str | None, end: str | None) -> Column:
    """Inclusive, open-ended, as strings; null is out once there is a bound."""
    test = F.lit(True)
    if start or end:
        test = c.isNotNull()
    if start:
        test = test & (c >= start)
    if end:
        test = test & (c <= end)
    return test


def path_regex(c: Column, regex: str) -> Column:
    """Whatever the case; an invalid expression matches nothing."""
    import re

    try:
        re.compile(regex)
    except re.error:
        return F.lit(False)
    return c.rlike("(?i)" + regex)


def tag_matches(c: Column, wanted: list[str]) -> Column:
    """Equal, or a child of, one of the tags."""
    low = F.lower(c)
    tests = [(low == t.lower()) | low.startswith(t.lower() + "/") for t in wanted]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def with_tag(nodes: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Nodes that have a matching tag themselves."""
    return nodes.join(tags.filter(tag_matches(F.col("tag"), wanted)).select(F.col("node_id").alias("id")), "id", "left_semi")


def notes_with_tag(nodes: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Nodes of notes any of whose nodes has a matching tag; all if no tag is wanted."""
    if not wanted:
        return nodes
    hits = with_tag(nodes.select("id", "note_id"), tags, wanted).select("note_id")
    return nodes.join(hits, "note_id", "left_semi")


def request_filter(tags=None, path_globs=None, start=None, end=None, strict: bool = False) -> tuple[NodeFilter, list[str]]:
    """Filter and warnings of a request: an invalid glob is dropped with a warning, or matches nothing if strict."""
    f, warnings = NodeFilter(tags_any=list(tags or []), start=start or None, end=end or None), []
    if path_globs:
        try:
            f.path_regex = globs.globs_regex(list(path_globs))
        except ValueError as e:
            warnings.append(f"path globs ignored: {e}")
            if strict:
                f.path_regex = "(?!)"
    return f, warnings


def non_leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that have a child."""
    return nodes.join(nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")), "id", "left_semi")
