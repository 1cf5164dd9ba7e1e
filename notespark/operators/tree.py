"""Traversal of node trees. Ancestor arrays are made once, at indexing; queries then need one join and no recursion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

MOST_ROOTS = 1024


def _linked(nodes: DataFrame) -> DataFrame:
    """(id, parent_id), null where the parent is not there."""
    there = nodes.select(F.col("id").alias("parent_id")).withColumn("__there", F.lit(True))
    return nodes.select("id", "parent_id").join(there, "parent_id", "left").select("id", F.when(F.col("__there"), F.col("parent_id")).alias("parent_id"))


def _pointers(nodes: DataFrame, start: Column, merge, out: str) -> DataFrame:
    """Pointer doubling over parent links: (id, up, out) where up is null for all, and out is what merge(own, above) makes of `start`
    along the way to the root. Each round doubles the way, so a chain of n nodes takes log2(n)
    rounds, each one join on ids; a node that never gets to a root is in a cycle, or under one, which is an error."""
    now = kept(nodes.select("id", F.col("parent_id").alias("up"), start.alias(out)))
    rounds = math.ceil(math.log2(max(2, nodes.count()))) + 1
    for _ in range(rounds):
        if now.filter("up IS NOT NULL").isEmpty():
            return now
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col(out).alias("__out"))
        done, going = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
        now = kept(done.unionByName(going.join(above, "up").select("id", F.col("__up").alias("up"), merge(F.col(out), F.col("__out")).alias(out))))
    if now.filter("up IS NOT NULL").isEmpty():
        return now
    raise ValueError(f"the parents of {now.filter('up IS NOT NULL').first().id} form a cycle")


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """nodes(id, parent_id, ...) plus ancestor_ids, root first, whatever the depth; a cycle is an error."""
    kind = nodes.schema["id"].dataType.simpleString()
    own = F.when(F.col("parent_id").isNotNull(), F.array(F.col("parent_id"))).otherwise(F.array()).cast(f"array<{kind}>")
    return nodes.drop("ancestor_ids").join(_pointers(_linked(nodes), own, lambda a, b: F.concat(b, a), "ancestor_ids").drop("up"), "id", "left")


def depths(nodes: DataFrame) -> DataFrame:
    """(id, depth) by parent links alone."""
    return _pointers(_linked(nodes), F.when(F.col("parent_id").isNull(), 0).otherwise(1), lambda a, b: a + b, "depth").select("id", "depth")


def closure(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the nodes in or under roots(id), by parent links alone."""
    marked = _linked(nodes).join(roots.select("id").distinct().withColumn("__root", F.lit(True)), "id", "left")
    inside = _pointers(marked, F.coalesce("__root", F.lit(False)), lambda a, b: a | b, "inside")
    return inside.filter("inside").select("id")


def subtree_sql(table: str, roots: list) -> str:
    """The closure by a recursive query, for tables without ancestor arrays."""
    listed = ", ".join(str(r) if isinstance(r, int) else "'" + r.replace("'", "''") + "'" for r in roots)
    return f"WITH RECURSIVE sub AS (SELECT id FROM {table} WHERE id IN ({listed}) UNION ALL SELECT n.id FROM {table} n JOIN sub s ON n.parent_id = s.id) SELECT id FROM sub"


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes in or under the roots(id). A cut list of roots is held against the ancestor arrays where nodes are read, without an
    exchange; more roots than MOST_ROOTS are joined to the exploded arrays."""
    few = [r.id for r in roots.select("id").distinct().limit(MOST_ROOTS + 1).collect()]  # at most MOST_ROOTS + 1
    line = F.concat("ancestor_ids", F.array("id"))
    if len(few) <= MOST_ROOTS:
        kind = nodes.schema["id"].dataType.simpleString()
        return nodes.filter(F.arrays_overlap(line, F.array(*[F.lit(i) for i in few]).cast(f"array<{kind}>"))) if few else nodes.limit(0)
    lines = nodes.select("id", F.explode(line).alias("root"))
    inside = lines.join(roots.select(F.col("id").alias("root")), "root", "left_semi").select("id").distinct()
    return nodes.join(inside, "id", "left_semi")


def ancestors(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ids(id): its ancestors as (id, ancestor_id, pos), root first."""
    return nodes.join(ids, "id", "left_semi").select("id", F.posexplode("ancestor_ids").alias("pos", "ancestor_id"))


def siblings(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ids(id): (id, sibling_id, sibling_order, content), other nodes of the same parent and note."""
    own = nodes.join(ids, "id", "left_semi").select("id", "note_id", F.col("parent_id").alias("p"))
    other = nodes.select(F.col("id").alias("sibling_id"), F.col("note_id").alias("n"), "parent_id", "sibling_order", "content")
    both = own.join(other, (own["note_id"] == other["n"]) & own["p"].eqNullSafe(other["parent_id"]) & (own["id"] != other["sibling_id"]))
    return both.select("id", "sibling_id", "sibling_order", "content")


def children(nodes: DataFrame) -> DataFrame:
    """parent_id and its children, in order."""
    rows = F.sort_array(F.collect_list(F.struct("sibling_order", "id")))
    return nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.transform(rows, lambda r: r["id"]).alias("child_ids"))


def with_order_path(nodes: DataFrame) -> DataFrame:
    """nodes plus order_path, the sibling orders from the root: sorting by it is preorder."""
    orders = nodes.select(F.col("id").alias("a"), F.col("sibling_order").alias("o"))
    lines = nodes.select("id", F.posexplode(F.concat("ancestor_ids", F.array("id"))).alias("pos", "a"))
    paths = lines.join(orders, "a").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "o"))), lambda r: r["o"]).alias("order_path"))
    return nodes.join(paths, "id")


def preorder(nodes: DataFrame) -> DataFrame:
    """nodes plus pre, from 0 in each note."""
    return with_order_path(nodes).withColumn("pre", F.row_number().over(Window.partitionBy("note_id").orderBy("order_path")) - 1)


def postorder(nodes: DataFrame) -> DataFrame:
    """nodes plus post, from 0 in each note: children before parents."""
    padded = F.concat(F.col("order_path"), F.array(F.lit(2147483647)))
    return with_order_path(nodes).withColumn("post", F.row_number().over(Window.partitionBy("note_id").orderBy(padded)) - 1)


def note_roots(nodes: DataFrame) -> DataFrame:
    """note_id and the id of its one root; more or fewer fail at run time."""
    roots = nodes.groupBy("note_id").agg(F.collect_list(F.when(F.col("parent_id").isNull(), F.col("id"))).alias("r"))
    return roots.select("note_id", F.when(F.size("r") == 1, F.get("r", 0)).otherwise(F.raise_error(F.concat(F.lit("note without one root: "), "note_id"))).alias("root_id"))
