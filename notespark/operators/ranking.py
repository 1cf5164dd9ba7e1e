"""Ranks, fusion, running budgets, first uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
CAPS = {"topics": 10, "entities": 15, "dates": 15, "actions": 15, "tags": 50}


def ranked(hits: DataFrame, score: str, id_col: str = "id", descending: bool = False) -> DataFrame:
    """hits plus rank, from 1. For lists that a top-k has cut: one task orders them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score) if descending else F.asc(score), id_col)))


def fuse(lists: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) lists: id, rrf_score."""
    every = reduce(DataFrame.unionByName, [x.select(id_col, "rank") for x in lists])
    return every.groupBy(id_col).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("rrf_score"))


def merge_min(lists: list[DataFrame], id_col: str = "id", score: str = "distance") -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(id_col, score) for x in lists]).groupBy(id_col).agg(F.min(score).alias(score))


def fitting_prefix(rows: DataFrame, length: Column, order: str, limit: int, separator: int = 0, per_item: bool = False) -> DataFrame:
    """The longest prefix by `order` that fits in `limit` tokens, plus `used`. per_item rounds each item up, not the whole."""
    w = Window.orderBy(order)
    size = F.ceil(length / 4) if per_item else length + F.when(F.row_number().over(w) > 1, separator).otherwise(0)
    total = rows.withColumn("__size", size).withColumn("__sum", F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    used = F.col("__sum") if per_item else F.ceil(F.col("__sum") / 4)
    return total.withColumn("used", used.cast("long")).filter(F.col("used") <= limit).drop("__size", "__sum")


def first_uses(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first record of each key, renumbered from 0."""
    first = records.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__k = 1").drop("__k")
    return first.withColumn("insertion_order", F.row_number().over(Window.orderBy(order)) - 1)


def sources(records: DataFrame, path: str = "note_path", node: str = "node_id", order: str = "insertion_order") -> DataFrame:
    """Distinct paths with the node that used each first."""
    return records.groupBy(path).agg(F.min_by(node, F.struct(order, node)).alias(node), F.min(order).alias(order))


def clip_rubric(lines: DataFrame, note: str = "id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines (id, pos, line) of a rubric without the list items past their section's cap."""
    by = Window.partitionBy(note).orderBy(pos)
    field = F.regexp_extract(F.trim(line), "^(" + "|".join(CAPS) + "):", 1)
    item = F.col(line).rlike(r"^\s*-\s")
    section = F.last(F.when(F.col("__f") != "", F.struct(F.col(pos).alias("p"), F.col("__f").alias("f"))), ignorenulls=True).over(by)
    cap = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    marked = lines.withColumn("__f", field).withColumn("__s", section)
    n = F.sum(F.when(item & (F.col("__f") == ""), 1).otherwise(0)).over(Window.partitionBy(note, "__s").orderBy(pos))
    keep = (F.col("__f") != "") | ~item | F.col("__s").isNull() | (F.col("__n") <= cap[F.col("__s")["f"]])
    return marked.withColumn("__n", n).filter(keep).drop("__f", "__s", "__n")
