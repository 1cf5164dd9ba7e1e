"""Operator 4, benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The Jaccard similarity of a short item and a long document is next to nothing even if the document holds all of the item, so
equal-sized signatures would lose links. The search is asymmetric instead: items are partitioned by the size of their shingle
sets, and each item is sketched by its k smallest hashes (a bottom-k MinHash sketch), with k set by the largest set of its
partition: k = floor((1 - threshold) * largest) + 1. A document that holds `threshold` of an item misses fewer than k of its
shingles, so it holds at least one hash of the sketch: recall is 1 by construction. Candidates are then verified against the item's
whole shingle set. Documents are only scanned: nothing about them is shuffled, collected or kept.

The benchmark is the stated query set. It is read in blocks of at most BLOCK_SHINGLES shingles (8 bytes each, plus sketches), which
bounds what is broadcast; a larger benchmark means more passes over the documents, not larger tasks.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. An item of 1 to 4 words is one shingle of its
own length, so it is found where its words stand in a row; an item without words matches nothing. Null texts count as empty, very
long ones are searched whole; repeated rows are each answered; an empty table gives no rows. Extra columns pass through
drop_contaminated() untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read
from .hashing import NON_ALNUM, distinct, shingle_hashes, word_hashes

WORDS, THRESHOLD = 5, 0.8
BLOCK_SHINGLES = 500_000
_TABLE = np.uint64((1 << 20) - 1)


def sketch_sizes(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """k of each item: what the largest item of its size partition (powers of two) needs, at most the whole set."""
    part = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    largest = np.zeros(part.max(initial=0) + 1, np.int64)
    np.maximum.at(largest, part, sizes)
    return np.minimum(sizes, np.floor((1 - threshold) * largest[part] + 1e-9).astype(np.int64) + 1)


class Sketches:
    """The sketches of items whose shingles have the same number of words: sorted hashes, the item of each, a table of low bits."""

    def __init__(self, items: np.ndarray, sets: list[np.ndarray], threshold: float):
        k = sketch_sizes(np.array([len(s) for s in sets], np.int64), threshold)
        hashes = np.concatenate([s[:n] for s, n in zip(sets, k)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.repeat(items, k)[order]
        self.table = np.zeros(int(_TABLE) + 1, bool)
        self.table[(self.hashes & _TABLE).astype(np.int64)] = True


class Block:
    """Some items, ready to be searched for: sketches by the number of words of a shingle, WORDS or that of a shorter item."""

    def __init__(self, ids: list, sets: list[np.ndarray], words: list[int], threshold: float):
        self.ids, self.sets, self.threshold = ids, sets, threshold
        of = np.array(words, np.int64)
        self.sketches = {n: Sketches(np.flatnonzero(of == n), [sets[i] for i in np.flatnonzero(of == n)], threshold) for n in np.unique(of).tolist()}

    def matches(self, texts: pa.Array):
        """(position of the text, item id, shared, size of the item) for each confirmed pair."""
        words, offsets = word_hashes(texts, NON_ALNUM)
        for n, s in self.sketches.items():
            every = shingle_hashes(words, n)
            near = np.flatnonzero(s.table[(every & _TABLE).astype(np.int64)])
            near = near[np.isin(every[near], s.hashes)]
            text = np.searchsorted(offsets, near, "right") - 1
            near, text = (x[near + n <= offsets[text + 1]] for x in (near, text))
            for t in np.unique(text).tolist():
                h = np.unique(every[near[text == t]])
                lo, hi = np.searchsorted(s.hashes, h, "left"), np.searchsorted(s.hashes, h, "right")
                items = np.unique(np.concatenate([s.owner[a:b] for a, b in zip(lo, hi)]))
                own = np.unique(every[offsets[t] : offsets[t + 1] - n + 1])
                for i in items.tolist():
                    shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                    if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                        yield t, self.ids[i], shared, len(self.sets[i])


def blocks(items: DataFrame, id_col: str, text_col: str, threshold: float):
    """The benchmark, block after block; the driver holds one block at a time."""
    ids, sets, sizes, total = [], [], [], 0
    for row in items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        words = word_hashes(pa.array([row.t]), NON_ALNUM)[0]
        if not len(words):
            continue
        n = min(WORDS, len(words))
        s = distinct(shingle_hashes(words, n))
        if ids and total + len(s) > BLOCK_SHINGLES:
            yield Block(ids, sets, sizes, threshold)
            ids, sets, sizes, total = [], [], [], 0
        ids.append(row.i)
        sets.append(s)
        sizes.append(n)
        total += len(s)
    if ids:
        yield Block(ids, sets, sizes, threshold)


def _pieces(batch: pa.RecordBatch, size: int = 512):
    return (batch.slice(at, size) for at in range(0, batch.num_rows, size))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All pairs: doc_id, item_id, shared, item_shingles, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id, item_text, threshold):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for part in _pieces(batch):
                    found = list(sent.value.matches(part.column("text")))
                    ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3))], names=["doc_id", "item_id", "shared", "item_shingles"])

        out = out.unionByName(rows.mapInArrow(lean(run), schema))
    return out.withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; all columns of docs, in one scan."""
    for block in blocks(items, item_id, item_text, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for part in _pieces(batch):
                    keep = np.ones(part.num_rows, bool)
                    for found in sent.value.matches(part.column(text_col)):
                        keep[found[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = {
    "op4_decontaminate": r"""
WITH w AS (
  SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
t AS (SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM w),
s AS (SELECT k, id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i+4], ' ')))) AS g FROM t),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 'b' GROUP BY 1),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM s d JOIN s b ON d.k = 'd' AND b.k = 'b' AND d.g = b.g GROUP BY 1, 2),
short AS (SELECT id, ' ' || array_to_string(ws, ' ') || ' ' AS g FROM t WHERE k = 'b' AND len(ws) BETWEEN 1 AND 4),
whole AS (SELECT id, ' ' || array_to_string(ws, ' ') || ' ' AS g FROM t WHERE k = 'd')
SELECT doc_id, item_id, shared, n AS item_shingles, round(shared / n, 6) AS containment FROM p JOIN n ON n.id = p.item_id WHERE 10 * shared >= 8 * n
UNION ALL SELECT whole.id, short.id, 1, 1, 1.0 FROM whole JOIN short ON contains(whole.g, short.g)"""
}
QUERIES = {"op4_decontaminate": op4_decontaminate}
