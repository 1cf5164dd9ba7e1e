"""Operator 10, exact dedup: two passes over a Bloom filter.

Pass 1 hashes every text (A-Z lower-cased, UTF-8, SHA-256) into a narrow shared table and builds a Bloom filter with two bit
planes, "seen" and "seen again". The filter is cut into shards by the high bits of the hash; all bits of a hash lie in one shard,
so the hashes (8 bytes a row, each at most twice a task) are dealt to shards and each shard sets its own bits: what moves grows
in proportion to the rows, and no task sees more than its share even if one text makes up most rows.
Pass 2 broadcasts the "seen again" plane. Rows it does not hold are unique for certain and pass straight through; only the others
are grouped by their full digest. The broadcast has a proven bound: a plane has at most MAX_PLANE_BYTES. Past the rows that fit, the
narrow table is written in segments of the hash space; each is read with a plane of its own, which is destroyed before the next one is
made, so the work stays in proportion to the rows and one plane is held at a time.

keep_latest() then knows which rows go, by file and row number, and scans the texts once more without hashing them again: rows that
go are dropped by broadcast lists of row numbers, in groups of files that are as large as may be broadcast. At every size texts are in
no exchange, and each file is read once by pass 1 and once by pass 2.

Nulls: a null text counts as empty; null ids sort below all others. Rows that repeat id and text: exactly one stays. Very long texts
are hashed whole. Empty table: no rows. Extra columns pass through keep_latest(); they don't meet inner names.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, DROP_BYTES, Scratch, drop_rows, lean, place_of, read, small_side

MAX_PLANE_BYTES = 64 << 20
BITS_PER_ROW = 16
PROBES = 4
SHARD_BYTES = 64 << 10

_HASHED = "__nd_id long, __nd_file long, __nd_row long, __nd_sha binary, __nd_h long"


def _digest(batches):
    """The narrow row of each text: its digest and filter hash instead of the text."""
    for batch in batches:
        raw = batch.column("__nd_text").cast(pa.large_binary()).to_pylist()
        shas = [hashlib.sha256(b"" if x is None else x.lower()).digest() for x in raw]
        heads = np.frombuffer(b"".join(s[:8] for s in shas), "<i8") if shas else np.zeros(0, np.int64)
        cols = [batch.column(c) for c in ("__nd_id", "__nd_file", "__nd_row")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(shas, pa.binary()), pa.array(heads)], names=["__nd_id", "__nd_file", "__nd_row", "__nd_sha", "__nd_h"])


def segments_for(rows: int, max_plane_bytes: int = MAX_PLANE_BYTES) -> int:
    """How many planes the filter of so many rows takes."""
    need = max(1, math.ceil(rows * BITS_PER_ROW / (SHARD_BYTES * 8)))
    return math.ceil(need / max(1, max_plane_bytes // SHARD_BYTES))


def hash_rows(docs: DataFrame, id_col: str, text_col: str, own: Scratch, file: Column | None = None, row: Column | None = None, segments: int = 1) -> list[DataFrame]:
    """The narrow table of pass 1, written to the shared folder in segments of the hash space. file and row tell rows apart."""
    file, row = (F.lit(0).cast("long"), F.monotonically_increasing_id()) if file is None else (file, row)
    rows = docs.select(F.col(id_col).cast("long").alias("__nd_id"), file.alias("__nd_file"), row.alias("__nd_row"), F.col(text_col).alias("__nd_text"))
    hashed = own.write(rows.mapInArrow(lean(_digest), _HASHED), "hashes", by=_segment_of(F.col("__nd_h"), segments) if segments > 1 else None)
    return [hashed] if segments == 1 else [hashed.filter(F.col("__nd_part") == k).drop("__nd_part") for k in range(segments)]


def _positions(h: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each hash and its PROBES bits in that shard."""
    u = h.view(np.uint64)
    step = (u >> np.uint64(17)) | np.uint64(1)
    probes = np.stack([(u + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40) for i in range(PROBES)]) % np.uint64(bits)
    return ((u >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), probes


def _twice_per_task(batches):
    """Each hash at most twice a task, so that a hot hash stays small; the work set is bounded and flushed when full."""
    once, twice = set(), set()
    for batch in batches:
        out = []
        for h in batch.column(0).to_pylist():
            if h in twice:
                continue
            (twice if h in once else once).add(h)
            out.append(h)
        if len(once) > 1_000_000:
            once, twice = set(), set()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])


def _plane_builder(shards: int, bits: int):
    def build(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            h = batch.column("h").to_numpy()
            shard, probes = _positions(h, shards, bits)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                planes = seen.setdefault(int(shard[part[0]]), [np.zeros(bits, bool), np.zeros(bits, bool)])
                same, counts = np.unique(h[part], return_counts=True)
                at = _positions(same, shards, bits)[1]
                hits = np.bincount(at.ravel().astype(np.int64), weights=np.tile(np.minimum(counts, 2), PROBES), minlength=bits)
                planes[1] |= (hits >= 2) | (planes[0] & (hits > 0))
                planes[0] |= hits > 0
        for shard, (_, again) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([np.packbits(again).tobytes()], pa.binary())], names=["shard", "plane"])

    return build


def _probe(plane, shards: int, bits: int):
    def run(batches):
        for batch in batches:
            h = batch.column("__nd_h").to_numpy()
            shard, probes = _positions(h, shards, bits)
            at = (shard * bits).astype(np.uint64) + probes
            table = plane.value
            hit = ((table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], names=[*batch.schema.names, "__nd_maybe"])

    return run


def flagged(segments: list[DataFrame], own: Scratch, max_plane_bytes: int = MAX_PLANE_BYTES) -> DataFrame:
    """The narrow rows with __nd_maybe, which tells whether their text may be repeated; written, a segment after the other."""
    out = []
    for k, hashed in enumerate(segments):
        spark, bits = hashed.sparkSession, SHARD_BYTES * 8
        shards = max(1, min(math.ceil(hashed.count() * BITS_PER_ROW / bits), max_plane_bytes // SHARD_BYTES))  # segments differ a little in size
        deal = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
        dealt = hashed.select(F.col("__nd_h").alias("h")).mapInArrow(_twice_per_task, "h long").repartition(deal, F.expr(f"pmod(shiftrightunsigned(h, 32), {shards})"))
        plane = np.zeros(shards * SHARD_BYTES, np.uint8)
        for row in dealt.mapInArrow(_plane_builder(shards, bits), "shard long, plane binary").toLocalIterator():  # one plane in all
            plane[row.shard * SHARD_BYTES : (row.shard + 1) * SHARD_BYTES] = np.frombuffer(row.plane, np.uint8)
        sent = spark.sparkContext.broadcast(plane)
        schema = T.StructType([*hashed.schema.fields, T.StructField("__nd_maybe", T.BooleanType())])
        out.append(own.write(hashed.mapInArrow(_probe(sent, shards, bits), schema), f"flagged-{k}"))
        sent.destroy()
    own.drop("hashes")
    return reduce(DataFrame.unionByName, out)


def _segment_of(h, segments: int):
    """h modulo segments, h read as unsigned 64-bit."""
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return ((high % segments) * ((1 << 32) % segments) + low % segments) % segments


def _groups(maybe: DataFrame) -> DataFrame:
    """Digest, size and staying row of each text that occurs more than once, from the rows that the filter lets through."""
    best = F.max(F.struct("__nd_id", "__nd_file", "__nd_row"))
    return maybe.groupBy("__nd_sha").agg(best.alias("__nd_best"), F.count(F.lit(1)).alias("__nd_n")).filter("__nd_n > 1")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_plane_bytes: int = MAX_PLANE_BYTES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Texts never move; unique rows take part in no exchange."""
    own = Scratch("exact")
    parts = segments_for(docs.count(), max_plane_bytes)
    every = flagged(hash_rows(docs, id_col, text_col, own, segments=parts), own, max_plane_bytes)
    maybe = every.filter("__nd_maybe")
    groups = own.write(_groups(maybe), "groups")
    own.leave("groups", *(f"flagged-{k}" for k in range(parts)))
    maybe = maybe.join(small_side(groups, BROADCAST_ROWS // 4), "__nd_sha", "left")
    alone = every.filter("NOT __nd_maybe")
    sha = F.lower(F.hex("__nd_sha")).alias("text_sha256")
    doc_id = F.col("__nd_id").alias("doc_id")
    return alone.select(doc_id, F.col("__nd_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha).unionByName(
        maybe.select(
            doc_id,
            F.when(F.col("__nd_n").isNull(), F.col("__nd_id")).otherwise(F.col("__nd_best.__nd_id")).alias("keep_id"),
            F.coalesce("__nd_n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("__nd_best.__nd_row") == F.col("__nd_row"), F.lit(True)).alias("kept"),
            sha,
        )
    )


def keep_latest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_plane_bytes: int = MAX_PLANE_BYTES, most: int = DROP_BYTES) -> DataFrame:
    """docs with only the row of the largest id of each text; all columns of docs. What is no plain scan of Parquet files is written
    to the shared folder first, as rows are told apart by file and row number. `most`: bytes of row numbers that are broadcast at once."""
    own = Scratch("exact")
    if place_of(docs) is None:
        docs = own.write(docs, "docs")
        own.leave("docs")
    file, row = place_of(docs)
    maybe = flagged(hash_rows(docs, id_col, text_col, own, file, row, segments_for(docs.count(), max_plane_bytes)), own, max_plane_bytes).filter("__nd_maybe")
    groups = own.write(_groups(maybe), "groups")
    stays = F.struct("__nd_id", "__nd_file", "__nd_row").eqNullSafe(F.col("__nd_best"))
    gone = maybe.join(small_side(groups, BROADCAST_ROWS // 4), "__nd_sha").filter(~stays).select(F.col("__nd_file").alias("file"), F.col("__nd_row").alias("row"))
    out = drop_rows(docs, gone, own, most)
    own.close()
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(read(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
