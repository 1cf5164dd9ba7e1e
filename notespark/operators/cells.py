"""Exact nearest neighbours that leave most vectors unread: cells with a centre and a radius.

Centres are fitted by k-means on at most SAMPLE vectors; every vector then lies in the cell of its nearest centre, with its distance
`far` from it. By the triangle inequality no vector of a cell is nearer to a query than the query's distance from the centre less the
cell's radius, and none of a given `far` nearer than the difference of the two distances. A search reads the nearest cells first,
which gives a k-th distance, and then only those cells, and of them only the ring of `far`, that may still hold something nearer; the
table is sorted by cell and far, so files and row groups are skipped. The answer equals a full scan, whatever the sample was.

At most MOST_CELLS centres and their numbers are held by the driver. Vectors that are null are not indexed. Filters (`allowed`) hold for
the first step too; where the nearest cells have fewer than k allowed vectors, twice as many are read, up to all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2, literal

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 8
SLACK = 1e-9


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


def fit(vectors: DataFrame, cells: int | None = None, id_col: str = "id", column: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Centres by k-means on the `sample` vectors of the smallest hashes; as many as the root of the number of vectors, unless told."""
    there = vectors.filter(F.col(column).isNotNull())
    wanted = cells or int(np.ceil(np.sqrt(there.count())))
    rows = there.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(column).cast("array<double>").alias("v")).collect()  # at most `sample`
    x = np.array([r.v for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    wanted = max(1, min(wanted, MOST_CELLS, len(x)))
    centres = x[np.linspace(0, len(x) - 1, wanted).astype(int)]
    for _ in range(ROUNDS):
        near = _apart(x, centres).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=wanted)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(id, cell, far, embedding) of every vector that is not null, sorted by cell and far."""
    table = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part.column("embedding").to_pylist(), np.float64).reshape(part.num_rows, -1)
                near = _apart(x, table.value).argmin(axis=1)
                far = np.sqrt(((x - table.value[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(near.astype(np.int32)), pa.array(far), part.column("embedding")], names=["id", "cell", "far", "embedding"])

    rows = vectors.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.col(column).alias("embedding"))
    schema = T.StructType([rows.schema["id"], T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), rows.schema["embedding"]])
    return rows.mapInArrow(run, schema).repartitionByRange("cell", "far").sortWithinPartitions("cell", "far")


class CellIndex:
    def __init__(self, table: DataFrame, cells: DataFrame):
        """table(id, cell, far, embedding), cells(cell, centre, n, least, radius)."""
        self.table, self.spark = table, table.sparkSession
        rows = cells.orderBy("cell").collect()  # at most MOST_CELLS
        self.cell = np.array([r.cell for r in rows], np.int64)
        self.centres = np.array([r.centre for r in rows], np.float64)
        self.n, self.least, self.radius = (np.array([r[c] for r in rows], np.float64) for c in ("n", "least", "radius"))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "id", column: str = "embedding", sample: int = SAMPLE) -> CellIndex:
        """Writes the index of all vectors to the folder `path`."""
        spark, centres = vectors.sparkSession, fit(vectors, cells, id_col, column, sample)
        assign(vectors, centres, id_col, column).write.parquet(f"{path}/vectors")
        placed = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")
        sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("radius"))
        placed.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))

    def _allowed(self, rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
        return rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi")

    def _kth(self, query: np.ndarray, apart: np.ndarray, k: int, allowed: DataFrame | None) -> float:
        """The distance of the k-th nearest in the nearest cells; infinite where all cells have fewer than k."""
        order = np.argsort(apart)
        take = int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1
        while True:
            rows = self._allowed(self.table.filter(F.col("cell").isin(self.cell[order[:take]].tolist())), allowed)
            near = rows.select(l2(F.col("embedding"), literal(query.tolist())).alias("d")).orderBy("d").limit(k).collect()  # k rows
            if len(near) == k:
                return near[-1].d
            if take >= len(order):
                return float("inf")
            take *= 2

    def candidates(self, query: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The vectors that a search for the k nearest has to look at."""
        if not len(self.cell) or k < 1:
            return self.table.limit(0)
        q = np.array(query, np.float64)
        if len(q) != self.centres.shape[1]:
            raise ValueError(f"a query of {len(q)} dimensions where {self.centres.shape[1]} are stored")
        apart = np.sqrt(((self.centres - q) ** 2).sum(axis=1))
        kth = self._kth(q, apart, k, allowed) * (1 + SLACK) + SLACK
        live = (apart - self.radius <= kth) & (self.least - apart <= kth)
        rings = [(c, float(d - kth), float(d + kth)) for c, d in zip(self.cell[live].tolist(), apart[live])]
        ring = F.broadcast(self.spark.createDataFrame(rings, "cell int, low double, high double"))  # at most MOST_CELLS rows
        inside = self.table.filter(F.col("cell").isin([c for c, _, _ in rings])).join(ring, "cell").filter("far BETWEEN low AND high")
        return self._allowed(inside.drop("low", "high"), allowed)

    def nearest(self, query: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, distance) of the k nearest of all vectors, or of those whose id is in allowed(id)."""
        found = self.candidates(query, k, allowed).select("id", l2(F.col("embedding"), literal(query)).alias("distance"))
        return found.orderBy("distance", "id").limit(k)
