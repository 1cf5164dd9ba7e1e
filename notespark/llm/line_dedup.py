"""Operator 8, line dedup: overlapping windows of three lines.

The lines of a document are hashed in windows of WINDOW consecutive lines; windows that occur again anywhere are found by one
aggregation on the hash, which also gives the first occurrence (smallest document, then position). Every later occurrence covers
its lines; covered positions merge, and covered lines go. Windows are written once (hashes and positions only) and aggregated with
partial sums, so that a passage in most documents is one row a task there; the repeated ones, one row a passage, are then joined to
the windows as a written table, in an exchange whose hot keys Spark can split, as nothing stands between its sides and their scans.
Texts meet the positions that go in one more such join. Both are merge joins at every size, as neither table has a bound.

Lines end at line feeds. Blank lines count as lines, but a window of blank lines only is never a repetition. A null text counts as
empty (one empty line); documents of fewer than three lines have no window; very long texts are taken whole. Documents are told apart by id and text: rows that
repeat both are one document and all treated as the first. Null ids come before all others. Empty table: no rows. Extra columns
pass through drop_repeated(); inner names avoid theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, let, read

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(id_col: str, text_col: str) -> list[Column]:
    """Document id and a 128-bit digest of the text."""
    return [F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("md")]


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, md, pos, h): the windows of each document, pos from 0."""
    lines = docs.select(*_key(id_col, text_col), lines_of(F.col(text_col)).alias("ls")).filter(F.size("ls") >= WINDOW)

    def one(i: Column) -> Column:
        parts = [F.get("ls", i + k) for k in range(WINDOW)]
        joined = F.concat_ws("\n", *parts)
        # two 64-bit hashes: a chance equality needs both
        return F.when(F.concat(*[F.trim(p) for p in parts]) != "", F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit(7), joined).alias("b")))

    every = F.transform(F.sequence(F.lit(0), F.size("ls") - WINDOW), one)
    return lines.select("id", "md", F.posexplode(every).alias("pos", "h")).filter("h IS NOT NULL")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, md, cut): per document with later occurrences, the merged covered positions, sorted."""
    own = Scratch("lines")
    w = own.write(windows(docs, id_col, text_col), "windows")
    place = F.struct("id", "md", "pos")
    firsts = own.write(w.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h", "first"), "firsts")
    later = w.join(firsts.hint("merge"), "h").filter(place != F.col("first"))
    cover = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (WINDOW - 1))))))
    out = own.write(later.groupBy("id", "md").agg(cover.alias("cut")), "cuts")
    own.leave("cuts")
    own.close()
    return out


def mark(docs: DataFrame, cut_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus cut_col, the positions of the lines that go (empty array if none)."""
    i, m = fresh(docs, "id", "md")
    cut = repeated(docs, id_col, text_col).select(F.coalesce("id", F.lit(0)).alias(i), F.col("id").isNull().alias(m + "n"), F.col("md").alias(m), F.col("cut").alias(cut_col))
    own_id, md = _key(id_col, text_col)
    keyed = docs.withColumns({i: F.coalesce(own_id, F.lit(0)), m + "n": own_id.isNull(), m: md})
    joined = keyed.join(cut.hint("merge"), [i, m + "n", m], "left")
    return joined.drop(i, m + "n", m).withColumn(cut_col, F.coalesce(cut_col, F.array().cast("array<int>")))


def kept_lines(text: Column, cut: Column) -> Column:
    """The other lines, in order; array_except hashes, so the cost follows the number of lines."""

    def rest(ls: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), cut), lambda i: F.get(ls, i))

    return F.when(F.size(cut) == 0, lines_of(text)).otherwise(let(lines_of(text), rest))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the covered lines removed from the text; all columns and all rows of docs."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    (cut,) = fresh(docs, "cut")
    marked = mark(docs, cut, id_col, text_col)
    text = F.array_join(kept_lines(F.col(text_col), F.col(cut)), "\n")
    return marked.select(*columns, text.alias(text_col)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mark(read(spark, sf_dir, "documents").select("doc_id", "text"), "cut")
    kept = F.array_join(kept_lines(F.col("text"), F.col("cut")), "\n")
    return docs.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.size("cut").cast("long").alias("n_removed"),
        F.array_join("cut", ",").alias("removed_lines"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


SQL = {
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, ls[i] || chr(10) || ls[i+1] || chr(10) || ls[i+2] AS h
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3) WHERE trim(ls[i]) || trim(ls[i+1]) || trim(ls[i+2]) <> ''),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
g AS (SELECT doc_id, list(pos ORDER BY pos) AS cut FROM c GROUP BY 1)
SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(cut), 0) AS n_removed, coalesce(array_to_string(cut, ','), '') AS removed_lines,
  sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: cut IS NULL OR NOT list_contains(cut, i - 1)), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
}
QUERIES = {"op8_line_dedup": op8_line_dedup}
