"""Operator 12, substring dedup: anchors of a difference cover.

A window is `words` consecutive words of one document. A word goes if a window over it stands earlier too: in a document of smaller
id, or earlier in its own; what stays is judged on the input. No window is compared with another for its own sake. A difference cover
D modulo v holds, for any two positions i and j, an offset d < v with (i + d) mod v and (j + d) mod v both in D. So of two equal
windows each contains an anchor, a shorter window of words - v + 1 words that starts at a cover position, at the same offset. Pass 1
hashes the anchors only (4 of 13 positions for windows of 20 words) and finds those that occur again. Pass 2 extends them: a repeated
anchor is hashed with all words that a window with it can hold, its context. Where a context stands earlier, so do all windows in it
that hold the anchor, and nothing more is asked of them; so long copies cost a row an anchor, not a row a window. What is left are
windows around anchors that occur in several contexts, as they do where a copy ends or was edited: pass 3 hashes those windows
themselves, but for the ones that pass 2 has settled. No link is lost: two equal windows share an anchor; either its contexts are equal, and the later one is settled,
or they differ, and both windows are in pass 3, unless settled. The first window of its kind is never settled, so it is there to be found.

Each pass is an aggregation with partial sums and a merge join to the written table of what was found, in which Spark can split hot
keys, as nothing stands between its sides and their scans: a passage in a third of all documents is one row a task in the aggregation.
Contexts and windows have hashes of 128 bits. Texts are in an exchange where they meet what was found, by document. What a pass has
shuffled is freed when it ends.

Words are runs of other bytes than space, tab, line feed, vertical tab, form feed and carriage return; upper and lower case differ.
Null and blank texts have no words and stay as they are, as do texts from which nothing goes; others are joined by one space. Very
long texts are taken whole. Documents are told apart by id and text: rows that repeat both are one document and all judged as the
first. Of different texts of one id the order is that of a hash. Null ids come first. Empty table: no rows. Extra columns pass
through; inner names avoid theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, lean, read
from .hashing import SPACES, mix, word_hashes

WORDS = 20
#: Perfect difference covers by modulus.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
ROWS = 1 << 16  # of an Arrow batch that goes back to Spark
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))

_FORMS = [mix(np.arange(k, k + 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1) for k in (1001, 5003)]


def cover_of(words: int) -> tuple[int, tuple[int, ...], int]:
    """Modulus, cover and words of an anchor for windows of `words` words: as few positions as leave anchors of a third of them."""
    period = max(v for v in COVERS if v == 1 or words - v + 1 >= max(3, words / 3))
    return period, COVERS[period], words - period + 1


def window_hashes(words: np.ndarray, n: int, form: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the n words from each position, or from the positions `at`; forms are independent of each other."""
    if at is None:
        at = np.arange(max(0, len(words) - n + 1))
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += words[at + k] * (_FORMS[form][k % 256] + np.uint64(2 * (k // 256)))
    return mix(out)


def _sliced(columns: dict[str, np.ndarray]):
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        yield pa.RecordBatch.from_pydict({c: pa.array(v[at : at + ROWS]) for c, v in columns.items()})


def _anchors(words: int):
    period, cover, size = cover_of(words)
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def run(batches):
        for batch in batches:
            hashes, offsets = word_hashes(batch.column("text"), SPACES, lower=False)
            counts = np.diff(offsets)
            pos = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
            fits = (pos <= np.repeat(counts, counts) - size) & (np.repeat(counts, counts) >= words) & chosen[pos % period]
            at = np.flatnonzero(fits)
            keys = np.repeat(batch.column("key").to_numpy(), counts)[at]
            yield from _sliced({"key": keys, "pos": pos[at].astype(np.int32), "h": window_hashes(hashes, size, 0, at).view(np.int64)})

    return run


def _around(words: int, emit, columns: list[str]):
    """Runs emit(hashes of the words of a text, row of the batch) on each text; it returns positions and more columns of numbers."""

    def run(batches):
        for batch in batches:
            hashes, offsets = word_hashes(batch.column("text"), SPACES, lower=False)
            rows, made = [], []
            for row, found in enumerate(zip(*[batch.column(c).to_pylist() for c in columns])):
                made.append(emit(hashes[offsets[row] : offsets[row + 1]], *[np.array(x, np.int64) for x in found]))
                rows.append(np.full(len(made[-1][0]), row))
            if not rows:
                continue
            rows, parts = np.concatenate(rows), [np.concatenate(x) for x in zip(*made)]
            for at in range(0, len(rows), ROWS):
                same = [batch.column(c).take(pa.array(rows[at : at + ROWS])) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(x[at : at + ROWS]) for x in parts]], names=["id", "key", *["pos", "a", "b", "h"][: len(parts)]])

    return run


def _contexts(words: int):
    period, _, size = cover_of(words)
    edge = np.zeros(period - 1, np.uint64)  # stands for words before and behind a text

    def emit(mine, at):
        at = at[at <= len(mine) - size]  # those of another text, should two keys be equal, do no harm
        wide = np.concatenate((edge, mine, edge))
        both = [window_hashes(wide, size + 2 * (period - 1), form, at).view(np.int64) for form in (0, 1)]
        return at.astype(np.int32), *both, window_hashes(mine, size, 0, at).view(np.int64)

    return _around(words, emit, ["at"])


def _near(at: np.ndarray, n: int, period: int) -> np.ndarray:
    """For each of n window starts: does the window hold an anchor of `at`?"""
    edge = np.zeros(n + period + 1, np.int32)
    at = at[at < n + period - 1]
    np.add.at(edge, np.maximum(at - period + 1, 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.cumsum(edge[:n]) > 0


def _windows(words: int):
    period = cover_of(words)[0]

    def emit(mine, later, mixed):
        n = max(0, len(mine) - words + 1)
        start = np.flatnonzero(_near(mixed, n, period) & ~_near(later, n, period))
        return start.astype(np.int32), *[window_hashes(mine, words, form, start).view(np.int64) for form in (0, 1)]

    return _around(words, emit, ["later", "mixed"])


def _cut(words: int, text_col: str, cut_cols: list[str], made: list[str]):
    period = cover_of(words)[0]

    def run(batches):
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary()).to_pylist()
            counts, spans, texts = [], [], []
            cuts = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in cut_cols]
            for text, later, starts in zip(raw, *cuts):
                ws = (text or b"").split()  # bytes split at exactly the white space above
                counts.append(len(ws))
                goes = _near(np.array(later or [], np.int64), max(0, len(ws) - words + 1), period)
                goes[np.array(starts or [], np.int64)] = True
                starts = np.flatnonzero(goes)
                new = np.concatenate(([True], starts[1:] > starts[:-1] + words)) if len(starts) else np.zeros(0, bool)
                begin = starts[new]
                stop = starts[np.append(np.flatnonzero(new)[1:] - 1, -1)] + words if len(starts) else begin
                spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(begin, stop)])
                rest, last = [], 0
                for s, e in zip(begin, stop):
                    rest += ws[last:s]
                    last = e
                texts.append(b" ".join(rest + ws[last:]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            new = [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *made])

    return run


def _keyed(id_col: str, text_col: str) -> list[Column]:
    """The document's number and a hash of number and text."""
    id_ = F.col(f"`{id_col}`").cast("long")
    return [F.coalesce(id_, F.lit(-(1 << 63))).alias("id"), F.xxhash64(id_, F.col(f"`{text_col}`").cast("string")).alias("key")]


def repeated(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, later, starts): for each document with windows that stand earlier too, the anchors all of whose windows do, and where
    other such windows start. A null id is the smallest long."""
    if words < 1:
        raise ValueError("a window has at least one word")
    own = Scratch("substrings", tidy=True)
    place = F.struct("id", "key", "pos")
    texts = docs.select(*_keyed(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    anchors = own.write(texts.select("key", "text").mapInArrow(lean(_anchors(words)), "key long, pos int, h long"), "anchors")
    again = own.write(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "again")
    places = own.write(anchors.join(again.hint("merge"), "h").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("at")), "places")
    own.drop("anchors", "again")
    near = texts.join(places.hint("merge"), "key").select("id", "key", "at", "text")
    contexts = own.write(near.mapInArrow(lean(_contexts(words)), "id long, key long, pos int, a long, b long, h long"), "contexts")
    own.drop("places")
    groups = own.write(contexts.groupBy("h", "a", "b").agg(F.min(place).alias("first")), "groups")
    mixed = groups.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.lit(True).alias("mixed"))
    mixed = own.write(mixed, "mixed")
    groups = own.write(groups.join(mixed.hint("merge"), "h", "left").select("h", "a", "b", "first", F.coalesce("mixed", F.lit(False)).alias("mixed")), "judged")
    told = contexts.join(groups.hint("merge"), ["h", "a", "b"]).select("id", "key", "pos", "mixed", (place != F.col("first")).alias("later")).filter("mixed OR later")
    listed = lambda which: F.sort_array(F.collect_set(F.when(F.col(which), F.col("pos")))).alias(which)  # noqa: E731  positions of one text
    told = own.write(told.groupBy("id", "key").agg(listed("later"), listed("mixed")), "told")
    own.drop("contexts", "groups", "mixed", "judged")
    open_ = told.filter(F.size("mixed") > 0)
    windows = texts.join(open_.hint("merge"), ["id", "key"]).select("id", "key", "later", "mixed", "text")
    windows = own.write(windows.mapInArrow(lean(_windows(words)), "id long, key long, pos int, a long, b long"), "windows")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("a", "b", "first")
    firsts = own.write(firsts, "firsts")
    later = windows.join(firsts.hint("merge"), ["a", "b"]).filter(place != F.col("first"))
    starts = own.write(later.groupBy("id", "key").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "starts")
    cuts = told.select("id", "key", "later").join(starts.hint("merge"), ["id", "key"], "left").filter("size(later) > 0 OR starts IS NOT NULL")
    cuts = own.write(cuts, "cuts")
    own.leave("cuts")
    own.close("cuts")
    return cuts


def mark(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", made: tuple[str, str, str] = ("n_words", "spans", "kept")) -> DataFrame:
    """docs plus three columns: the number of words, the spans of words that go as (start, stop) from 0, and the text of the others."""
    i, k, c, d, t = fresh(docs, "id", "key", "later", "starts", "text")
    id_, key = _keyed(id_col, text_col)
    keyed = docs.withColumns({i: id_, k: key, t: F.col(f"`{text_col}`").cast("string")})
    cuts = repeated(docs, words, id_col, text_col).select(F.col("id").alias(i), F.col("key").alias(k), F.col("later").alias(c), F.col("starts").alias(d))
    joined = keyed.join(cuts.hint("merge"), [i, k], "left").select(*[F.col(f"`{x}`") for x in docs.columns], t, c, d)
    kinds = (T.LongType(), SPANS, T.StringType())
    schema = T.StructType([*joined.schema.fields, *[T.StructField(n, kind) for n, kind in zip(made, kinds)]])
    return joined.mapInArrow(lean(_cut(words, t, [c, d], list(made))), schema).drop(t, c, d)


def drop_repeated(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words removed whose windows stand earlier too; all columns and all rows of docs."""
    made = fresh(docs, "n_words", "spans", "kept")
    marked = mark(docs, words, id_col, text_col, tuple(made))
    text = F.when(F.size(made[1]) > 0, F.col(made[2])).otherwise(F.col(f"`{text_col}`"))
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mark(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return docs.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT doc_id, list(DISTINCT j) AS cut FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE k > 1) GROUP BY 1),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN (SELECT doc_id, unnest(cut) AS j FROM c) x ON x.doc_id = p.doc_id AND x.j = p.j WHERE x.j IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(len(cut), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""
}
QUERIES = {"op12_substring_dedup": op12_substring_dedup}
