"""Operator 11, periodic runs: partition refinement after Crochemore.

Words of a text are coded by number. For growing lengths, positions are kept in classes of equal factors: two positions stay together
from one length to the next if the positions after them do. Only the smaller parts of a class that was split are looked at to split
the classes before them (the largest part may be left out, as what it would split off is what the others leave), so each position
is looked at O(log n) times and n words take O(n log n) steps. Classes are linked lists in order of position; a neighbour at a
distance equal to the length is a square whose root is primitive, and squares of one period in a row are a run.

Many texts are refined at once (BATCH_WORDS words together, a longer text alone), as one numpy step a length then serves all of them;
no text takes part past a third of its own length, as a run holds its period at least three times. Texts never meet in an exchange:
the operator is one pass over its table, whatever is repeated in it.

A run is a stretch of words of smallest period q, at least max(least, times * q) words long, that no neighbouring word extends. Null
and blank texts have no words and no runs; very long texts are taken whole; ties and repeated rows do not matter, as each row is
judged alone. Empty table: no rows. Extra columns pass through; inner names avoid theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, let, read

LEAST, TIMES = 24, 3
BATCH_WORDS = 1_000_000

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def squares(codes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each square of a primitive root in texts that lie one behind the other.

    codes: a code for each word, different from text to text, and one of its own behind each text. limits: for each position the
    longest period that its text may have."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(codes[order[1:]], codes[order[:-1]], out=head[1:])
    label = np.cumsum(head) - 1
    cls = np.empty(n, np.int64)
    cls[order] = label
    size = np.zeros(n, np.int64)
    used = int(label[-1]) + 1 if n else 0
    size[:used] = np.bincount(label, minlength=used)
    first = np.full(n, -1, np.int64)
    first[:used] = order[head]
    after, before, since = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.ones(n, np.int64)
    inner = ~head[1:]
    after[order[:-1][inner]], before[order[1:][inner]] = order[1:][inner], order[:-1][inner]
    found_at, found_d, bits = [], [], max(1, n.bit_length())
    length, last = 1, int(limits.max(initial=0))
    small = np.arange(n)

    def in_order(*columns: np.ndarray) -> list[np.ndarray]:
        """Rows of numbers up to n, sorted by all columns: as one number a row where they fit."""
        if len(columns) * bits > 63:
            order = np.lexsort(columns[::-1])
            return [c[order] for c in columns]
        packed = columns[0]
        for c in columns[1:]:
            packed = (packed << bits) | c
        packed, mask = np.sort(packed), (1 << bits) - 1
        return [(packed >> (bits * k)) & mask for k in range(len(columns) - 1, -1, -1)]

    def relink(x: np.ndarray, to: np.ndarray) -> None:
        """x is followed by `to` from the next length on; what it was followed by till now may have been a square."""
        d = after[x] - x
        hit = (since[x] <= d) & (d <= length)
        if hit.any():
            found_at.append(x[hit])
            found_d.append(d[hit])
        after[x], since[x] = to, length + 1

    while len(small) and length < last:
        i = small - 1
        ok = (i >= 0) & (size[cls[i]] > 1) & (limits[i] > length)
        i, by = i[ok], cls[small[ok]]
        if not len(i):
            break
        own, by, i = in_order(cls[i], by, i)
        new_own = np.concatenate(([True], own[1:] != own[:-1]))
        new = new_own | np.concatenate(([True], by[1:] != by[:-1]))
        at = np.flatnonzero(new)  # where each part of a class begins
        count = np.diff(np.append(at, len(i)))
        of = own[at]
        class_at = np.flatnonzero(new_own[at])  # where each class begins among the parts
        parts = np.diff(np.append(class_at, len(at)))
        total, largest = np.add.reduceat(count, class_at), np.maximum.reduceat(count, class_at)
        rest = size[of[class_at]] - total
        split = (parts > 1) | (rest > 0)
        if not split.all():  # classes that stay whole
            keep_part = np.repeat(split, parts)
            keep = np.repeat(keep_part, count)
            i, own, count, of = i[keep], own[keep], count[keep_part], of[keep_part]
            parts, total, largest, rest = parts[split], total[split], largest[split], rest[split]
            if not len(i):
                break
            at = np.concatenate(([0], np.cumsum(count)[:-1]))
            class_at = np.concatenate(([0], np.cumsum(parts)[:-1]))
        # what is left of a class closes over what goes
        gone = in_order(own, i)[1]
        starts = np.concatenate(([True], before[gone[1:]] != gone[:-1]))
        ends = np.append(starts[1:], True)
        left, right, owner = before[gone[starts]], after[gone[ends]], cls[gone[starts]]
        has_left, has_right = left >= 0, right >= 0
        first[owner[~has_left]] = right[~has_left]
        before[right[has_right]] = left[has_right]
        relink(left[has_left], right[has_left])
        # each part is a list of its own
        tail = np.zeros(len(i), bool)
        tail[np.append(at[1:], len(i)) - 1] = True
        follow = np.append(i[1:], -1)
        follow[tail] = -1
        precede = np.append(-1, i[:-1])
        precede[at] = -1
        moved = follow != after[i]
        relink(i[moved], follow[moved])
        before[i] = precede
        # the first of the largest parts of a class that is used up keeps the name
        big = count == np.repeat(largest, parts)
        nth = np.cumsum(big)
        lead = big & (nth - np.repeat(nth[class_at] - big[class_at], parts) == 1)
        keeps = lead & np.repeat(rest == 0, parts)
        names = np.where(keeps, of, 0)
        fresh_names = np.flatnonzero(~keeps)
        names[fresh_names] = used + np.arange(len(fresh_names))
        used += len(fresh_names)
        size[of[class_at]] = rest
        size[names], first[names] = count, i[at]
        cls[i] = np.repeat(names, count)
        # all parts but the largest are looked at next
        short = (rest > 0) & (rest < largest)
        skip = lead & np.repeat(rest < largest, parts)
        nxt = [i[np.repeat(~skip, count)]]
        walk = first[of[class_at][short]]
        while len(walk):
            nxt.append(walk)
            walk = after[walk]
            walk = walk[walk >= 0]
        small = np.concatenate(nxt)
        length += 1
    x = np.flatnonzero(after >= 0)
    d = after[x] - x
    hit = (since[x] <= d) & (d <= limits[x])
    return np.concatenate([*found_at, x[hit]]), np.concatenate([*found_d, d[hit]])


def runs_of(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    chosen = [k for k, ws in enumerate(texts) if len(ws) >= max(least, times)]
    if not chosen:
        return out
    codes, limits, offsets, used = [], [], [0], 0
    for k in chosen:
        ws = texts[k]
        seen = {w: c for c, w in enumerate(dict.fromkeys(ws))}
        part = np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))
        codes += [part + used, np.array([used + len(seen)])]
        used += len(seen) + 1
        limits.append(np.append(np.full(len(ws), len(ws) // times), 0))
        offsets.append(offsets[-1] + len(ws) + 1)
    at, d = squares(np.concatenate(codes), np.concatenate(limits))
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    if not len(at):
        return out
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)))
    begin = np.flatnonzero(new)
    start, period = at[begin], d[begin]
    length = np.diff(np.append(begin, len(at))) + 2 * period - 1
    good = length >= np.maximum(least, times * period)
    start, period, length = start[good], period[good], length[good]
    text = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((period, start))
    for k in np.unique(text):
        mine = order[text[order] == k]
        out[chosen[k]] = np.stack([start[mine] - offsets[k], length[mine], period[mine]], axis=1)
    return out


def kept(words: list, runs: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _annotate(text_col: str, runs_col: str, kept_col: str, least: int, times: int):
    def finish(rows: list[pa.RecordBatch], texts: list[list[bytes]]):
        found, k = runs_of(texts, least, times), 0
        for batch in rows:
            mine, said = found[k : k + batch.num_rows], texts[k : k + batch.num_rows]
            k += batch.num_rows
            flat = np.concatenate(mine) if mine else np.zeros((0, 3), np.int64)
            fields = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]
            structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, mine)]), pa.int32()), structs)
            joined = pa.array([b" ".join(kept(w, r)) for w, r in zip(said, mine)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, joined], names=[*batch.schema.names, runs_col, kept_col])

    def run(batches):
        rows, texts, n = [], [], 0
        for batch in batches:
            at = 0
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
            for k, raw in enumerate(column.to_pylist()):
                texts.append((raw or b"").split())  # bytes split at exactly space, tab, line feed, \v, \f and \r
                n += len(texts[-1])
                if n >= BATCH_WORDS:
                    yield from finish([*rows, batch.slice(at, k + 1 - at)], texts)
                    rows, texts, n, at = [], [], 0, k + 1
            if at < batch.num_rows:
                rows.append(batch.slice(at))
        yield from finish(rows, texts)

    return run


def mark(docs: DataFrame, runs_col: str = "runs", kept_col: str = "kept", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs plus runs_col, the runs of each text as (start, length, period) by start, then period, counted in words from 0, and
    kept_col, its words without those that a run holds after its first period, joined by one space."""
    (inner,) = fresh(docs, "text")
    schema = T.StructType([*docs.schema.fields, T.StructField(inner, T.StringType()), T.StructField(runs_col, RUNS), T.StructField(kept_col, T.StringType())])
    return docs.withColumn(inner, F.col(f"`{text_col}`").cast("string")).mapInArrow(lean(_annotate(inner, runs_col, kept_col, least, times)), schema).drop(inner)


def collapse(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with each run cut down to its first period; all columns and rows of docs. Texts without a run stay as they are."""
    runs, text = fresh(docs, "runs", "kept")
    marked = mark(docs, runs, text, text_col, least, times)
    cut = F.when(F.size(runs) > 0, F.col(text)).otherwise(F.col(f"`{text_col}`"))
    return marked.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def planted(docs: DataFrame) -> DataFrame:
    """The query's input: in one document of ten the words from one on repeat, with a period that hangs on the document's number."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(ws: Column) -> Column:
        n, g = F.size(ws).cast("long"), F.floor(h / 10)

        def again(a: Column) -> Column:
            p = 1 + F.floor((n - a) / (3 + g % 8))
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

        return F.when(n > 0, let(g % n, again)).otherwise("")

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+", -1), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeat)).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """Of runs by start, then period, the first of the greatest exact length / period; null if there is none."""
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(planted(read(spark, sf_dir, "documents")), text_col="text").withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("kept"), 256).alias("collapsed_sha256"),
    )


SQL = {
    "op11_periodic_runs": r"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
  xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)), 4294967295)::BIGINT AS h FROM documents),
a AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
x AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM d),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.word = a.word AND b.i > a.i AND b.i - a.i <= a.n // 3),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY 1, 2, 3),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::HUGEINT * 1000000000000 // period DESC, start, period) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""
}
QUERIES = {"op11_periodic_runs": op11_periodic_runs}
