"""Operator 7, near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

One pass hashes the distinct word shingles of every whole text; the sorted set gives the one-permutation signature for free (the
first hash of each of BINS ranges), empty bins borrow from random occupied ones (optimal densification), and BANDS bands of ROWS
bins give bucket keys. With similarity s a pair shares no bucket with probability (1 - s**4)**32: 6e-11 at 0.85, 5e-8 at 0.8.

Texts with equal shingle sets are one class and only its representative goes on, so groups of copies cost one row each. In a
bucket, candidate edges form a star around its most connected member, so edges grow with documents, not with pairs; buckets of a
group share their centre, so a document has few of them. Stars alone would lose links between two members that are both too far
from the centre, so stars whose members are not in one component are settled exactly: each gets a second centre, from its largest
component, which is compared with all members of other components; then members of different components are compared where a prefix
filter on their differences to that centre (rarest elements first) cannot rule a link out. No pair of a bucket goes
unanswered and nothing is capped. Every edge is confirmed on the two full shingle sets (48-bit hashes of shingles). Components come
from alternating large-star and small-star steps over tables in the shared folder; links never reach the driver.

Nulls: a null or blank text has an empty set and is linked with nothing; a null id is ignored when the smallest id of a component is
sought. Rows that repeat are one class. Fewer words than a shingle: the whole sequence is the one shingle. Very long texts are
hashed whole, in segments. Empty table: no rows. Extra columns pass through keep_first(); inner names avoid theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, DROP_BYTES, Scratch, drop_rows, few_files, lean, place_of, read, small_side
from .hashing import distinct, mix, shingle_sets

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
_SHIFT = np.uint64(64 - 7)
_rng = np.random.Generator(np.random.PCG64(20240601))
_PROBES = _rng.integers(0, BINS, (BINS, 16))
_MORE = _rng.integers(0, BINS, (BINS, 1024))
_ROW_KEYS = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND_KEYS = mix(np.arange(501, 501 + BANDS, dtype=np.uint64))
_LOW48 = np.uint64((1 << 48) - 1)

_SIGNED = "doc_id long, row long, digest long, file long, at long, n long, set_a long, set_b long, bands array<long>, items binary"


def signature(items: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, non-empty set of hashes."""
    bins = (items >> _SHIFT).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(bins[1:] != bins[:-1]) + 1))
    sig, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]] = items[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    for probes in (_PROBES, _MORE):
        if not len(empty):
            return sig
        hit = full[probes[empty]]
        at = hit.argmax(axis=1)
        found = hit[np.arange(len(empty)), at]
        sig[empty[found]] = sig[probes[empty[found], at[found]]]
        empty = empty[~found]
    sig[empty] = items[0]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(BANDS, ROWS) * _ROW_KEYS).sum(axis=1, dtype=np.uint64) + _BAND_KEYS).view(np.int64)


def pack(items: np.ndarray) -> bytes:
    return distinct(items & _LOW48).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sign(words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, a, b, bands, items = [], [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    n.append(len(s))
                    m = mix(s)
                    a.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int((m * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                    bands.append(band_keys(signature(s)) if len(s) else None)
                    items.append(pack(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "row", "digest", "file", "at")), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(items, pa.binary())],
                    names=["doc_id", "row", "digest", "file", "at", "n", "set_a", "set_b", "bands", "items"],
                )

    return run


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()
            keep = []
            for x, y in zip(a, b):
                p, q = unpack(x), unpack(y)
                z = np.sort(np.concatenate((p, q)), kind="stable")
                shared = int((z[1:] == z[:-1]).sum())
                keep.append(den * shared >= num * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connected_components(edges: DataFrame, own: Scratch | None = None) -> DataFrame:
    """Of edges (a, b): node, smallest node of its component as root, for every node that is not a root. Alternating large-star and
    small-star steps, until every component is one star."""
    own = own or Scratch("components")
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    turn = 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = own.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"least-{turn}")
        large = own.write(both.filter("b > a").join(small_side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"large-{turn}")
        lowest = own.write(large.groupBy("a").agg(F.min("b").alias("m")), f"lowest-{turn}")
        small = large.join(small_side(lowest), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        e = own.write(small, f"edges-{turn}")
        own.drop(f"least-{turn}", f"large-{turn}", f"lowest-{turn}", f"edges-{turn - 1}")
        turn += 1
        nodes = e.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
        inner = e.select(F.col("b").alias("a")).distinct().withColumn("c", F.lit(2))  # a root that hangs on another node
        if nodes.filter("c > 1").isEmpty() and nodes.select("a").join(inner, "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _differences(num: int, den: int):
    """Per (rep, centre): the elements of the symmetric difference, with how many must be shared for a link across components."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, centre = part.column("items_b").to_pylist(), part.column("items_a").to_pylist()
                ids = part.column("a").to_numpy().astype(np.uint64)
                gs, slots = [], []
                for c, x, y in zip(ids, own, centre):
                    x, y = unpack(x), unpack(y)
                    z = np.sort(np.concatenate((x, y)), kind="stable")
                    edge = np.concatenate(([True], z[1:] != z[:-1], [True]))
                    d = z[edge[1:] & edge[:-1]]
                    shared = (len(z) - len(d)) // 2
                    if den * shared >= num * (len(z) - shared):
                        s = ((num + den) * len(d) + (den - num) * (len(y) - len(x))) // (2 * (num + den)) + 1
                    else:
                        s = -(((den - num) * (len(x) + len(y)) - (num + den) * len(d)) // (2 * (num + den)))
                    gs.append(mix(d ^ mix(c + np.zeros(1, np.uint64))).view(np.int64))
                    slots.append(len(d) - max(1, s) + 1)
                n = [len(g) for g in gs]
                cols = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("a", "b", "comp", "n")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(np.array(slots, np.int64), n)), pa.array(np.repeat(np.array(n, np.int64), n)), pa.array(np.concatenate(gs) if gs else np.zeros(0, np.int64))], names=["a", "b", "comp", "n", "slots", "d", "g"])

    return run


def link(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. Links have den * intersection >= num * union."""
    own = Scratch("near")
    rows, firsts = _linked(docs, words, num, den, id_col, text_col, own)
    own.leave("rows", "firsts")
    named = rows.join(small_side(firsts, BROADCAST_ROWS // 4), "comp", "left").withColumn("component_id", F.coalesce("first.doc_id", "doc_id"))
    return few_files(named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def _linked(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, own: Scratch, file: Column | None = None, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, digest of the text, place (file and row number, where given), n, comp of every row; firsts: for components of several
    rows with an id, the smallest (doc_id, digest, file, at). A key that many rows share (an exact set, a bucket, a centre, an element, a component) is aggregated with
    partial sums and joined to a written table, so that no window or join needs all its rows in one task."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), (F.lit(0) if file is None else file).cast("long").alias("file"), (F.lit(0) if at is None else at).cast("long").alias("at"), F.col(text_col).alias("text"))
    signed = own.write(texts.mapInArrow(lean(_sign(words)), _SIGNED), "signed")
    classes = own.write(signed.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("rep")), "classes")
    reps = signed.select("row", "n", "bands").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    banded = own.write(reps.select(F.col("row").alias("rep"), "n", F.explode("bands").alias("key")), "banded")
    keys = own.write(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "keys")
    shared = own.write(banded.join(small_side(keys), "key"), "shared")
    own.drop("banded", "keys")
    # the most connected member of a bucket is its first centre: in a group of near copies that is close to what they are copies of
    degrees = own.write(shared.groupBy("rep").agg(F.sum("m").alias("degree")), "degrees")
    sets = own.write(signed.select(F.col("row").alias("rep"), "n", "items").join(small_side(degrees.select("rep")), "rep", "left_semi"), "sets")
    members = own.write(shared.select("key", "rep", "n").join(small_side(degrees), "rep"), "members")
    own.drop("shared")
    alike = F.expr(f"{den} * least(n, na) >= {num} * greatest(n, na)")  # sizes too far apart cannot reach the similarity

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are linked, by both whole sets."""
        pairs = own.write(pairs, name)
        a = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
        b = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
        links = own.write(pairs.join(b, "b").join(a, "a").select("a", "b", "items_a", "items_b").mapInArrow(lean(_confirm(num, den)), "a long, b long"), f"{name}-links")
        own.drop(name)
        return links

    def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """labels (rep, comp) after joining the components that the links connect."""
        if links.isEmpty():
            return labels
        known = small_side(labels)
        of_a, of_b = known.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), known.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
        between = own.write(links.join(of_a, "a").join(of_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct(), f"{name}-between")
        inner = Scratch("near-components")
        roots = own.write(connected_components(between, inner).select(F.col("node").alias("comp"), "root"), f"{name}-roots")
        inner.close()
        out = own.write(labels.join(small_side(roots), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp")), name)
        own.drop(f"{name}-between", f"{name}-roots")
        return out

    def still_open(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame | None:
        """Of rows (key, rep, ...): those of buckets whose members are not in one component, with their component."""
        labelled = rows.join(small_side(labels), "rep")
        keys = own.write(labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key"), f"{name}-keys")
        return None if keys.isEmpty() else own.write(labelled.join(small_side(keys), "key"), name)

    def unsettled(now: DataFrame) -> DataFrame:
        """Pairs of different components in a star (a, b, comp) that may still be linked: an exact prefix filter on differences to the centre.

        With k = (1 - t) / (1 + t), x and y are linked if and only if |x ^ y| <= k (|x| + |y|), and |x ^ y| follows from what the
        differences to the centre c have in common: |x^c & y^c| = (|x^c| + |y^c| - |x^y|) / 2. As c has been compared with every
        member of another component, at most one of them is linked with c, so that must be at least 1, and more than (|x^c| + k (|c| - |x|)) / 2 for the linked one. So one common element is among
        the |x^c| - s + 1 rarest of either. Elements that one component alone has come first in the order and never match.
        """
        a = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
        b = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"), "n")
        schema = "a long, b long, comp long, n long, slots long, d long, g long"
        rows = own.write(now.join(b, "b").join(a, "a").select("a", "b", "comp", "n", "items_a", "items_b").mapInArrow(lean(_differences(num, den)), schema), "open-items")
        common = own.write(rows.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("df")).filter("x <> y").select("g", "df"), "open-common")
        of_spoke = Window.partitionBy("a", "b")
        rare = rows.join(small_side(common), "g").withColumns({"v": F.count(F.lit(1)).over(of_spoke), "at": F.row_number().over(of_spoke.orderBy("df", "g"))})
        prefix = own.write(rare.filter("at <= slots - (d - v)").select("g", F.col("b").alias("rep"), "comp", "n", "d", "v"), "open-prefix")
        own.drop("open-items", "open-common")
        other = prefix.select("g", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("v").alias("va"))
        enough = F.expr(f"{2 * (num + den)} * least(v, va) >= {num + den} * (d + da) - {den - num} * (n + na)")  # what both could share, against what a link needs
        return prefix.join(other, "g").filter((F.col("rep") < F.col("b")) & (F.col("comp") != F.col("cb")) & alike & enough).select(F.col("rep").alias("a"), "b").distinct()

    head = F.max(F.struct("degree", (-F.col("rep")).alias("a"), "n")).alias("h")
    heads = own.write(members.groupBy("key").agg(head).select("key", (-F.col("h.a")).alias("a"), F.col("h.n").alias("na")), "heads")
    first = members.join(small_side(heads, BROADCAST_ROWS // 2), "key").filter((F.col("a") != F.col("rep")) & alike).select("a", F.col("rep").alias("b")).distinct()
    labels = own.write(degrees.select("rep", F.col("rep").alias("comp")), "labels-0")
    labels = merged(labels, confirmed(first, "first"), "labels-1")
    own.drop("heads")
    # centres are chosen once: after the merge each split bucket keeps the one that its members have been compared with
    parts = still_open(members, labels, "parts")
    if parts is not None:
        # from the component with most members in the bucket: differences to such a centre are small
        most = parts.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("degree", F.col("rep").alias("a"), F.col("n").alias("na"))).alias("t"))
        centres = own.write(most.groupBy("key").agg(F.max(F.struct("c", "t", F.col("comp").alias("ca"))).alias("w")).select("key", "w.t.a", "w.t.na", "w.ca"), "centres")
        stars = own.write(parts.join(small_side(centres, BROADCAST_ROWS // 2), "key").select("key", "rep", "n", "comp", "a", "na", "ca"), "stars")
        own.drop("parts", "centres")
        second = stars.filter(F.expr("comp <> ca") & alike).select("a", F.col("rep").alias("b")).distinct()
        labels = merged(labels, confirmed(second, "second"), "labels-2")
        left = still_open(stars.select("key", "rep", "a"), labels, "left")
        if left is not None:
            labels = merged(labels, confirmed(unsettled(left.select("a", F.col("rep").alias("b"), "comp").distinct()), "third"), "labels-3")
    own.drop("sets", "members", "degrees", "stars", "left", "open-prefix")
    named = classes.join(small_side(labels), "rep", "left").select("set_a", "set_b", F.coalesce("comp", "rep").alias("comp"))
    rows = signed.select("doc_id", "row", "digest", "file", "at", "n", "set_a", "set_b").join(named, ["set_a", "set_b"], "left").select("doc_id", "digest", "file", "at", "n", F.when(F.col("n") > 0, F.col("comp")).otherwise(-1 - F.col("row")).alias("comp"))
    rows = own.write(rows, "rows")
    several = rows.filter("doc_id IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "digest", "file", "at")).alias("first"), F.count(F.lit(1)).alias("c"))
    # a row without an id takes part too: it is named after the smallest id of its component
    alone = rows.filter("doc_id IS NULL AND n > 0").select("comp").distinct().withColumn("other", F.lit(True))
    firsts = own.write(several.join(alone, "comp", "left").filter("c > 1 OR other").select("comp", "first"), "firsts")
    own.close("rows", "firsts")
    return rows, firsts


def keep_first(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = DROP_BYTES) -> DataFrame:
    """docs with one row of each component, the one of the smallest id; all columns of docs. Rows without an id stay.

    Rows are judged each by its own text, also where several share an id. Of several rows of the smallest id in one component one stays,
    of the smallest hash of its text, then the first. What is no plain scan of Parquet files is written to the shared folder first, as
    rows go by file and row number: texts are in no exchange, whatever goes."""
    own = Scratch("near")
    if place_of(docs) is None:
        docs = own.write(docs, "docs")
        own.leave("docs")
    file, at = place_of(docs)
    rows, firsts = _linked(docs, words, num, den, id_col, text_col, own, file, at)
    judged = rows.filter("doc_id IS NOT NULL AND n > 0").join(small_side(firsts, BROADCAST_ROWS // 4), "comp")
    gone = judged.filter(F.struct("doc_id", "digest", "file", "at") != F.col("first")).select("file", F.col("at").alias("row"))
    out = few_files(drop_rows(docs, gone, own, most))
    own.close()
    return out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"), words=3, num=85, den=100)


SQL = {
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""
}
QUERIES = {"op7_near_dedup": op7_near_dedup}
