"""Exact and near dedup, line dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast

from notespark.llm import common, decontaminate, exact_dedup, hashing, line_dedup, near_dedup

DOCS = "doc_id long, text string, row int"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", low(t)) if w]


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, z in sets[a + 1 :]:
            if s and z and den * len(s & z) >= num * len(s | z):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def variants(seed, groups=12, copies=14, size=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice((4, 20, size, 2 * size)))]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 4, 6))):
                k = r.randrange(len(t))
                if r.random() < 0.3 and len(t) > 2:
                    t.pop(k)
                else:
                    t[k] = r.choice(vocabulary)
            base = t if r.random() < 0.3 else base
            out.append(" ".join(x.upper() if r.random() < 0.1 else x for x in t))
    return out + ["", " \n ", None, "one", "ONE", "two words", "two words "]


@pytest.mark.parametrize("seed,n,num", [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_near_dedup_equals_brute_force(spark, seed, n, num):
    texts = variants(seed)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(df, n, num, 100).collect()}
    assert got == brute_links(rows, n, num, 100)
    kept = sorted(r.doc_id for r in near_dedup.keep_first(df, n, num, 100).collect())
    assert kept == sorted({root for _, root in got.values()})


def test_near_dedup_borderline_group(spark):
    """Many copies on either side of the threshold to one base: the stars leave most of them open."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(150):
        t = list(base)
        for i in r.sample(range(0, 120, 3), r.choice((1, 2, 3, 4, 5))):
            t[i] = f"x{k}y{i}" if r.random() < 0.8 else "same"
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.link(df, 3, 85, 100).collect()}
    assert got == brute_links(list(enumerate(texts)), 3, 85, 100)


def test_near_dedup_tied_small_groups(spark):
    """Small groups of short texts about the threshold, where many members of a bucket are equally connected."""
    r = random.Random(21)
    groups = []
    for k in range(2500):
        base = [f"g{k}w{i}" for i in range(r.randint(12, 40))]
        texts = []
        for j in range(r.randint(3, 7)):
            t = list(base)
            for i in r.sample(range(len(t)), r.choice((0, 1, 1, 2))):
                t[i] = f"g{k}x{r.randrange(3)}i{i}"
            cut = r.choice((0, 0, 1, 2, 3))
            texts.append(" ".join(t[cut:] if r.random() < 0.5 else t[: len(t) - cut]))
        groups.append([(100 * k + j, t) for j, t in enumerate(texts)])
    df = spark.createDataFrame([(i, t, 0) for g in groups for i, t in g], DOCS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.link(df, 3, 85, 100).collect()}
    want = {i: v for g in groups for i, v in brute_links(g, 3, 85, 100).items()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_near_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 3), (None, None, 4)], DOCS)
    out = near_dedup.link(df, 3, 85, 100).collect()
    assert len(out) == 4 and {r.component_id for r in out if r.n_shingles} == {5}
    assert near_dedup.link(df.limit(0)).count() == 0 and near_dedup.keep_first(df).columns == df.columns


def test_near_dedup_repeated_ids(spark):
    """One id with two texts, of which one is a near copy of a smaller id: the other text stays."""
    df = spark.createDataFrame([(1, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "p q r s t u", 3), (3, "p q r s t u", 4), (None, "a b c d e f", 5), (2, None, 6)], DOCS)
    assert sorted(r.row for r in near_dedup.keep_first(df).collect()) == [1, 3, 5, 6]
    assert near_dedup.link(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.root for r in near_dedup.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 105: 100}


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    x = hashing.mix(r.integers(0, 1 << 60, 1000).astype(np.uint64))
    a, b = np.sort(x[:900]), np.sort(x[100:])
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - 0.8) < 0.12
    assert (near_dedup.unpack(near_dedup.pack(a)) == np.sort(a & near_dedup._LOW48)).all()


@pytest.mark.parametrize("texts", [["a b", None, "", "  x\ty\nz ", "É é ß", "w " * 5000], ["q" * 700_000, "a", "b c"]])
def test_word_hashes(texts):
    h, at = hashing.word_hashes(pa.array(texts, pa.string()))
    seen = {}
    for t, i, j in zip(texts, at, at[1:]):
        ws = (t or "").encode().lower().split()
        assert len(ws) == j - i
        for w, x in zip(ws, h[i:j]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- exact


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {i: (max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("most", [exact_dedup.MAX_PLANE_BYTES, exact_dedup.SHARD_BYTES])
def test_exact_dedup(spark, most):
    r = random.Random(4)
    rows = [(i, r.choice(["A b", "a B", "É", "é", "", None, "x" * 10_000, f"u{i}", f"u{i // 2}"])) for i in range(3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS).repartition(5)
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.annotate(df, max_plane_bytes=most).collect()}
    want = brute_exact(rows)
    assert got == want
    assert sorted(x.doc_id for x in exact_dedup.keep_latest(df, max_plane_bytes=most).collect()) == sorted(i for i in want if want[i][2])


def test_exact_dedup_segments(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 2000)
    rows = [(i, f"t{i % 700}") for i in range(1000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS)
    assert exact_dedup.segments_for(len(rows), exact_dedup.SHARD_BYTES) > 1
    held, most, broadcast, destroy = set(), [], SparkContext.broadcast, Broadcast.destroy

    def sent(self, value):
        out = broadcast(self, value)
        held.add(id(out))
        most.append((len(held), value.nbytes))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", sent)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: held.discard(id(self)) or destroy(self, *a))
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.annotate(df, max_plane_bytes=exact_dedup.SHARD_BYTES).collect()}
    assert got == brute_exact(rows)
    assert len(most) > 1 and not held and max(most) == (1, exact_dedup.SHARD_BYTES)  # one plane at a time
    assert sorted(x.doc_id for x in exact_dedup.keep_latest(df, max_plane_bytes=exact_dedup.SHARD_BYTES).collect()) == sorted(i for i, v in got.items() if v[2])


def test_exact_dedup_ties(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "A", 2), (1, "b", 3), (None, "z", 4), (None, "Z", 5)], DOCS)
    assert sum(x.kept for x in exact_dedup.annotate(df).collect()) == 3
    assert exact_dedup.keep_latest(df).count() == 3 and exact_dedup.keep_latest(df).columns == df.columns
    assert exact_dedup.annotate(df.limit(0)).count() == 0 and exact_dedup.keep_latest(df.limit(0)).count() == 0


@pytest.mark.parametrize("files,most", [(7, 600), (1, 200)])
def test_dedup_moves_no_texts(spark, monkeypatch, files, most):
    """Several planes, several groups of files and one file of more rows that go than may be broadcast: no exchange holds a text."""
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 2000)
    monkeypatch.setattr(common, "CHUNK", 128)
    rows = [(i, f"t{i % 700} " + " ".join(f"w{i % 700}x{k}" for k in range(6)), 0) for i in range(1000)]
    path = common.new_path(spark, "t")
    spark.createDataFrame(rows, DOCS).repartition(files).write.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exact = exact_dedup.keep_latest(spark.read.parquet(path), max_plane_bytes=exact_dedup.SHARD_BYTES, most=most)
        near = near_dedup.keep_first(spark.read.parquet(path), most=most)
        for out, want in ((exact, range(300, 1000)), (near, range(700))):
            assert sorted(r.doc_id for r in out.collect()) == list(want)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Scan parquet") >= 4 and plan.count("BroadcastHashJoin") >= 2
            assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "MapInArrow" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_clashing_names(spark):
    names = ["__nd_id", "__nd_sha", "__nd_digest", "__nd_file", "__nd_row", "__nd_text", "__nd_i", "__nd_m", "__nd_md", "__nd_cut", "__nd_maybe", "comp", "key"]
    rows = [(1, "a\nb\nc d e f g"), (1, "a\nb\nc d e f g"), (2, "A\nb\nc d e f g"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for f, n in ((exact_dedup.keep_latest, 2), (near_dedup.keep_first, 3), (line_dedup.drop_repeated, 5)):
        out = f(df)
        assert out.columns == df.columns and out.count() == n, f
        assert {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}


def test_near_dedup_keeps_one_row_a_component(spark):
    same = "a b c d e f g h i j k l m n o p q r s t"
    df = spark.createDataFrame([(1, same, 1), (1, same, 2), (2, same.upper(), 3), (1, same + " u", 4), (7, "z y x w v", 5), (7, "z y x w v", 6)], DOCS)
    assert sorted((r.doc_id, r.text.split()[-1] in "tu") for r in near_dedup.keep_first(df).collect()) == [(1, True), (7, False)]


# --- decontamination


def grams(t, n=5):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_decontamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 60)
    r = random.Random(2)
    v = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice((2, 3, 4, 5, 6, 12, 30, 60))))) for i in range(20)] + [(90, None), (91, "")]
    docs = []
    for i in range(200):
        w = [r.choice(v) for _ in range(r.randint(0, 200))]
        if i % 2:
            t = r.choice(items)[1] or ""
            t = t.split()
            for _ in range(r.choice((0, 0, 1, 2))):
                if t:
                    t[r.randrange(len(t))] = "zz"
            w[10:10] = [x.upper() + "," for x in t]
        docs.append((i, " ".join(w), 0))
    docs += [(900, None, 0), (901, "", 0), (901, "", 0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.shared, x.item_shingles) for x in decontaminate.contaminated(d, b).collect()}
    want = {}
    for i, t, _ in docs:
        for j, u in items:
            n = min(5, len(re.findall(r"[0-9a-z]+", low(u))))
            g, q = grams(t, n), grams(u, n)
            if q and 10 * len(q & g) >= 8 * len(q):
                want[i, j] = (len(q & g), len(q))
    assert got == want and len(want) > 20
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, *_ in docs if i not in {k for k, _ in want})
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.drop_contaminated(d.limit(0), b).count() == 0


# --- lines


def brute_lines(rows):
    seen, cut = {}, defaultdict(set)
    for i, t in sorted(rows):
        ls = (t or "").split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if "".join(x.strip(" ") for x in w):
                if w in seen:
                    cut[i] |= {p, p + 1, p + 2}
                else:
                    seen[w] = (i, p)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in cut[i]) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice("abcd ") for _ in range(r.choice((0, 1, 2, 3, 8, 40))))) for i in range(60)] + [(99, None), (98, "x\ny\nz\n" * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS)
    got = {x.doc_id: x.text for x in line_dedup.drop_repeated(df).collect()}
    assert got == brute_lines(rows)
    assert line_dedup.drop_repeated(df).columns == df.columns and line_dedup.drop_repeated(df.limit(0)).count() == 0


def test_line_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 1)] * 2 + [(None, "a\nb\nc", 1), (2, "a\nb\nc\nd", 1)], DOCS)
    got = sorted((x.doc_id or 0, x.text) for x in line_dedup.drop_repeated(df).collect())
    assert got == [(0, "a\nb\nc"), (1, ""), (1, ""), (2, "d")]
