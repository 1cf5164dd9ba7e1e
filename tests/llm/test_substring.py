"""Substring dedup against brute force, and the covers its anchors rest on."""

import random
import re

import pytest

from notespark.llm import substring_dedup as sd

DOCS = "doc_id long, text string, cut int, `__nd_key` string"


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]


def brute(rows, n):
    """rows in order to the positions that go."""
    seen, out = set(), []
    for t in rows:
        ws, gone = words(t), set()
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if g in seen:
                gone |= set(range(i, i + n))
            seen.add(g)
        out.append(gone)
    return out


@pytest.mark.parametrize("v", sorted(sd.COVERS))
def test_covers(v):
    d = set(sd.COVERS[v])
    assert all(any((i + k) % v in d and (j + k) % v in d for k in range(v)) for i in range(v) for j in range(v))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["a", "A"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(n, 4 * n))] for _ in range(6)]
    texts = []
    for _ in range(80):
        t = []
        for _ in range(r.randint(0, 5)):
            x = r.random()
            if x < 0.4:
                p = r.choice(passages)
                a = r.randrange(len(p))
                t += p[a : a + r.randint(1, 3 * n)]
            elif x < 0.5:
                t += [r.choice("ab")] * r.randint(1, 3 * n)
            else:
                t += [r.choice(vocabulary) for _ in range(r.randint(1, 2 * n))]
        texts.append(r.choice((" ", "\n", "\t \x0b")).join(t))
    return texts + texts[:5] + ["", None, "  ", "one"]


@pytest.mark.parametrize("n", [1, 4, 9, 20, 33])
def test_equals_brute_force(spark, n):
    texts = corpus(n, n)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], DOCS).repartition(5)
    marked = {r.doc_id: r for r in sd.mark(df, n).collect()}
    want = brute(texts, n)
    assert [{k for s in marked[i].spans for k in range(s.start, s.stop)} for i in range(len(texts))] == want
    assert [marked[i].kept for i in range(len(texts))] == [" ".join(w for k, w in enumerate(words(t)) if k not in g) for t, g in zip(texts, want)]
    kept = sd.drop_repeated(df, n)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: marked[i].kept if want[i] else t for i, t in enumerate(texts)}


def test_rows_that_repeat_null_ids_and_empty_tables(spark):
    p, q = " ".join(f"p{k}" for k in range(25)), " ".join(f"q{k}" for k in range(30))
    rows = [(5, p, 1, "x"), (5, p, 2, "x"), (6, "start " + p, 3, "x"), (None, q, 4, None), (7, q + " end", 5, "x"), (8, p.upper(), 6, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.cut: r.text for r in sd.drop_repeated(df).collect()}
    assert got == {1: p, 2: p, 3: "start", 4: q, 5: "end", 6: p.upper()}
    assert sd.drop_repeated(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, p, 1, ""), (1, p + " x", 2, "")], DOCS)
    assert sorted(len(words(r.text)) for r in sd.drop_repeated(two).collect()) in ([1, 25], [0, 26])


def test_very_long_text(spark):
    r = random.Random(3)
    body = [f"t{r.randrange(10**6)}" for _ in range(150_000)]
    df = spark.createDataFrame([(1, " ".join(body), 0, ""), (2, " ".join(["x", *body[70_000:140_000], "y"]), 0, "")], DOCS)
    got = {r.doc_id: r for r in sd.mark(df).collect()}
    assert (got[1].n_words, got[1].spans, got[2].kept) == (150_000, [], "x y")


def test_no_window_of_unique_text_is_shuffled(spark, monkeypatch):
    """Only windows around repeated anchors are hashed in full."""
    r, sizes, write = random.Random(8), {}, sd.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(sd.Scratch, "write", counted)
    shared = [f"s{k}" for k in range(40)]
    texts = [" ".join([f"u{r.randrange(10**9)}" for _ in range(400)] + shared * (k < 2)) for k in range(20)]
    sd.repeated(spark.createDataFrame([(k, t, 0, "") for k, t in enumerate(texts)], DOCS))
    assert sizes["anchors"] < 0.34 * 20 * 440 and sizes["windows"] <= 2 * (40 + 2 * 13) and sizes["contexts"] <= 2 * 20
