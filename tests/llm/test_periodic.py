"""Periodic runs against brute force: random, periodic and planted texts, and the query over whole tables."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from notespark.llm import periodic


def brute_runs(ws, least, times):
    """Every maximal stretch of each period, without those whose stretch has a smaller period."""
    found = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_kept(ws, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(ws) if k not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcdefgh"), max_size=60), max_size=6), st.integers(2, 9), st.integers(2, 4))
def test_runs_equal_brute_force(texts, least, times):
    assert [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(texts, least, times)] == [brute_runs(x, least, times) for x in texts]


def test_runs_of_periodic_texts():
    r = random.Random(5)
    texts = []
    for _ in range(60):
        base = [r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 40))]
        text = [r.choice("xyz") for _ in range(r.randint(0, 30))] + base * r.randint(1, 9) + base[: r.randrange(len(base))]
        if r.random() < 0.5:
            text[r.randrange(len(text))] = "odd"
        texts.append(text + r.choice(([], text[-20:], base * 4)))
    texts += [["a"] * 500, ["a", "b"] * 300, list("abaababaabaab" * 40)]
    got = [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(texts)]
    assert got == [brute_runs(x, 24, 3) for x in texts]
    assert sum(map(bool, got)) > 30
    assert [periodic.kept(t, x) for t, x in zip(texts, periodic.runs_of(texts))] == [brute_kept(t, g) for t, g in zip(texts, got)]


def brute_row(doc_id, text):
    ws = words(text)
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(ws), h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(ws, 24, 3)
    best = min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]), default=None)
    out = (len(runs), *(best if best else (None,) * 3), best[1] * 1000 // best[2] if best else None)
    return (*out, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(brute_kept(ws, runs))))


def test_query_equals_brute_force_over_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r.doc_id: tuple(r[c] for c in columns) for r in periodic.op11_periodic_runs(spark, small).collect()}
    assert got == {r.doc_id: brute_row(r.doc_id, r.text) for r in docs}
    assert any(v[0] for v in got.values())


def test_nulls_long_texts_and_clashing_names(spark):
    long = " ".join(["x y z"] * 40_000 + [str(k) for k in range(3000)])
    rows = [(1, None, 5, "k"), (2, "", 6, "k"), (None, "a " * 30, 7, "k"), (4, long, 8, "k"), (4, long, 8, "k"), (5, "un\x0bo due " * 13, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__nd_text` int, runs string")
    got = periodic.collapse(docs)
    assert got.columns == docs.columns
    out = sorted(((r.doc_id or 0, r.text, r["__nd_text"], r.runs) for r in got.collect()), key=str)
    short = " ".join(["x y z"] + [str(k) for k in range(3000)])
    assert out == sorted([(1, None, 5, "k"), (2, "", 6, "k"), (0, "a", 7, "k"), (4, short, 8, "k"), (4, short, 8, "k"), (5, "un o due", 9, None)], key=str)
    assert periodic.collapse(docs.limit(0)).count() == 0
