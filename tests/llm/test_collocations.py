"""Collocations against brute force; each phrase is counted by one pivot and without a further exchange."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from notespark.llm import collocations as co

DOCS = "doc_id long, text string, lang string, n long, phrase string"


def pieces(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\f\r]", low)]


def brute(rows, least, most, top, shadow):
    f = Counter()
    for t, lang in rows:
        for ws in pieces(t):
            for m in range(1, most + 1):
                f.update((lang or "und", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                if shadow[1] * a >= shadow[0] * f[lang, ws[i : i + m]]:
                    hidden.add((lang, ws[i : i + m]))
    out = {}
    for (lang, ws), a in candidates.items():
        if (lang, ws) in hidden:
            continue
        score, k = min((10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    total = Counter()
    for (lang, ws), a in f.items():
        total[lang] += a if len(ws) == 1 else 0
    return {(lang, i + 1): (p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def corpus(seed):
    r = random.Random(seed)
    common, rare = [f"c{k}" for k in range(5)], [f"R{k}é" for k in range(120)]
    rows = []
    for _ in range(150):
        t = ""
        for _ in range(r.randint(0, 60)):
            x = r.random()
            t += r.choice(common) if x < 0.5 else r.choice(rare) if x < 0.8 else r.choice(("New York City", "a a a a", "\x00 z w", "of the")) if x < 0.95 else "x"
            t += r.choice((" ", "  ", "\t", " ", ", ", ".", "\n", "\r\n"))
        rows.append((t, r.choice(("en", "de", None))))
    return rows + rows[:10] + [(None, "en"), ("", None), ("lone", "xx"), (" ".join(["Ha"] * 4000), "xx")]


@pytest.mark.parametrize("seed,most,group,top", [(1, 3, 100_000, 2000), (2, 3, 20, 2000), (3, 2, 50, 7), (4, 4, 30, 40)])
def test_equals_brute_force(spark, seed, most, group, top):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, lang, 7, "p") for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(df, 10, most, top, group=group).collect()}
    want = brute(rows, 10, most, top, (50, 100))
    assert got == want and len(got) > 10


def test_empty_table_has_no_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert co.collocations(df).collect() == []


def test_words_of_equal_count_and_hash_are_ordered_by_themselves():
    words = [b"b", b"a", b"c", b"d"]
    r = co.ranks(words, np.array([5, 5, 9, 0]), np.array([1, 1, 0, 3]))
    assert r[1] < r[0] < r[2] and r[3] == -1


def test_each_phrase_is_in_one_fragment_of_its_rarest_word():
    r = random.Random(4)
    for _ in range(200):
        rank = np.array([r.choice((-1, 0, 1, 2, 3)) for _ in range(r.randint(1, 30))])
        left, right = co.around(rank, 3)
        got = Counter((s, e) for i in range(len(rank)) for s in range(i - left[i], i + 1) for e in range(i, i + right[i] + 1) if 1 <= e - s <= 2)
        want = {(s, s + m) for m in (1, 2) for s in range(len(rank) - m) if min(rank[s : s + m + 1]) >= 0}
        assert set(got) == want and set(got.values()) <= {1}


def test_sums_beyond_64_bits_are_exact(spark):
    a, l, r = 999_999_999_999_937, 10**15 - 1, 10**15 - 11
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    wide = {c: co.F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = co.F.call_function("div", co.F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"], wide["l"] * wide["r"])
    assert row.select(score).first()[0] == 10**6 * a * a // (l * r)


def test_mining_needs_no_exchange_of_its_own(spark):
    routed = spark.createDataFrame([(1, "en", "a b", 0, 3)], co._FRAGMENTS).repartition("h")
    plan = co.mined(routed, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h" in plan and "hashpartitioning(h#" in plan and plan.count("Exchange hashpartitioning") == 2  # by h, then by phrase
