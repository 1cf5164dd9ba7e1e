"""Closures over parent links alone, of any depth, and date phrases for a table of prompts."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from notespark.functions import dates as D
from notespark.operators import tree
from notespark.plans import chat


def test_long_chain(spark):
    n = 10_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in order], "id long, parent_id long")
    got = tree.depths(nodes)
    assert got.filter("depth <> id").isEmpty() and got.count() == n
    assert tree.closure(nodes, spark.createDataFrame([(7000,)], "id long")).agg(F.min("id"), F.count("id")).first()[:] == (7000, 3000)


def test_random_forest_equals_brute_force(spark):
    r = random.Random(2)
    up = {k: r.choice([None, -1, *range(max(0, k - 4), k)]) for k in range(300)}  # -1 is not there
    nodes = spark.createDataFrame(list(up.items()), "id long, parent_id long")

    def line(k):
        out = []
        while up[k] in up:
            k = up[k]
            out.insert(0, k)
        return out

    want = {k: line(k) for k in up}
    assert {x.id: x.ancestor_ids for x in tree.with_ancestors(nodes).collect()} == want
    assert {x.id: x.depth for x in tree.depths(nodes).collect()} == {k: len(v) for k, v in want.items()}
    roots = {5, 40, 41, 200}
    inside = {k for k, v in want.items() if roots & {k, *v}}
    asked = spark.createDataFrame([(k,) for k in roots], "id long")
    assert {x.id for x in tree.closure(nodes, asked).collect()} == inside
    lined = tree.with_ancestors(nodes)
    assert {x.id for x in tree.descendants(lined, asked).collect()} == inside
    tree_limit, tree.MOST_ROOTS = tree.MOST_ROOTS, 2
    try:
        assert {x.id for x in tree.descendants(lined, asked).collect()} == inside and tree.descendants(lined, asked.limit(0)).count() == 0
    finally:
        tree.MOST_ROOTS = tree_limit


def test_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "e"), ("d", "c"), ("e", "d"), ("f", "e")], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        tree.depths(nodes)
    with pytest.raises(ValueError, match="cycle"):
        tree.with_ancestors(nodes)


def test_prompts_of_a_table(spark):
    today = date(2026, 3, 3)
    prompts = ["what did I do last 99999999999 weeks", "notes from 3 March onwards", "on 2026-02-30", "March 5", "since March 5", "", None, "last:7d plans #x", "LAST:3d last:12D", "last:99999999999999999999d", "since:2026-01-01 last:2d", "between 1 Jan and Feb 3rd, 2025"]
    df = spark.createDataFrame([(k, p, today) for k, p in enumerate(prompts)], "k int, p string, today date")
    f = chat.chat_filters(F.col("p"), F.col("today"))
    rows = df.select("k", "p", D.prompt_range(F.col("p"), F.col("today")).alias("r"), f["start"].alias("start"), f["text"].alias("text")).collect()
    for r in rows:
        want = D.resolve_range(r.p, today) if r.p else None
        assert (r.r.start, r.r.end, r.r.phrase) == ((want["start"], want["end"], want["phrase"]) if want else (None, None, None)), r.p
        if r.p:
            one = chat.parse_input(r.p, today)
            assert (r.start, r.text) == (one.get("start"), one["text"]), r.p
