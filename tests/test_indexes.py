"""Block-max BM25 and the cell index: the same rows as scoring everything, and how much of the index is read."""

import random

import pytest
from pyspark.sql import functions as F

from notespark.functions import text as T
from notespark.operators import blockmax, cells, search
from notespark.session import kept


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(f"n{k:05d}", " ".join(r.choices([f"t{j}" for j in range(400)], weights, k=r.choice((3, 8, 20, 80))))) for k in range(3000)]
    rows += [("same1", "t0 t1 t399"), ("same2", "t0 t1 t399"), ("blank", ""), ("null", None)]
    return spark.createDataFrame(rows, "id string, content string")


@pytest.fixture(scope="module")
def index(corpus):
    posted = kept(search.postings(corpus))
    return posted, kept(blockmax.build(posted)), search.corpus_stats(corpus)


QUERIES = ["t0", "t0 t1 t2", "t399", "t0 t250 t399", "t1 t5 t9 t30 t100 t301 t302", "unknown", "t0 unknown t7", " ".join(f"t{k}" for k in range(60))]


def plain(posted, stats, query, k, allowed=None):
    found = search.python_terms(query)
    rows = search.bm25(posted, stats, found) if found else None
    rows = rows.join(allowed, "id") if allowed is not None else rows
    return [(r.id, r.s) for r in rows.select("id", F.round("bm25", 9).alias("s")).orderBy("s", "id").limit(k).collect()]


@pytest.mark.parametrize("k", [1, 10])
def test_block_max_equals_scoring_all(spark, corpus, index, k):
    posted, blocks, stats = index
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string").select("query", T.query_terms(F.col("text")).alias("terms"))
    got = blockmax.top_k(blocks, stats, asked, k).orderBy("query", "rank").collect()
    for q, text in enumerate(QUERIES):
        assert [(r.id, round(r.bm25, 6)) for r in got if r.query == q] == [(i, round(s, 6)) for i, s in plain(posted, stats, text, k)], text


def test_block_max_under_a_filter_and_through_search(corpus, index):
    posted, blocks, stats = index
    some = corpus.filter("id LIKE '%7'")
    got = search.keyword_top(some, posted, stats, "t0 t3 t200", 10, blocks=blocks).orderBy("bm25", "id").collect()
    assert [(r.id, round(r.bm25, 6)) for r in got] == [(i, round(s, 6)) for i, s in plain(posted, stats, "t0 t3 t200", 10, some.select("id"))]
    few = search.keyword_top(corpus.filter("id IN ('same1', 'n00003')"), posted, stats, "t399 t0", 10, blocks=blocks)
    assert {r.id for r in few.collect()} >= {"same1"}
    assert search.keyword_top(corpus, posted, stats, "and or", 10, blocks=blocks).count() == 0


def test_block_max_leaves_most_postings_of_common_terms_unread(spark, index):
    posted, blocks, stats = index
    asked = spark.createDataFrame([(0, ["t0", "t390"]), (1, ["t0", "t1", "t395", "t398"])], "query int, terms array<string>")
    shares = {r.query: r.read / r.postings for r in blockmax.Run(blocks, stats, asked, 10).read.collect()}
    assert max(shares.values()) < 0.5


def test_block_index_of_nothing(spark, index):
    empty = blockmax.build(index[0].limit(0))
    assert empty.count() == 0
    asked = spark.createDataFrame([(0, ["t0"])], "query int, terms array<string>")
    assert blockmax.top_k(kept(empty), index[2], asked, 5).count() == 0


def vectors(spark, n=1500, dim=8):
    r = random.Random(3)
    middles = [[r.gauss(0, 5) for _ in range(dim)] for _ in range(12)]
    rows = [(k, [x + r.gauss(0, 0.4) for x in r.choice(middles)]) for k in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_cells_equal_a_full_scan(spark, tmp_path):
    v = vectors(spark)
    index = cells.CellIndex.build(v, f"file://{tmp_path}/c", sample=300)
    there = v.filter("embedding IS NOT NULL")
    assert index.table.count() == there.count()
    queries = [list(r.embedding) for r in there.filter("id % 300 = 0").collect()] + [[0.0] * 8, [100.0] * 8]
    for allowed in (None, there.filter("id % 97 = 1"), there.filter("id = 5"), there.limit(0)):
        some = there if allowed is None else there.join(allowed.select("id"), "id", "left_semi")
        for q in queries[::3] if allowed is not None else queries:
            got = [(r.id, round(r.distance, 9)) for r in index.nearest(q, 7, allowed).collect()]
            assert got == [(r.id, round(r.distance, 9)) for r in search.nearest(some, q, 7).collect()]


def test_cells_leave_most_vectors_unread(spark, tmp_path):
    v = vectors(spark)
    index = cells.CellIndex.build(v, f"file://{tmp_path}/c")
    q = list(v.filter("id = 700").first().embedding)
    assert index.candidates(q, 5).count() < 0.3 * v.count()
    again = cells.CellIndex.read(spark, f"file://{tmp_path}/c")
    assert again.nearest(q, 5).collect() == index.nearest(q, 5).collect()
    with pytest.raises(ValueError):
        index.nearest([0.0], 5)


def test_cells_of_nothing(spark, tmp_path):
    v = vectors(spark).filter("embedding IS NULL")
    assert cells.CellIndex.build(v, f"file://{tmp_path}/c").nearest([0.0] * 8, 5).count() == 0


def test_engine_answers_the_same_with_and_without_indexes(spark, tmp_path):
    from notespark.engine import Engine

    r = random.Random(5)
    word = lambda: r.choice(["deal", "acme", "budget", "trip", "river", "mountain", "paper", "tree"])
    notes = [(f"{'a' if k % 2 else 'b'}/{k}.md", f"# {word()} {k}\n\n{word()} {word()}\n\n## {word()}\n\n- {word()} {word()}\n- {word()}\n") for k in range(25)]
    files = spark.createDataFrame(notes, "path string, content string").withColumn("hash", F.sha2("content", 256))
    e = Engine(spark, f"file://{tmp_path}/s")
    e.index(files)
    asked = [search.SearchRequest("acme deal", k=5), search.SearchRequest("river", k=3, path_globs=["a/**"], coarse_k=4), search.SearchRequest("paper tree", hybrid=False)]
    answer = lambda: [[tuple(x) for x in e.search(q).orderBy("rank").collect()] for q in asked]
    before = answer()
    version = e.optimize()
    assert e.corpus().blocks is not None and set(e.corpus().cells) == {"content", "summary"} and answer() == before
    assert e.optimize() == version
    e.index(files.limit(1).withColumn("content", F.lit("# new river")).withColumn("hash", F.lit("x")))
    assert e.corpus().blocks is None and e.corpus().cells == {}
