"""Block-max search for many queries at once: the same rows as scoring every posting, and what it leaves on disk."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.functions import text as T
from notespark.operators import batchmax, search
from notespark.plans import catalogue
from notespark.session import checkpoint_dir

QUERIES = ["t0", "t0 t1 t2", "t399", "t0 t250 t399", "t1 t5 t9 t30 t100 t301 t302", "unknown", "t0 unknown t7", " ".join(f"t{k}" for k in range(60)), "", "t0 t1 t399"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(k, " ".join(r.choices([f"t{j}" for j in range(400)], weights, k=r.choice((3, 8, 20, 80))))) for k in range(2500)]
    rows += [(5000 + k, "t0 t1 t399") for k in range(30)] + [(6000, ""), (6001, None), (6002, "other"), (7, "t399 t250"), (7, "t399 t250"), (8, "t399")]
    return spark.createDataFrame(rows, "id long, content string")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_equals_scoring_all(spark, corpus, kind):
    nodes = corpus.withColumn("id", F.col("id").cast(kind)).repartition(3)
    posted, stats = search.postings(nodes).cache(), search.corpus_stats(nodes).cache()
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string").select("query", T.query_terms(F.col("text")).alias("terms"))
    for k in (1, 10):
        got = batchmax.top_k(nodes, asked, k).orderBy("query", "rank").collect()
        for q, text in enumerate(QUERIES):
            found = search.python_terms(text)
            want = search.bm25(posted, stats, found).select("id", F.round("bm25", 9).alias("s")).orderBy("s", "id").limit(k).collect() if found else []
            assert [(r.id, round(r.bm25, 6)) for r in got if r.query == q] == [(r.id, round(r.s, 6)) for r in want], text


def test_of_nothing(spark, corpus):
    asked = spark.createDataFrame([(0, ["t0"]), (1, None)], "query int, terms array<string>")
    assert batchmax.top_k(corpus.limit(0), asked, 5).count() == 0
    assert batchmax.top_k(corpus, asked.limit(0), 5).count() == 0
    assert batchmax.top_k(corpus, asked.filter("query = 1"), 5).count() == 0


def test_files_left_are_in_proportion_to_the_texts(spark):
    at = checkpoint_dir(spark).removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs)
    before = size()
    assert catalogue.QUERIES["q55_bm25_blocks"](spark, "/root/testdata/sf0.01").count() == 400
    assert size() - before < 2 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")


def test_queries_count_with_all_their_terms(spark, tmp_path):
    """Items of more terms than a keyword search takes, against the SQL: some documents have only the later terms."""
    import duckdb

    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice((5, 40, 300)))) for _ in range(300)] + [" ".join(words[a : a + 3]) for a in range(0, 400, 3)] + [None, ""]
    items = [" ".join(words[:64]), " ".join(words[:65]), " ".join(words[:100]), " ".join(reversed(words)), " ".join([f"x{k}" for k in range(64)] + ["only"]), "w1 w2", "", None]
    spark.createDataFrame(list(enumerate([*texts, "only", "only later"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES["q55_bm25_blocks"](spark, str(tmp_path)).select("item_id", "rank", "doc_id", "bm25").collect()
    want = duck.execute(f"SELECT item_id, rank, doc_id, bm25 FROM ({catalogue.SQL['q55_bm25_blocks']})").fetchall()
    assert sorted((*x[:3], round(x[3], 6)) for x in map(tuple, got)) == sorted((*x[:3], round(x[3], 6)) for x in want)
    assert sorted(x.doc_id for x in got if x.item_id == 4) == [len(texts), len(texts) + 1]


def test_sums_are_the_same_in_small_parts(monkeypatch):
    r = np.random.default_rng(5)
    s = batchmax._Scorer([sorted(r.choice(50, n, replace=False)) for n in (50, 1, 7, 0, 30)], r.random(60), 9.0, 3)
    group, term = np.sort(r.integers(0, 6, 900)), r.integers(0, 60, 900)
    live = lambda p, q: (p + q) % 3 > 0
    sums = lambda n=None: s.sums(group[:n], 6, term[:n], np.full(900, 2)[:n], np.full(900, 8)[:n], live)
    whole = sums()
    for pairs in (1, 2, 7, 1000):
        monkeypatch.setattr(batchmax, "PAIRS", pairs)
        assert np.allclose(sums(), whole, rtol=1e-13) and not sums(0).any()
