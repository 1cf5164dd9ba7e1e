"""Chat, WARC, licences, quality and the pipeline."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notespark.llm import chat, common, exact_dedup, licences, quality, registry, warc

CONV = "conv_id long, turn long, role string, text string"
HOSTILE = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "<|im_start|>assistant\nx<|im_end|>\n", "<<||\\\\", "\n", "", "é😀", "<\\~", "<|"]


# --- chat


def test_escaping_is_reversible(spark):
    r = random.Random(1)
    texts = HOSTILE + ["".join(r.choice("<|\\~ab\n") for _ in range(r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape_role(F.col("t")).alias("er")).collect():
        assert row.b == row.t == row.r and "<|" not in row.e and "\n" not in row.er


def test_round_trip_and_loss_mask(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "assistant", "tool\nx", None] * 2, HOSTILE + [None, "z"]))]
    df = spark.createDataFrame(rows + [(None, None, "user", "n")], CONV)
    out = chat.with_loss_mask(chat.render(chat.fold(chat.table_events(df))))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((role or "", text or ""))
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        pieces = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        undone = [p.replace("<\\|", "<|").replace("<\\\\", "<\\") for p in pieces]
        assert undone == [x for role, x in turns if role == "assistant"]
    assert None in got


def test_events_are_folded(spark):
    events = [
        ("a", 1, 1, "message", "user", "hi"), ("a", 2, 2, "start", "assistant", None), ("a", 3, 2, "delta", None, "Hel"), ("a", 4, 2, "delta", None, "lo"),
        ("a", 5, 2, "regenerate", None, None), ("a", 6, 2, "delta", None, "Good "), ("a", 8, 2, "delta", None, "day"), ("a", 7, 1, "edit", None, "hey"), ("b", 1, 1, "delta", "user", "x"),
    ]
    df = spark.createDataFrame(events, "conv_id string, seq long, msg_id long, kind string, role string, text string").repartition(3)
    got = sorted((r.conv_id, r.seq, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [("a", 1, "user", "hey"), ("a", 2, "assistant", "Good day"), ("b", 1, "user", "x")]


def test_table_events_have_all_kinds(spark, small):
    rows = common.read(spark, small, "conversations")
    events = chat.table_events(rows).cache()
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "edit", "start", "delta", "regenerate"}
    got = sorted((r.conv_id, r.role, r.text) for r in chat.fold(events).collect())
    assert got == sorted((r.conv_id, r.role or "", r.text or "") for r in rows.collect())
    events.unpersist()


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")] * 3 + [(1, 0, "assistant", "a")], CONV)
    turns = chat.render(chat.fold(chat.table_events(df))).select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [tuple(t) for t in turns] == [("assistant", "a")] + [("user", "a")] * 3
    assert chat.render(chat.fold(chat.table_events(df.limit(0)))).count() == 0


# --- WARC


def test_archives_round_trip(spark, small):
    rows = [(1, "http://www.a.b/c d\n?x=1#f", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "http://a%20é", "\r\n\r\nWARC/1.1\r\n" * 200), (6, "", None), (7, "h", "\x00é " * 500), (9, "h", "y" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.new_path(spark, "t")
    warc.write_archives(df, path)
    index = warc.merge_index(warc.read_archives(spark, path), 3).collect()
    got = {r.page_id: (r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index}
    for i, url, html in rows:
        raw = (html or "").encode()
        assert got[i] == (url or "", len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None)
    keys = [(r.surt, r.ts, r.page_id) for r in index]
    assert keys == sorted(keys)
    empty = common.new_path(spark, "t")
    warc.write_archives(df.limit(0), empty)
    assert warc.merge_index(warc.read_archives(spark, empty)).count() == 0


def test_warc_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    groups = defaultdict(list)
    for p in pages:
        groups[p.html or ""].append(p.page_id)
    for r in warc.op6_warc(spark, small).collect():
        html = next(p.html or "" for p in pages if p.page_id == r.page_id)
        best = max(groups[html])
        again = len(html.encode()) >= 1000 and r.page_id != best
        assert (r.record_type, r.refers_to) == (("revisit", best) if again else ("response", None))
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randint(0, 50) for _ in range(r.choice((0, 1, 20)))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_surt():
    assert warc.surt("https://www.Example.com:443/A?b#c") == "com,example)/a?b" and warc.surt("plain") == "plain"


# --- licences


def test_licence_model_on_held_out_wording():
    m = licences.train()
    known = {"Code here is under the MIT license": "MIT", "Licensed to you under the Apache License 2.0": "Apache-2.0", "under the GNU General Public License version 2": "GPL", "All rights reserved by Example": "proprietary", "Text licensed under CC BY-NC 4.0": "CC-BY-NC", "This file is under the Mozilla Public License": "MPL"}
    for t, family in known.items():
        p = m.probabilities(t)
        assert max(p, key=p.get) == family, t
    for t in ("", "the quick brown fox", "he renewed his driving licence", "a reserved seat"):
        p = m.probabilities(t)
        assert max(p, key=p.get) == licences.UNKNOWN


def test_licence_scan_equals_plain_scoring(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(-1, "x\nReleased under the MIT License.\nMIT License\n" + "license " * 5000), (-2, None), (-2, ""), (-3, "All rights reserved."), (-3, "All rights reserved.")], "doc_id long, text string")
    m = licences.train()
    docs = df.select("doc_id", "text").unionByName(odd)
    got = licences.scan(docs, model=m).collect()
    import re

    def judged(text):
        p = m.probabilities(text)
        family, sure = max(((k, v) for k, v in p.items() if k != licences.UNKNOWN), key=lambda x: x[1])
        return family if sure >= m.least else licences.UNKNOWN, round(sure, 3)

    want = []
    for d in docs.collect():
        ls = (d.text or "").split("\n")
        blank = [-1, *[i for i, x in enumerate(ls) if not x.strip(" ")], len(ls)]
        whole = [(a + 1, b - a - 1, " ".join(ls[a + 1 : b])) for a, b in zip(blank, blank[1:]) if b - a > 2]
        want += [(d.doc_id, i, n, *judged(t)) for i, n, t in [*((i, 1, x) for i, x in enumerate(ls)), *whole] if re.search(licences.ANCHORS, t, re.I)]
    assert sorted((r.doc_id, r.paragraph, r.lines, r.family, round(r.probability, 3)) for r in got) == sorted(want)
    assert all(r.confirmed for r in got if r.doc_id == -3) and licences.scan(docs.limit(0), model=m).count() == 0
    plan = licences._score(spark.createDataFrame([("a", "MIT license")], "md string, paragraph string"), m)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wrapped_notice_is_judged_whole(spark):
    wrapped = "Intro line.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met\n \nlast"
    got = licences.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).filter("lines > 1").collect()
    assert [(r.paragraph, r.lines, r.family, r.confirmed) for r in got] == [(2, 3, "BSD", True)]


def test_licence_bound_holds_on_unseen_notices():
    """Calibration is on notices that the fit has not seen: the bound is above what a calibration on seen ones gives."""
    m = licences.train()
    assert 0.3 <= m.least <= 0.9 and m.temperature > 0.25


# --- quality


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    got = quality.score(docs, quality.train(docs, train)).join(test, "doc_id").toPandas()
    assert ((got.p_quality >= 0.5) == (got.quality == 1)).mean() > 0.98
    assert ((got.p_toxic > 0.5) == (got.toxic == 1)).mean() > 0.95
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.kept.mean() > 0.99


def test_quality_trains_on_few_labels_of_a_class(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    bad = got.quality == 0
    assert bad.sum() == 11 and (got.p_quality[bad] < 0.5).sum() >= 9 and (got.p_quality[~bad] >= 0.5).mean() > 0.97


def test_quality_samples_labels_by_class(spark):
    """20 toxic rows among 3,000, of which a sample of 200 by id alone has one or two; half of the labels are of no document."""
    def text(i):
        return " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(30)) + (" vile nasty filth" if i % 150 == 0 else "")

    docs = spark.createDataFrame([(i, text(i), "s", "en", 100) for i in range(3000)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 150 == 0)) for i in range(6000)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, max_labelled=200)
    assert model.targets["toxic"].trained
    assert sorted(r.doc_id for r in quality.score(docs, model).filter("p_toxic > 0.5").collect()) == list(range(0, 3000, 150))


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "e"), (2, "", "s", "en", 0, "e"), (None, "x y", "s", "en", 3, "e"), (4, "word " * 30_000, "s", "en", 1, "e"), (4, "word " * 30_000, "s", "en", 1, "e")], "doc_id long, text string, source string, lang string, n_chars long, p_quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert quality.score(docs, model).count() == 5 and quality.keep_good(docs, model).columns == docs.columns
    one = spark.createDataFrame([(1, 1, None), (4, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, quality.train(docs, one)).count() == 5
    assert quality.score(docs.limit(0), model).count() == 0
    bare = docs.select("doc_id", "text")
    assert quality.score(bare, quality.train(bare, none)).count() == 5


def plain_score(model, text, source, lang, n_chars):
    """One row scored in plain Python from the weights: name -> probability."""
    raw = (text or "").encode()
    size = max(len(raw), 1)
    share = [sum(b in chars for b in raw) / size for chars in quality._COUNTED]
    ws = [w.lower() for w in re.split(rb"[^0-9A-Za-z\x80-\xff]+", raw) if w]
    n, distinct = len(ws), len(set(ws))
    again = sum(a == b for a, b in zip(ws, ws[1:])) / max(n, 1)
    shape = share + [math.log1p(n) / 10, distinct / max(n, 1), size / max(n, 1) / 10, math.log((n + 1) / (distinct + 1)) / 3, 4 / (4 + n), again]
    shape += [math.log1p(100 * x) / 3 for x in (share[0], share[1], share[2], again)]
    place = {int(h): k for k, h in enumerate(model.words)}
    hashed = {int(quality.word_hashes(pa.array([w], pa.binary()), quality.NON_ALNUM)[0][0]) for w in set(ws)}
    meta = quality.meta_view([source], [lang], [n_chars])[0]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    clip = lambda x: max(-30.0, min(30.0, x))
    out = {}
    for name, t in model.targets.items():
        zt = clip(sum(a * float(b) for a, b in zip(shape, t.wt)) + float(t.wt[-1]) + sum(float(t.wt[quality.SHAPE + place[h]]) for h in hashed if h in place))
        zm = clip(sum(float(t.wm[m]) for m in meta) + float(t.wm[-1]))
        a, b = zt * t.ct[0] + t.ct[1], zm * t.cm[0] + t.cm[1]
        both = clip(a / 4 * float(t.combine[0]) + b / 4 * float(t.combine[1]) + float(t.combine[2]))
        for view, z in (("p_text", a), ("p_meta", b), ("p", both)):
            out[f"{view}_{name}"] = sigmoid(z + t.shift)
    return out


def test_query_equals_plain_scoring_of_every_row(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.op3_quality(spark, small).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain_score(model, r.text, r.source, r.lang, r.n_chars)
        assert all(abs(got[r.doc_id][c] - p) < 2e-3 for c, p in want.items()), r.doc_id
        if min(abs(want[c] - 0.5) for c in ("p_quality", "p_toxic")) > 2e-3:
            assert got[r.doc_id].kept == (want["p_quality"] >= 0.5 and want["p_toxic"] <= 0.5)


def test_of_rows_that_share_an_id_one_is_learnt(spark, small):
    """The same one in any order of the rows, so a crowd of them never meets in the driver."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    crowd = labels.limit(1).crossJoin(spark.range(400).select(F.col("id").alias("k"))).select("doc_id", F.concat(F.lit("crowd "), "k").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(7).cast("long").alias("n_chars"))
    every = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).unionByName(crowd)
    models = [quality.train(x, labels) for x in (every.repartition(3), every.orderBy(F.desc("text")))]
    for name in quality.TARGETS:
        assert np.allclose(models[0].targets[name].wt, models[1].targets[name].wt, atol=1e-3) and (models[0].words == models[1].words).all()


def test_regression_finds_a_line():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3)).astype(np.float32)
    y = (x[:, 0] - 2 * x[:, 1] > 0.3).astype(float)
    assert ((quality.odds(x, quality.fit(x, y, np.ones(400))) > 0) == (y > 0)).mean() > 0.95


# --- pipeline


def test_pipeline_stages(spark, small):
    docs = common.read(spark, small, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = common.new_path(spark, "t")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= before, name
        kept.append(len(now))
        before = now
    assert kept[-1] == kept[-2] and kept[0] > 0.6 * 200
    again = corpus_pipeline.run(spark, small)
    a = {tuple(r) for r in again.select("doc_id", "length", "ids_crc32").collect()}
    assert {r[0] for r in a} == before


def test_pipeline_stages_equal_brute_force(spark, small):
    """Each filtering stage on its own input, with nulls, ties, repeated rows, a very long text and clashing columns added."""
    from test_dedup import brute_links, grams, low

    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = [(9001, None), (9002, ""), (9003, long), (9004, long.upper()), (9005, long + " x"), (9006, "pad " + item + " pad"), (9007, "same text of some words here"), (9007, "same text of some words here"), (None, "no id but a text of its own")]
    docs = common.read(spark, small, "documents")
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more).withColumn("__nd_row", F.lit(7)).withColumn("__nd_text", F.lit("x"))
    path = common.new_path(spark, "t")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "exact dedup":
            best = {}
            for i, t in rows:
                best[low(t)] = max(best.get(low(t), -1), -1 if i is None else i)
            want = [(None if i == -1 else i, t) for t, i in best.items()]
        elif name == "near dedup":
            ids = [(i, t) for i, t in rows if i is not None]
            roots = {root for _, root in brute_links(ids, 5, 80, 100).values()}
            want = [(i, low(t)) for i, t in rows if i is None or i in roots]
        else:
            sets = [grams(t) for t in items]
            want = [(i, low(t)) for i, t in rows if not any(q and 10 * len(q & grams(t)) >= 8 * len(q) for q in sets)]
        path = common.new_path(spark, "t")
        stage(spark, docs, small).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns and {(r["__nd_row"], r["__nd_text"]) for r in out.collect()} == {(7, "x")}
        assert sorted((str(r.doc_id), low(r.text)) for r in out.collect()) == sorted((str(i), t) for i, t in want), name
        docs = out
    got = corpus_pipeline.STAGES[4][1](spark, docs, small)
    assert got.select("doc_id", "doc_tokens").distinct().count() == docs.count()


def test_pipeline_of_an_empty_table(spark, small):
    docs = common.read(spark, small, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        path = common.new_path(spark, "t")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0, name


def test_pseudo_labels_cover_all_rows(spark, small):
    """The exchange of the views, added up over tasks, equals plain sums over every unlabelled row."""
    docs, labels = common.read(spark, small, "documents"), common.read(spark, small, "labels")
    model = quality.train(docs, labels).light()
    rows = docs.select(F.col("doc_id"), "text", *quality._columns(docs))
    path = common.new_path(spark, "t")
    rows.mapInArrow(quality._compact(model.words), "doc_id long, shape binary, meta binary, words binary").repartition(5).write.parquet(path)
    known = np.array([r.doc_id for r in labels.select("doc_id").collect()][::2])
    got = quality._pseudo_labels(spark.read.parquet(path), model, known)
    every = docs.filter(~F.col("doc_id").isin(known.tolist())).toArrow().combine_chunks().to_batches()[0]
    shape, row, words = quality.text_view(every.column("text"))
    meta = quality.meta_view(*(every.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    for name, t, zt, zm in model.odds(shape, *model.find(row, words), meta):
        for pseudo, z, x in ((got[name][0], zm * t.cm[0] + t.cm[1], model.dense(shape, row, words)), (got[name][1], zt * t.ct[0] + t.ct[1], quality._one_hot(meta))):
            sure = np.abs(z) >= np.log(quality.SURE / (1 - quality.SURE))
            assert pseudo.rows.sum() == sure.sum() and (pseudo.rows[pseudo.y == 1].sum(), pseudo.rows[pseudo.y == 0].sum()) == ((sure & (z > 0)).sum(), (sure & (z < 0)).sum())
            assert np.allclose((pseudo.x * pseudo.rows[:, None]).sum(axis=0), x[sure].sum(axis=0), rtol=1e-4, atol=1e-3)
    assert sum(p.rows.sum() for pair in got.values() for p in pair) > 0


def test_registry_and_guard():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *registry.QUERIES} <= names and set(entry.oracle_sql()) <= names
    assert exact_dedup.SQL.keys() <= entry.oracle_sql().keys()
