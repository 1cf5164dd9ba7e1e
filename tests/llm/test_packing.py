"""Packing: invariants over the whole table, ids by the plain tokenizer, order against a sequential deficit round-robin."""

import math
import zlib
from collections import defaultdict, deque

import numpy as np
import pytest

from notespark.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def check(out, docs, tokenizer, window=4096):
    ids = {}
    for d in docs:
        ids[d.doc_id] = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for k, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[k])
    sizes = {}
    for s, rs in by_seq.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes[s] = at
    total = sum(map(len, ids.values()))
    assert sorted(sizes) == list(range(math.ceil(total / window)))
    assert all(sizes[s] == window for s in sorted(sizes)[:-1])


def test_whole_table(spark, small, tokenizer):
    check(packing.op2_packing(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet").collect(), tokenizer)


def test_words_are_tokenised_as_whole_texts(tokenizer):
    texts = [
        "", " ", "a<|endoftext|>b  <|startoftext|>", "<|ENDOFTEXT|>", "Don't\tstop\x1cnow", "é É ﬁ １２ 'S", "a\x85b c", "é ́x", "İ ǅ ẞ ΑΣ", "x's.", "we're!! 'tis", "a.'s b,'t", "word... (x) \"y\"", "~~", "don'", "a≠", "q.́",
        "rock'n'roll's", "5's 10%", "é.", "z\r\nq\x0bw",
    ]
    t = packing.WordTokenizer(packing.default_vocabulary())
    for _ in range(2):
        got = t.many([x.encode() for x in texts])
        for x, g in zip(texts, got):
            assert np.frombuffer(g, "<u2").tolist() == tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_cache_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE", 50)
    t = packing.WordTokenizer(packing.default_vocabulary())
    for i in range(30):
        text = " ".join(f"w{i}x{j}," for j in range(20))
        assert np.frombuffer(t.many([text.encode()])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("weights,least", [(None, 4), (None, 30), ({"a": 5.0, "b": 2.5, "": 2.5}, 4), ({"a": 0.01, "b": 1.0}, 16)])
def test_order_is_deficit_round_robin(spark, weights, least):
    rows = [(i, "ab"[i % 3 == 0] if i % 7 else None, (i * 37) % 90 + 1) for i in range(200)]
    tokens = spark.createDataFrame([(i, i, s, n, b"") for i, s, n in rows], "row long, doc_id long, source string, n long, ids binary")
    pieces = packing.place(tokens, weights, window=64, least=least).collect()
    from pyspark.sql import functions as F

    order = {r.row: r.h for r in tokens.select("row", F.xxhash64("doc_id", "row").alias("h")).collect()}
    queues = defaultdict(list)
    for i, s, n in rows:
        queues["\0" if s is None else s].append((order[i], i, n))
    weight = {q: (float(weights.get(q, min(weights.values()))) if weights else float(sum(x[2] for x in v))) for q, v in queues.items()}
    quantum = {q: w / sum(weight.values()) * 64 for q, w in weight.items()}
    fifo, sent = {}, defaultdict(int)
    for q, v in queues.items():
        grain, line = math.ceil(least / quantum[q]) * quantum[q], [(i, j) for _, i, n in sorted(v) for j in range(n)]
        ends = sorted({math.floor(k * grain) for k in range(1, int(len(line) / grain) + 2)} | {e for e in range(1, len(line) + 1) if e == len(line) or line[e][0] != line[e - 1][0]})
        ends = [e for e in ends if e <= len(line)]
        fifo[q] = deque(line[a:e] for a, e in zip([0, *ends], ends))
    stream, rnd = [], 0
    while any(fifo.values()):
        rnd += 1
        for q in sorted(fifo):
            while fifo[q] and math.ceil((sent[q] + len(fifo[q][0])) / quantum[q]) <= rnd:
                packet = fifo[q].popleft()
                sent[q] += len(packet)
                stream += packet
    got = []
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        got += [(r.row, r.start + j) for j in range(r.length)]
    assert got == stream


def test_windows_hold_the_mixture(spark, monkeypatch):
    """Every window but those after a queue has run dry is within a token a queue of the targets; buckets and runs are small here."""
    monkeypatch.setattr(packing, "ROWS", 20)
    monkeypatch.setattr(packing, "FAN", 3)
    rows = [(i, "abc"[min(2, i % 5)], (i * 37) % 300 + 1) for i in range(2000)]
    tokens = spark.createDataFrame([(i, i, s, n, b"") for i, s, n in rows], "row long, doc_id long, source string, n long, ids binary")
    source, total = {i: s for i, s, _ in rows}, sum(n for *_, n in rows)
    size = {s: sum(n for _, q, n in rows if q == s) for s in "abc"}
    held = defaultdict(lambda: defaultdict(int))
    for r in packing.place(tokens, window=512, least=16).collect():
        held[r.sequence_id][source[r.row]] += r.length
    last = max(held)
    assert last == (total - 1) // 512
    for k, of in held.items():
        assert sum(of.values()) == (512 if k < last else total - last * 512)
        for s in "abc":
            assert k == last or abs(of[s] - 512 * size[s] / total) <= 4


def test_weights_are_checked(spark):
    tokens = spark.createDataFrame([(1, 1, "a", 5, b"")], "row long, doc_id long, source string, n long, ids binary")
    for bad in ({}, {"a": 0.0}, {"a": -1.0, "b": 1.0}):
        with pytest.raises(ValueError):
            packing.place(tokens, bad)


def test_wide_vocabularies_have_four_bytes_an_id():
    ids = np.array([70_000, 5, 2], "<u4")
    import pyarrow as pa

    piece = pa.array([[{"start": 1, "length": 2, "sequence_id": 0, "offset": 0}]])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["s"]), pa.array([3]), piece, pa.array([ids.tobytes()])], names=["doc_id", "source", "n", "pieces", "ids"])
    assert next(packing._checksums([batch])).column("ids_crc32").to_pylist() == [zlib.crc32(ids[1:].tobytes())]


def test_odd_rows(spark, tokenizer):
    df = spark.createDataFrame([(1, None, None, 0), (2, "", "s", 0), (3, "w " * 30000, "s", 0), (4, "same", "t", 1), (5, "same", "t", 1)], "doc_id long, text string, source string, row int")
    check(packing.pack(df).collect(), df.collect(), tokenizer)
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(df.filter("doc_id = 4").unionByName(df.filter("doc_id = 4"))).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, twice[0].doc_tokens}
