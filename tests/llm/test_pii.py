"""PII spans against plain Python regular expressions."""

import hashlib
import re

import pytest

from notespark.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    s = 0
    for i, ch in enumerate(reversed(d)):
        v = int(ch) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def passes(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else False,
        "card": 14 <= len(d) <= 19 and luhn(d),
        "phone": 10 <= len(d) <= 15,
    }[kind]


def brute(text):
    text = text or ""
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text) if passes(kind, m.group())]
    found.sort()
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
    return [sum(f[3] == k for f in found) for k, _ in BASE], hashlib.sha256(joined.encode()).hexdigest(), joined


TRICKY = [
    None, "", " ", "a@b.c@d.e f", "x@a.b.com_y@z.org", "a@b..c d@e.f-", "@x.y", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.255", "001.002.003.004", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111-4111", "4111  1111 1111 1111", "x4111111111111111y", "0" * 14, "0" * 19, "0" * 20, "5 4111111111111111", "5-  4111111111111111",
    "+1 (555) 123-4567", "+49 30 1234567890 12345", "++12345678901", "+1234567890-", "+1 2", "é@x.y ü+1 555 555 5555 😀 a@b.co", "1 - 2 3-4 5 6 7 8 9 0 1 2 3 4",
    "call +1 555 555 5555 and 10.0.0.1", "a@b.c" * 300, "a%b+c@d.e,f_g@h-i.j",
]


def rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.find_pii(df).collect()}, df


def digest(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in pii.BASE)


def test_base_spans_match_plain_patterns(spark):
    got, _ = rows(spark, TRICKY)
    for i, t in enumerate(TRICKY):
        assert digest(got[i].pii) == brute(t)[2], repr(t)[:200]


def test_long_texts(spark):
    texts = ["a" * 20_000 + "@", "1." * 20_000, "7 " * 150_000, "x@" + "a." * 20_000 + "b", "+" * 50_000 + "1 2345678901", "me@site.org " * 20_000, "é" * 100_000 + "1.2.3.4"]
    got, _ = rows(spark, texts)
    for i, t in enumerate(texts):
        assert digest(got[i].pii) == brute(t)[2], i


def test_random_texts(spark):
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("0123456789 .-+()@ab_ 11\n") for _ in range(r.randint(0, 400))) for _ in range(400)]
    got, _ = rows(spark, texts)
    for i, t in enumerate(texts):
        assert digest(got[i].pii) == brute(t)[2], repr(t)


def test_query_is_whole_table(spark, small):
    out = {r.doc_id: r for r in pii.op1_pii(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        counts, sha, _ = brute(d.text)
        r = out[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == sha


def test_added_kinds_and_redaction(spark):
    t = "bank DE89 3704 0044 0532 0130 00, social security 123-45-6789, other 123-45-6789 x" + " " * 60 + "987-65-4321, DE00 3704 0044 0532 0130 00. me@x.org"
    got, df = rows(spark, [t, None])
    assert [s.kind for s in got[0].pii] == ["iban", "ssn", "email"] or [s.kind for s in got[0].pii] == ["iban", "ssn", "ssn", "email"]
    clean = {r.doc_id: r.text for r in pii.redact(pii.find_pii(df)).collect()}
    assert "[IBAN]" in clean[0] and "[EMAIL]" in clean[0] and "DE89" not in clean[0] and clean[1] == ""


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, start int, kind string")
    assert pii.find_pii(df).count() == 0
    df = spark.createDataFrame([(None, "a@b.c", 1, "k")] * 2, "doc_id long, text string, start int, kind string")
    assert [len(r.pii) for r in pii.find_pii(df).collect()] == [1, 1]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 129])
def test_running_sums(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(1).select(pii.running_sums(F.array(*[F.lit(i) for i in range(n)])).alias("x")).collect()[0].x
    assert got == [i * (i - 1) // 2 for i in range(n)]
