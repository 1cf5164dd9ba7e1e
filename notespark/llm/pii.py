"""Operator 1, personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Each pattern runs once over a whole text (and a second time, as a splitter, only over texts that it
matches), so positions are sums of the lengths of gaps and matches. Patterns are possessive and start only where a run of their
characters starts, which keeps them linear in the text, without recursion, however long a run is; the spans are those of the
plain patterns in KINDS' comments, leftmost and non-overlapping.

Base kinds (email, ip, card, phone) have no score threshold: a base span that passes its check always stays. The method adds
`iban` (mod-97) and `ssn` (range checks, and a context word near it).

Null text counts as empty; a text without spans gives zeros, empty strings and empty arrays; repeated rows are each answered;
an empty table gives no rows. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without a match of this simple test can hold no span; saves the larger pattern
    valid: object  # Column of a match -> Column
    score: float
    context: str  # words that make a span likelier
    least: float = 0.0  # added spans need this score


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


def iban_ok(m: Column) -> Column:
    """The rearranged number, letters as 10 to 35, leaves 1 modulo 97."""
    flat = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))

    def step(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(flat).between(15, 34) & (F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1)


LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++", "@", lambda m: F.lit(True), 0.9, r"mail|contact|write|@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip_ok, 0.6, r"\bip\b|address|server|host|addr"),
    # [0-9]([\x20-]?[0-9])+ ; runs of other than 14 to 19 digits fail in any case and are not proposed
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){13}", lambda m: F.call_function("luhn_check", digits(m)), 0.7, r"card|visa|master|credit|pay|cvv"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _phone_ok, 0.6, r"phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Z0-9])", r"[A-Z]{2}[0-9]{2}", iban_ok, 0.8, r"iban|bank|account|konto", 0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-", lambda m: F.lit(True), 0.3, r"ssn|social|security", 0.5),
)
BASE = ("email", "ip", "card", "phone")


def running_sums(x: Column) -> Column:
    """Sums of all earlier items, for each item of an array of ints; by blocks, so that long arrays cost little more than their length."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    block = 64

    def of_blocks(sums: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, 1, b)))
        return let(before, lambda p: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(p, F.floor(i / block).cast("int")) + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block))))

    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: total(F.slice(x, b * block + 1, block)))
    return let(sums, of_blocks)


def _spans(text: Column, order: int, kind: Kind) -> Column:
    """The confirmed spans of one kind: array of (start, ord, end, kind, score)."""

    def positioned(m: Column, gaps: Column) -> Column:
        lengths = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))

        def build(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                near = F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.lit(CONTEXT)))
                score = F.when(near.rlike(f"(?i){kind.context}"), F.lit(min(1.0, kind.score + 0.25))).otherwise(F.lit(kind.score))
                return F.when(kind.valid(x), F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + F.length(x)).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score")))

            return F.filter(F.transform(m, one), lambda s: s.isNotNull() & (s["score"] >= kind.least))

        return let(running_sums_of(lengths), build)

    def running_sums_of(lengths: Column) -> Column:
        return let(lengths, running_sums)

    found = F.when(text.rlike(kind.needs), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,score:double>>")
    spans = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda g: positioned(m, g))))
    return F.coalesce(spans, none)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs plus an array of (start, ord, end, kind, score), by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_spans(text, i, k) for i, k in enumerate(kinds)])
    return docs.withColumn(out, F.array_sort(found))


def redact(docs: DataFrame, text_col: str = "text", spans: str = "pii") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans merge under the first one's kind."""
    text, s = F.coalesce(F.col(text_col), F.lit("")), F.col(spans)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["done"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        fresh = F.struct(piece.alias("done"), x["end"].alias("at"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["at"], x["end"]).alias("at")))

    return docs.withColumn(text_col, F.aggregate(s, start, step, lambda a: F.concat(a["done"], F.substr(text, a["at"] + 1, F.lit(2147483647)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")
    base = F.filter(pii, lambda s: s["ord"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in (*BASE, "iban", "ssn")]
    return docs.select(
        "doc_id",
        *counts[: len(BASE)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(pii).alias("spans"),
        *counts[len(BASE) :],
        F.round(F.coalesce(F.array_max(F.transform(pii, lambda s: s["score"])), F.lit(0.0)), 2).alias("max_score"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op1_pii": op1_pii}
