"""Operator 13, collocations: frequent phrases by pivot partitioning, as MG-FSM has it.

Words are counted first. A phrase belongs to the rarest of its words, its pivot: around each occurrence of a word, the text is
rewritten to the fragment of up to `most` - 1 words to either side in which no word is rarer, and that fragment is routed to the
word. A partition then holds all that its pivots need: it mines the phrases of its fragments that hold the pivot, counts them and
keeps the frequent ones, so no other count of a phrase is made anywhere else. A phrase that holds its pivot twice is counted where
the pivot stands first. Common words get short fragments, as their neighbours are rarer, so there are few different ones of them;
equal fragments of a task are counted together before they are routed.

Which of two words is rarer must be known wherever text is read. That takes no list of all words: SLOTS counts (16 MB, whatever the
corpus) are broadcast, each the largest count of the words that hash to it, 0 where none is frequent. Words are ordered by that count,
then by themselves; a crowded slot can only make a word look commoner than it is, which moves work to another word and adds phrases
that fall out when they are counted, but changes no result. Words of more than MOST_OF_A_PIVOT occurrences are dealt to several groups by
fragment, whose counts are added up afterwards; so no group grows with the corpus.

Everything is per language (null: `und`). A-Z count as a-z; texts end phrases, and so do . , ; : ! ? and line ends; other white space
than space and tab is part of no word. Null and blank texts have no words; very long texts are taken whole; rows that repeat are
counted each. Scores are exact integers. Ties in rank go to the phrase that comes first in byte order. Empty table: no rows. Extra
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, lean, read

LEAST, MOST, TOP = 10, 3, 2000
SHADOW = (50, 100)  # a longer phrase of at least this share of the occurrences stands for the phrases in it
SLOTS = 1 << 22
MOST_OF_A_PIVOT = 100_000
KEPT = 200_000  # different fragments that a task counts before it passes them on
DEAL = 64  # groups of a language that are cut to the best before they meet
ENDS = ".,;:!?\n\x0b\f\r"
_TABLE = bytes.maketrans(UPPER.encode() + ENDS.encode() + b"\t", LOWER.encode() + b"\n" * len(ENDS) + b" ")
_FRAGMENTS = "h long, lang string, fragment string, at int, c long"


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, c) of all words."""
    flat = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER + ENDS + "\t", LOWER + " " * (len(ENDS) + 1))
    words = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(flat, " ", -1)).alias("word"))
    return words.filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))


def _slot(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode() + b"\0"))


def sketch(frequent: DataFrame) -> np.ndarray:
    """The counts by slot: of (lang, word, c) the largest c in each of SLOTS slots, so at most SLOTS rows reach the driver."""
    slot = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word").cast("binary"))).bitwiseAND(F.lit(SLOTS - 1))
    rows = frequent.groupBy(slot.cast("int").alias("s")).agg(F.least(F.max("c"), F.lit((1 << 31) - 1)).cast("int").alias("c")).toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[rows.column("s").to_numpy()] = rows.column("c").to_numpy()
    return out


def ranks(words: list[bytes], counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each word in the order by count, then hash, then word; -1 for those of count 0."""
    order = np.lexsort((hashes, counts))
    tied = (counts[order[1:]] == counts[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]]) & (counts[order[1:]] > 0)
    if tied.any():
        order = np.array(sorted(range(len(words)), key=lambda k: (counts[k], hashes[k], words[k])))
    out = np.empty(len(words), np.int64)
    out[order] = np.arange(len(words))
    out[counts == 0] = -1
    return out


def around(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position how many words before and after it, most - 1 at the utmost, belong to its fragment: no rarer ones, and before it
    no equal ones either, as phrases with those belong to the earlier occurrence."""
    n = len(r)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_left, open_right = r >= 0, r >= 0
    for k in range(1, most):
        open_left[:k], open_right[n - k :] = False, False
        open_left[k:] &= r[: n - k] > r[k:]
        open_right[: n - k] &= r[k:] >= r[: n - k]
        left += open_left
        right += open_right
    return left, right


def _fragments(table, most: int, group: int, most_kept: int = KEPT):
    def run(batches):
        kept: dict[tuple, int] = {}

        def flush():
            rows = list(kept.items())
            kept.clear()
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                h, lang, place, text = zip(*[k for k, _ in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(place, pa.int32()), pa.array([c for _, c in part], pa.int64())], names=["h", "lang", "fragment", "at", "c"]
                )

        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                if raw:
                    by_lang.setdefault(lang, []).append(raw)
            for lang, raws in by_lang.items():
                words = [w for w in b"\n".join(raws).translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]
                names = dict.fromkeys(words)
                number = {w: k for k, w in enumerate(names)}
                codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                start = zlib.crc32(lang.encode() + b"\0")
                hashes = np.array([zlib.crc32(w, start) for w in names], np.int64)
                counts = table.value[hashes & (SLOTS - 1)]
                if b"\n" in number:
                    counts[number[b"\n"]] = 0
                r = ranks(list(names), counts, hashes)[codes]
                left, right = around(r, most)
                at = np.flatnonzero(left + right)
                groups = -(-counts[codes[at]].astype(np.int64) // group)
                for i, a, b, h, g in zip(at.tolist(), left[at].tolist(), right[at].tolist(), hashes[codes[at]].tolist(), groups.tolist()):
                    text = b" ".join(words[i - a : i + b + 1])
                    if g > 1:  # one of the groups of a common pivot
                        h += (1 + zlib.crc32(text) % g) << 32
                    key = (h, lang, a, text)
                    kept[key] = kept.get(key, 0) + 1
                if len(kept) > most_kept:
                    yield from flush()
        yield from flush()

    return run


def phrases_of(words: Column, at: Column, most: int) -> Column:
    """The phrases of 2 to `most` words of a fragment that hold the word at `at`; null where one would pass an end."""
    parts = []
    for m in range(2, most + 1):
        for k in range(m):
            inside = (at >= k) & (at - k + m <= F.size(words))
            parts.append(F.when(inside, F.concat_ws(" ", *[F.get(words, at - k + j) for j in range(m)])))
    return F.array(*parts)


def frequent_phrases(docs: DataFrame, frequent: DataFrame, own: Scratch, least: int = LEAST, most: int = MOST, group: int = MOST_OF_A_PIVOT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a), written: phrases of 2 to `most` words that occur `least` times or more. frequent: the words that do, (lang, word, c)."""
    table = docs.sparkSession.sparkContext.broadcast(sketch(frequent))
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    routed = texts.mapInArrow(lean(_fragments(table, most, group)), _FRAGMENTS).repartition("h")
    out = own.write(mined(routed, least, most), "phrases")
    table.destroy()
    return out


def mined(routed: DataFrame, least: int, most: int) -> DataFrame:
    """The frequent phrases of fragments that lie together by pivot: the first aggregation needs no exchange, the second one adds up
    the groups of common pivots, and others have only frequent phrases left by then."""
    split = routed.select("h", "lang", "at", "c", F.split("fragment", " ", -1).alias("ws"))
    phrases = split.select("h", "lang", "c", F.explode(phrases_of(F.col("ws"), F.col("at"), most)).alias("phrase")).filter("phrase IS NOT NULL")
    local = phrases.groupBy("h", "lang", "phrase").agg(F.sum("c").alias("a")).filter((F.col("a") >= least) | (F.col("h") >= 1 << 32))
    return local.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _cuts(phrase: Column, most: int) -> Column:
    """All ways to cut a phrase in two: (k, left, right)."""

    def cut(ws: Column, k: int) -> Column:
        return F.when(F.size(ws) > k, F.struct(F.lit(k).alias("k"), F.array_join(F.slice(ws, 1, k), " ").alias("left"), F.array_join(F.slice(ws, k + 1, most), " ").alias("right")))

    ws = F.split(phrase, " ", -1)
    return F.array(*[cut(ws, k) for k in range(1, most)])


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, shadow: tuple[int, int] = SHADOW, text_col: str = "text", lang_col: str = "lang", group: int = MOST_OF_A_PIVOT) -> DataFrame:
    """The `top` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    score is floor(10**6 * a * a / (l * r)) for the cut that scores lowest (of equal ones the first), l and r the occurrences of its two
    parts; it is exact for up to 10**15 occurrences. A phrase goes where a longer candidate that holds it occurs shadow[0] / shadow[1] times as often or more."""
    if most < 2 or least < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    own = Scratch("collocations", tidy=True)
    counts = own.write(word_counts(docs, text_col, lang_col), "counts")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    words = counts.filter(F.col("c") >= least)
    phrases = frequent_phrases(docs, words, own, least, most, group, text_col, lang_col)
    known = own.write(words.select("lang", F.col("word").alias("part"), F.col("c").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))), "known")
    cuts = phrases.select("lang", "phrase", "a", F.explode(_cuts(F.col("phrase"), most)).alias("cut")).filter("cut IS NOT NULL").select("lang", "phrase", "a", "cut.*")
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"], wide["l"] * wide["r"]))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    ws = F.split("phrase", " ", -1)
    inner = [F.when((F.size(ws) >= m + k) & (F.size(ws) > m), F.array_join(F.slice(ws, k + 1, m), " ")) for m in range(2, most) for k in range(most - m + 1)]
    if inner:
        over = phrases.select("lang", F.col("a").alias("longer"), F.explode(F.array(*inner)).alias("phrase")).filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(over, ["lang", "phrase"], "left").filter(F.coalesce(shadow[1] * F.col("longer") < shadow[0] * F.col("a"), F.lit(True))).drop("longer")
    scored = own.write(scored, "scored")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEAL))).orderBy(*best))
    first = scored.withColumn("__k", dealt).filter(F.col("__k") <= top).drop("__k")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    out = own.write(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "ranked")
    own.leave("ranked")
    own.close()
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = {
    "op13_collocations": r"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
f AS (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, 1 AS m, unnest(ws) AS g FROM p
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i+1] FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, g AS phrase, f AS a, string_split(g, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS le, array_to_string(ws[k+1:], ' ') AS ri FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.g = le JOIN f y ON y.lang = k.lang AND y.g = ri),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, ws[1] || ' ' || ws[2] AS g FROM c WHERE m = 3 UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE m = 3) GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
}
QUERIES = {"op13_collocations": op13_collocations}
