"""Operator 2, mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents in hashed order. Round r gives each queue a quantum, its target share of a window of WINDOW
tokens; a queue sends its next packets as long as they fit in what it has been given and not yet used, and carries the rest, its
deficit, to the next round. Documents are cut into packets where a quantum ends (or several, where one is under LEAST tokens, so
that a small source sends a packet now and then instead of crumbs in each window). A packet that ends at token e of its queue is
sent in round ceil(e / quantum): the sequential rule in closed form, which lets all packets be placed at once, with deficits carried
across windows and partitions alike. The rounds in turn, queues in order within a round, are one token stream, cut every WINDOW
tokens: only the last sequence has padding. As long as no queue has run dry, each window holds the target of every queue to within
one token a queue where the quantum is LEAST tokens or more, and to within LEAST tokens where it is less. Without given weights the
target is each source's share of all tokens, so that all queues end together. Given weights must be positive; they are scaled to
sum to 1 over the queues that exist, and a queue that has none gets the smallest one.

Plan: (1) texts are tokenised once into a shared table (2 bytes an id, 4 for vocabularies over 65,536); (2) running sums place
documents in their queues and packets in the stream. They are taken in buckets of about ROWS rows, whose sums are added up in two
levels, so that a source with most rows spreads over tasks and no task sees more than a few thousand rows of one group; (3) the
pieces of each document meet its ids once more for their checksums. Memory is bounded by one bucket or one Arrow batch; no
per-source state is on the driver.

Nulls: null text is empty (the end id alone), a null source is a queue of its own. Rows that repeat are packed each. Very long texts
are tokenised whole. Empty table: no rows. Extra columns are ignored. Word results are cached per worker, at most CACHE words, of
which the first KEEP stay between tasks.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, few_files, lean, read, small_side

WINDOW, LEAST, END_ID = 4096, 512, 2
ROWS, FAN = 1000, 1000
CACHE, KEEP = 300_000, 100_000
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Lower-case letters whose normal form is themselves, so that a word of them stays one word for the tokenizer.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

#: Byte-level vocabularies write bytes that are no visible character as the letters from U+0100 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer(dict):
    """ids of whole texts by a tokenizer that lower-cases and drops white space, word by word: a dict from words to their ids that
    fills itself. trim() leaves the KEEP words that came first, which hold nearly all frequent ones.

    Splitting at blanks and line feeds never changes the ids: both only separate words. Neither does lower-casing ASCII first, nor
    cutting ASCII punctuation off the end of a word whose last letter is an ASCII letter, as a letter before punctuation always ends
    a piece. A word of letters only is one piece for the tokenizer's model. A text with a special token's string goes to the
    tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.end = array(self.code, [END_ID]).tobytes()

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters, lower-cased before
            ids = array(self.code, [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        elif not word:
            ids = b""
        else:
            core = word.rstrip(_PUNCT)
            text = word.decode()
            if core and core != word and 97 <= core[-1] <= 122:
                ids = self[core] + self[word[len(core) :]]
            elif _LETTERS(text):
                ids = array(self.code, [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
            else:
                ids = self._encode(text)
        if len(self) >= CACHE:
            self.trim()
        self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > KEEP:
            kept = dict(islice(self.items(), min(KEEP, CACHE // 2)))
            self.clear()
            self.update(kept)

    def many(self, raw: list[bytes]) -> list[bytes]:
        """ids of each text, 2 or 4 bytes each, without an end id."""
        get = self.__getitem__
        return [self._encode(x.decode()) if b"<|" in x else b"".join(map(get, x.lower().replace(b"\n", b" ").split(b" "))) for x in raw]


_tokenizers: dict[str, WordTokenizer] = {}  # of a worker: loaded once; task by task only the trimmed cache stays


def _tokenize(vocabulary: str):
    def run(batches):
        if vocabulary not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[vocabulary] = WordTokenizer(vocabulary)
        tokenizer = _tokenizers[vocabulary]
        width = len(tokenizer.end)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    raw = [x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                    ids = [x + tokenizer.end for x in tokenizer.many(raw)]
                    cols = [part.column(c) for c in ("row", "doc_id", "source")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "source", "n", "ids"])
        finally:
            tokenizer.trim()

    return run


def _checksums(batches):
    for batch in batches:
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")}
        docs, sources, sizes, pieces, ids = (batch.column(c) for c in ("doc_id", "source", "n", "pieces", "ids"))
        for doc, source, n, ps, raw in zip(docs.to_pylist(), sources.to_pylist(), sizes.to_pylist(), pieces.to_pylist(), ids):
            raw = raw.as_buffer()
            x = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4")
            for p in ps:
                out["doc_id"].append(doc)
                out["source"].append(source)
                out["doc_tokens"].append(n)
                out["ids_crc32"].append(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()))
                for k in ("start", "length", "sequence_id", "offset"):
                    out[k].append(p[k])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "source" else pa.int64()) for k, v in out.items()], names=list(out))


def tokenized(docs: DataFrame, vocabulary: str, own: Scratch) -> DataFrame:
    """row, doc_id, source, n, ids of every document, with the end id, in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return own.write(rows.mapInArrow(lean(_tokenize(vocabulary)), "row long, doc_id long, source string, n long, ids binary"), "tokens")


def sums_before(sums: DataFrame, by: list[str], at: str) -> DataFrame:
    """sums(by, at, s), at from 0, plus `before`: the sum of s over smaller `at`. Runs of FAN values are summed first, so that no window holds more than
    FAN rows, or one row for each run."""
    runs = sums.withColumn("__run", F.floor(F.col(at) / FAN))
    tops = runs.groupBy(*by, "__run").agg(F.sum("s").alias("__t"))
    tops = tops.select(*by, "__run", (F.sum("__t").over(Window.partitionBy(*by).orderBy("__run")) - F.col("__t")).alias("__u"))
    inner = F.sum("s").over(Window.partitionBy(*by, "__run").orderBy(at)) - F.col("s")
    return runs.withColumn("__v", inner).join(tops, [*by, "__run"]).select(*by, at, "s", (F.col("__u") + F.col("__v")).alias("before"))


def place(tokens: DataFrame, weights: dict[str, float] | None = None, window: int = WINDOW, least: int = LEAST, own: Scratch | None = None) -> DataFrame:
    """Pieces of the stream: row, start, length, sequence_id, offset."""
    own = own or Scratch("pack")
    if weights is not None and not (weights and all(w > 0 for w in weights.values())):
        raise ValueError("weights must be positive")
    queue = F.coalesce("source", F.lit("\0"))
    meta = tokens.select("row", "n", queue.alias("queue"), F.xxhash64("doc_id", "row").alias("h"))
    weight = F.col("all").cast("double")
    if weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("queue")].cast("double"), F.lit(float(min(weights.values()))))
    queues = own.write(meta.groupBy("queue").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).withColumn("weight", weight), "queues")
    total = queues.agg(F.sum("weight")).first()[0] or 1.0
    quantum = F.col("weight") / F.lit(total) * window
    known = queues.select("queue", F.ceil(F.col("rows") / ROWS).alias("buckets"), quantum.alias("quantum"))
    known = known.withColumn("grain", F.ceil(F.lit(least) / F.col("quantum")) * F.col("quantum"))
    docs = meta.join(small_side(known), "queue").withColumn("bucket", F.pmod("h", "buckets"))
    sums = own.write(sums_before(docs.groupBy("queue", "bucket").agg(F.sum("n").alias("s")), ["queue"], "bucket").select("queue", "bucket", "before"), "sums")
    in_bucket = Window.partitionBy("queue", "bucket").orderBy("h", "row")
    docs = docs.withColumn("at", F.sum("n").over(in_bucket) - F.col("n")).join(small_side(sums), ["queue", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    # packets end where floor(k * grain) is: k runs a step wide of what can be needed, and what is empty goes
    first, last = F.floor(F.col("at") / F.col("grain")), F.floor((F.col("at") + F.col("n")) / F.col("grain"))
    cut = docs.select("row", "n", "queue", "at", "quantum", "grain", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last + 1)).alias("k"))
    lo = F.greatest("at", F.floor(F.col("k") * F.col("grain")))
    hi = F.least(F.col("at") + F.col("n"), F.floor((F.col("k") + 1) * F.col("grain")))
    packets = cut.select("row", "queue", "at", "quantum", lo.alias("lo"), hi.alias("hi")).filter("hi > lo")
    packets = packets.select("row", "queue", "lo", (F.col("lo") - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"), F.ceil(F.col("hi") / F.col("quantum")).alias("round"))
    packets = own.write(packets, "packets")
    # rounds grow with the tokens; so many of them make a block that a block has about 2 * ROWS packets
    count, rounds = packets.agg(F.count(F.lit(1)), F.coalesce(F.max("round"), F.lit(1))).first()
    per_block = max(1, math.ceil(rounds / max(1, math.ceil(count / (2 * ROWS)))))
    blocked = packets.withColumn("block", F.floor(F.col("round") / per_block))
    ends = own.write(sums_before(blocked.groupBy("block").agg(F.sum("length").alias("s")), [], "block").select("block", "before"), "ends")
    in_block = Window.partitionBy("block").orderBy("round", "queue", "lo")
    placed = blocked.withColumn("pos", F.sum("length").over(in_block) - F.col("length")).join(small_side(ends), "block").withColumn("pos", F.col("pos") + F.col("before"))
    first, final = F.floor(F.col("pos") / window), F.floor((F.col("pos") + F.col("length") - 1) / window)
    cut = placed.select("row", "start", "length", "pos", F.explode(F.sequence(first, final)).alias("sequence_id"))
    lo, hi = F.greatest("pos", F.col("sequence_id") * window), F.least(F.col("pos") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return cut.select("row", (F.col("start") + lo - F.col("pos")).alias("start"), (hi - lo).alias("length"), "sequence_id", (lo - F.col("sequence_id") * window).alias("offset"))


def pack(docs: DataFrame, weights: dict[str, float] | None = None, vocabulary: str | None = None, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    own = Scratch("pack")
    tokens = tokenized(docs, vocabulary or default_vocabulary(), own)
    pieces = place(tokens, weights, window, least, own).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    own.leave("tokens", "packets", "ends")
    own.close()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return few_files(tokens.join(pieces, "row").select("doc_id", "source", "n", "pieces", "ids").mapInArrow(lean(_checksums), schema))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
