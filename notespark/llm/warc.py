"""Operator 6, WARC archives with an external index merge.

Writing: records are rendered as text and written by Spark's own text sink, whose line separator is the blank line that ends a WARC
record; so files go through the commit protocol of any Hadoop file system and a lost executor costs one task. Pages are written
from the partitions of their scan, at most so many to a file that files have about `file_bytes`. Equal payloads of at least
MIN_REVISIT bytes are stored once: the largest page id is the response, the others are revisit records that name it. Which they are
is found on digests alone, one row for each repeated payload; below a checked size that table is broadcast and no payload is in any
exchange, beyond it pages are joined by digest once, where Spark can split hot ones.

Reading: files are read whole by Spark's binary source, so file_bytes bounds what a task holds; each is parsed by Content-Length in
one forward pass, payloads are digested again and held against the header. The index has file, offset and length of each record.

Index: the records of a file, sorted by SURT key and timestamp, are one capture run. The runs are merged externally: a range
partitioning by (key, timestamp, id, file, offset) cuts all runs at common splitters, so that a key with a third of all captures,
or a capture that repeats, is spread over tasks; each task then merges its slices of the runs with a loser tree (log2(k) comparisons
a record), which gives globally ordered capture histories across tasks. Slices come out of the exchange in the order in which their
runs were read; that is checked, and only a slice that is out of order is sorted again.

Nulls: null html is an empty payload, a null url an empty target. Very long payloads are one record. Rows that repeat the largest id of a payload are all responses.
Captures have no time in the tables: the date is derived from the id. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from datetime import datetime, timezone
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few_files, lean, new_path, read, ready, small_side, write_table

MIN_REVISIT = 1000
FILE_BYTES = 16 << 20
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
ID = "urn:notespark:page:"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)

INDEX = "surt string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), payload_bytes, payload_digest (SHA-1)."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"),
    )


def with_types(digested: DataFrame) -> DataFrame:
    """Adds record_type and refers_to. Only digests that occur more than once take part in the join; others have no partner row."""
    large = digested.filter(F.col("payload_bytes") >= MIN_REVISIT)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("__best"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 AND __best IS NOT NULL")
    groups = write_table(groups.select(F.col("payload_digest").alias("__d"), "__best"), "warc-groups", "warc")
    joined = digested.join(small_side(groups, BROADCAST_ROWS // 4), (F.col("payload_digest") == F.col("__d")) & (F.col("payload_bytes") >= MIN_REVISIT), "left")
    revisit = F.col("__best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__best"))
    return joined.select(*digested.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__best")).alias("refers_to"))


def _uri(url: Column) -> Column:
    """Header values hold no control characters and no blanks."""
    out = F.replace(url, F.lit("%"), F.lit("%25"))
    for ch in [chr(c) for c in range(33)] + ["\x7f"]:
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}")) if ch in "\r\n\t \x00" else out
    return out


def _date(page_id: Column) -> Column:
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000))
    return F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(typed: DataFrame) -> DataFrame:
    """One text row per record, without the blank line that ends it."""
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, F.concat(F.lit(HTTP), F.col("html"))).otherwise(F.lit(HTTP))
    identity = F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    headers = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), identity),
        F.concat(F.lit("WARC-Date: "), _date(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(~is_response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit(f"WARC-Refers-To: <{ID}"), F.col("refers_to").cast("string"), F.lit(">")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return typed.select(F.concat(headers, F.lit(CRLF + CRLF), block).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages(page_id, url, html) as .warc files of about file_bytes at most."""
    digested = with_digests(pages)
    size, rows = digested.agg(F.sum(F.col("payload_bytes") + 600), F.count(F.lit(1))).first()
    most = max(1, int(file_bytes / ((size or 0) / max(rows, 1) or 1)))
    out = few_files(records(with_types(digested)))
    out.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).text(path)


def surt(url: str) -> str:
    """Sort-friendly key: host labels reversed, scheme, www, port 80/443 and fragment dropped, lower case."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host = re.sub(r":(80|443)?$", "", m[1].rpartition("@")[2].lower())
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def parse_records(data: bytes, file: str = ""):
    """The records of one archive, by Content-Length: (headers, payload, offset, length)."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{file}: no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = head_end + 4
        stop = start + int(headers["Content-Length"])
        body = data.index(b"\r\n\r\n", start, stop) + 4
        yield headers, view[body:stop], at, stop - at
        at = stop + 4


def _page(ref: str | None) -> int | None:
    number = ref[len(ID) + 1 : -1] if ref else "none"
    return None if number == "none" else int(number)


def _read(batches):
    """Per file: its records in run order, so each output batch is a sorted capture run."""
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            out = []
            for h, payload, at, length in parse_records(data.as_py(), path):
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                if h["WARC-Type"] == "response":
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: damaged payload at byte {at}")
                url = unquote(h["WARC-Target-URI"])
                out.append((surt(url), re.sub(r"\D", "", h["WARC-Date"]), _page(h["WARC-Record-ID"]), url, size, digest, h["WARC-Type"], _page(h.get("WARC-Refers-To")), path, at, length))
            out.sort(key=_order)
            cols = list(zip(*out)) if out else [[]] * 11
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in INDEX.split(", ")])


def _order(r: tuple) -> tuple:
    return (r[0], r[1], -1 if r[2] is None else r[2], r[8], r[9])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The capture runs of all archives under path: one run a file, each sorted by key, timestamp and id."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(lean(_read), INDEX)


class LoserTree:
    """K-way merge: each inner node holds the loser of its match, the root's parent the winner; a step replays one path."""

    def __init__(self, runs: list, key):
        self.key, self.runs, self.k = key, [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._enter(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _enter(self, leaf: int) -> None:
        """First matches: waits in the first empty node on the way up, or plays on."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and (w := self.tree[0]) != -1 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            winner, node = w, (w + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def _merge(batches):
    """The slices of the runs that fall into this key range, merged. The range bounds the rows, hence the memory."""
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            runs.setdefault(row[8], []).append(row)
    for run in runs.values():
        if any(_order(a) > _order(b) for a, b in zip(run, run[1:])):
            run.sort(key=_order)
    merged = iter(LoserTree([runs[f] for f in sorted(runs)], _order))
    while part := list(islice(merged, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], names=schema.names)


def merge_index(runs: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """The globally ordered index: partitions follow each other in (surt, ts, page_id) order and so do the rows in each."""
    n = max(1, math.ceil(runs.count() / rows_per_range))
    return runs.repartitionByRange(n, "surt", "ts", "page_id", "file", "offset").mapInArrow(lean(_merge), INDEX)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(ready(spark), "warc", "warc")
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    runs = write_table(read_archives(spark, path), "warc-runs", "warc")
    index = merge_index(runs)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "surt", "ts")


SQL = {
    "op6_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)' AS pat FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, url, regexp_matches(url, pat) AS parts,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, pat, 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\d*\.', '') AS host, lower(regexp_extract(url, pat, 2)) AS rest FROM p),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to,
  CASE WHEN parts THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE lower(url) END AS surt,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS ts
FROM b"""
}
QUERIES = {"op6_warc": op6_warc}
