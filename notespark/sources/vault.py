"""Note sources: a folder of Markdown files, or any table with a path and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import excluded, under_folder
from ..functions.text import agent_path_ok, content_hash

MAX_NOTE_BYTES = 1_000_000


def relative_path(uri: Column, root: str) -> Column:
    """A file's URI relative to its root folder, with escapes of the URI undone."""
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.regexp_replace(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), r"^[a-z0-9+.-]+:/*", "/")
    return F.substring(path, len(base) + 1, 1 << 20)


def list_files(spark: SparkSession, root: str, folders: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, content bytes) of all .md files under root, relative paths; exclusion wins. The filter runs before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    rows = files.select(relative_path(F.col("path"), root).alias("path"), "content")
    return rows.filter(~excluded(F.col("path"), exclude or []) & under_folder(F.col("path"), folders or []))


def index_payload(files: DataFrame) -> DataFrame:
    """(path, content, hash), lazily."""
    text = F.decode("content", "UTF-8")
    return files.select("path", text.alias("content"), content_hash(text).alias("hash"))


def from_table(rows: DataFrame, path, text) -> DataFrame:
    """Any table as index files."""
    return rows.select(path.alias("path"), text.alias("content"), content_hash(text).alias("hash"))


def write_notes(drafts: DataFrame, folder: str, roots: list[str]) -> DataFrame:
    """Writes drafts(path, content) as notes under folder, over a note of the same path, where the path is allowed and the size under the
    cap; returns what was refused. Drafts are what one answer proposes, so they go through the driver, one at a time."""
    ok = F.coalesce(agent_path_ok(F.col("path"), roots) & (F.octet_length("content") <= MAX_NOTE_BYTES), F.lit(False))
    sc = drafts.sparkSession.sparkContext
    path_of = sc._jvm.org.apache.hadoop.fs.Path
    for r in drafts.filter(ok).select("path", "content").toLocalIterator():
        at = path_of(f"{folder.rstrip('/')}/{r.path}")
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(r.content.encode())
        finally:
            out.close()
    return drafts.filter(~ok)
