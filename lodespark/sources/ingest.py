"""Files into documents: scanning, titles, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions.paths import glob_regex, handelized, hidden
from lodespark.operators.store import content_hash

#: Directories that are never scanned.
SKIPPED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def _heading(text: Column, pattern: str) -> Column:
    found = trimmed(F.regexp_extract(text, pattern, 1))
    return F.when(found != "", found)


def file_stem(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\.[^.]+$", ""), "/"), -1)


def title_of(text: Column, path: Column) -> Column:
    """The first heading of the first two levels in markdown (the next second-level one, if it just says Notes), ``#+TITLE:`` or the first heading in org files, else the file's stem."""
    first = _heading(text, r"(?md)^##?\s+(.+)$")
    generic = first.isin("Notes", "📝 Notes")
    md = F.when(generic, F.coalesce(_heading(text, r"(?md)^##\s+(.+)$"), first)).otherwise(first)
    org = F.coalesce(_heading(text, r"(?imd)^#\+TITLE:\s*(.+)$"), _heading(text, r"(?md)^\*+\s+(.+)$"))
    ext = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    found = F.when(ext == ".md", md).when(ext == ".org", org)
    return F.coalesce(found, file_stem(path))


def scanned(files: DataFrame) -> DataFrame:
    """Adds ``hash`` and ``title`` to ``files(collection, path, text, ...)``; null and blank texts are skipped."""
    rows = files.filter(~blank(F.col("text")))
    return rows.withColumn("hash", content_hash(F.col("text"))).withColumn("title", title_of(F.col("text"), F.col("path")))


def scan_files(spark: SparkSession, root: str, collection: str, pattern: str = "**/*.md", ignore: list[str] | None = None) -> DataFrame:
    """``collection, path, text, hash, title, modified_at`` of the text files below ``root``.

    Patterns apply to the path below the root. Hidden files and directories, and those of tools, are left out; so are unreadable, blank and
    non-UTF-8 files. Symbolic links are not followed by Spark's listing of local files. Paths are normalised.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = F.lit(root.rstrip("/").removeprefix("file:") + "/")
    full = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    raw = raw.withColumn("rel", F.substring(full, F.length(base) + 1, F.length(full)))
    keep = F.col("rel").rlike(glob_regex(pattern)) & ~hidden(F.col("rel")) & ~F.exists(F.split("rel", "/"), lambda s: s.isin(*SKIPPED))
    for p in ignore or []:
        keep = keep & ~F.col("rel").rlike(glob_regex(p))
    rows = raw.filter(keep).filter(F.is_valid_utf8(F.col("content").cast("string")))
    out = rows.select(F.lit(collection).alias("collection"), handelized(F.col("rel")).alias("path"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("modified_at"))
    return scanned(out.filter("path is not null"))
