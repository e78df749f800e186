"""Where documents come from: files, or a table of texts."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import extension
from ..operators.extract import with_kind
from .listing import contents, listed


def scan_files(spark: SparkSession, *paths: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, size, ext, content, digest, mime) of files, read as they are.

    A digest is computed once here and carried along; it identifies content everywhere else.
    Files in folders that all machines share are listed and read by executors. Elsewhere Spark's
    reader lists them; it passes over empty files, which come back here from its listing. Empty
    files have size 0, unreadable ones and paths that lead nowhere have none, so that whatever
    was given has its outcome and ends nobody else's.
    """
    found, rows = {p: _matches(spark, p) for p in paths}, None
    there = sorted({x for given in found.values() for x in given})
    if there and all(x.startswith("file:") for x in there):
        rows = contents(listed(spark, there, pattern, recursive))
    elif there:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        files = reader.load(there)
        rows = files.select("path", F.col("length").alias("size"), "content")
        bare = F.regexp_replace(F.col("path"), r"\A(\w+):/+(?=/)", "$1:")
        left = _listed_by_driver(files).join(rows.select(bare.alias("path")), "path", "left_anti")
        rows = rows.unionByName(left.select("path", "size", F.lit("").cast("binary").alias("content")))
    missing = [p for p, given in found.items() if not given]
    if missing or rows is None:
        absent = spark.createDataFrame([(p, None, None) for p in missing], "path string, size long, content binary")
        rows = absent if rows is None else rows.unionByName(absent)
    return identified(rows)


def _matches(spark: SparkSession, path: str) -> list[str]:
    """What a path or a pattern of paths leads to, with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [x.getPath().toString() for x in found or []]


def _listed_by_driver(files: DataFrame) -> DataFrame:
    """(path, size) in stores that only Spark's readers open, from the listing that they have made; of
    what they leave out there, empty files are all that is known."""
    paths = [re.sub(r"\A(\w+):/+(?=/)", r"\1:", unquote(f)) for f in files.inputFiles()]
    return files.sparkSession.createDataFrame(pa.table({"path": pa.array(paths, pa.string()), "size": pa.array([0] * len(paths), pa.int64())}))


def scan_texts(table: DataFrame, path: Column, text: Column) -> DataFrame:
    """The same rows from a table of texts; further columns of the table pass through. Texts
    hold no containers, so nothing here needs Python."""
    content = F.coalesce(text, F.lit("")).cast("binary")
    return identified(table.withColumns({"path": path, "content": content, "size": F.octet_length(content).cast("long")}), containers=False)


def identified(rows: DataFrame, containers: bool = True) -> DataFrame:
    """Add ext, digest and mime to rows with path, size and content."""
    return with_kind(rows.withColumn("ext", extension(F.col("path"))).withColumn("digest", F.sha2("content", 256)), containers=containers)
