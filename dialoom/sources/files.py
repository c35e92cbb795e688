"""Small files and folders through the Hadoop file system, so that any root works: local, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null where there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside and renames it over the old one; readers see the old text or the new one."""
    fs, at = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    # The rename of FileContext replaces its target in one step, where the file system can.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(at), options)


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def overlay(state: DataFrame, mirror: DataFrame) -> DataFrame:
    """(path, content): artifacts of the state (path, content BINARY) before those of a mirror folder."""
    s, m = state.select("path", F.col("content").alias("a")), mirror.select("path", F.col("content").alias("b"))
    return s.join(m, "path", "full_outer").select("path", F.coalesce("a", "b").alias("content"))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, hash) of the files below a folder, paths relative to it; hash is SHA-256 of the bytes."""
    fs, at = _fs(spark, root)
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    short = F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(base.replace("file:///", "file:/")), F.lit(""))
    return found.select(short.alias("path"), "content", F.sha2("content", 256).alias("hash"))


def require(found: DataFrame, paths: list[str]) -> None:
    """An error that names the paths that are missing from found (path, ...)."""
    there = {r.path for r in found.where(F.col("path").isin(*paths)).select("path").collect()}  # at most one row a wanted path
    missing = [p for p in paths if p not in there]
    if missing:
        raise ValueError("missing artifacts; build the bundle first: " + ", ".join(missing))


def section(lines: DataFrame, heading: str, *, order: str = "line_no", text: str = "value") -> DataFrame:
    """The lines of a Markdown file that stand below a heading, up to the next heading, in order. lines: one file, (line_no, value)."""
    from pyspark.sql import Window

    w = Window.orderBy(order)  # one document of a person's size
    title = F.trim(F.regexp_replace(F.trim(text), "^#+", ""))
    is_head = F.startswith(F.trim(text), F.lit("#"))
    marked = lines.withColumn("__head", F.last(F.when(is_head, title), ignorenulls=True).over(w)).withColumn("__is", is_head)
    return marked.where((F.lower("__head") == heading.lower()) & ~F.col("__is")).drop("__head", "__is")
