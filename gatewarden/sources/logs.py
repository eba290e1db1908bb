"""Log files as rows, and results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .listing import list_files


def _plain(uri: str) -> Column:
    """The path of a URI, its escapes undone (a plus sign is none)."""
    return F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B")))


def _one_form(c) -> Column:
    """A file's path with one slash after its scheme, as the readers differ in their number."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def read_log_lines(spark: SparkSession, paths) -> DataFrame:
    """file_path, line_number (from 1, per file), content (its bytes as they are) and read time of every line, nested files
    too.

    A split is read in one go, so a line's number in it is its running id less the split's first one. One row for each
    split, with the lines of earlier splits of the file added up, meets the lines; texts are neither sorted nor grouped.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("content"))
    splits = raw.groupBy("uri", "block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = splits.select("uri", "block", _plain("uri").alias("file_path"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("start"))
    return raw.join(start, ["uri", "block"]).select("file_path", (F.col("seq") + F.col("start")).alias("line_number"), "content", F.current_timestamp().alias("timestamp_read"))


def decode_lines(lines: DataFrame) -> DataFrame:
    """UTF-8 where a line is valid, Latin-1 otherwise; with the encoding taken."""
    good = F.is_valid_utf8("content")
    return lines.withColumns({"encoding": F.when(good, "utf-8").otherwise("latin-1"), "content": F.when(good, F.col("content")).otherwise(F.decode(F.col("content").cast("binary"), "ISO-8859-1"))})


def decode_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The encoding decided for each file by its head (files: list_files with encodings), taken for all its lines. A line
    that is no UTF-8 in a file whose head is gets decode_error, and Latin-1 as its content, so that no line is lost.
    Lines of files without a known encoding are decided line by line."""
    known = files.select(_one_form("file_path").alias("key"), F.col("encoding").alias("of_file"))
    got = lines.withColumn("key", _one_form("file_path")).join(known, "key", "left")
    good, single = F.is_valid_utf8("content"), F.decode(F.col("content").cast("binary"), "ISO-8859-1")
    encoding = F.coalesce("of_file", F.when(good, "utf-8").otherwise("latin-1"))
    utf8 = encoding == "utf-8"
    return got.select(*(c for c in lines.columns if c != "content"), F.when(utf8 & good, F.col("content")).otherwise(single).alias("content"), encoding.alias("encoding"), (utf8 & ~good).alias("decode_error"))


def file_inventory(spark: SparkSession, paths, max_bytes: int | None = None) -> DataFrame:
    """Size and line count of every file, nested ones too, and the encoding of its head; empty and too large files are
    flagged."""
    files = list_files(spark, paths, encoding=True).withColumn("file_path", _one_form("file_path"))
    lines = read_log_lines(spark, paths).groupBy(_one_form("file_path").alias("file_path")).agg(F.count("*").alias("line_count"))
    return files.join(lines, "file_path", "left").select("file_path", "file_size", F.coalesce("line_count", F.lit(0)).alias("line_count"), "encoding", (F.col("file_size") == 0).alias("is_empty"), (F.col("file_size") > max_bytes if max_bytes else F.lit(False)).alias("too_large"))


def ingestion_summary(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Lines processed, errors and success per file; lines from decode_files count as errors where they are no text of
    their file's encoding."""
    bad = F.count_if("decode_error") if "decode_error" in lines.columns else F.lit(0).cast("long")
    done = lines.groupBy(_one_form("file_path").alias("file_path")).agg(F.count("*").alias("lines_processed"), bad.alias("bad"))
    errors = F.array_compact(F.array(F.when(F.col("is_empty"), "file is empty"), F.when(F.col("too_large"), "file is too large"), F.when(F.col("bad") > 0, F.concat(F.lit("encoding error in "), F.col("bad").cast("string"), F.lit(" lines")))))
    out = inventory.join(done, "file_path", "left").select("file_path", "file_size", F.coalesce("lines_processed", F.lit(0)).alias("lines_processed"), errors.alias("errors"))
    return out.withColumn("success", F.size("errors") == 0)


def write_findings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings as parquet or json, or a one-column report as text."""
    df.write.mode("overwrite").format(fmt).save(path)
