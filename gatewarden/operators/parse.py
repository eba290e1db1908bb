"""Parsing of access-log lines in Common and Combined format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_clf_timestamp, request_path, valid_ip
from .registry import line_parsers
from .registry import parsers as registered

# One pattern for both formats: Combined is Common with an optional tail.
LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\S+)( "([^"]*)" "([^"]*)")?'
UNKNOWN = "Line does not match a known log format"
FIELDS = ["file_path", "line_number", "ip", "ts", "request_line", "status", "raw_line", "user_agent", "bytes_sent", "referer", "remote_user", "path"]


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Entry columns and `error` (null for a good line) of every line."""
    text = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    got = lines.select("file_path", "line_number", F.col("content").alias("raw_line"), text.alias("t"))
    # one pass of the pattern for all groups, joined by a mark; a line that holds the mark itself is taken group by group
    groups, mark = (1, 3, 4, 5, 6, 7, 8, 9, 10), "\u0001"
    cut = F.regexp_replace("t", "(?s)" + LINE + ".*$", mark + mark.join(f"${k}" for k in groups))
    marked = F.col("t").contains(mark)
    got = got.withColumn("cut", F.when(~marked, cut))
    parts = F.when(~marked, F.slice(F.split("cut", mark), 2, len(groups))).otherwise(F.array(*(F.regexp_extract("t", LINE, k) for k in groups)))
    got = got.withColumn("matched", F.when(~marked, F.col("cut").startswith(mark)).otherwise(F.col("t").rlike(LINE)))
    got = got.withColumn("g", F.when(F.col("matched"), parts))
    names = ("ip", "user", "stamp", "request_line", "code", "size", "tail", "ref", "agent")
    got = got.withColumns({n: F.get("g", F.lit(k)) for k, n in enumerate(names)})
    got = got.withColumns({"ts": parse_clf_timestamp(F.col("stamp")), "status": F.col("code").try_cast("int"), "bytes_sent": F.when(F.col("size") != "-", F.col("size").try_cast("bigint")), "combined": F.col("tail") != ""})
    error = (
        F.when(F.col("t").isNull() | (F.col("t") == ""), "Empty log line")
        .when(~F.col("matched"), UNKNOWN)
        .when(~valid_ip(F.col("ip")), F.concat(F.lit("Invalid IP address: "), "ip"))
        .when(F.col("ts").isNull(), F.concat(F.lit("Invalid timestamp '"), "stamp", F.lit("'")))
        .when(F.col("status").isNull() | ~F.col("status").between(100, 599), F.concat(F.lit("Invalid HTTP status code: "), "code"))
        .when((F.col("size") != "-") & F.col("bytes_sent").isNull(), F.concat(F.lit("Invalid bytes sent format: "), "size"))
    )
    return got.withColumns(
        {
            "error": error,
            "user_agent": F.when(F.col("combined"), F.nullif("agent", F.lit("-"))),
            "referer": F.when(F.col("combined"), F.nullif("ref", F.lit("-"))),
            "remote_user": F.nullif("user", F.lit("-")),
            "path": request_path(F.col("request_line")),
        }
    ).select(*FIELDS, "error")


def _dispatched(parsed: DataFrame) -> DataFrame:
    """Lines of an unknown format by the first registered line parser that has no error for them, in the same pass."""
    own = [f for f in parsed.schema.fields if f.name not in ("file_path", "line_number", "raw_line", "error")]
    taken = []
    for fn in line_parsers().values():
        got = fn(F.col("raw_line"))
        taken.append(F.when(got["error"].isNull(), F.struct(*(got[f.name].cast(f.dataType).alias(f.name) for f in own))))
    if not taken:
        return parsed
    out = parsed.withColumn("by", F.when(F.col("error") == UNKNOWN, F.coalesce(*taken)))
    hit = F.col("by").isNotNull()
    columns = {f.name: F.when(hit, F.col("by")[f.name]).otherwise(F.col(f.name)) for f in own}
    return out.withColumns(columns | {"error": F.when(~hit, F.col("error"))}).select(*FIELDS, "error")


def parse_lines(lines: DataFrame) -> DataFrame:
    """parse_access_log, and for the lines whose format it does not know the registered parsers: the first that has no error
    for a line gives its columns. Line parsers (columns) are all asked in the one pass over the lines; then those that are
    functions of tables, in order of their registration, in one more pass for each."""
    out = _dispatched(parse_access_log(lines))
    for fn in registered().values():
        unknown = F.col("error") == UNKNOWN
        tried = fn(out.where(unknown).select("file_path", "line_number", F.col("raw_line").alias("content"))).where("error IS NULL").select(*FIELDS, "error")
        left = out.join(tried.select("file_path", "line_number").withColumn("hit", F.lit(True)), ["file_path", "line_number"], "left").where("hit IS NULL").select(*FIELDS, "error")
        out = left.unionByName(tried)
    return out


def entries_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").drop("error")


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Bad lines with the reason and their first 100 characters."""
    short = F.when(F.char_length("raw_line") > 100, F.concat(F.substring("raw_line", 1, 100), F.lit("..."))).otherwise(F.col("raw_line"))
    return parsed.where("error IS NOT NULL").select("file_path", "line_number", "error", short.alias("raw_line"))


def parse_stats(parsed: DataFrame, *by: str) -> DataFrame:
    """Total, good and bad lines and the rate of success in per cent, overall or by columns."""
    out = parsed.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return out.withColumn("success_rate", F.when(F.col("total") > 0, F.col("successful") * 100.0 / F.col("total")).otherwise(0.0))
