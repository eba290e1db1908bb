"""What the detectors need of entries, added up once for all of them.

One pass over the narrow columns of entries groups them three ways at once (grouping sets, added up on the map side):
by address and time, by address, path and time, and by address and agent. All counting, window and geographic detectors
read these sums; none of them goes back to the entries, but for single rows that a finding shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seconds
from ..params import DetectorParams

#: The ways of grouping, by the id that Spark gives them: a bit for each of ip, ts, file_path, path, agent left out.
GROUPS = {"times": (3, ["ip", "ts", "file_path"]), "paths": (5, ["ip", "ts", "path"]), "agents": (14, ["ip", "agent"])}
Store = Callable[[str, DataFrame], DataFrame]


def same(name: str, df: DataFrame) -> DataFrame:
    """No store: Spark works parts that are used again out again."""
    return df


def grouped(entries: DataFrame, p: DetectorParams) -> DataFrame:
    """The sums of all three groupings, told apart by `grouping`."""
    size = F.octet_length("request_line")
    rows = entries.select(
        "ip", "ts", "file_path", "path", F.nullif("user_agent", F.lit("")).alias("agent"), "line_number", "status", size.alias("size"),
        F.col("status").isin(401, 403).alias("is_failed"), (size < p.tiny_bytes).alias("is_tiny"), (size > p.huge_bytes).alias("is_huge"),
    )
    line = F.col("line_number")
    return rows.groupingSets([keys for _, keys in GROUPS.values()], "ip", "ts", "file_path", "path", "agent").agg(
        F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("n"), F.count_if("is_failed").alias("failed"), F.count_if(F.col("status") == 404).alias("not_found"), F.count_if(F.col("status") == 403).alias("forbidden"),
        F.count_if("is_tiny").alias("tiny"), F.count_if("is_huge").alias("huge"), F.sum("size").alias("size"), F.max("size").alias("max_size"),
        F.min(line).alias("first_line"), F.max(line).alias("line"), F.max(F.when(F.col("is_failed"), line)).alias("failed_line"), F.max(F.when(F.col("agent").isNotNull(), line)).alias("agent_line"),
    )


def part(sums: DataFrame, name: str) -> DataFrame:
    """One of the groupings."""
    number, keys = GROUPS[name]
    rest = [c for c in sums.columns if c not in ("ip", "ts", "file_path", "path", "agent", "grouping")]
    return sums.where(F.col("grouping") == number).select(*keys, *rest)


def place(line: str) -> Column:
    return F.struct("file_path", F.col(line).alias("line_number"))


def addresses(times: DataFrame) -> DataFrame:
    """One row for each address: totals, and the places of its last entries in input order (all, failed) and in time."""
    last = lambda line: F.max(F.when(F.col(line).isNotNull(), place(line)))
    return times.groupBy("ip").agg(
        F.sum("n").alias("total"), *(F.sum(c).alias(c) for c in ("failed", "not_found", "forbidden", "tiny", "huge", "size")), F.max("max_size").alias("max_size"),
        last("line").alias("last_in"), last("failed_line").alias("last_failed"), F.max_by(place("line"), F.struct("ts", place("line"))).alias("last_at"),
    )


def in_whole_seconds(times: DataFrame) -> DataFrame:
    """ip, sec, n, f: rows and failed ones of each second."""
    return times.groupBy("ip", seconds(F.col("ts")).alias("sec")).agg(F.sum("n").alias("n"), F.sum("failed").alias("f"))
