"""Traffic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums by which frequent values are found: one row each from every task.
BUCKETS = 1 << 16


def requests_by_country(geo: DataFrame) -> DataFrame:
    return geo.groupBy("country").agg(F.count("*").alias("requests"), F.count_distinct("ip").alias("ips"))


def _top(entries: DataFrame, column: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The k most frequent values, exactly, without moving every distinct value.

    Values are hashed to buckets, whose sums are bounds on the counts of their values. The k-th count among the values of
    the 4 k largest buckets is at most the k-th count of all, so values of buckets with smaller sums cannot be among the
    first k; those of the other buckets are counted. Every pass reads this column only.
    """
    values = entries.where(F.col(column) != "").select(column, F.pmod(F.xxhash64(column), F.lit(buckets)).alias("bucket"))
    sums = values.groupBy("bucket").agg(F.count("*").alias("n"))

    def counted(some: DataFrame) -> DataFrame:
        # at most `buckets` numbers are sent to all tasks
        of_these = values.join(F.broadcast(some.select("bucket")), "bucket", "left_semi")
        return of_these.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)

    least = counted(sums.orderBy(F.desc("n"), "bucket").limit(4 * k)).agg(F.min("n").alias("least"))
    return counted(sums.crossJoin(F.broadcast(least)).where("n >= least"))


def top_user_agents(entries: DataFrame, k: int = 10) -> DataFrame:
    return _top(entries, "user_agent", k)


def top_referers(entries: DataFrame, k: int = 10) -> DataFrame:
    return _top(entries, "referer", k)


def error_analysis(entries: DataFrame) -> DataFrame:
    """Errors per status class and status, with subtotals (null), and their share of all requests."""
    n = entries.agg(F.count("*").alias("all"))
    g = entries.where("status >= 400").rollup(F.floor(F.col("status") / 100).cast("int").alias("class"), "status").agg(F.count("*").alias("errors"))
    return g.crossJoin(F.broadcast(n)).select("class", "status", "errors", (F.col("errors") / F.col("all")).alias("share"))


def errors_by_path(entries: DataFrame) -> DataFrame:
    return entries.groupBy("path").agg(F.count("*").alias("requests"), F.count_if(F.col("status").between(400, 499)).alias("client_errors"), F.count_if(F.col("status") >= 500).alias("server_errors"))


def requests_over_time(entries: DataFrame, unit: str = "minute") -> DataFrame:
    return entries.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
