"""What was known of an address when: answers of reputation sources with the time in which each is valid, kept up to date
by new answers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import seconds
from ..sources.publish import bucket_of, publish, published

#: Seconds of a slice in which one task orders the answers of an address.
SLICE = 300
#: Bytes up to which intervals are sent to all tasks.
SMALL = 32 << 20


def _slice(c: str) -> Column:
    return F.floor(seconds(F.col(c)) / SLICE)


def history(reputation: DataFrame) -> DataFrame:
    """ip, provider, valid_from, valid_to (the next answer's time; null for the last) and the answer's other columns.

    Of answers of one time the one with the greatest score, then country, then JSON text counts, so repeated rows count
    once. Rows without address, provider or time are left out. The next answer is sought within slices, then among the
    first answers of slices, so that an address with most rows is not ordered in one task.
    """
    rest = [c for c in reputation.columns if c not in ("ip", "provider", "query_ts")]
    answer = F.struct(*rest)
    known = reputation.where("ip IS NOT NULL AND provider IS NOT NULL AND query_ts IS NOT NULL")
    one = known.groupBy("ip", "provider", "query_ts").agg(F.max_by(answer, F.struct("confidence_score", "country_code", F.to_json(answer))).alias("r"))
    cut = one.withColumn("slice", _slice("query_ts"))
    inside = cut.withColumn("next", F.lead("query_ts").over(Window.partitionBy("ip", "provider", "slice").orderBy("query_ts")))
    firsts = cut.groupBy("ip", "provider", "slice").agg(F.min("query_ts").alias("first"))
    later = firsts.select("ip", "provider", "slice", F.lead("first").over(Window.partitionBy("ip", "provider").orderBy("slice")).alias("later"))
    return inside.join(later, ["ip", "provider", "slice"]).select("ip", "provider", F.col("query_ts").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"), "r.*")


def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The intervals of the batch's addresses, from their old intervals and the batch."""
    old = current.join(batch.select("ip").distinct(), "ip", "left_semi").withColumnRenamed("valid_from", "query_ts").drop("valid_to")
    return history(old.unionByName(batch))


def update_history(spark: SparkSession, root: str, batch: DataFrame, run: str, buckets: int = 64) -> None:
    """Publish the history with a batch of answers added, in any order of their times. Only buckets with an address of the
    batch are read and written; of the other addresses in these buckets the intervals are copied. A repeated run changes
    nothing."""
    batch = batch.where("ip IS NOT NULL AND provider IS NOT NULL AND query_ts IS NOT NULL")
    current = published(spark, root, newest=True)
    if current is None:
        new = history(batch)
    else:
        touched = batch.select(bucket_of("ip", buckets).alias("bucket")).distinct()
        there = current.withColumn("bucket", bucket_of("ip", buckets)).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")  # at most `buckets` rows
        same = there.join(batch.select("ip").distinct(), "ip", "left_anti")
        new = same.unionByName(merged(there, batch))
    new = new.withColumn("bucket", bucket_of("ip", buckets))
    # an address with most rows is dealt out by its slices
    publish(new.repartition("bucket", F.pmod(F.xxhash64(_slice("valid_from")), F.lit(8))), root, run, "bucket")


def read_history(spark: SparkSession, root: str) -> DataFrame | None:
    return published(spark, root, newest=True)


def valid_at(intervals: DataFrame, at=None) -> DataFrame:
    """The answer of each address and provider that is valid at a time; the last one without a time."""
    if at is None:
        return intervals.where("valid_to IS NULL")
    t = F.lit(at).cast("timestamp_ntz")
    return intervals.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def small(df: DataFrame, limit: int = SMALL) -> bool:
    """Whether the rows of df take at most `limit` bytes, by their texts and 64 bytes a row."""
    texts = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(64))
    return (df.agg(F.sum(texts).alias("n")).first().n or 0) <= limit


def attach_valid(entries: DataFrame, intervals: DataFrame, column: str = "country_code", name: str = "country", limit: int = SMALL) -> DataFrame:
    """entries with the value of the interval in which they lie (intervals of one provider); others, and null values, drop.

    Distinct times of an address meet the intervals that begin in their slice; the interval that is open when a slice
    begins comes from one row for each address and slice. Intervals are sent to all tasks where their measured size
    allows it, else both sides are shuffled by address and slice.
    """
    begins = intervals.select("ip", _slice("valid_from").alias("slice"), "valid_from", "valid_to", F.col(column).alias("v"))
    asked = entries.select("ip", "ts").distinct().withColumn("slice", _slice("ts"))
    last = begins.groupBy("ip", "slice").agg(F.max_by("v", "valid_from").alias("v"), F.lit(0).alias("kind"))
    slices = last.unionByName(asked.select("ip", "slice").distinct().select("ip", "slice", F.lit(None).cast(dict(intervals.dtypes)[column]).alias("v"), F.lit(1).alias("kind")))
    # known: an answer with a null value hides the ones before it
    earlier = Window.partitionBy("ip").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("kind") == 0, F.struct("v")), ignorenulls=True).over(earlier)
    opened = slices.withColumn("open", known).where("kind = 1").select("ip", "slice", F.col("open.v").alias("open"))
    own = begins.drop("slice").withColumnsRenamed({"valid_from": "t0", "valid_to": "t1"}).withColumn("slice", _slice("t0"))
    met = asked.join(F.broadcast(own) if small(own, limit) else own, ["ip", "slice"], "left")
    here = (F.col("t0") <= F.col("ts")) & (F.col("t1").isNull() | (F.col("t1") > F.col("ts")))
    inside = met.groupBy("ip", "slice", "ts").agg(F.max(F.when(here, F.struct("t0", "v"))).alias("x"))
    found = inside.join(opened, ["ip", "slice"]).select("ip", "ts", F.when(F.col("x").isNotNull(), F.col("x.v")).otherwise(F.col("open")).alias(name)).where(F.col(name).isNotNull())
    return entries.join(found, ["ip", "ts"]).select(*entries.columns, name)
